"""Labelling prompts and answers, token windows, small text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def describe_json(schema: dict, indent: int = 0) -> str:
    """A schema as lines of prompt text: name (type): description, nested fields indented."""
    lines = []
    for name, spec in schema.get("properties", schema).items():
        spec = spec if isinstance(spec, dict) else {"type": str(spec)}
        lines.append("  " * indent + f"{name} ({spec.get('type', 'any')}): {spec.get('description', '')}".rstrip(": "))
        if "properties" in spec:
            lines.append(describe_json(spec, indent + 1))
    return "\n".join(lines)


def prompt_for(spec: str, prompts: dict[str, str], lineage: list[str], default: str) -> str:
    """The spec's own prompt, else the first of its lineage, else the default."""
    return next((prompts[s] for s in [spec, *lineage] if s in prompts), default)


def answer(text: Column) -> Column:
    """What stands between <answer> tags, trimmed; null if there are none."""
    found = F.regexp_extract(text, "(?s)<answer>(.*?)</answer>", 1)
    return F.when(F.regexp_like(text, F.lit("(?s)<answer>.*?</answer>")), F.btrim(found, F.lit(" \t\r\n")))


def answer_json(text: Column, schema: str) -> Column:
    return F.from_json(answer(text), schema)


def token_windows(tokens: Column, size: int, stride: int = 32, pad: str | int = "<pad>") -> Column:
    """Windows of `size` tokens every `stride`, padded; those with fewer than two tokens are left out."""
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda i: F.slice(tokens, i + 1, size))
    return F.transform(F.filter(cut, lambda w: F.size(w) >= 2), lambda w: F.concat(w, F.array_repeat(F.lit(pad), size - F.size(w))))


def inputs_and_labels(window: Column) -> Column:
    """A window shifted against itself by one token."""
    n = F.size(window)
    return F.struct(F.slice(window, F.lit(1), n - 1).alias("inputs"), F.slice(window, F.lit(2), n - 1).alias("labels"))


def roman(numeral: Column) -> Column:
    """The number that a numeral writes; a smaller sign before a larger one counts against it."""
    value = F.create_map(*(F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv))
    digits = F.transform(F.filter(F.split(numeral, ""), lambda c: c != ""), lambda c: F.element_at(value, c))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    # From right to left, so that a sign is known to be small when it is met.
    step = lambda a, d: F.struct((a["sum"] + F.when(d < a["last"], -d).otherwise(d)).alias("sum"), d.alias("last"))
    return F.aggregate(F.reverse(digits), start, step)["sum"]


def full_match(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})$")
