"""Quality rules learned as a decision list.

text_features() counts a text's words, symbols, repeated lines and repeated 8-word windows with built-in functions only.
learn_rules() is sequential covering: a rule for low quality grows one threshold condition at a time, the one with the best information gain
on the growing rows, and is pruned back to the prefix that does best on the pruning rows; rows that it covers are set aside, and the
next rule is learned from the rest, until a rule is not sure enough. Growing needs counts by feature and bin only, so every step is one
small aggregation. verdict() turns the list into one ordered conditional expression.

Cases: null and empty texts have no words and fail the base rules; rows without a label only get a verdict; contradicting labels of one
id: the lowest counts; no labelled rows: no rules, everything that passes the base rules is kept; features of texts without words are 0,
never null; repeated rows each give a row; very long texts are counted whole; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import staged

WS = "[\\x20\\x09-\\x0D]+"
#: Words in a window; thresholds tried for each feature; most rules and conditions; least precision and covered rows of a rule.
WINDOW, BINS, MOST_RULES, MOST_CONDITIONS, LEAST_PRECISION, LEAST_COVER = 8, 24, 10, 3, 0.9, 5
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")


def words_of(text: Column) -> Column:
    """The words of a text: runs of anything but ASCII white space."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WS)).otherwise(F.array().cast("array<string>"))


def text_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks (all bigint)."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.select("id", "t", words_of(F.col("t")).alias("words"), F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    # Hashes of the words, then of each window of them; a text whose windows all differ needs no more.
    rows = rows.select("id", "t", "words", "lines", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    window = lambda i: F.xxhash64(*(F.get(F.col("h"), i + k) for k in range(WINDOW)))
    rows = rows.withColumn("win", F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), window)))
    rows = rows.withColumn("again", F.coalesce(F.size(F.array_distinct("win")) < F.size("win"), F.lit(False)))
    rows = rows.withColumn("at", F.when(F.col("again"), F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, k: F.coalesce(F.get(F.col("at"), k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col("at"), k + 1)["h"] == x["h"], F.lit(False))
    rows = rows.withColumn("first", F.when(F.col("again"), F.array_sort(F.transform(F.filter("at", twin), lambda x: x["i"]))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, x: F.struct((x + WINDOW).alias("end"), (a["n"] + x + WINDOW - F.greatest(x, a["end"])).cast("bigint").alias("n"))
    return rows.select(
        F.col("id").alias(id_col),
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("again"), F.aggregate("first", start, step)["n"]).otherwise(0).cast("bigint").alias("n_repeat_words"),
        F.regexp_count("t", F.lit("\\p{Lu}")).cast("bigint").alias("n_upper"),
        F.regexp_count("t", F.lit("[!?;:]")).cast("bigint").alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def shares() -> dict[str, Column]:
    """What rules may test, by name; never null."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {"n_words": F.col("n_words").cast("double"), "word_length": F.col("word_chars") / words, "symbol_share": F.col("n_symbols") / chars, "dup_line_share": F.col("n_dup_lines") / words, "repeat_share": F.col("n_repeat_words") / words, "upper_share": F.col("n_upper") / chars, "mark_share": F.col("n_marks") / chars}


@dataclass(frozen=True)
class Condition:
    """feature >= threshold, or feature < threshold; `cut` counts the thresholds up to it."""

    feature: str
    cut: int
    threshold: float
    above: bool

    def binned(self) -> Column:
        return F.col(f"b_{self.feature}") >= self.cut if self.above else F.col(f"b_{self.feature}") < self.cut

    def column(self) -> Column:
        value = shares()[self.feature]
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _sums(rows: DataFrame, columns: dict[str, Column]) -> dict[str, int]:
    got = rows.agg(*(F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(k) for k, c in columns.items())).first()
    return got.asDict()


def _best(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition | None, int, int]:
    """The condition of best information gain over rows, and rows' low and good counts: one aggregation by feature and bin."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in cuts)))
    table = rows.select("low", pairs.alias("x")).groupBy("x.f", "x.b").agg(F.sum(F.col("low").cast("int")).alias("p"), F.count(F.lit(1)).alias("n")).collect()
    by: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in cuts}
    for r in table:
        by[r["f"]][r["b"]] = (r["p"], r["n"] - r["p"])
    any_feature = next(iter(by.values()))
    p0, n0 = (sum(v[k] for v in any_feature.values()) for k in (0, 1))
    best, gain = None, 1e-9
    for f, values in cuts.items():
        for j, t in enumerate(values, 1):
            for above in (True, False):
                inside = [v for b, v in by[f].items() if (b >= j) == above]
                p, n = sum(v[0] for v in inside), sum(v[1] for v in inside)
                if p and (g := p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))) > gain:
                    best, gain = Condition(f, j, t, above), g
    return best, p0, n0


def learn_rules(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[list[Condition]]:
    """Ordered rules, each a conjunction, for label 0. Rows whose hashed id is 0 modulo 3 prune, the others grow."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("known")).agg((F.min(label_col) == 0).alias("low"))
    rows = features.join(known, F.col(id_col) == F.col("known")).filter(~base_failed())
    rows = rows.select("low", (F.pmod(F.xxhash64("known"), F.lit(3)) == 0).alias("prune"), *(c.alias(f) for f, c in shares().items()))
    rows = staged(rows, "labelled")
    spots = [(k + 1) / (BINS + 1) for k in range(BINS)] + [0.99, 0.995, 0.999]
    found = rows.agg(*(F.percentile_approx(f, spots, 10_000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(found[f] or [])) for f in FEATURES}
    cuts = {f: v for f, v in cuts.items() if v}
    if not cuts:
        return []
    rows = staged(rows.select("low", "prune", *(reduce(lambda a, b: a + b, ((F.col(f) >= t).cast("int") for t in v)).alias(f"b_{f}") for f, v in cuts.items())), "binned")
    rules: list[list[Condition]] = []
    while len(rules) < MOST_RULES:
        left = rows.filter(_all([~_all([c.binned() for c in r]) for r in rules]))
        grow, rule = left.filter(~F.col("prune")), []
        while len(rule) < MOST_CONDITIONS:
            condition, p, n = _best(grow.filter(_all([c.binned() for c in rule])), cuts)
            if condition is None or not n:
                break
            rule.append(condition)
        if not rule:
            break
        counts = _sums(left, {f"{k}{s}{w}": _all([c.binned() for c in rule[:k]]) & (F.col("prune") if s == "v" else F.lit(True)) & (F.col("low") if w == "p" else ~F.col("low")) for k in range(1, len(rule) + 1) for s in "va" for w in "pn"})
        worth = lambda k: (counts[f"{k}vp"] - counts[f"{k}vn"]) / max(1, counts[f"{k}vp"] + counts[f"{k}vn"])
        k = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        p, n = counts[f"{k}ap"], counts[f"{k}an"]
        if p < LEAST_COVER or p < LEAST_PRECISION * (p + n) or worth(k) < 2 * LEAST_PRECISION - 1:
            break
        rules.append(rule[:k])
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """false for the first rule that holds, else true."""
    out = None
    for rule in rules:
        test = _all([c.column() for c in rule])
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judged(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the counts, base_failed, kept and the rule that decided (null for none), one row for each row of df."""
    features = staged(text_features(df, id_col, text_col), "features")
    rules = learn_rules(features, labels, id_col)
    failed = base_failed()
    named = F.coalesce(F.when(failed, F.lit("base")), *(F.when(_all([c.column() for c in r]), F.lit(" and ".join(map(str, r)))) for r in rules), F.lit(None).cast("string"))
    return features.select("*", failed.alias("base_failed"), F.when(failed, False).otherwise(verdict(rules)).alias("kept"), named.alias("rule"))
