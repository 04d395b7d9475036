"""Models as columns, and links as a table function. Scorers are given by the caller, so nothing here needs a network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.ship import ship


def scored(df: DataFrame, column: str, load: Callable[[], Callable[[pd.Series], pd.Series]], kind: str = "double", name: str = "score") -> DataFrame:
    """df with a model's output. `load` runs once in each worker and returns a function over a batch of values."""

    @F.pandas_udf(kind)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for values in batches:
            yield model(values)

    ship(df.sparkSession)
    return df.withColumn(name, score(column))


@F.udtf(returnType="position int, href string")
class AnchorLinks:
    """Every anchor's href by an HTML parser: exact where a pattern is not, and slower."""

    def eval(self, html: str):
        from html.parser import HTMLParser

        found: list[str] = []

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                href = dict(attrs).get("href") if tag == "a" else None
                if href is not None:
                    found.append(href)

        Reader().feed(html or "")
        yield from enumerate(found)


def zorder(*columns: Column, bits: int = 16) -> Column:
    """The interleaved low bits of whole-number columns: rows close in all of them are close in this one."""
    out = F.lit(0).cast("bigint")
    for b in range(bits * len(columns) if bits * len(columns) < 63 else 62):
        c, k = columns[b % len(columns)], b // len(columns)
        out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("bigint"), k).bitwiseAND(F.lit(1).cast("bigint")), b))
    return out
