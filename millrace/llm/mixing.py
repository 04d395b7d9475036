"""Mixing sources to target weights with soft membership.

The labelled table names domains (here the four pairs of quality and toxicity). A softmax regression over a few text measures, fitted on at most
`sample` labelled rows, gives every document a posterior over domains, so a document counts with fractions of its tokens in several. Rates r >= 0
are sought for which the expected token totals sum(r * tokens * posterior) meet the targets: least squares by projected gradient
steps r <- max(0, r - sum(posterior * u)), where u is the domains' residuals scaled by their token totals. A step needs one aggregation over
a narrow staged table, and rates never leave it. Rates become whole copies: floor(rate + a hash of the document in [0, 1)).

Some measures count words with beginnings that labelled toxic documents have significantly more often than others; all such beginnings count.

Only DataFrame functions are used; sums are pre-aggregated in every task, so a hot domain or source is no matter. The driver fits the weights from the
sample's measures, a few numbers a row.

Cases: null text counts as empty with 0 tokens, the posterior of an empty text and the rate that gives; contradicting labels of one id: the lowest
quality and the highest toxicity; no labelled rows or no tokens: every rate is 1; domains without labelled rows get no target, the other targets are scaled up;
targets out of reach end at the nearest totals; repeated rows are judged alike; an empty table gives an empty table; other columns pass or are ignored,
whatever their names; ids may be of any type.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import staged

#: Token shares wanted, by domain.
TARGETS = {"q1t0": 0.93, "q0t0": 0.05, "q1t1": 0.015, "q0t1": 0.005}
#: Labelled rows that the classifier is fitted on at most, those first in a hash of their id; most steps, residual (of all tokens) that ends them.
SAMPLE, STEPS, CLOSE = 20_000, 60, 1e-4
#: Letters of a word's beginning; log-odds and standard deviations from which a beginning marks a kind; ridge of the classifier.
START, LEAST_ODDS, LEAST_Z, RIDGE = 5, 2.0, 4.0, 1.0
MEASURES = ("x_words", "x_tokens", "x_length", "x_symbols", "x_symbols2", "x_upper", "x_marked", "x_marked_share", "x_any")


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(known, domain), one row for each labelled id."""
    whole = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return whole.groupBy(F.col(id_col).alias("known")).agg(F.concat(F.lit("q"), F.min("quality").cast("string"), F.lit("t"), F.max("toxic").cast("string")).alias("domain"))


def beginnings(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"(\\p{{L}}{{1,{START}}})\\p{{L}}*"), F.lit(1))


def markers(docs: DataFrame, known: DataFrame) -> list[str]:
    """Beginnings of words that toxic rows of the bounded labelled sample `known` have significantly more often than others: all of them."""
    words = docs.join(F.broadcast(known), F.col("id") == F.col("known")).select(F.col("domain").endswith("t1").alias("toxic"), F.explode(F.array_distinct(beginnings(F.coalesce("text", F.lit(""))))).alias("word"))
    counts = staged(words.groupBy("word").agg(F.sum(F.col("toxic").cast("int")).alias("a"), F.sum((~F.col("toxic")).cast("int")).alias("b")), "beginnings")
    a, b = counts.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    if not a or not b:
        return []
    odds = F.log((F.col("a") + 0.5) / (F.col("b") + 0.5)) - F.log(F.lit((a + 0.5) / (b + 0.5)))
    worth = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    return sorted(r["word"] for r in counts.filter((odds >= LEAST_ODDS) & (worth >= LEAST_Z)).select("word").collect())


def measures(docs: DataFrame, words: list[str], *keep: str) -> DataFrame:
    """docs (id, text) with its token count and measures; nothing is null but the id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("id", F.xxhash64("text").alias("t"), text.alias("text"), *keep)
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    marked = F.size(F.filter(beginnings(F.col("text")), lambda w: w.isin(words))).cast("double") if words else F.lit(0.0)
    rows = rows.select("id", "t", *keep, F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint").alias("tokens"), F.length("text").cast("double").alias("chars"), count("text", "[#*$%&|<>]").alias("symbols"), count("text", "\\p{Lu}").alias("upper"), marked.alias("marked"))
    # Shares are drawn towards usual ones as if every text had fifty more words, so that a short text's few signs say little.
    chars, tokens = F.col("chars") + 300, F.col("tokens") + 50
    symbols = F.log((F.col("symbols") + 0.3) / chars)
    return rows.select("id", "t", *keep, "tokens", F.log1p("tokens").alias("x_words"), (F.col("tokens") / 1000).alias("x_tokens"), F.least(chars / tokens, F.lit(50.0)).alias("x_length"), symbols.alias("x_symbols"), (symbols * symbols / 10).alias("x_symbols2"), F.log((F.col("upper") + 6) / chars).alias("x_upper"), F.log1p("marked").alias("x_marked"), F.log((F.col("marked") + 0.3) / tokens).alias("x_marked_share"), F.least("marked", F.lit(1.0)).alias("x_any"))


def classifier(rows: DataFrame, known: DataFrame) -> dict[str, list[float]]:
    """By domain, the weights of a constant and of each measure: softmax regression on the bounded labelled sample.

    Its posteriors add up to the sample's own counts, and as one measure is the number of tokens, to its tokens by domain."""
    seen = rows.join(F.broadcast(known), F.col("id") == F.col("known")).select("domain", *MEASURES).collect()
    names = sorted({r["domain"] for r in seen})
    if not names:
        return {}
    x = np.array([[1.0, *(r[m] for m in MEASURES)] for r in seen])
    mean, dev = x.mean(0), np.maximum(x.std(0), 1e-6)
    mean[0], dev[0] = 0.0, 1.0
    w = softmax_regression((x - mean) / dev, np.array([names.index(r["domain"]) for r in seen]), len(names)) / dev
    w[:, 0] -= w[:, 1:] @ mean[1:]
    return {d: w[k].tolist() for k, d in enumerate(names)}


def softmax_regression(x: np.ndarray, y: np.ndarray, kinds: int, ridge: float = RIDGE, rounds: int = 40) -> np.ndarray:
    """Weights (kinds, columns) by Newton's method; the constant, x's first column, is not shrunk."""
    n, m = x.shape
    want = np.eye(kinds)[y]
    w, shrink = np.zeros((kinds, m)), np.full(m, ridge)
    shrink[0] = 1e-9

    def posteriors(w):
        s = x @ w.T
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    loss = lambda w: -np.log(np.maximum(posteriors(w)[np.arange(n), y], 1e-300)).sum() + 0.5 * (shrink * w * w).sum()
    for _ in range(rounds):
        p = posteriors(w)
        slope = (want - p).T @ x - shrink * w
        curve = np.zeros((kinds, m, kinds, m))
        for a in range(kinds):
            for b in range(kinds):
                curve[a, :, b, :] = (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
        curve = curve.reshape(kinds * m, kinds * m) + np.diag(np.tile(shrink, kinds)) + 1e-9 * np.eye(kinds * m)
        step, before, size = np.linalg.solve(curve, slope.ravel()).reshape(kinds, m), loss(w), 1.0
        while loss(w + size * step) > before and size > 1e-4:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def with_posteriors(rows: DataFrame, model: dict[str, list[float]], *keep: str) -> DataFrame:
    """rows with p_<domain>, which add up to 1."""
    score = lambda w: _sum([F.lit(w[0]), *(F.col(m) * F.lit(v) for m, v in zip(MEASURES, w[1:]))])
    rows = rows.select("id", "t", *keep, "tokens", *(score(w).alias(f"s_{k}") for k, w in model.items()))
    top = F.greatest(*(F.col(f"s_{k}") for k in model), F.lit(-1e300))
    rows = rows.select("id", "t", *keep, "tokens", *(F.exp(F.col(f"s_{k}") - top).alias(f"e_{k}") for k in model))
    total = _sum([F.col(f"e_{k}") for k in model])
    return rows.select("id", "t", *keep, "tokens", *((F.col(f"e_{k}") / total).alias(f"p_{k}") for k in model))


def rate_after(history: list[dict[str, float]], names: list[str]) -> Column:
    """A document's rate after the steps so far, from its posteriors alone: no state is kept for documents."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*(F.struct(*(F.lit(float(u[k])).alias(k) for k in names)) for u in history))
    return F.aggregate(steps, F.lit(1.0), lambda r, u: F.greatest(F.lit(0.0), r - _sum([F.col(f"p_{k}") * u[k] for k in names])))


def solved(rows: DataFrame, targets: dict[str, float], names: list[str], steps: int = STEPS, close: float = CLOSE) -> list[dict[str, float]]:
    """The projected gradient steps that bring the totals of rows (staged, with tokens and p_<domain>) to the targets."""
    history: list[dict[str, float]] = []
    first = rows.agg(F.sum("tokens").alias("all"), *(F.sum(F.col("tokens") * F.col(f"p_{k}")).alias(k) for k in names)).first()
    scale = sum(targets.get(k, 0.0) for k in names)
    if not first["all"] or not scale:
        return history
    goal = {k: first["all"] * targets.get(k, 0.0) / scale for k in names}
    now, before, slow = first, None, 1.0
    while len(history) < steps:
        rest = {k: now[k] - goal[k] for k in names}
        worst = max(abs(v) for v in rest.values())
        if worst <= close * first["all"]:
            break
        slow = slow / 2 if before is not None and worst > 1.5 * before else slow
        before = worst
        history.append({k: slow * rest[k] / max(first[k], 1e-9 * first["all"]) for k in names})
        weight = rate_after(history, names) * F.col("tokens")
        now = rows.agg(*(F.sum(weight * F.col(f"p_{k}")).alias(k) for k in names)).first()
    return history


def _copies() -> Column:
    return F.floor(F.col("rate") + F.pmod(F.xxhash64("id", "t"), F.lit(1 << 30)) / float(1 << 30)).cast("int")


def _fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None, id_col: str, sample: int) -> tuple[DataFrame, dict[str, list[float]], list[dict[str, float]], list[str]]:
    known = staged(domains(labels, id_col).orderBy(F.xxhash64("known"), "known").limit(sample), "domains")  # bounded by `sample`
    words = markers(docs, known)
    rows = staged(measures(docs, words), "measures")
    model = classifier(rows, known)
    if model:
        rows = staged(with_posteriors(rows, model), "posteriors")
    return rows, model, solved(rows, TARGETS if targets is None else targets, list(model)) if model else [], words


def mixed(df: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row for each row of df: id_col, n_tokens, p_<domain>, rate, copies."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows, model, history, _ = _fitted(docs, labels, targets, id_col, sample)
    rows = rows.withColumn("rate", rate_after(history, list(model))).withColumn("copies", _copies())
    return rows.select(F.col("id").alias(id_col), F.col("tokens").alias("n_tokens"), *(f"p_{k}" for k in model), "rate", "copies")


def resampled(df: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """df with each row as many times as its copies; rates are worked out from the text again, so no join moves it."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    _, model, history, words = _fitted(docs, labels, targets, id_col, sample)
    quoted = [f"`{c.replace('`', '``')}`" for c in df.columns]
    whole = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*quoted).alias("row"))
    rows = measures(whole, words, "row")
    rows = (with_posteriors(rows, model, "row") if model else rows).withColumn("rate", rate_after(history, list(model)))
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), _copies())).alias("one")).select("row.*")
