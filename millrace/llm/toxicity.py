"""Toxic passages by maximum-scoring segment search.

Every word has a score: its log-odds of toxic against other labelled documents, under Dirichlet priors in two levels. The beginnings of
words are counted first and shrunk towards no difference; a word's own log-odds are then shrunk towards those of its beginning by their
variance, so that a word seen once says little and an unseen word speaks by its beginning. `DRIFT` is taken off each score, so that
usual text loses. One linear scan (Ruzzo and Tompa) finds every maximal scoring segment of a text. By the extreme-value law for such segments, one
of score S in n words has the expectation n * exp(-lambda * S), where lambda solves sum p * exp(lambda * s) = 1 over other documents'
words; a text's evidence is the sum over its segments of how far that lies below 1. A logistic curve over evidence makes it a probability.

The labelled rows are halved: lambda and the curve come from rows scored by the words of the other half. Labels are learned from at most
`max_rows` labelled rows (those first in the order of a hash of their id), which bounds what is sent to the workers; all their words are kept.

Cases: null text counts as empty; an empty text has no evidence and gets the score of clean texts; contradicting labels of one id
count as toxic; no labelled rows, or none of a kind: every score is 0; a half without a kind: both halves are scored by all words; an empty
table gives an empty table; repeated rows each give a row; other columns are ignored; ids may be of any type.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import crc_mod, map_batches, remember, staged, utf8, with_id

MAX_ROWS, REMEMBERED = 20_000, 250_000
#: Prior counts as a share of a word's own; variances to which a beginning's and a word's log-odds are shrunk; letters of a beginning; taken
#: off every score; segments listed must be rarer than this.
PRIOR, SHRINK_START, SHRINK_WORD, START, DRIFT, RARE = 0.03, 3.0, 3.0, 5, 1.0, 0.01
_RUNS = regex.compile(r"\p{L}+").findall
#: Columns of a lexicon: the scores by all rows, by those outside half 0, and by those outside half 1.
ALL = 0


class _Words(dict):
    """Chunk of UTF-8 to its lower-cased words."""

    def __missing__(self, chunk: bytes) -> list[str]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[chunk] = found = _RUNS(chunk.decode().lower())
        return found


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts that have each word and each beginning, by half and label: a word counts once in a text, so texts that repeat themselves weigh no more."""
    words_of, found = _Words(), defaultdict(Counter)
    for toxic, half, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
        words = {w for chunk in set(text.split()) for w in words_of[chunk]}
        for start, names in ((False, words), (True, {w[:START] for w in words})):
            for w in names:
                found[start, w][2 * half + bool(toxic)] += 1
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.bool_()), pa.array([k[1] for k in found], pa.string()), *(pa.array([c[j] for c in found.values()], pa.int64()) for j in range(4))], ["start", "word", "n0", "n1", "n2", "n3"])


def log_odds(clean: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and their variance for counts of words in clean and in toxic texts; infinite variance where a word was not seen."""
    n0, n1, own = clean.sum(), toxic.sum(), PRIOR * (clean + toxic)
    total = PRIOR * (n0 + n1)
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log((toxic + own) / (n1 + total - toxic - own)) - np.log((clean + own) / (n0 + total - clean - own))
        spread = 1 / (toxic + own) + 1 / (clean + own)
    seen = clean + toxic > 0
    return np.where(seen, odds, 0.0), np.where(seen, spread, np.inf)


def word_scores(start_counts: np.ndarray, word_counts: np.ndarray, start_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores, DRIFT not yet taken off, of beginnings and words from their (clean, toxic) counts; start_of: the row of each word's beginning."""
    odds, spread = log_odds(*start_counts.T)
    starts = odds / (1 + spread / SHRINK_START)
    odds, spread = log_odds(*word_counts.T)
    return starts, (odds / spread + starts[start_of] / SHRINK_WORD) / (1 / spread + 1 / SHRINK_WORD)


class Lexicon:
    """Scores of words and beginnings, a column for each way of learning, and the extreme-value rate."""

    def __init__(self, starts: list[str], words: list[str], counts: tuple[np.ndarray, np.ndarray]):
        index = {w: k for k, w in enumerate(starts)}
        of = np.array([index[w[:START]] for w in words], np.int64)
        halves = [c.reshape(-1, 2, 2).astype(float) for c in counts]  # half, label
        every = [c.sum(1) for c in halves]
        if all((halves[1][:, h].sum(0) > 0).all() for h in (0, 1)):
            learned = [every, [c[:, 1] for c in halves], [c[:, 0] for c in halves]]
            tried = [(halves[1][:, 0, 0], 1), (halves[1][:, 1, 0], 2)]
        else:
            learned, tried = [every] * 3, [(every[1][:, 0], 0)]
        scores = [word_scores(s, w, of) for s, w in learned]
        self.tables = [pa.RecordBatch.from_arrays([pa.array(names), *(pa.array((x[j] - DRIFT).astype(np.float32)) for x in scores)], ["w", "s0", "s1", "s2"]) for j, names in enumerate((starts, words))]
        self.rate = karlin_rate(np.concatenate([scores[k][1] for _, k in tried]) - DRIFT, np.concatenate([n for n, _ in tried]) / sum(n.sum() for n, _ in tried))

    def column(self, k: int) -> tuple[dict[str, float], dict[str, float]]:
        return tuple(dict(zip(t.column(0).to_pylist(), t.column(1 + k).to_pylist())) for t in self.tables)


def segments(positions: list[int], scores: list[float], other: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, end) of a sequence: `scores` at `positions`, `other` (negative) elsewhere. Linear time."""
    stack: list[list] = []  # [sum before, sum after, first, end]
    total, last = 0.0, 0
    for at, s in zip(positions, scores):
        total += other * (at - last)
        last = at + 1
        if s <= 0:
            total += s
            continue
        new = [total, total + s, at, at + 1]
        total += s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= new[0]:
                j -= 1
            if j < 0 or stack[j][1] >= new[1]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(b - a, i, e) for a, b, i, e in stack]


def scan(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, end) of scores; neighbours of one sign are added up first, as no segment parts them."""
    if not len(scores):
        return []
    begins = np.flatnonzero(np.r_[True, (scores[1:] > 0) != (scores[:-1] > 0)])
    sums, ends = np.add.reduceat(scores, begins), np.r_[begins[1:], len(scores)]
    return [(x, int(begins[a]), int(ends[e - 1])) for x, a, e in segments(list(range(len(sums))), sums.tolist(), -1.0)]


class _Scores(dict):
    """Chunk to its score: the best of its words'; that of a word that says nothing if it has none."""

    def __init__(self, lexicon: Lexicon, column: int):
        self.starts, self.words = lexicon.column(column)

    def __missing__(self, chunk: bytes) -> float:
        s = max((self.words[w] if w in self.words else self.starts.get(w[:START], -DRIFT) for w in _RUNS(chunk.decode().lower())), default=-DRIFT)
        if len(self) >= REMEMBERED:
            self.clear()
        self[chunk] = s
        return s


class _Score:
    """Evidence of (id, text), or of (id, text, half) by the words of the other half."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.token = lexicon, uuid.uuid4().hex

    def open(self):
        memory = remember(f"toxic {self.token}", dict)
        rate = self.lexicon.rate

        def scores_by(column: int) -> _Scores:
            if column not in memory:
                memory[column] = _Scores(self.lexicon, column)
            return memory[column]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            evidence, best, spans = [], [], []
            columns = [1 + h for h in batch.column(2).to_pylist()] if batch.num_columns > 2 else [ALL] * batch.num_rows
            for text, column in zip(utf8(batch.column(1)), columns):
                scores = np.array(list(map(scores_by(column).__getitem__, text.split())))
                found = scan(scores)
                worth = [rate * s - np.log(len(scores)) for s, _, _ in found]
                evidence.append(float(sum(max(0.0, w) for w in worth)))
                best.append(float(max(worth, default=-20.0)))
                spans.append([{"first_word": a, "end_word": e, "score": s} for (s, a, e), w in zip(found, worth) if w > -np.log(RARE)])
            kind = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(evidence, pa.float64()), pa.array(best, pa.float64()), pa.array(spans, kind)], ["id", "evidence", "best", "segments"])

        return step


def _features(evidence: np.ndarray, best: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(best)), np.log1p(evidence), np.clip(best, -10, 10) / 10])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def karlin_rate(scores: np.ndarray, p: np.ndarray) -> float:
    """The positive lambda with sum p * exp(lambda * s) = 1; the mean score must be negative."""
    low, high = 0.0, 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * scores, 700))).sum())
    while f(high) < 1 and high < 1e3:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 1 else (low, mid)
    return max(high, 1e-3)


def learned(rows: DataFrame) -> Lexicon | None:
    """The lexicon of labelled rows (toxic, half, text), whose number is bounded; None if a label is missing."""
    counts = map_batches(rows.select("toxic", "half", "text"), _count, "start boolean, word string, n0 bigint, n1 bigint, n2 bigint, n3 bigint")
    table = staged(counts.groupBy("start", "word").agg(*(F.sum(f"n{j}").alias(f"n{j}") for j in range(4))), "words").toArrow().sort_by([("word", "ascending")])
    start = table["start"].to_numpy()
    parts = [table.filter(pa.array(m)) for m in (start, ~start)]
    names = [t["word"].to_pylist() for t in parts]
    counts = tuple(np.column_stack([t[f"n{j}"].to_numpy() for j in range(4)]) for t in parts)
    kinds = counts[1].reshape(-1, 2, 2).sum((0, 1))
    return Lexicon(*names, counts) if kinds.all() else None


def scored(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row for each row of df: id_col, score (0 to 1), predicted, evidence, segments. `labels` must hold training rows only."""
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    known = staged(known.orderBy(F.xxhash64("id"), "id").limit(max_rows).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)).cast("int")), "labelled")
    rows = slim.join(F.broadcast(known), "id")  # at most max_rows ids
    lexicon = learned(rows)
    if lexicon is None:
        return slim.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("evidence"), F.lit(None).cast("array<struct<first_word: bigint, end_word: bigint, score: double>>").alias("segments"))
    step, schema = _Score(lexicon), with_id(slim, "evidence double, best double, segments array<struct<first_word: bigint, end_word: bigint, score: double>>")
    fit = map_batches(rows.select("id", "text", "half"), step, schema).join(F.broadcast(known), "id").select("evidence", "best", "toxic").toArrow()
    w = fit_logistic(_features(fit["evidence"].to_numpy(), fit["best"].to_numpy()), fit["toxic"].to_numpy().astype(float))
    logit = F.lit(float(w[0])) + float(w[1]) * F.log1p("evidence") + float(w[2]) * F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("best"))) / 10
    out = map_batches(slim, step, schema).withColumn("score", 1 / (1 + F.exp(-logit)))
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "segments")


def training_labels(labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id") -> DataFrame:
    """The rows outside the held-out fold."""
    return labels.filter(crc_mod(id_col, folds) != held)
