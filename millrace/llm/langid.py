"""Language identification by interpolated Kneser-Ney character models.

Every language that the training rows name gets a model of order 5 over the letters (whole code points) of its words, each word padded, so no context
crosses a word. Counts cover all training rows: tasks count the 5-grams of their distinct words, Spark adds the counts up and gets the
lower orders, discounts and contexts from all of them. The counts are stored as sorted arrays of hashed n-grams, cut into shards in the
shared folder, which workers map; probabilities are made from them at lookup, and an absent n-gram backs off to the next shorter one. A text goes to the language with the lowest cross-entropy per letter. It is rejected if it has no
letter, or if that cross-entropy is further above the language's usual one than (nearly) any text's is that was labelled but not counted.

Every n-gram is kept: the model grows with the training text on disk, in files of about a million rows, and not in what is sent.

Cases: null or letterless text: `und`, score 0, rejected; ties go to the language first in order; no training rows: all `und`;
repeated rows each count and each give a row; very long texts are read whole; an empty table gives an empty table; other columns pass
by, so clashing names do no harm.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import filesystem, fresh_path, map_batches, remember, staged, utf8

#: A code point's low bits and high bits are packed apart, as five whole ones exceed an integer.
ORDER, BITS, HIGH_BITS = 5, 12, 9
#: No letters, so no word has them.
PAD, END = "\1", "\2"
#: Rows in a shard; one training text in so many calibrates rejection, with this margin; chunks that a worker remembers; bytes of text and new
#: words scored at once.
SHARD_ROWS, CALIBRATION, LOOSE, REMEMBERED, AT_ONCE, WORDS = 1_000_000, 16, 1.5, 250_000, 2_000_000, 10_000
#: Letters and the marks that follow them.
_RUNS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def grams(words: list[str], high: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The packed 5-gram that ends at each letter or word end, and the number of them in each word: the low bits of the code points, or the high ones."""
    text = "".join(PAD * (ORDER - 1) + w + END for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    bits = HIGH_BITS if high else BITS
    signs = points >> np.uint64(BITS) if high else points & np.uint64((1 << BITS) - 1)
    keys = signs.copy()
    for j in range(1, ORDER):
        keys[j:] |= signs[:-j] << np.uint64(bits * j)
    return keys[points != ord(PAD)], np.array([len(w) + 1 for w in words])


def _suffix(keys: np.ndarray, n: int, bits: int = BITS) -> np.ndarray:
    return keys & np.uint64((1 << bits * n) - 1)


def _distinct(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs and where each pair is among them."""
    if not high.any():
        low, where = np.unique(low, return_inverse=True)
        return low, np.zeros_like(low), where
    order = np.lexsort((low, high))
    low, high = low[order], high[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    where = np.empty(len(low), np.int64)
    where[order] = np.cumsum(new) - 1
    return low[new], high[new], where


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The 5-grams of the texts (lang, text, unseen), by language and whether the text is unseen."""
    chunks: dict[tuple, Counter] = defaultdict(Counter)
    for lang, text, unseen in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
        chunks[lang, unseen].update(text.split())
    out = []
    for kind, found in chunks.items():
        words: Counter = Counter()
        for chunk, n in found.items():
            for w in _RUNS(chunk.decode().lower()):
                words[w] += n
        if words:
            keys, sizes = grams(list(words))
            unique, high, where = _distinct(keys, grams(list(words), high=True)[0])
            out.append((kind, unique, high, np.bincount(where, np.repeat(np.fromiter(words.values(), float), sizes))))
    of = lambda j, t: pa.array([x for kind, u, *_ in out for x in [kind[j]] * len(u)], t)
    join = lambda k, t: np.concatenate([o[k] for o in out]).astype(t) if out else np.empty(0, t)
    return pa.RecordBatch.from_arrays([of(0, pa.string()), *(pa.array(join(k, np.int64)) for k in (1, 2, 3)), of(1, pa.bool_())], ["lang", "gram", "high", "n", "unseen"])


def _hashed(kind: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(kind, low, high) of bigints."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(1, 42, np.uint64)
    for x in (np.full(1, kind, np.uint64), low, high):
        h = turn((h + p5 + np.uint64(8)) ^ (turn(x * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h


class Shards:
    """Rows (hash, language, a, b) sorted by hash and language and cut by the first `bits` bits of the hash: arrays, or files in the shared
    folder, which are mapped into memory where that folder is local, so that a worker holds only what it touches."""

    def __init__(self, parts: dict[int, tuple | str], bits: int, width: int):
        self.parts, self.bits, self.width, self.opened = parts, bits, width, {}

    def __getstate__(self):
        return self.__dict__ | {"opened": {}}

    def _open(self, k: int) -> tuple:
        if k not in self.opened:
            part = self.parts[k]
            if isinstance(part, str):
                system, at = filesystem(part)
                rows = pa.ipc.open_file(pa.memory_map(at) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(at)).get_batch(0)
                part = tuple(rows.column(j).to_numpy() for j in range(4))
            self.opened[k] = part
        return self.opened[k]

    def get(self, kind: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a and b by language for each key, 0 where there is no row."""
        wanted, where = np.unique(_hashed(kind, low, high), return_inverse=True)
        a, b = np.zeros((2, len(wanted), self.width))
        ends = np.searchsorted(wanted >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        for k in self.parts:
            begin, end = ends[k], ends[k + 1]
            if begin == end:
                continue
            hashes, lang, va, vb = self._open(k)
            row, at = np.arange(begin, end), np.searchsorted(hashes, wanted[begin:end])
            while True:
                fits = at < len(hashes)
                row, at = row[fits], at[fits]
                fits = hashes[at] == wanted[row]
                row, at = row[fits], at[fits]
                if not len(row):
                    break
                a[row, lang[at]], b[row, lang[at]] = va[at], vb[at]
                at = at + 1
        return a[where], b[where]


@dataclass
class Model:
    """Counts of the n-grams of order n are rows of kind n, totals and kinds of what follows a context rows of kind ORDER + n."""

    langs: list[str]
    rows: Shards | None = None
    discounts: np.ndarray | None = None
    usual: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = np.inf
    #: Blocks of 1 << BITS code points from which training letters come: any sign of them may follow.
    blocks: int = 1

    def log_p(self, keys: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each packed 5-gram's last letter, by language; no high bits are all 0."""
        keys, high, where = _distinct(keys, np.zeros_like(keys) if high is None else high)
        p = np.full((len(keys), len(self.langs)), 1 / (self.blocks << BITS))
        for n in range(1, ORDER + 1):
            own, up, d = _suffix(keys, n), _suffix(high, n, HIGH_BITS), self.discounts[n - 1]
            count, _ = self.rows.get(n, own, up)
            total, kinds = self.rows.get(ORDER + n, own >> np.uint64(BITS), up >> np.uint64(HIGH_BITS))
            p = np.where(total > 0, (np.maximum(count - d, 0) + d * kinds * p) / np.maximum(total, 1), p)
        return np.log(p)[where]

    def usual_from(self, sums: np.ndarray) -> None:
        """usual and spread from each language's number of letters and the sums of their entropies and squared entropies."""
        weight = np.maximum(sums[0], 1)
        self.usual = sums[1] / weight
        self.spread = np.sqrt(np.maximum(sums[2] / weight - self.usual**2, 1e-6))


def _discount(n1, n2):
    return np.minimum(0.95, np.maximum(0.1, np.where(n1 > 0, n1 / np.maximum(n1 + 2 * n2, 1), 0.5)))


def _own_entropy(model: Model, lang: np.ndarray, gram: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
    own = -model.log_p(gram.astype(np.uint64), high.astype(np.uint64))[np.arange(len(gram)), lang] if len(gram) else np.empty(0)
    return np.array([np.bincount(lang, n * own**k, len(model.langs)) for k in range(3)])


def kneser_ney(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, high: np.ndarray | None = None) -> Model:
    """Interpolated Kneser-Ney models from 5-gram counts in memory (lang: index into langs); train() has Spark count the same."""
    high = (np.zeros_like(gram) if high is None else high).astype(np.uint64)
    rows, model = [], Model(langs, discounts=np.full((ORDER, len(langs)), 0.5), blocks=max(1, len(np.unique(_suffix(high, 1, HIGH_BITS)))))
    for k in range(len(langs)):
        keys, up, counts = gram[lang == k].astype(np.uint64), high[lang == k], n[lang == k].astype(float)
        for size in range(ORDER, 0, -1):
            if size < ORDER:  # lower orders count the letters that come before
                keys, up, where = _distinct(_suffix(keys, size), _suffix(up, size, HIGH_BITS))
                counts = np.bincount(where)
            model.discounts[size - 1, k] = _discount((counts == 1).sum(), (counts == 2).sum())
            ctx, ctx_up, where = _distinct(keys >> np.uint64(BITS), up >> np.uint64(HIGH_BITS))
            rows.append((_hashed(size, keys, up), np.full(len(keys), k), counts, np.zeros(len(keys))))
            rows.append((_hashed(ORDER + size, ctx, ctx_up), np.full(len(ctx), k), np.bincount(where, counts), np.bincount(where)))
    hashes, owner, a, b = (np.concatenate(c) for c in zip(*rows)) if rows else np.zeros((4, 0))
    order = np.lexsort((owner, hashes))
    half = np.searchsorted(hashes[order], np.uint64(1 << 63))
    model.rows = Shards({k: (hashes[o], owner[o], a[o], b[o]) for k, o in enumerate((order[:half], order[half:]))}, 1, len(langs))
    model.usual_from(_own_entropy(model, lang, gram, high, n))
    return model


class _Write:
    """Writes the shards of a partition, whose rows (shard, h, lang, a, b) are sorted, as files of one Arrow batch each."""

    def __init__(self, folder: str, langs: list[str]):
        self.folder, self.langs = folder, langs

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        system, root = filesystem(self.folder)
        system.create_dir(root, recursive=True)
        rows = pa.Table.from_batches(found).combine_chunks()
        shard = rows["shard"].to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        names = []
        for begin, end in zip(begins, [*begins[1:], len(shard)]):
            part = rows.slice(begin, end - begin)
            cols = [part["h"].to_numpy().view(np.uint64), pa.compute.index_in(part["lang"], value_set=pa.array(self.langs)).to_numpy(), part["a"].to_numpy(), part["b"].to_numpy()]
            batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "lang", "a", "b"])
            names.append(f"{shard[begin]}-{uuid.uuid4().hex}.arrow")
            with system.open_output_stream(f"{root}/{names[-1]}") as sink, pa.ipc.new_file(sink, batch.schema) as out:
                out.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array(shard[begins]), pa.array([f"{self.folder}/{x}" for x in names])], ["shard", "path"])


class _Entropy:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        lang = pa.compute.index_in(batch.column(0), value_set=pa.array(self.model.langs)).to_numpy(zero_copy_only=False)
        sums = _own_entropy(self.model, lang, *(batch.column(j).to_numpy() for j in (1, 2, 3)))
        return pa.RecordBatch.from_arrays([pa.array(range(len(self.model.langs)), pa.int32()), *(pa.array(s, pa.float64()) for s in sums)], ["k", "s0", "s1", "s2"])


def _fitted(counts: DataFrame) -> Model:
    """The models of 5-gram counts (lang, gram, high, n), a staged table: Spark counts the lower orders and contexts, all of them."""
    spark, levels = counts.sparkSession, [counts]
    for size in range(ORDER - 1, 0, -1):  # lower orders count the letters that come before
        low, high = (F.col(c).bitwiseAND(F.lit((1 << bits * size) - 1)).alias(c) for c, bits in (("gram", BITS), ("high", HIGH_BITS)))
        levels.insert(0, staged(levels[0].groupBy("lang", low, high).agg(F.count(F.lit(1)).alias("n")), f"grams{size}"))
    once = [t.groupBy(F.lit(k).alias("k"), "lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.count(F.lit(1)).alias("n")) for k, t in enumerate(levels)]
    facts = reduce(DataFrame.union, once).collect()
    model = Model(sorted({r["lang"] for r in facts}))
    if not facts:
        return model
    index = {x: k for k, x in enumerate(model.langs)}
    model.discounts = np.full((ORDER, len(index)), 0.5)
    for r in facts:
        model.discounts[r["k"], index[r["lang"]]] = _discount(r["n1"], r["n2"])
    model.blocks = levels[0].select("high").distinct().count()
    bits = max(1, (2 * sum(r["n"] for r in facts) // SHARD_ROWS).bit_length())
    rows = []
    for size, t in enumerate(levels, 1):
        ctx = t.groupBy("lang", F.shiftright("gram", BITS).alias("gram"), F.shiftright("high", HIGH_BITS).alias("high")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
        for kind, of in ((size, t.withColumn("kinds", F.lit(0))), (ORDER + size, ctx)):
            rows.append(of.select("lang", F.xxhash64(F.lit(kind).cast("bigint"), "gram", "high").alias("h"), F.col("n").cast("double").alias("a"), F.col("kinds").cast("double").alias("b")))
    sharded = reduce(DataFrame.union, rows).select(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("shard"), "h", "lang", "a", "b")
    write = _Write(fresh_path(spark, "languages"), model.langs)
    files = sharded.repartition(1 << bits, "shard").sortWithinPartitions("shard", "h", "lang").mapInArrow(write, "shard int, path string").collect()
    model.rows = Shards({r["shard"]: r["path"] for r in files}, bits, len(model.langs))
    sums = np.zeros((3, len(model.langs)))
    for k, *s in map_batches(counts, _Entropy(model), "k int, s0 double, s1 double, s2 double").groupBy("k").agg(F.sum("s0"), F.sum("s1"), F.sum("s2")).collect():
        sums[:, k] = s
    model.usual_from(sums)
    return model


class Scorer(dict):
    """Chunk of UTF-8 without white space to its row of summed log probabilities and number of letters."""

    def __init__(self, model: Model):
        self.model, self.new = model, []
        self.sums = np.zeros((1, len(model.langs) + 1))

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = at = len(self)
        self.new.append(chunk)
        return at

    def learn(self) -> None:
        runs = [_RUNS(c.decode().lower()) for c in self.new]
        words = sorted({w for r in runs for w in r})
        rows = np.zeros((len(self.new), self.sums.shape[1]))
        if words:
            per = np.concatenate([self._words(words[k : k + WORDS]) for k in range(0, len(words), WORDS)])
            at = {w: k for k, w in enumerate(words)}
            owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
            np.add.at(rows, owner, per[[at[w] for r in runs for w in r]])
        self.sums = np.vstack([self.sums[: len(self) - len(self.new)], rows])
        self.new = []

    def _words(self, words: list[str]) -> np.ndarray:
        keys, sizes = grams(words)
        return np.add.reduceat(np.column_stack([self.model.log_p(keys, grams(words, high=True)[0]), np.ones(len(keys))]), np.cumsum(sizes) - sizes)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text: the sum for every language, then the number of letters."""
        out, k = np.zeros((len(texts), self.sums.shape[1])), 0
        while k < len(texts):
            part, size = [], 0
            while k + len(part) < len(texts) and size < AT_ONCE:
                size += len(texts[k + len(part)]) + 1
                part.append(list(map(self.__getitem__, texts[k + len(part)].split())))
            self.learn()
            for row in part:
                if row:
                    out[k] = self.sums[row].sum(0)
                k += 1
            if len(self) > REMEMBERED:
                self.clear()
                self.sums = self.sums[:0]
        return out


class _Predict:
    def __init__(self, model: Model, token: str):
        self.model, self.token = model, token

    def open(self):
        scorer = remember(f"languages {self.token}", lambda: Scorer(self.model))
        model = scorer.model

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sums = scorer.score(utf8(batch.column(batch.num_columns - 1)))
            letters = sums[:, -1]
            entropy = -sums[:, :-1] / np.maximum(letters, 1)[:, None]
            best = entropy.argmin(1)
            low = entropy[np.arange(len(best)), best]
            score = 1 / np.exp(-(entropy - low[:, None]) * np.minimum(letters, 50)[:, None]).sum(1)
            above = (low - model.usual[best]) / (model.spread[best] / np.sqrt(np.maximum(letters, 1)) + 0.05 * model.usual[best])
            none = letters == 0
            names = ["und" if e else model.langs[b] for e, b in zip(none, best)]
            cols = [pa.array(names), pa.array(np.where(none, 0.0, score)), pa.array(low, mask=none), pa.array(np.where(none, 0.0, above)), pa.array(none | (above > model.limit))]
            return pa.RecordBatch.from_arrays([batch.column(k) for k in range(batch.num_columns - 1)] + cols, [f"c{k}" for k in range(batch.num_columns - 1)] + ["lang_pred", "score", "cross_entropy", "above", "rejected"])

        return step


def train(df: DataFrame, keep: Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Models from the rows of df where `keep` holds and language and text are there; all of them are counted.

    The level of rejection comes from models like these that do not count one text in CALIBRATION, chosen by its hash: these texts, unseen by
    them, set it half as high again as their 0.999 quantile. Where there are none, all training texts do."""
    rows = df.filter(keep & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("unseen", F.pmod(F.xxhash64(F.lit("calibration"), "text"), F.lit(CALIBRATION)) == 0)
    found = map_batches(rows.select("lang", "text", "unseen"), _count, "lang string, gram bigint, high bigint, n bigint, unseen boolean")
    counts = staged(found.groupBy("lang", "gram", "high").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("unseen"), 0).otherwise(F.col("n"))).alias("m")), f"grams{ORDER}")
    model = _fitted(counts.select("lang", "gram", "high", "n"))
    if model.langs:
        part = _fitted(counts.filter("m > 0").select("lang", "gram", "high", F.col("m").alias("n")))
        above = None
        if part.langs:
            above = _quantile(rows.filter("unseen"), part)
        if above is None:
            above = _quantile(rows, model)
        model.limit = LOOSE * max(1.0, above)
    return model


def _quantile(rows: DataFrame, model: Model) -> float | None:
    """How far nearly all of the texts with letters lie above the usual, in units of it."""
    return predict(rows.select("lang", "text"), model, "lang", "text").filter("cross_entropy is not null").agg(F.percentile_approx("above", 0.999, 10_000)).first()[0]


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id_col, lang_pred, score, cross_entropy, above (its excess in units of the usual), rejected."""
    if not model.langs:
        return df.select(F.col(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(0.0).alias("above"), F.lit(True).alias("rejected"))
    slim = df.select(F.col(id_col).alias("c0"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([slim.schema["c0"], *T.StructType.fromDDL("lang_pred string, score double, cross_entropy double, above double, rejected boolean")])
    return map_batches(slim, _Predict(model, uuid.uuid4().hex), schema).withColumnRenamed("c0", id_col)


class _Keep(_Predict):
    """Passes whole rows on, the rejected left out."""

    def __init__(self, model: Model, token: str, at: int):
        super().__init__(model, token)
        self.at = at

    def open(self):
        inner = super().open()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            bad = inner(pa.RecordBatch.from_arrays([batch.column(self.at)], ["text"])).column(4)
            return batch.filter(pa.compute.invert(bad))

        return step


def kept(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df whose text is not rejected; nothing is judged where no language could be learned."""
    return map_batches(df, _Keep(model, uuid.uuid4().hex, df.columns.index(text_col)), df.schema) if model.langs else df
