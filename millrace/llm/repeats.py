"""Removal of byte strings that repeat anywhere in a corpus.

Every byte covered by a string of `size` bytes that also starts somewhere else is found exactly, whatever its alignment. Sorting all suffixes
costs many times the input in shuffles (see the README and suffixes.py, which has the difference-cover construction), so only
windows that can repeat are compared here:

1. Each window of `size` bytes has an anchor: its k-gram of least hash, the leftmost of equals. Equal windows have equal anchors at equal
   places, so a window can only repeat inside its anchor's group. Neighbouring windows with one anchor form a region.
2. Anchors that come once are dropped: nothing there repeats. Regions that repeat whole are repeats. Of the rest each region that differs
   in its group is taken once and cut into blocks of windows: a block repeats if all its bytes do, cannot repeat if what its windows
   share does not, and only blocks between, at the ends of passages, are compared window by window.
3. Spans come together by text, are merged, and cut out.

Hot keys: a passage that very many texts share is counted by partial aggregation, and joins on hot anchors are left to adaptive skew
handling; copies of a text that is hot itself, and all short texts, lie in any bucket. No group is ever collected, except the spans of one text, which
its length bounds. Bytes are compared by pairs of 64-bit polynomial hashes with random letter values, texts are told apart by a 64-bit hash.

Cases: null text counts as empty; texts shorter than `size` keep everything; equal texts of at least `size` bytes lose everything;
overlapping matches count, inside one text too; ties between places need no order, as all go; repeated rows are copies; very long
texts are read in overlapping pieces; an empty table gives an empty table; other columns are ignored or pass by.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh_path, map_batches, staged, tidy, utf8, with_id

SIZE, GRAM = 200, 40
#: Bytes hashed at once; a place in a piece takes PLACE bits of an ordering key.
PIECE, PLACE = 1 << 18, 19
#: Windows in a block.
STEP = 16
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter values, powers of the base and of its inverse modulo 2**64."""
    letters = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    n = PIECE + 4096
    power = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)])
    return letters, power(np.uint64(_BASE)), power(np.uint64(pow(_BASE, -1, 1 << 64)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of any substring of at most a piece of bytes."""

    def __init__(self, data: np.ndarray):
        letters, power, self.inverse = _tables()
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(letters[data] * power[: len(data)], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """The hash of each substring of one size, by its first place."""
        return _mix((self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, in time that w does not matter to."""
    n = len(v) - w + 1
    padded = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def pieces(texts: list[bytes], size: int):
    """(bytes, piece's texts, their first places in it, their first places in the text, window starts of each): many short texts or a part of a long one."""
    part: list[tuple[int, int, bytes]] = []
    total = 0
    for k, t in enumerate(texts):
        if len(t) < size:
            continue
        for at in range(0, len(t) - size + 1, PIECE - size):
            cut = t[at : at + PIECE - 1]
            if total + len(cut) > PIECE + 2048 and part:
                yield part
                part, total = [], 0
            part.append((k, at, cut))
            total += len(cut)
    if part:
        yield part


def regions(texts: list[bytes], size: int, gram: int) -> list[tuple[np.ndarray, ...]]:
    """For each piece: text number, first window start, number of windows, anchor hash, region hash."""
    out = []
    for part in pieces(texts, size):
        data = np.frombuffer(b"".join(c for _, _, c in part), np.uint8)
        lengths = np.array([len(c) for _, _, c in part])
        base = np.cumsum(lengths) - lengths
        h = Hashes(data)
        grams = h.every(gram)
        places = np.arange(len(grams), dtype=np.uint64)
        mask = np.uint64((1 << PLACE) - 1)
        least = _least((grams & ~mask) | places, size - gram + 1)
        # A piece of a long text brings the window starts that its successor does not.
        counts = np.array([min(n - size + 1, PIECE - size) for n in lengths])
        owner = np.repeat(np.arange(len(part)), counts)
        start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + base[owner]
        anchor = (least[start] & mask).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
        first, many, own = start[new], np.diff(np.r_[new, len(start)]), owner[new]
        whole = h.at(first, first + many + size - 1) + _mix((anchor[new] - first).astype(np.uint64) << np.uint64(32) | many.astype(np.uint64))
        number, offset = np.array([k for k, _, _ in part]), np.array([a for _, a, _ in part])
        out.append((number[own], first - base[own] + offset[own], many, grams[anchor[new]], whole))
    return out


class _Regions:
    def __init__(self, size: int, gram: int):
        self.size, self.gram = size, gram

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = regions(utf8(batch.column(1)), self.size, self.gram)
        if not found:
            return None
        number, first, many, anchor, region = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(number)), pa.array(first.astype(np.int64)), pa.array(many.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(region.view(np.int64))], ["t", "first", "many", "anchor", "region"])


def _anchors(grams: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """The place of each window's anchor: the leftmost of its grams of least hash."""
    high = grams & ~np.uint64((1 << PLACE) - 1)
    return first + high[first[:, None] + np.arange(width)].argmin(1)


def blocks(text: bytes, first: np.ndarray, many: np.ndarray, size: int, gram: int, step: int) -> tuple[np.ndarray, ...]:
    """Regions cut into blocks of at most `step` windows, at places that only the anchor fixes: region number, first window, windows, place of
    the first in its block, hash of what all windows of the block have in common, hash of all its bytes (0 if unknown)."""
    width = size - gram + 1
    if len(text) > PIECE:  # region by region, so that no more than a region is hashed at once
        parts = []
        for k in range(len(first)):
            low, high = max(0, int(first[k]) - width), min(len(text), int(first[k] + many[k]) + size + width)
            own = blocks(text[low:high], first[k : k + 1] - low, many[k : k + 1], size, gram, step)
            at = first[k] % (PIECE - size) == 0, (first[k] + many[k]) % (PIECE - size) == 0
            # A region that may go on in the next piece could bring a block twice: its windows speak for themselves.
            parts.append((own[0] + k, own[1] + low, *own[2:5], np.zeros_like(own[5]) if any(at) else own[5]))
        return tuple(np.concatenate(x) for x in zip(*parts))
    h = Hashes(np.frombuffer(text, np.uint8))
    grams = h.every(gram)
    anchor = _anchors(grams, first, width)
    zero = anchor - (width - 1)  # the first window that could have this anchor
    low, high = (first - zero) // step, (first + many - 1 - zero) // step
    number = np.repeat(np.arange(len(first)), high - low + 1)
    block = np.arange(len(number)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[number]
    begin = zero[number] + block * step
    start = np.maximum(begin, first[number])
    n = np.minimum(begin + step, (first + many)[number]) - start
    # Blocks of two anchors may be the same bytes; anchor and number keep them apart.
    name = _mix(grams[anchor[number]] + block.astype(np.uint64))
    core = h.at(begin + step - 1, begin + size) ^ name
    inside = (begin >= 0) & (begin + step - 1 + size <= len(text))
    whole = np.where(inside, h.at(np.where(inside, begin, 0), np.where(inside, begin + step - 1 + size, 0)) ^ name, np.uint64(0))
    return number, start, n, start - begin, core, whole


class _Blocks:
    def __init__(self, size: int, gram: int, step: int):
        self.size, self.gram, self.step = size, gram, step

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for t, text, listed in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
            first, many, known = (np.array([r[k] for r in listed]) for k in ("first", "many", "known"))
            number, *rest = blocks(text, first, many, self.size, self.gram, self.step)
            found.append((np.full(len(number), t, np.int64), known[number], *rest))
        t, known, start, n, place, core, whole = (np.concatenate(x) for x in zip(*found))
        names = ["t", "known", "first", "n", "place", "core", "whole"]
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(known), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))], names)


class _Windows:
    """Hashes of the listed windows of a text."""

    def __init__(self, size: int):
        self.size = size

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, hashes, places, known, cores = [], [], [], [], []
        for t, text, listed in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
            for r in listed:
                a, n = r["first"], r["n"]
                hashes.append(Hashes(np.frombuffer(text, np.uint8, n + self.size - 1, a)).every(self.size))
                places.append(np.arange(a, a + n, dtype=np.int64))
                known.append(np.full(n, r["known"]))
                cores.append(np.full(n, r["core"], np.int64))
                keys.append(np.full(n, t, np.int64))
        t, place, core, h, k = (np.concatenate(x) for x in (keys, places, cores, hashes, known))
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(place), pa.array(core), pa.array(h.view(np.int64)), pa.array(k)], ["t", "first", "core", "hash", "known"])


def _twice(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that stand for two places or more; a known row stands for two."""
    return rows.groupBy(*keys).agg(F.sum(F.when(F.col("known"), 2).otherwise(1)).alias("c")).filter("c > 1").select(*keys)


#: A text is hot if it has more than this share of a bucket's usual rows; so there are at most buckets / HOT of them.
HOT, BUCKET_BYTES = 0.1, 64 << 20


class Texts:
    """Rows (row: all columns, t: the hash of the text), joined with lists by text three times.

    The rows are written once, bucketed by `t`, so that only lists are shuffled for each join. Buckets follow the bytes of text. Rows that no
    list names go to any bucket: texts shorter than a window, and the copies of hot texts, of which one stays in place to be read. The
    table's name is dropped at once; its files stay in the shared folder."""

    def __init__(self, df: DataFrame, text_col: str, size: int):
        self.text_col, self.size = text_col, size
        self.columns, self.schema = df.columns, df.schema
        text = df[text_col].cast("string")
        rows = df.select(F.struct(*(df[f"`{c.replace('`', '``')}`"] for c in df.columns)).alias("row"), F.xxhash64(text).alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).alias("bytes"))
        self.rows = self._bucketed(rows)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        long = F.col("bytes") >= self.size
        counts = staged(rows.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("b"), F.max("bytes").alias("bytes")), "copies")
        total, volume = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), volume // BUCKET_BYTES + 1)
        hot = counts.filter(long & (F.col("c") > max(1.0, HOT * total / n))).select("t", F.lit(True).alias("hot"))  # at most n / HOT rows
        rows = rows.join(F.broadcast(hot), "t", "left")
        away = F.col("hot").isNotNull() | ~long
        named = rows.select("row", F.when(away, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col("t")).alias("t"), F.col("hot").isNotNull().alias("whole"), (~away).alias("listed"))
        one = rows.filter("hot").groupBy("t").agg(F.first(F.struct("row")).alias("r")).select("r.row", "t", F.lit(False).alias("whole"), F.lit(True).alias("listed")).withColumn("spare", F.lit(True))
        name = f"millrace_{uuid.uuid4().hex}"
        with tidy(spark):
            named.withColumn("spare", F.lit(False)).unionByName(one).repartition(n, "t").write.bucketBy(n, "t").option("path", fresh_path(spark, "texts")).option("compression", "zstd").format("parquet").saveAsTable(name)
        table = spark.table(name)
        spark.sql(f"DROP TABLE {name}")
        return table

    def text(self) -> Column:
        return F.col("row").getField(self.text_col).cast("string").alias("text")

    def docs(self) -> DataFrame:
        """Texts of at least a window. A hot text is there once more than its one row in place, so that it still counts as repeated."""
        times = F.array_repeat(F.lit(1), F.when(F.col("spare"), 2).otherwise(1))
        return self.rows.filter("listed").select("t", self.text(), F.explode(times).alias("one")).select("t", "text")

    def listed(self, rows: DataFrame, *fields: str) -> DataFrame:
        """(t, text, list) for every text that rows (with t) name. Only texts that come once have rows that are not known, so copies need no care."""
        lists = staged(rows.groupBy("t").agg(F.collect_list(F.struct(*fields)).alias("list")), "listed")
        return self.rows.filter("listed").join(lists, "t").select("t", self.text(), "list")

    def with_spans(self, spans: DataFrame) -> DataFrame:
        """The rows' columns, named c0, c1 and on, and their spans."""
        every = F.when(F.col("whole"), F.array(F.struct(F.lit(0).cast("bigint").alias("first"), F.octet_length(self.text()).cast("bigint").alias("end")))).when(F.col("listed"), F.col("spans"))
        return self.rows.filter("not spare").join(spans, "t", "left").select(*(F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(self.columns)), every.alias("spans"))


def repeated_spans(texts: Texts, gram: int = GRAM) -> DataFrame:
    """Staged rows (t, spans): the hash of each text with repeats, and its maximal byte ranges {first, end} that repeat, in order."""
    size = texts.size
    found = map_batches(texts.docs(), _Regions(size, gram), "t bigint, first bigint, many int, anchor bigint, region bigint")
    groups = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("region").alias("low"), F.max("region").alias("high")).filter("c > 1")
    shared = staged(found.join(groups.select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "anchor"), "regions")
    mixed = shared.filter("mixed")
    kinds = staged(mixed.groupBy("anchor", "region").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("t", "first", "many")).alias("one")), "kinds")
    whole = shared.filter("not mixed").select("t", "first", "many").union(mixed.join(kinds.filter("c > 1").select("anchor", "region"), ["anchor", "region"], "left_semi").select("t", "first", "many"))
    spans = whole.select("t", "first", (F.col("first") + F.col("many") + (size - 1)).alias("end"))
    cut = map_batches(texts.listed(kinds.select("one.*", (F.col("c") > 1).alias("known")), "first", "many", "known"), _Blocks(size, gram, STEP), "t bigint, known boolean, first bigint, n int, place int, core bigint, whole bigint")
    parts = staged(cut, "blocks")
    # A block repeats whole if all its bytes do, and not at all if what its windows share does not; few are left between. What is taken for a
    # repeat is told by two hashes of different bytes: anchor and region, core and whole, core and window.
    whole = _twice(parts.filter("whole <> 0"), "core", "whole").withColumn("full", F.lit(True))
    open_ = staged(parts.filter("not known").join(_twice(parts, "core"), "core", "left_semi").join(whole, ["core", "whole"], "left").select("t", "first", "n", "core", F.coalesce("full", F.lit(False)).alias("full")), "open")
    full = open_.filter("full").select("t", "first", (F.col("first") + F.col("n") + (size - 1)).alias("end"))
    own = F.when(F.col("whole") != 0, F.col("whole")).otherwise(F.xxhash64("t", "first"))
    asked = parts.join(open_.filter("not full").select("core").distinct(), "core", "left_semi").withColumn("own", own)
    kinds = asked.groupBy("core", "own", "place", "n").agg(F.min(F.struct("t", "first")).alias("one"), F.sum(F.when(F.col("known"), 2).otherwise(1)).alias("c"))
    windows = map_batches(texts.listed(kinds.select("one.*", "n", "core", (F.col("c") > 1).alias("known")), "first", "n", "core", "known"), _Windows(size), "t bigint, first bigint, core bigint, hash bigint, known boolean")
    windows = staged(windows, "windows")
    single = full.union(windows.filter("not known").join(_twice(windows, "core", "hash"), ["core", "hash"], "left_semi").select("t", "first", (F.col("first") + F.lit(size)).alias("end")))
    together = spans.union(single).groupBy("t").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    return staged(map_batches(together, _merge, "t bigint, spans array<struct<first: bigint, end: bigint>>"), "spans")


def _merge(batch: pa.RecordBatch) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"first": a, "end": b} for a, b in merged(s)] for s in batch.column(1).to_pylist()], kind)], ["t", "spans"])


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["first"], s["end"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(text)]))


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for text, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
        cut = merged(spans)
        rows.append((len(text), sum(b - a for a, b in cut), len(cut), hashlib.sha256(_kept(text, cut)).hexdigest()))
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """One row for each row of df: id_col, n_bytes, n_removed, n_spans, kept_sha256."""
    slim = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    texts = Texts(slim, "text", size)
    return map_batches(texts.with_spans(repeated_spans(texts, gram)), _digest, with_id(slim, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")).withColumnRenamed("id", id_col)


class _Cut:
    def __init__(self, at: int, names: list[str]):
        self.at, self.names = at, names

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_columns - 1
        texts = batch.column(self.at).to_pylist()
        cut = [t if not s else _kept(t.encode(), merged(s)).decode("utf-8", "ignore") for t, s in zip(texts, batch.column(n).to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array(cut, batch.column(k).type) if k == self.at else batch.column(k) for k in range(n)], names=self.names)


def without_repeats(df: DataFrame, text_col: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """df with the repeated bytes cut out of its text; signs that a cut splits go too. Every row stays, if with an empty text."""
    texts = Texts(df, text_col, size)
    return map_batches(texts.with_spans(repeated_spans(texts, gram)), _Cut(df.columns.index(text_col), df.columns), df.schema)
