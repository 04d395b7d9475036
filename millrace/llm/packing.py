"""Best-fit packing of tokenised documents into sequences by the linear grouping scheme.

1. Tokens: each document is encoded, an end id is appended, and only documents longer than a sequence are cut into full pieces.
2. The plan needs nothing but the number of pieces of each length, at most `capacity` figures however large the corpus is. Large
   lengths are sorted and cut into groups of equal cardinality, each rounded up to its group's largest; the configuration programme
   over these few sizes is solved by column generation; its whole multiples are filled with the actual documents; then everything
   left, the small ones last, goes best-fit into the gaps. A few group numbers are tried until one reaches the lower bound.
3. The plan is a table of runs: items of one length and a range of ranks go to a range of sequences at one offset. Ranks come from
   counts by task and length, so nothing is sorted or gathered, and a hot length is spread over all tasks.

Cases: null text counts as empty, and an empty document is its end id alone; repeated rows are packed once each; ties in length are
broken by the order of rows in the staged piece table; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tiktoken._tiktoken import CoreBPE

from millrace.llm.common import map_batches, remember, staged, utf8, with_id
from millrace.llm.tokencount import _TO_BYTES, load

CAPACITY, END_ID = 4096, 1
#: Chunks whose ids a worker remembers, the older and the newer half; bytes of text encoded at once. Only speed depends on them.
REMEMBERED, AT_ONCE = 500_000, 2_000_000
#: Groupings that are tried: groups, the share of a sequence above which a piece is large, and the share of each configuration's sequences that are made.
GROUPINGS = [(g, large, share) for share in (1.0, 0.9, 0.6) for large in (1 / 8, 1 / 5) for g in (12, 18, 24)]


#: Text that normalizing only lower-cases: printable ASCII without the opening of a special string, and Latin-1 signs.
_PLAIN = regex.compile(r"(?:(?!<\|)[\x21-\x7e\xa1-\xac\xae-\xff])+").fullmatch
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n").findall
#: Ends a word where the vocabulary writes </w>; plain text has no such sign.
_MARK = "\1"


def unreached(tokens: dict[str, int], merges: dict[tuple[str, str], int]) -> set[str]:
    """The tokens that the merges, in their order, do not make of the token's own signs alone.

    A state of merging inside a token's span depends on that span only as long as no merge crosses its ends. So a token that is made alone
    comes from one pair wherever it comes up, and a token that is not made alone never comes up: merging by the rank of what two
    neighbours spell is the same as merging by pairs once the unreached are left out."""
    out = set()
    for token in tokens:
        parts = [*token[:-4]] if token.endswith("</w>") else [*token]
        if token.endswith("</w>"):
            parts[-1:] = [parts[-1] + "</w>"]
        while len(parts) > 1:
            rank, at = min((merges.get(x, 1 << 60), k) for k, x in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                out.add(token)
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return out


@lru_cache(maxsize=2)
def word_table(path: str) -> tuple[str, ...] | None:
    """The unreached tokens of a file of lower-cased words with word ends; None for any other kind of file, which goes through the library."""
    spec = json.loads(Path(path).read_text())
    model, kinds = spec["model"], [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cut = json.dumps(spec.get("pre_tokenizer") or {})
    known = kinds == ["NFC", "Replace", "Lowercase"] and json.dumps("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+") in cut and '"add_prefix_space": false' in cut
    if not known or model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return None
    merges = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
    vocab = {t: i for t, i in model["vocab"].items() if not t.startswith("<|")}
    lost = unreached(vocab, merges)
    made = {a + b: k for (a, b), k in merges.items()}
    order = sorted((i, made[t]) for t, i in vocab.items() if t in made and t not in lost)
    single = [i for t, i in vocab.items() if t not in made]
    # Ranks must rise as the merges do, and single signs, word ends put on, must come before any merge.
    fits = all(a < b for (_, a), (_, b) in zip(order, order[1:])) and max(single) < order[0][0] and all(len(t.removesuffix("</w>")) == 1 for t in vocab if t not in made)
    return tuple(sorted(lost)) if fits else None


def remembered(path: str, lost: tuple[str, ...] | None) -> "_Ids":
    """One memory for each worker, whatever the number of tasks that it runs."""
    return remember(f"ids {path}", lambda: _Ids(path, lost))


class _Ids(dict):
    """White-space-free chunk of UTF-8 to its ids, as little-endian 32-bit bytes. The tokenizer never joins text across white space.

    A new chunk gets an empty place, which learn() fills together with the other new ones of a batch: plain chunks go through the merge
    table in one call, others through the library."""

    def __init__(self, path: str, lost: tuple[str, ...] | None):
        self.tok, self.new, self.old = load(path), {}, {}
        self.table = None
        if lost is not None:
            left = set(lost)
            ranks = {}
            for t, i in self.tok.get_vocab(with_added_tokens=False).items():
                if t not in left and not t.startswith("<|"):
                    core = t.removesuffix("</w>")
                    ranks[bytes(_TO_BYTES[c] for c in core) + _MARK.encode() * (core != t)] = i
            self.line = ranks[b"\n" + _MARK.encode()]
            self.table = CoreBPE(ranks, {}, f"[^{_MARK}]+{_MARK}")

    def __missing__(self, chunk: bytes) -> bytes | bytearray:
        found = self.old.get(chunk)
        if found is None:
            self.new[chunk] = found = bytearray()
        self[chunk] = found
        return found

    def learn(self) -> None:
        texts = {c: c.decode() for c in self.new}
        plain = [c for c, t in texts.items() if self.table and _PLAIN(t)]
        if plain:
            pre = _PRE("\n".join(texts[c] for c in plain).lower())
            ids = bytes(memoryview(self.table.encode_to_tiktoken_buffer(_MARK.join(pre) + _MARK, set())))
            ends = np.flatnonzero(np.frombuffer(ids, "<u4") == self.line) * 4
            for c, a, b in zip(plain, [0, *(ends + 4).tolist()], [*ends.tolist(), len(ids)]):
                self[c] = ids[a:b]
                self.new.pop(c)[:] = self[c]
        others = list(self.new)
        for c, e in zip(others, self.tok.encode_batch([texts[c] for c in others], add_special_tokens=False)):
            self[c] = struct.pack(f"<{len(e.ids)}I", *e.ids)
            self.new.pop(c)[:] = self[c]
        if len(self) >= REMEMBERED // 2:
            self.old = dict(self)
            self.clear()

    def encoded(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        k = 0
        while k < len(texts):
            rows, size = [], 0
            while k + len(rows) < len(texts) and size < AT_ONCE:
                size += len(texts[k + len(rows)]) + 1
                rows.append(list(map(self.__getitem__, texts[k + len(rows)].split())))
            self.learn()
            yield from map(b"".join, rows)
            k += len(rows)


class _Pieces:
    def __init__(self, path: str, capacity: int, end_id: int):
        self.path, self.capacity, self.end, self.lost = path, capacity, np.array([end_id], "<u4").tobytes(), word_table(path)

    def open(self):
        ids_of, width = remembered(self.path, self.lost).encoded, 4 * self.capacity
        part, seen = TaskContext.get().partitionId(), defaultdict(int)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at_doc, rows = [], []
            for doc, ids in enumerate(ids_of(utf8(batch.column(1)))):
                ids += self.end
                for piece, at in enumerate(range(0, len(ids), width)):
                    cut = ids[at : at + width]
                    n = len(cut) // 4
                    at_doc.append(doc)
                    rows.append((piece, at // 4, n, zlib.crc32(cut), part, seen[n]))
                    seen[n] += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at_doc)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

        return step


class Plan:
    """Sequences filled in runs: every run puts `count` items of one length, from a rank on, into as many sequences at one offset."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.rank, self.runs = capacity, 0, defaultdict(int), []
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.mask = 0

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], count, first, offset))
        self.rank[length] += count

    def leave(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            self.gaps[gap].append((first, count))
            self.mask |= 1 << gap

    def best_fit(self, length: int, count: int) -> None:
        """Each item into the tightest gap that holds it, else into a new sequence."""
        while count:
            if fits := self.mask >> length:
                gap = length + (fits & -fits).bit_length() - 1
                first, there = self.gaps[gap].pop()
                if not self.gaps[gap]:
                    self.mask &= ~(1 << gap)
                n = min(count, there)
                self.put(length, n, first, self.capacity - gap)
                self.leave(gap, first + n, there - n)
                self.leave(gap - length, first, n)
                count -= n
            else:
                n = -(-count // (self.capacity // length))
                self.leave(self.capacity, self.bins, n)
                self.bins += n

    def fresh(self, count: int) -> int:
        """The first of `count` new sequences."""
        self.bins += count
        return self.bins - count


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within capacity (unbounded)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k, (s, v) in enumerate(zip(sizes, values)):
        if v <= 1e-12:
            continue
        for at in range(s, capacity + 1, s):
            block = slice(at, min(at + s, capacity + 1))
            new = best[at - s : block.stop - s] + v
            better = new > best[block] + 1e-12
            best[block] = np.where(better, new, best[block])
            last[block] = np.where(better, k, last[block])
    at, picked = int(np.argmax(best)), np.zeros(len(sizes))
    value = float(best[at])
    while at > 0 and last[at] >= 0:
        picked[last[at]] += 1
        at -= int(sizes[last[at]])
    return value, picked


def configurations(sizes: np.ndarray, needs: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[int, np.ndarray]]:
    """Column generation for the configuration programme over few sizes: (whole times, items of each size)."""
    k = len(sizes)
    basis = np.diag(np.maximum(1, capacity // sizes).astype(float))
    for _ in range(rounds):
        x = np.linalg.solve(basis, needs)
        price = np.linalg.solve(basis.T, np.ones(k))
        value, column = _knapsack(sizes, price, capacity)
        if value <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
    x = np.linalg.solve(basis, needs)
    return [(int(t + 1e-9), basis[:, j]) for j, t in enumerate(x) if t >= 1]


def grouped(counts: dict[int, int], groups: int) -> dict[int, int]:
    """Lengths, sorted and cut into groups of equal cardinality, each rounded up to its group's largest; groups of one largest are one."""
    cut, need, size, taken = -(-sum(counts.values()) // groups), defaultdict(int), 0, 0
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            if not size or taken == cut:
                size, taken = x, 0
            m = min(n, cut - taken)
            need[size], taken, n = need[size] + m, taken + m, n - m
    return dict(need)


def linear_grouping(counts: dict[int, int], capacity: int, groups: int = 12, large: float = 1 / 8, share: float = 1.0) -> Plan:
    """The plan of one grouping. A configuration's slot takes the largest actual item that its rounded size holds, and its last slot the
    largest that the sequence still holds. `share` of each configuration's sequences are made so; items left over go best-fit."""
    plan, left = Plan(capacity), dict(counts)
    if n := left.pop(capacity, 0):
        plan.put(capacity, n, plan.fresh(n), 0)
    need = grouped({x: n for x, n in left.items() if x > large * capacity}, groups)
    sizes = np.array(sorted(need, reverse=True), np.int64)
    there = sum(1 << x for x in left if x > large * capacity)
    for times, column in configurations(sizes, np.array([float(need[int(x)]) for x in sizes]), capacity) if need else []:
        times = int(times * share)
        parts = [(plan.fresh(times), times, 0)] if times else []
        slots = [int(x) for x, k in zip(sizes, np.rint(column).astype(int)) for _ in range(k)]
        for at, size in enumerate(slots):
            after = []
            while parts:
                first, count, used = parts.pop()
                most = capacity - used if at == len(slots) - 1 else size
                x = (there & ((2 << most) - 1)).bit_length() - 1
                if x <= 0:
                    after.append((first, count, used))
                    continue
                n = min(count, left[x])
                plan.put(x, n, first, used)
                left[x] -= n
                if not left[x]:
                    there &= ~(1 << x)
                after.append((first, n, used + x))
                if count > n:
                    parts.append((first + n, count - n, used))
            parts = after
        for first, count, used in parts:
            plan.leave(capacity - used, first, count)
    for x in sorted(left, reverse=True):
        plan.best_fit(x, left[x])
    return plan


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Plain best fit: a yardstick for tests, not used for packing."""
    plan = Plan(capacity)
    for x in sorted(counts, reverse=True):
        plan.best_fit(x, counts[x])
    return plan


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    """The plan with the fewest sequences of several groupings; none is tried after one that reaches the lower bound."""
    bound, best = -(-sum(x * n for x, n in counts.items()) // capacity), None
    for groups, large, share in GROUPINGS:
        plan = linear_grouping(counts, capacity, groups, large, share)
        if best is None or plan.bins < best.bins:
            best = plan
        if best.bins == bound:
            break
    return best


class _Place:
    """Looks the run of (length, rank) up; the table of runs depends on the distinct lengths, not on the number of documents."""

    def __init__(self, runs: list[tuple[int, int, int, int, int]]):
        runs = sorted(runs)
        self.key = np.array([x << 44 | r for x, r, *_ in runs], np.int64)
        self.rank, self.first, self.offset = (np.array([r[k] for r in runs], np.int64) for k in (1, 3, 4))

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
        run = np.searchsorted(self.key, length << 44 | rank, "right") - 1
        return pa.RecordBatch.from_arrays([batch.column(k) for k in range(5)] + [pa.array(self.first[run] + rank - self.rank[run]), pa.array(self.offset[run])], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    slim = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    pieces = staged(map_batches(slim, _Pieces(path, capacity, end_id), with_id(slim, "piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint")), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    plan = make_plan({r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, capacity)
    before = counts.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return map_batches(ranked, _Place(plan.runs), with_id(slim, "piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")).withColumnRenamed("id", id_col)
