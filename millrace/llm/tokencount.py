"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that come back as exactly one token are proved whole. A pre-token that is
such a string counts one without any merging, and only the rest go through the byte-pair merges. Counts of chunks between single
spaces are remembered up to a fixed number of chunks, which bounds a worker's memory whatever the corpus holds.

Cases: null text counts as empty; an empty text has 0 tokens; very long texts are read chunk by chunk; repeated rows each give a row;
an empty table gives an empty table; other columns are ignored, so clashing names do no harm. Texts holding a special string's opening
go whole through the library, which treats those strings as its default says.
"""

from __future__ import annotations

from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.common import map_batches, remember, utf8

#: Chunks whose counts a worker remembers; only speed depends on it.
REMEMBERED = 250_000
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CUT = regex.compile(r"(?<=\S) (?=\S)")
_BROKEN = -(1 << 48)


def byte_letters() -> str:
    """The letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(rest)) for b in range(256))


_LETTERS = byte_letters()
_TO_LETTERS = {b: _LETTERS[b] for b in range(256)}
_TO_BYTES = {letter: b for b, letter in enumerate(_LETTERS)}


@lru_cache(maxsize=4)
def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def proved_whole(path: str) -> frozenset[str]:
    """The vocabulary's texts that the library, given each alone, encodes as that one token."""
    tok = load(path)
    texts, ids = [], []
    for piece, i in tok.get_vocab(with_added_tokens=False).items():
        try:
            texts.append(bytes(_TO_BYTES[c] for c in piece).decode())
            ids.append(i)
        except (KeyError, UnicodeDecodeError):
            continue
    found = tok.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, i, e in zip(texts, ids, found) if e.ids == [i])


class Counts(dict):
    """Chunk (its leading space left out) to its number of tokens."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.whole, self.model, self.tok = whole, load(path).model, load(path)
        self.marks = [t.content[:2] for t in self.tok.get_added_tokens_decoder().values()]

    def __missing__(self, chunk: str) -> int:
        n = self.merged(" " + chunk) if chunk and not chunk[-1].isspace() else _BROKEN
        if len(self) >= REMEMBERED:
            self.clear()
        self[chunk] = n
        return n

    def merged(self, text: str) -> int:
        n = 0
        for pre in _PRE.findall(text):
            n += 1 if pre in self.whole else len(self.model.tokenize(pre.encode().decode("latin-1").translate(_TO_LETTERS)))
        return n

    def count(self, text: str) -> int:
        if any(m in text for m in self.marks):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            n = self.merged(first) + sum(map(self.__getitem__, rest))
            if n >= 0:
                return n
        # Runs of white space: cut only where a single space stands between two other characters.
        first, *rest = _CUT.split(text)
        return self.merged(first) + sum(self.merged(" " + x) for x in rest)


class _Step:
    def __init__(self, path: str, whole: frozenset[str], limit: int):
        self.path, self.whole, self.limit = path, whole, limit

    def open(self):
        counts = remember(f"counts {self.path}", lambda: Counts(self.path, self.whole))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = utf8(batch.column(1))
            n = [counts.count(t.decode()) for t in texts]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > self.limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

        return step


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """One row for each row of df: id_col (bigint), n_bytes, n_tokens as the library gives them, over_limit."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    slim = df.select(df[id_col].cast("bigint").alias("id"), df[text_col].cast("string").alias("text"))
    out = map_batches(slim, _Step(path, proved_whole(path), limit), "id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
