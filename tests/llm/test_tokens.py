import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from millrace.llm import packing, tokencount

DATA = "/root/testdata/sf0.01"
HARD = ["", "a", "it's  two  spaces", " lead", "trail ", "\n\n x \t y\r\n", "<|endoftext|>", "a <|endoftext|> b<|startoftext|>c", "naïve café     x", "\x1cx\x1d y", "İSTANBUL Σας", "日本語 テキスト", "á é", "12 345,6!!??", "x" * 500, "I'LL we've"]


@pytest.fixture(scope="module")
def texts(corpus):
    return HARD + [r[1] or "" for r in corpus]


def test_counts_are_the_library_s(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts = tokencount.Counts(path, tokencount.proved_whole(path))
    assert [counts.count(t) for t in texts] == [len(e.ids) for e in tokencount.load(path).encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_library_s(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = [np.array(e.ids, "<u4").tobytes() for e in tokencount.load(path).encode_batch(texts, add_special_tokens=False)]
    for lost in (packing.word_table(path), None):  # by the merge table, and all by the library
        ids = packing._Ids(path, lost)
        assert list(ids.encoded([t.encode() for t in texts])) == want
        assert list(ids.encoded([t.encode() for t in reversed(texts)])) == want[::-1]


def test_memory_of_chunks_forgets(texts, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    monkeypatch.setattr(packing, "AT_ONCE", 50)
    ids = packing._Ids(path, packing.word_table(path))
    want = [np.array(e.ids, "<u4").tobytes() for e in tokencount.load(path).encode_batch(texts, add_special_tokens=False)]
    assert list(ids.encoded([t.encode() for t in texts])) == want
    assert len(ids) + len(ids.old) < 3000


def test_merge_table_is_proved():
    """A token that its signs alone do not make is left out; a file of another kind is not read as a word table."""
    merges = {("a", "b"): 0, ("b", "c</w>"): 1, ("a", "bc</w>"): 2}
    assert packing.unreached({"a": 0, "ab": 1, "bc</w>": 2, "abc</w>": 3}, merges) == {"abc</w>"}
    assert packing.word_table(public_tokenizers.path("word_bpe_49k.json")) == ()
    assert packing.word_table(public_tokenizers.path("byte_bpe_50k.json")) is None


def test_count_table(docs, corpus, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = sorted(tuple(r) for r in tokencount.token_counts(docs).filter("doc_id is not null").collect())
    n = {t: len(tokencount.load(path).encode(t or "", add_special_tokens=False).ids) for _, t, *_ in corpus}
    assert got == sorted((k, len((t or "").encode()), n[t], n[t] > 512) for k, t, *_ in corpus if k is not None)
    assert tokencount.token_counts(empty).count() == 0


def packed_rows(df, **options):
    return [tuple(r) for r in packing.packed(df, **options).collect()]


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_is_whole_and_gapless(docs, corpus, capacity):
    got = packed_rows(docs, capacity=capacity)
    tok = tokencount.load(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for k, t, *_ in corpus:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            want[(k, piece, at, len(cut), zlib.crc32(cut.tobytes()))] += 1
    assert Counter(r[:5] for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r[5]].append((r[6], r[3]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity


def test_empty_table_packs_to_nothing(empty):
    assert packed_rows(empty) == []


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_few_sequences(seed):
    draw = np.random.default_rng(seed)
    lengths = np.minimum(4096, np.maximum(1, draw.lognormal(6, 1.2, 3000).astype(int)))
    counts = {int(k): int(v) for k, v in Counter(lengths.tolist()).items()}
    least = -(-int(lengths.sum()) // 4096)
    for plan in (packing.linear_grouping(counts, 4096), packing.make_plan(counts, 4096)):
        assert dict(plan.rank) == counts
        filled = Counter()
        for length, _, n, first, offset in plan.runs:
            for b in range(first, first + n):
                assert offset == filled[b], "runs are written in the order that they fill a sequence"
                filled[b] += length
        assert max(filled.values()) <= 4096 and len(filled) <= plan.bins <= 1.03 * least + 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_grouping_reaches_plain_best_fit_on_the_tables():
    """On the lengths of sf0.01 the grouping's plan needs as few sequences as plain best fit, and as the lower bound."""
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [(t or "").encode() for t in pq.read_table(f"{DATA}/documents.parquet", columns=["text"])["text"].to_pylist()]
    counts = Counter()
    for ids in packing._Ids(path, packing.word_table(path)).encoded(texts):
        whole, rest = divmod(len(ids) // 4 + 1, 4096)
        counts.update({4096: whole} if whole else {})
        counts.update({rest: 1} if rest else {})
    made = packing.make_plan(dict(counts), 4096)
    assert made.bins <= packing.best_fit_decreasing(dict(counts), 4096).bins
    assert made.bins == -(-sum(x * n for x, n in counts.items()) // 4096)


def test_hard_lengths_need_configurations():
    """Three pieces of a third and pairs just over a half: the programme finds the best, here one sequence for each two large ones."""
    counts = {2100: 30, 1990: 30, 1300: 60, 1496: 30}
    assert packing.make_plan(counts, 4096).bins <= 61
