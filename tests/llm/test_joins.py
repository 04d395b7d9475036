import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from support import rows

from millrace.llm import ngram_join, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(corpus, n=5):
    out = []
    for _, t, *_ in corpus:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("percent", [90, 60])
def test_similar_is_brute_force(docs, corpus, percent):
    s = sets(corpus)
    near = [[j for j in range(len(s)) if j != i and s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])] for i in range(len(s))]
    least = [c[0] for c in corpus]
    for _ in range(len(s)):
        least = [min([x for x in [least[i], *(least[j] for j in near[i])] if x is not None], default=None) for i in range(len(s))]
    want = sorted(((corpus[i][0], len(s[i]), len(near[i]), least[i]) for i in range(len(s))), key=repr)
    got = ngram_join.similar(docs, percent=percent)
    assert rows(got.select("doc_id", "n_shingles", "n_similar", "component_id")) == want
    assert sum(map(len, near)) > 20


def test_similar_shuffled_path_and_empty(docs, empty, monkeypatch):
    """Beyond the bound of a broadcast the same rows come from shuffled joins."""
    want = rows(ngram_join.similar(docs))
    monkeypatch.setattr(ngram_join, "if_small", lambda df: df)
    assert rows(ngram_join.similar(docs)) == want
    assert ngram_join.similar(empty).count() == 0


def test_one_of_each(docs, corpus):
    kept = [r["doc_id"] for r in ngram_join.one_of_each(docs).collect()]
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.similar(docs).collect() if r["doc_id"] is not None}
    assert Counter(k for k in kept if k is not None) == Counter(k for k, c in found.items() if k == c)
    assert kept.count(None) == 1, "the copy without an id goes, the lone one stays"


def test_components(spark):
    draw = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 60, (45, 2))] + [(100 + k, 101 + k) for k in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["u"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(find(u) == r for u, r in got.items())
    assert {x for x in parent if find(x) != x} <= set(got)


def brute(corpus, size):
    texts = [(t or "").encode() for _, t, *_ in corpus]
    seen = Counter(t[k : k + size] for t in texts for k in range(len(t) - size + 1))
    out = []
    for (doc, *_), t in zip(corpus, texts):
        covered = bytearray(len(t) + 1)
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                covered[k : k + size] = b"\1" * size
        kept = bytes(b for b, c in zip(t, covered) if not c)
        out.append((doc, len(t), sum(covered), bytes(covered).count(b"\1\0"), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size,gram", [(200, 40), (50, 10), (24, 6)])
def test_removed_is_brute_force(docs, corpus, size, gram):
    assert rows(repeats.removed(docs, size=size, gram=gram)) == brute(corpus, size)


def test_removed_from_nothing(empty):
    assert repeats.removed(empty).count() == 0


def test_removed_from_texts_of_many_pieces(spark, monkeypatch):
    """With tiny pieces nearly every region is cut; the rows must not change."""
    draw = np.random.default_rng(3)
    say = lambda n: draw.integers(97, 101, n).astype(np.uint8).tobytes().decode()
    a, b = say(3000), say(700)
    data = [(0, a), (1, say(500) + a[300:1900] + say(90)), (2, b + b[:400] + a[2500:]), (3, say(2500)), (4, a[:1200] + "x" + a[1201:2000]), (5, "ab" * 900)]
    monkeypatch.setattr(repeats, "PIECE", 777)
    repeats._tables.cache_clear()
    found = [t.encode() for _, t in data]
    spans = {k: [] for k, _ in data}
    parts = []
    for number, first, many, anchor, region in repeats.regions(found, 200, 40):
        parts += list(zip(number.tolist(), first.tolist(), many.tolist()))
    for k, first, many in parts:
        number, start, n, place, core, whole = repeats.blocks(found[k], np.array([first]), np.array([many]), 200, 40, 16)
        spans[k] += [w for s, c in zip(start, n) for w in range(s, s + c)]
    for k, t in enumerate(found):
        assert sorted(spans[k]) == list(range(len(t) - 199)), "every window is in one block of one region"
    monkeypatch.undo()
    repeats._tables.cache_clear()
    table = spark.createDataFrame(data, "doc_id bigint, text string")
    assert rows(repeats.removed(table)) == brute([(k, t) for k, t in data], 200)


def test_regions_of_pieces():
    """A text longer than a piece has the same windows, each once."""
    text = np.random.default_rng(0).integers(97, 100, 3 * repeats.PIECE // 2).astype(np.uint8).tobytes()
    number, first, many, _, _ = (np.concatenate(x) for x in zip(*repeats.regions([text, b"short", text[:5000]], 200, 40)))
    for k, n in ((0, len(text)), (2, 5000)):
        starts = np.concatenate([np.arange(a, a + m) for a, m in zip(first[number == k], many[number == k])])
        assert np.array_equal(np.sort(starts), np.arange(n - 199))


def test_without_repeats_keeps_rows_and_whole_signs(docs, corpus):
    got = repeats.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(corpus)
    by = {r["doc_id"]: r["text"] for r in got.collect()}
    assert by[3] == "" or len(corpus[3][1].encode()) < 200
    assert by[46] is None or isinstance(by[46], str)


def test_orders_filter_and_lose_no_link(spark):
    """The other orders throw out pairs that the first lets pass, each some that the other keeps; every link passes all."""
    draw = np.random.default_rng(5)
    texts = []
    for _ in range(60):
        base = [f"w{x}" for x in draw.integers(0, 10**6, 200)]
        for cut in (0, 1, 2, 4, 9, 15):  # fewer and fewer shingles in common
            w = list(base)
            for at in draw.choice(200, cut, replace=False):
                w[at] = f"v{draw.integers(0, 10**6)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    for name, step in ngram_join.shingles(ngram_join.F.col("text")):
        df = df.withColumn(name, step)
    whole = ngram_join.staged(df.select(ngram_join.F.col("id").alias("k"), "s", ngram_join.F.size("s").alias("n"), *ngram_join.signs(ngram_join.F.col("s"), ngram_join.F.size("s"), 3, 90)), "whole")
    every = whole.select("k").crossJoin(whole.select(ngram_join.F.col("k").alias("k2"))).filter("k < k2 and floor(k / 6) = floor(k2 / 6)")
    links = {tuple(r) for r in ngram_join._links(every, whole, 90).collect()}
    assert len(links) >= 60
    passed = [{tuple(r) for r in ngram_join._filtered(every, whole.drop(*drop).withColumnRenamed("o1" if drop else "o0", "o0"), n, 90).collect()} for drop, n in (((), 2), (("o0",), 2), ((), 3))]
    one, other, both = passed
    assert links <= both == one & other and both < one and both < other and len(one) < every.count()


def test_near_misses_of_a_group_read_no_whole_sets(spark, monkeypatch):
    """Most pairs of a group of texts made from one are not similar; few more than the links get as far as the whole sets."""
    draw = np.random.default_rng(8)
    base, texts = [f"w{k}" for k in range(400)], []
    for k in range(70):
        w = list(base)
        for at in draw.choice(400, 1 if k < 12 else 6, replace=False):
            w[at] = f"v{draw.integers(0, 10**9)}"
        texts.append(" ".join(w))
    s = sets([(k, t) for k, t in enumerate(texts)])
    near = [sum(j != i and 100 * len(x & y) >= 90 * len(x | y) for j, y in enumerate(s)) for i, x in enumerate(s)]
    met, links = [], ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda pairs, *rest: met.append(pairs.count()) or links(pairs, *rest))
    got = ngram_join.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert rows(got.select("doc_id", "n_similar")) == sorted(enumerate(near), key=repr)
    assert 60 < sum(near) / 2 <= met[0] < 1.3 * sum(near) / 2 < 70 * 69 / 2 / 4


def test_parities_are_a_bound(spark):
    """Bits that differ are never more than the elements that do, at any two sizes; where few elements differ, nearly all show."""
    F, draw = ngram_join.F, np.random.default_rng(9)
    some = lambda n: draw.integers(-(2**63), 2**63, n, dtype=np.int64).tolist()
    kept = some(5000)
    data = [(k, sorted({*kept[:n], *some(m)})) for k, (n, m) in enumerate([(1, 0), (2, 0), (0, 31), (32, 0), (30, 3), (64, 0), (60, 8), (400, 0), (400, 20), (510, 3), (500, 20), (0, 400), (5000, 0), (5000, 90)])]
    table = spark.createDataFrame(data, "k int, s array<bigint>").withColumn("p", ngram_join.parities(F.col("s"), F.size("s")))
    both = table.crossJoin(table.toDF("k2", "s2", "p2")).select("k", "k2", F.size("p").alias("words"), ngram_join._apart(F.col("p"), F.col("p2")).alias("h")).collect()
    size = {k: len(s) for k, s in data}
    apart = {(a, b): len(set(s) ^ set(t)) for a, s in data for b, t in data}
    assert all(2 * size[r["k"]] <= 64 * r["words"] <= max(128, 4 * size[r["k"]]) for r in both)
    assert all(r["h"] <= apart[r["k"], r["k2"]] and (r["h"] - apart[r["k"], r["k2"]]) % 2 == 0 for r in both)
    assert all(r["h"] >= 0.8 * apart[r["k"], r["k2"]] for r in both if {r["k"], r["k2"]} in ({7, 8}, {9, 10}, {12, 13}))


def test_element_of_thousands_of_classes(spark):
    """One five-word passage in 3,000 texts of many lengths, most otherwise unlike: few pairs meet, and the near copies are found."""
    draw = np.random.default_rng(6)
    texts = ["same five words in all " + " ".join(f"w{x}" for x in draw.integers(0, 10**7, draw.integers(0, 40))) for _ in range(3000)]
    long = "same five words in all " + " ".join(f"u{k}" for k in range(80))
    texts += [long, long + " end", long + " other"]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: (r["n_similar"], r["component_id"]) for r in ngram_join.similar(df).collect()}
    s = sets([(k, t) for k, t in enumerate(texts)])
    short = [k for k in range(len(s)) if len(s[k]) <= 12]
    want = Counter(a for a in short for b in short if a != b and 100 * len(s[a] & s[b]) >= 90 * len(s[a] | s[b]))
    assert [got[k] for k in range(3000, 3003)] == [(2, 3000)] * 3
    assert all(got[k][0] == want[k] for k in short) and all(got[k] == (0, k) for k in range(3000) if len(s[k]) > 12)


def test_repeated_rows_take_no_places(spark):
    """Equal rows of a class are one class row; else they would fill its prefix and hide links."""
    base = [f"w{k}" for k in range(60)]
    other = base[:30] + ["x"] + base[31:]
    df = spark.createDataFrame([(1, " ".join(base))] * 30 + [(2, " ".join(base + ["tail"]))] * 30 + [(3, " ".join(other))], "doc_id bigint, text string")
    assert set(rows(ngram_join.similar(df).select("doc_id", "n_similar", "component_id"))) == {(1, 59, 1), (2, 59, 1), (3, 0, 3)}


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "none")], "doc_id string, text string")
    assert rows(ngram_join.similar(df).select("doc_id", "n_similar", "component_id")) == [("a", 1, "a"), ("b", 1, "a"), ("c", 0, "c")]
    assert rows(ngram_join.one_of_each(df).select("doc_id")) == [("a",), ("c",)]
