import random
from collections import Counter

import pytest

from millrace.llm import suffixes


@pytest.mark.parametrize("n,letters", [(29, "ab"), (100, "abc"), (61, "a"), (90, "ab")])
def test_suffix_array_is_sorted_suffixes(spark, n, letters):
    draw = random.Random(n)
    text = "".join(draw.choice(letters) for _ in range(n))
    got = suffixes.suffix_array(spark.createDataFrame([(k, ord(c)) for k, c in enumerate(text)], "pos bigint, sym bigint"), base=20).collect()
    assert [r["pos"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(range(n), key=lambda k: text[k:])
    assert sorted(r["rank"] for r in got) == list(range(n))


def test_repeated_starts_are_brute_force(spark):
    draw = random.Random(1)
    say = lambda n: "".join(draw.choice("abcd") for _ in range(n))
    shared = say(40)
    texts = [say(30) + shared, shared + say(20), say(60), None, "", "é" * 12, say(25) + shared[5:35] + say(5)]
    seen = Counter(t.encode()[k : k + 12] for t in texts if t for k in range(len(t.encode()) - 11))
    want = sorted((t, k) for t in texts if t for k in range(len(t.encode()) - 11) if seen[t.encode()[k : k + 12]] > 1)
    got = suffixes.repeated_starts(spark.createDataFrame([(t,) for t in texts], "text string"), size=12, base=50).collect()
    assert sorted(tuple(r) for r in got) == want and want
