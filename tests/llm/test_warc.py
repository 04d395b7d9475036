import hashlib
import random

import pytest

from support import rows

from millrace.llm import warc

PAGES = "page_id bigint, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    draw = random.Random(5)
    big = ["<p>" + "".join(draw.choice("abé\n") for _ in range(n)) for n in (1200, 999, 5000)]
    data = [(k, f"http://www.h{k % 3}.com:80/p{k % 4}?q={k % 2}#f", big[k % 3]) for k in range(40)]
    data += [(40, None, None), (41, "", ""), (42, "http://h/\r\nX: y", "short"), (43, "http://h/", "short"), (None, "http://h/", big[0]), (44, "not a url", "x" * 1000), (44, "not a url", "x" * 1000)]
    return data


def test_archives_and_index(spark, pages):
    got = warc.archived(spark.createDataFrame(pages, PAGES), archive_bytes=4000).collect()
    assert len(got) == len(pages)
    heads: dict = {}
    for k, _, html in pages:
        p = (html or "").encode()
        if len(p) >= 1000 and k is not None:
            heads[p] = max(k, heads.get(p, -1))
    want = []
    for k, _, html in pages:
        p = (html or "").encode()
        head = heads.get(p)
        revisit = head is not None and k is not None and head != k
        want.append((k, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
    assert rows(warc.archived(spark.createDataFrame(pages, PAGES)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == sorted(want, key=repr)
    keys = [(r["urlkey"], r["ts"]) for r in got]
    assert keys == sorted(keys), "partitions in order make the global order"


@pytest.mark.parametrize("fan_in", [2, 3])
def test_more_runs_than_fan_in(spark, pages, fan_in):
    manifest = warc.write_archives(spark.createDataFrame(pages, PAGES).repartition(5), archive_bytes=2000)
    assert manifest.count() > fan_in**2, "several passes"
    a = [tuple(r) for r in warc.capture_index(manifest, fan_in=fan_in, range_rows=7).collect()]
    b = [tuple(r) for r in warc.capture_index(manifest).collect()]
    assert a == b == sorted(a, key=warc._key) and len(a) == len(pages)


def test_odd_columns(spark):
    """Clashing names, names that need quotes, a hot URL with many captures: all rows, in order."""
    data = [(k, "http://hot/", "x" * 10, 1, "y") for k in range(300)]
    df = spark.createDataFrame(data, "page_id bigint, url string, `my html` string, archive int, head string")
    got = warc.capture_index(warc.write_archives(df, payload_col="my html"), range_rows=20).collect()
    assert [r["page_id"] for r in got] == list(range(300))


def test_empty(spark):
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("k", range(0, 9))
def test_loser_tree(k):
    draw = random.Random(k)
    runs = [sorted(((draw.choice("abc"), draw.randint(0, 4), draw.randint(0, 9), "", 0, "", None, str(i), j, 0) for j in range(draw.randint(0, 6))), key=warc._key) for i in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(sum(runs, []), key=warc._key)


def test_urlkey():
    assert [warc.urlkey(u) for u in ("http://www.A.com:80/x?y#z", "https://u@b.a.com", "", "/p")] == ["com,a)/x?y", "com,a,b)/", ")/", ")/p"]
