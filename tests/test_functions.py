from pyspark.sql import functions as F

from support import rows

from millrace.functions import metrics, text, uri
from millrace.operators import agents, asof, crawl
from millrace.sources import generators


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_names(spark):
    assert [one(spark, uri.escape_uri(F.lit(x))) for x in ("hello-world", "hello_world", "/hello/world#foo")] == ["hello__world", "hello_world", "__hello__world__foo"]
    assert one(spark, uri.keyspace(F.lit("foo/bar#howdy"))) == "universe_foo__bar__howdy"
    assert one(spark, uri.update_schema(F.array(F.lit("/std/text/prompt"), F.lit("/std/my/foo")))) == "(document_uri, __std__text__prompt, __std__my__foo)"
    assert one(spark, uri.column_type(F.lit("/std/int64"))) == "bigint"
    spaces = {"ns1": "prefix1/", "ns2": "prefix2"}
    assert one(spark, uri.resolve_all(F.array(*map(F.lit, ("ns1:key1", "ns2:a:b", "key4"))), spaces)) == ["prefix1/key1", "prefix2/a:b", "key4"]
    assert one(spark, uri.resolve_map(F.create_map(F.lit("ns1:k"), F.lit("ns1:v")), spaces, True, True)) == {"prefix1/k": "prefix1/v"}
    assert one(spark, uri.key_values(F.lit("a=b,c=d=e"))) == {"a": "b", "c": "d=e"}
    assert one(spark, uri.literal_text(F.lit("it's"))) == "'it''s'"


def test_bad_names_are_errors(spark):
    import pytest

    for bad in (uri.column_type(F.lit("unknown")), uri.resolve(F.lit("zz:k")), uri.key_values(F.lit("a"))):
        with pytest.raises(Exception):
            one(spark, bad)


def test_cells(spark):
    got = [one(spark, uri.cell(F.lit(x))) for x in ('"a"', "1", "2.5", "true", "[1]", "null")]
    assert [tuple(g) if g else None for g in got] == [("a", None, None, None), (None, 1, None, None), (None, None, 2.5, None), (None, None, None, True), None, None]


def test_text(spark):
    assert one(spark, text.answer_json(F.lit('<thinking>x</thinking><answer>\n{"kind": "photo", "score": 3}\n</answer>'), "kind string, score int")).asDict() == {"kind": "photo", "score": 3}
    assert one(spark, text.answer(F.lit("none"))) is None
    got = one(spark, text.token_windows(F.array(*(F.lit(str(k)) for k in range(5))), 4, 2))
    assert got == [["0", "1", "2", "3"], ["2", "3", "4", "<pad>"]]
    assert one(spark, text.inputs_and_labels(F.array(*map(F.lit, "abc")))).asDict() == {"inputs": ["a", "b"], "labels": ["b", "c"]}
    assert [one(spark, text.roman(F.lit(x))) for x in ("I", "III", "IV", "XC", "LXXXIX", "VCII")] == [1, 3, 4, 90, 89, 97]
    assert [one(spark, text.full_match(F.lit(a), b)) for a, b in (("ab", ".*"), ("aa", "a"), ("ab", ".*c"))] == [True, False, False]
    assert text.prompt_for("c", {"b": "B"}, ["a", "b"], "d") == "B" and text.prompt_for("c", {}, [], "d") == "d"
    assert text.describe_json({"properties": {"k": {"type": "int", "description": "a number"}}}) == "k (int): a number"


def test_links(spark):
    schemes = {"http://": True, "https://": True, "z39.50://": True, "web+soup://": True, "//x": False, "/search": False, "search": False}
    assert {k: one(spark, F.lit(k).rlike(crawl.SCHEME)) for k in schemes} == schemes
    norm = lambda link, url: one(spark, crawl.normal_link(F.lit(link), F.lit(url)))
    assert [norm(x, "http://a.com") for x in ("/foo", "bar", "//www.w.org")] == ["/foo", "/bar", "http://www.w.org"]
    assert [norm(x, "https://a.com/a/a/a") for x in ("/foo", "bar", "//www.w.org")] == ["/foo", "/a/a/bar", "https://www.w.org"]
    assert one(spark, crawl.full_url(F.lit("h"), F.lit("/p"))) == "https://h/p"
    key = lambda p, t, r: one(spark, crawl.lossy_key(F.lit(p), F.lit(t), F.lit(r)))
    assert key(2, 5, 1) < key(2, 6, 0) and key(1, 9, 0) < key(2, 5, 1) and len(key(1, 2, 3)) == 32


def test_spider_trap_stops_at_budget(spark):
    trap = lambda wanted: wanted.select("url", F.concat("url", F.lit("x")).alias("next"))
    assert crawl.crawl(spark.createDataFrame([("a",)], "url string"), trap, budget=6, rounds=20).count() == 6
    assert crawl.crawl(spark.createDataFrame([("a",)], "url string"), trap, rounds=3).count() == 3


def test_robots(spark):
    paths = spark.createDataFrame([("h", "/"), ("h", "/no/x"), ("h", "/no/yes/x"), ("g", "/a")], "host string, path string")
    rules = spark.createDataFrame([("h", "/no", False), ("h", "/no/yes", True), ("h", "/", True)], "host string, prefix string, allow boolean")
    assert rows(crawl.allowed(paths, rules)) == sorted([("h", "/", True), ("h", "/no/x", False), ("h", "/no/yes/x", True), ("g", "/a", True)], key=repr)


def test_metrics(spark):
    import math

    got = metrics.sine_wave(spark, 5, 10**8, 4).orderBy("time_ns").collect()
    assert [r["time_ns"] for r in got] == [5 + k * 10**8 for k in range(4)]
    assert all(abs(r["value"] - math.sin(2 * math.pi * k / 10)) < 1e-12 for k, r in enumerate(got))
    values = F.array(*(F.lit(float(k)) for k in range(10)))
    assert one(spark, metrics.format_series(values, 1000)).startswith("0.0000 1.0000")
    short = one(spark, metrics.format_series(values, 30))
    assert short.endswith("... 9.0000") and len(short) <= 30


def test_asof_and_range(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z")], "k string, t int, v string")
    assert rows(asof.asof_join(left, right, ["k"], "t", "t").select("k", "t", "r_v")) == sorted([("a", 5, "y"), ("a", 1, None), ("b", 9, None)], key=repr)
    points, ranges = spark.range(20), spark.createDataFrame([(0, 5, "p"), (3, 12, "q")], "lo long, hi long, n string")
    got = asof.range_join(points, ranges, "id", "lo", "hi", 4).select("id", "n")
    assert rows(got) == sorted([(k, n) for k in range(20) for lo, hi, n in ((0, 5, "p"), (3, 12, "q")) if lo <= k < hi], key=repr)


def test_agents(spark):
    import pytest

    mine = spark.createDataFrame([("a", {"x": "1"}, "running")], "agent_id string, properties map<string,string>, status string")
    new = spark.createDataFrame([("b", {"y": "2"}, "running")], mine.schema)
    both = agents.create(mine, new)
    assert both.count() == 2
    with pytest.raises(Exception, match="agent exists"):
        agents.create(both, new).collect()
    assert agents.changed(both, "agent_id", ["b"], "paused").filter("status = 'paused'").count() == 1
    assert one(spark, agents.set_property(F.create_map(F.lit("k"), F.lit("v")), "k", "w")) == {"k": "w"}
    assert one(spark, agents.drop_property(F.create_map(F.lit("k"), F.lit("v")), "k")) == {}


def test_generators(spark):
    assert generators.random_rows(spark, 7, 2, 12).count() == 7
    assert all(len(r["c0"]) == 12 for r in generators.random_rows(spark, 7, 2, 12).collect())


def test_robots_files(spark):
    """Groups, wildcards, ends, quotes in patterns, comments, several agents; a host without a file lets all be fetched."""
    from millrace.operators import crawl

    body = "User-agent: a\nUser-agent: bot # us\nDisallow: /x*y\nAllow: /x1y$\nDisallow: /q\\E.\nCrawl-delay: 1\n\nUser-agent: *\nDisallow: /\n"
    robots = spark.createDataFrame([("h", body), ("o", "User-agent: *\r\nDisallow: /p\r\nUser-agent: other\r\nDisallow: /\r\n"), ("n", None)], "host string, body string")
    rules = crawl.robots_rules(robots, "SuperBot/2")
    assert {(r["host"], r["prefix"], r["allow"], r["delay"]) for r in rules.collect()} == {("h", "/x*y", False, 1.0), ("h", "/x1y$", True, 1.0), ("h", "/q\\E.", False, 1.0), ("o", "/p", False, None)}
    paths = spark.createDataFrame([("h", p) for p in ("/x1y", "/x1yz", "/xaay", "/x", "/q\\E.a", "/qE", "/z")] + [("o", "/p/q"), ("o", "/q"), ("n", "/p"), ("gone", "/p")], "host string, path string")
    assert {(r["host"], r["path"]) for r in crawl.allowed(paths, rules).collect() if not r["allowed"]} == {("h", "/x1yz"), ("h", "/xaay"), ("h", "/q\\E.a"), ("o", "/p/q")}
    assert {r["prefix"] for r in crawl.robots_rules(robots, "someone").filter("host = 'h'").collect()} == {"/"}


def test_crawl_has_no_hidden_end(spark):
    """A chain of links is followed to its end; a bound on rounds fails where it leaves urls."""
    import pytest

    from millrace.operators import crawl

    web = spark.createDataFrame([(f"u{k}", f"u{k + 1}") for k in range(6)] + [("u6", None)], "url string, next string")
    seeds = spark.createDataFrame([("u0",)], "url string")
    fetch = lambda wanted: wanted.join(web, "url")
    assert {(r["url"], r["round"]) for r in crawl.crawl(seeds, fetch).collect()} == {(f"u{k}", k) for k in range(7)}
    with pytest.raises(RuntimeError):
        crawl.crawl(seeds, fetch, rounds=3)


def test_agents_not_found(spark):
    import pytest

    from millrace.operators import agents

    rows = spark.createDataFrame([("a", "stopped"), ("b", "running")], "agent_id string, status string")
    assert agents.one(rows, "agent_id", "b").collect() == [("b", "running")]
    with pytest.raises(Exception, match="not found: z"):
        agents.one(rows, "agent_id", "z").collect()
    with pytest.raises(Exception, match="not found: z"):
        agents.without(rows, "agent_id", spark.createDataFrame([("z",)], "agent_id string")).collect()
    channels = spark.createDataFrame([("c", "a", "chat")], agents.CHANNELS)
    with pytest.raises(Exception, match="not found: z"):
        agents.open_channels(channels, spark.createDataFrame([("d", "z", "chat")], agents.CHANNELS), rows).collect()
    with pytest.raises(Exception, match="exists"):
        agents.open_channels(channels, channels, rows).collect()


def test_asof_buckets_are_whole_lines(spark):
    from pyspark.sql import functions as F

    from millrace.operators.asof import asof_join

    left = spark.createDataFrame([(k, k % 2, 3 * k) for k in range(40)] + [(99, None, 50)], "id int, k int, t int")
    right = spark.createDataFrame([(k % 2, 7 * k, k) for k in range(12)] + [(None, 20, 77)], "k int, t int, v int")
    want = sorted(asof_join(left, right, ["k"], "t", "t").collect(), key=repr)
    assert sorted(asof_join(left, right, ["k"], "t", "t", bucket=F.floor(F.col("_t") / 10)).collect(), key=repr) == want


def test_tiles_of_another_part_fail(spark):
    import pytest
    from pyspark.sql import types as T

    from millrace.operators.partition import KeyHash
    from millrace.sources.store import Group, Store
    from millrace.workspace import fresh_path

    spec = KeyHash(("id",), 2)
    store = Store.create(spark, fresh_path(spark, "tiles"), T.StructType.fromDDL("id bigint, v int"), [Group("g", ("id",), ("v",), spec)])
    rows = spark.range(10).select("id", spec.column().alias("p"), F_lit_one())
    zero = rows.filter("p = 0").drop("p")
    with pytest.raises(ValueError, match="another part"):
        store.append_tiled([("g", "_part=1", zero)], ["v"])
    with pytest.raises(ValueError):
        store.append_tiled([("g", "", zero)], ["v"])
    with pytest.raises(ValueError, match="times"):
        store.append_tiled([("g", "_part=0", zero), ("g", "_part=0", zero)], ["v"])
    assert store.files.names(f"{store.root}/objects") == []
    store.append_tiled([("g", "_part=0", zero)], ["v"])
    assert store.read().count() == zero.count()


def F_lit_one():
    from pyspark.sql import functions as F

    return F.lit(1).alias("v")


def test_bpe_ids_are_the_library_s(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from millrace.functions.bpe import token_ids
    from pyspark.sql import functions as F

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  world", "", None, "naïve café\n", "x" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: r["ids"] for r in df.select("k", token_ids(F.col("t"), path).alias("ids")).collect()}
    tok = Tokenizer.from_file(path)
    assert got == {k: None if t is None else tok.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}


def test_bpe_holds_one_text_s_encoding_and_few_ids(monkeypatch):
    import pyarrow as pa
    from types import SimpleNamespace

    from millrace.functions import bpe

    met = []
    encoded = lambda texts, **options: met.append(len(texts)) or [SimpleNamespace(ids=[ord(c) for c in t]) for t in texts]
    tok = SimpleNamespace(encode_batch=encoded, encode_batch_fast=encoded)
    monkeypatch.setattr("tokenizers.Tokenizer", SimpleNamespace(from_file=lambda path: tok))
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: lambda column: f)
    monkeypatch.setattr(bpe, "AT_ONCE", 50, raising=False)
    texts = ["ab", None, "", None, None, "c" * 30] * 100 + [None]
    out = list(bpe.token_ids(None, "none")(iter([pa.array(texts), pa.array([], pa.string()), pa.array([None, "x"])])))
    assert [r for a in out for r in a.to_pylist()] == [None if t is None else [ord(c) for c in t] for t in [*texts, None, "x"]]
    assert max(met) == 1 and max(len(a.values) for a in out) <= 80


def test_bpe_ids_in_pieces_are_the_library_s(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from millrace.functions import bpe

    monkeypatch.setattr(bpe, "AT_ONCE", 3, raising=False)
    path, texts = public_tokenizers.path("byte_bpe_50k.json"), [None, "", *(f"some words {k}" if k % 3 else None for k in range(60)), "end", None]
    got = {r["k"]: r["ids"] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(2).select("k", bpe.token_ids(F.col("t"), path).alias("ids")).collect()}
    tok = Tokenizer.from_file(path)
    assert got == {k: None if t is None else tok.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}


def test_labelled_files_and_wiki_dumps(spark, tmp_path):
    from millrace.sources.generators import labelled_files, wiki_pages

    for label, name in (("cat", "a.png"), ("dog", "b.png"), ("dog", "c.txt")):
        (tmp_path / "files" / label).mkdir(parents=True, exist_ok=True)
        (tmp_path / "files" / label / name).write_bytes(name.encode())
    got = labelled_files(spark, str(tmp_path / "files"), "*.png").collect()
    assert sorted((r["label"], r["length"], bytes(r["content"])) for r in got) == [("cat", 5, b"a.png"), ("dog", 5, b"b.png")]
    (tmp_path / "dump.xml").write_text("<mediawiki><page><title>A</title><ns>0</ns><revision><text>one &amp; two</text></revision></page><page><title>B</title><ns>0</ns><redirect title='A'/><revision><text>#R</text></revision></page></mediawiki>")
    assert [tuple(r) for r in wiki_pages(spark, str(tmp_path / "dump.xml")).collect()] == [("A", 0, "one & two")]


def test_crawl_goes_on_where_it_broke_off(spark):
    """Finished rounds stay, the broken one is done again, the budget counts what was fetched before."""
    import pytest

    from millrace.operators import crawl
    from millrace.workspace import fresh_path

    web = spark.createDataFrame([(f"u{k}", f"u{k + 1}") for k in range(8)] + [("u8", None)], "url string, next string")
    seeds, root, calls = spark.createDataFrame([("u0",)], "url string"), fresh_path(spark, "rounds"), []

    def fetch(wanted):
        calls.append(1)
        if len(calls) == 4:
            raise OSError("lost")
        return wanted.join(web, "url")

    with pytest.raises(OSError):
        crawl.crawl(seeds, fetch, root=root)
    assert {(r["url"], r["round"]) for r in crawl.crawl(seeds, fetch, budget=6, root=root).collect()} == {(f"u{k}", k) for k in range(6)}
    assert {r["url"] for r in crawl.crawl(seeds, fetch, root=root).collect()} == {f"u{k}" for k in range(9)}


def test_catalog_files_and_datasets(spark, tmp_path):
    import json

    import pytest

    from millrace.sources.documents import Catalog
    from millrace.workspace import fresh_path

    catalog = Catalog(spark, fresh_path(spark, "catalog"))
    items = [{"kind": "universe", "uri": "/u"}, {"kind": "table", "uri": "/t", "universe": "/u", "columns": {"/a": "/std/text", "/b": "/std/double"}}]
    (tmp_path / "spec.json").write_text("\n".join(map(json.dumps, items)))
    catalog.deploy_file(f"file://{tmp_path}/spec.json")
    assert {r["uri"] for r in catalog.list("column").collect()} == {"/a", "/b"}
    assert catalog.table("/t", "/u").schema.names == ["document_uri", "__a", "__b"]
    spark.range(3).write.parquet(f"{tmp_path}/d1")
    catalog.register_dataset("d", f"{tmp_path}/d1", "1", about={"rows": 3})
    assert catalog.dataset("d").count() == 3 and [r["about"] for r in catalog.datasets().collect()] == ['{"rows": 3}']
    for wrong in (lambda: catalog.dataset("e"), lambda: catalog.dataset("d", "2"), lambda: catalog.register_dataset("d", "x", "1")):
        with pytest.raises(ValueError):
            wrong()


def test_schema_from_files(spark):
    from pyspark.sql import types as T

    from millrace.sources.store import Group, Store
    from millrace.workspace import fresh_path

    schema = T.StructType.fromDDL("id bigint, a string, b double")
    store = Store.create(spark, fresh_path(spark, "s"), schema, [Group("x", ("id",), ("a",)), Group("y", ("id",), ("b",))])
    store.append(spark.createDataFrame([(1, "q", 2.0)], schema))
    assert sorted((f.name, f.dataType) for f in store.inferred_schema()) == sorted((f.name, f.dataType) for f in schema)
    assert store.inferred_schema().names[0] == "id"
