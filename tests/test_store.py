import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from support import rows

from millrace.operators.merge import fold, fold_by_joins
from millrace.operators.partition import KeyHash, Window, siphash13, siphash_part
from millrace.sources.documents import Catalog
from millrace.sources.generators import register_numbers
from millrace.sources.log import Ancestor, AsOf, LogError, PriorCheckpoint, Ref, parse
from millrace.sources.store import Group, Store
from millrace.workspace import fresh_path

OVERLAP = [[(0, 3, 4), (1, 4, 5), (2, 5, 6)], [(0, 4, 7), (1, 5, 8), (2, 6, 9)], [(0, 7, 1), (1, 8, 1), (2, 9, 1)]]


def make(spark, kind="int"):
    groups = [Group("cg1", ("id",), ("a", "b"), KeyHash(("id",), 2)), Group("cg2", ("id",), ("c", "d"), KeyHash(("id",), 1))]
    return Store.create(spark, fresh_path(spark, "store"), T.StructType.fromDDL(f"id {kind}, a int, b int, c int, d int"), groups)


def put(spark, store, data, names="c d", kind="int", **options):
    x, y = names.split()
    return store.append(spark.createDataFrame(data, f"id {kind}, {x} int, {y} int"), **options)


def test_single_commit_partitioned(spark):
    store = make(spark)
    put(spark, store, [(k, k + 1, 9 - k) for k in range(9)], "a b")
    assert rows(store.read(columns=["id", "a", "b"])) == [(k, k + 1, 9 - k) for k in range(9)]


def test_disjoint_and_overlapping_commits(spark):
    store = make(spark)
    for base in (0, 3, 6):
        put(spark, store, [(base + k, base + k + 1, 7) for k in range(3)])
    assert rows(store.read(columns=["id", "c"])) == [(k, k + 1) for k in range(9)]
    store = make(spark)
    for commit in OVERLAP:
        put(spark, store, commit)
    assert rows(store.read(columns=["id", "c", "d"])) == OVERLAP[2]


@pytest.mark.parametrize("kind", ["smallint", "int", "bigint", "string"])
def test_id_types(spark, kind):
    store = make(spark, kind)
    for base in (10, 30):
        data = spark.range(9).select(F.col("id").cast(kind).alias("id"), (F.col("id") + base).cast("int").alias("a"), (F.col("id") + base + 10).cast("int").alias("b"))
        store.append(data)
    assert sorted(r["a"] for r in store.read(columns=["id", "a"]).collect()) == list(range(30, 39))
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(1.5, 1)], "id double, a int"))


def test_time_travel_and_references(spark):
    store = make(spark)
    ids = [put(spark, store, c, timestamp=1000 * (k + 1)).id for k, c in enumerate(OVERLAP)]
    read = lambda ref: rows(store.read(ref, ["id", "c", "d"]))
    assert read("main") == OVERLAP[2] and read("main@^") == OVERLAP[1] and read("main@{2}") == OVERLAP[0]
    assert [read(i) for i in ids] == OVERLAP
    assert read(AsOf(Ref(), 2500)) == OVERLAP[1] and read("main@[19700101T000001Z]") == OVERLAP[0]
    for bad in ("main@{3}", "nothing", "main@{x}", AsOf(Ref(), 10), PriorCheckpoint(Ref())):
        with pytest.raises(LogError):
            store.read(bad)
    assert parse("b@^@{2}") == Ancestor(Ancestor(Ref("b")), 2)


def test_null_does_not_overwrite_and_commits_after_checkpoint_are_in_order(spark):
    store = make(spark)
    put(spark, store, [(0, 3, 4), (1, 4, 5), (2, None, 6)])
    put(spark, store, [(0, None, 7), (1, 5, None), (3, 9, 9)])
    assert rows(store.read(columns=["id", "c", "d"])) == [(0, 3, 7), (1, 5, 5), (2, None, 6), (3, 9, 9)]
    store = make(spark)
    put(spark, store, OVERLAP[0])
    store.checkpoint()
    with pytest.raises(LogError):
        store.checkpoint()
    put(spark, store, OVERLAP[1])
    put(spark, store, OVERLAP[2])
    assert rows(store.read(columns=["id", "c", "d"])) == OVERLAP[2]
    assert [r["checkpoint"] for r in store.history().orderBy("age").collect()] == [False, False, True]
    assert rows(store.read(PriorCheckpoint(Ref()), ["id", "c", "d"])) == OVERLAP[0]


def test_interleaved_groups_join_on_id(spark):
    store = make(spark)
    store.append(spark.createDataFrame([(1, 1, 2, 3, 4)], "id int, a int, c int, b int, d int"))
    store.append(spark.createDataFrame([(2, 5)], "id int, d int"))
    assert rows(store.read()) == [(1, 1, 3, 2, 4), (2, None, None, None, 5)]
    assert rows(store.get({"id": 1}, columns=["id", "d"])) == [(1, 4)]


def test_deletes_and_expressions(spark):
    store = make(spark)
    put(spark, store, [(0, 1, 1), (1, 2, 2)])
    put(spark, store, [(0, 10, 5)], expressions={"c": "sum", "d": "max"})
    assert rows(store.read(columns=["id", "c", "d"])) == [(0, 11, 5), (1, 2, 2)]
    store.append(spark.createDataFrame([(0, True)], "id int, _deleted boolean"))
    assert rows(store.read(columns=["id", "c"])) == [(1, 2)]
    put(spark, store, [(0, 3, 3)])
    assert rows(store.read(columns=["id", "c"])) == [(0, 3), (1, 2)]


def test_rival_fast_forward_and_wrong_parent_fail(spark):
    store = make(spark)
    head = put(spark, store, OVERLAP[0])
    late = put(spark, store, OVERLAP[1], advance=False)
    put(spark, store, OVERLAP[2])
    with pytest.raises(LogError):
        store.log.fast_forward("main", late)
    assert not store.files.create(f"{store.log.root}/refs/main/00000001", b"{}")
    before = store.files.names(f"{store.root}/objects")
    with pytest.raises(LogError):
        put(spark, store, OVERLAP[1], parent=head.id)
    assert store.files.names(f"{store.root}/objects") == before, "a failed append leaves nothing"
    assert store.vacuum() == [], "young data may belong to a commit on its way"
    assert len(store.vacuum(age_ms=-1000)) == 1


def test_null_ids_fail(spark):
    with pytest.raises(Exception, match="is null"):
        put(spark, make(spark), [(None, 1, 1)])


def test_part_sizes_open_and_uninitialised(spark):
    store = make(spark)
    commit = store.append(spark.range(1000).select(F.col("id").cast("int").alias("id"), F.lit(1).alias("c"), F.lit(2).alias("d")), part_bytes=5000)
    assert len([f for t in commit.tiles for f in t["files"]]) > 3
    again = Store.open(spark, store.root)
    assert again.log.head().id == commit.id and again.read().count() == 1000
    with pytest.raises(LogError):
        Store.open(spark, fresh_path(spark, "none"))
    with pytest.raises(LogError):
        Store.create(spark, store.root, store.schema, store.groups)
    with pytest.raises(LogError):
        make(spark).read()


def test_blob_round_trip(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/deep/x").write_bytes(bytes(range(256)) * 40)
    store = make(spark)
    store.restore_blob(store.commit_blob(str(tmp_path / "in")), str(tmp_path / "out"))
    assert (tmp_path / "out/deep/x").read_bytes() == bytes(range(256)) * 40


def test_fold_equals_joins_and_python(spark):
    draw = random.Random(7)
    for _ in range(4):
        commits = [[(k, draw.choice([None, draw.randint(0, 9)]), draw.choice([None, draw.randint(0, 9)])) for k in draw.sample(range(8), 5)] for _ in range(draw.randint(2, 5))]
        frames = [spark.createDataFrame(c, "id int, x int, y int") for c in commits]
        want: dict = {}
        for c in commits:
            for k, x, y in c:
                old = want.get(k, (None, None))
                want[k] = (old[0] if x is None else x, old[1] if y is None else y)
        assert rows(fold(frames, ["id"])) == rows(fold_by_joins(frames, ["id"])) == sorted(((k, *v) for k, v in want.items()), key=repr)


def test_hash_splits_and_windows(spark):
    part = siphash_part("int", 2)
    got = {r["id"]: r["p"] for r in spark.range(9).select(F.col("id").cast("int").alias("id")).select("id", part("id").alias("p")).collect()}
    assert {k for k, p in got.items() if p == 0} == {0, 1, 3, 4, 7}
    assert {c for c in "abcdefghi" if siphash13(c.encode() + b"\xff") % 2 == 0} == set("bcegi")
    ids = spark.createDataFrame([(i,) for i in (1001, 1004, 2005, 2008, 100009)], "id long")
    assert sorted({r[0] for r in ids.select(Window("id", 1000).column()).collect()}) == [1, 2, 100]


def test_catalog(spark):
    catalog = Catalog(spark, fresh_path(spark, "catalog"))
    catalog.deploy([{"kind": "universe", "uri": "/test/u"}, {"kind": "table", "uri": "/test/t", "universe": "/test/u", "columns": {"/test/c1": "/std/text", "/test/c2": "/std/int64"}}])
    with pytest.raises(ValueError):
        catalog.create("column", "/test/bad", type="unknown")
    with pytest.raises(ValueError):
        catalog.create("universe", "/test/u")
    catalog.put("/test/t", "/test/u", spark.createDataFrame([("1", "a", 1), ("2", "b", 3)], "document_uri string, `/test/c1` string, `/test/c2` long"))
    catalog.put("/test/t", "/test/u", spark.createDataFrame([("1", 7)], "document_uri string, `/test/c2` long"))
    assert rows(catalog.get("/test/t", "/test/u")) == [("1", "a", 7), ("2", "b", 3)]
    with pytest.raises(ValueError):
        catalog.drop_table("/test/t", "/test/u")
    catalog.drop_table("/test/t", "/test/u", even_if_filled=True)
    assert catalog.list("table").isEmpty()


def test_numbers_source_streams(spark):
    register_numbers(spark)
    assert rows(spark.read.format("millrace_numbers").load()) == sorted((str(k),) for k in range(1, 11))


def test_repartition_and_squash(spark):
    store = make(spark)
    for commit in OVERLAP:
        put(spark, store, commit)
    store.repartition("cg2", KeyHash(("id",), 3))
    assert Store.open(spark, store.root).groups[1].partition.parts == 3
    put(spark, store, [(7, 7, 7)])
    assert rows(store.read(columns=["id", "c", "d"])) == [*OVERLAP[2], (7, 7, 7)]
    store.squash("main", "main@{3}", "short")
    assert rows(store.read(Ref("short"), ["id", "c", "d"])) == [*OVERLAP[2], (7, 7, 7)] and len(store.log.history(Ref("short"))) == 2


def test_log_sink(spark):
    from millrace.sources.connectors import LogSink

    spark.dataSource.register(LogSink)
    spark.range(3).write.format("millrace_log").mode("append").save()


def test_keys_come_once(spark):
    store = make(spark)
    put(spark, store, [(0, 1, 1)])
    before = store.files.names(f"{store.root}/objects")
    with pytest.raises(ValueError, match="2 times"):
        put(spark, store, [(1, 1, 1), (2, 2, 2), (1, 3, 3)])
    assert store.files.names(f"{store.root}/objects") == before and rows(store.read(columns=["id", "c"])) == [(0, 1)]
    repeated = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 2, 6)], "id int, c int, d int, at int")
    store.append(store.replace_duplicates(repeated, "at").drop("at"))
    assert rows(store.read(columns=["id", "c"])) == [(0, 1), (1, 2)]


@pytest.mark.parametrize("checkpoint", [None, 0, 1, 2])
def test_expressions_hold_for_their_commit_only(spark, checkpoint):
    store = make(spark)
    ways = [{}, {}, {"c": "sum", "d": "expr:old * 10 + new"}, {}, {"c": "max", "d": "min"}, {"c": "sum"}]
    want: dict = {}
    for k, (how, c, d) in enumerate(zip(ways, (10, 20, 5, 100, 50, 1), (1, 2, 3, 4, 1, 7))):
        put(spark, store, [(0, c, d), (k + 1, c, None)], expressions=how)
        for key, values in ((0, (c, d)), (k + 1, (c, None))):
            old = want.setdefault(key, [None, None])
            for j, (name, v) in enumerate(zip("cd", values)):
                way = how.get(name, "set")
                if v is not None:
                    old[j] = v if old[j] is None or way == "set" else {"sum": lambda o: o + v, "max": lambda o: max(o, v), "min": lambda o: min(o, v)}.get(way, lambda o: o * 10 + v)(old[j])
        if k == checkpoint:
            store.checkpoint()
    assert rows(store.read(columns=["id", "c", "d"])) == sorted((k, *v) for k, v in want.items())
    assert rows(store.read("main@{3}", ["id", "c", "d"]).filter("id = 0")) == [(0, 25, 23)]
    assert rows(store.read("main@{2}", ["id", "c", "d"]).filter("id = 0")) == [(0, 100, 4)]
    with pytest.raises(ValueError):
        put(spark, store, [(0, 1, 1)], expressions={"c": "unknown"})


@pytest.mark.parametrize("checkpoint", [False, True])
def test_get_finds_keys_at_every_version_after_a_repartition(spark, checkpoint):
    store = make(spark)
    data = [(k, k + 1, k + 2) for k in range(20)]
    put(spark, store, data)
    if checkpoint:
        store.checkpoint()
    put(spark, store, [(0, 50, 50)])
    if checkpoint:
        store.checkpoint()
    store.repartition("cg2", KeyHash(("id",), 7))
    put(spark, store, [(1, 60, 60)])
    store.repartition("cg2", Window("id", 5))
    again = Store.open(spark, store.root)
    assert again.groups[1].partition == Window("id", 5)
    for s in (store, again):
        for ref, changed in (("main@{2}", {}), ("main@^", {0: 50}), ("main", {0: 50, 1: 60})):
            found = [rows(s.get({"id": k}, ref, ["id", "c"])) for k in range(0, 20, 3)] + [rows(s.get({"id": 1}, ref, ["id", "c"]))]
            assert found == [[(k, changed.get(k, k + 1))] for k in (*range(0, 20, 3), 1)]


def test_failed_repartition_leaves_the_store_as_it_was(spark, monkeypatch):
    store = make(spark)
    put(spark, store, [(k, k, k) for k in range(9)])
    store.checkpoint()
    monkeypatch.setattr(Store, "_configure", lambda *a: (_ for _ in ()).throw(LogError("lost")))
    with pytest.raises(LogError):
        store.repartition("cg2", KeyHash(("id",), 5))
    monkeypatch.undo()
    again = Store.open(spark, store.root)
    assert again.groups[1].partition.parts == 1
    assert [rows(again.get({"id": k}, columns=["c"])) for k in range(9)] == [[(k,)] for k in range(9)]


def test_columns_and_metadata(spark):
    store = make(spark)
    put(spark, store, OVERLAP[0])
    store.add_columns("cg2", T.StructType.fromDDL("e string")).describe("c", {"unit": "cm"})
    store.append(spark.createDataFrame([(0, "x")], "id int, e string"))
    again = Store.open(spark, store.root)
    assert rows(again.read(columns=["id", "c", "e"])) == [(0, 3, "x"), (1, 4, None), (2, 5, None)]
    assert again.read(columns=["c"]).schema["c"].metadata == {"unit": "cm"}
    with pytest.raises(ValueError):
        store.add_columns("cg2", T.StructType.fromDDL("e string"))


def test_checkpoint_rows_that_no_commit_touches_are_not_shuffled(spark):
    store = make(spark)
    put(spark, store, [(k, k, k) for k in range(50)])
    store.checkpoint()
    put(spark, store, [(7, 70, None), (90, 1, 1)])
    df = store.read(columns=["id", "c", "d"])
    assert "LeftAnti" in df._jdf.queryExecution().toString()
    assert sorted(rows(df)) == sorted([(k, 70 if k == 7 else k, k) for k in range(50)] + [(90, 1, 1)])


def test_a_large_part_is_written_by_several_tasks_and_conf_comes_back(spark, monkeypatch):
    monkeypatch.setattr("millrace.sources.store.TASK_BYTES", 20_000, raising=False)
    keys = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(k) for k in keys]
    store = Store.create(spark, fresh_path(spark, "bounded"), T.StructType.fromDDL("id bigint, v bigint"), [Group("all", ("id",), ("v",), KeyHash(("id",), 1))])
    commit = store.append(spark.range(0, 40_000, 1, 8).select("id", F.xxhash64("id").alias("v")))
    assert len([f for t in commit.tiles for f in t["files"]]) > 3
    assert [spark.conf.get(k) for k in keys] == before
    assert store.read().agg(F.count("v"), F.sum("id")).first()[:] == (40_000, 40_000 * 39_999 // 2)


def test_large_versions_are_shuffled_before_keys_are_kept(spark, monkeypatch):
    monkeypatch.setattr("millrace.operators.merge.FOLD_BYTES", 2000, raising=False)
    store = Store.create(spark, fresh_path(spark, "folded"), T.StructType.fromDDL("id bigint, v bigint, n array<int>"), [Group("all", ("id",), ("v", "n"), KeyHash(("id",), 2))])
    store.append(spark.range(3000).select("id", F.col("id").alias("v"), F.array(F.lit(1)).alias("n")))
    store.append(spark.range(0, 3000, 3).select("id", F.lit(-1).cast("bigint").alias("v"), F.array(F.lit(2)).alias("n")), expressions={"n": "append"})
    store.append(spark.range(0, 3000, 5).select("id", F.lit(True).alias("_deleted")))
    df = store.read()
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().toString()
    assert rows(df) == rows(spark.range(3000).filter("id % 5 <> 0").selectExpr("id", "if(id % 3 = 0, -1, id) as v", "if(id % 3 = 0, array(1, 2), array(1)) as n"))
    assert rows(store.read(columns=["id"]).agg(F.count("id"))) == [(2400,)]
    assert "REPARTITION_BY_NUM" not in store.get({"id": 6})._jdf.queryExecution().toString() and store.get({"id": 6}).count() == 1
    with pytest.raises(ValueError, match="comes 2 times"):
        store.append(spark.range(3000).union(spark.range(7, 8)).select("id", F.lit(0).cast("bigint").alias("v")))
