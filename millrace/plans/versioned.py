"""Queries over the versioned store, the document catalog and partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import uri
from millrace.functions.inference import zorder
from millrace.operators.merge import fold, fold_by_joins
from millrace.operators.partition import KeyHash, Window
from millrace.plans.registry import query, table
from millrace.sources.documents import Catalog
from millrace.sources.log import Ancestor, AsOf, PriorCheckpoint, Ref
from millrace.sources.store import Group, Store
from millrace.workspace import fresh_path

_ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"


def priced_orders(spark: SparkSession, sf_dir: str, checkpoint_after: int | None = None) -> tuple[Store, list[str]]:
    """A store of orders with three commits at 1000, 2000 and 3000 ms: all rows; status X for keys of 3k; prices plus 10 for keys of 2k."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    store = Store.create(spark, fresh_path(spark, "orders"), T.StructType.fromDDL(_ORDERS), [Group("all", ("o_orderkey",), ("o_custkey", "o_orderstatus", "o_totalprice"))])
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    steps = [
        orders,
        orders.filter("o_orderkey % 3 = 0").select("o_orderkey", none("o_custkey", "bigint"), F.lit("X").alias("o_orderstatus"), none("o_totalprice", "double")),
        orders.filter("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") + 10).alias("o_totalprice")),
    ]
    ids = []
    for k, rows in enumerate(steps, 1):
        ids.append(store.append(rows, timestamp=1000 * k, message=f"step {k}").id)
        if checkpoint_after == k:
            store.checkpoint()
    return store, ids


_STATUS = "case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end as o_orderstatus"
_PRICE = "case when o_orderkey % 2 = 0 then o_totalprice + 10 else o_totalprice end as o_totalprice"
_V1 = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders"
_V2 = f"select o_orderkey, o_custkey, {_STATUS}, o_totalprice from orders"
_V3 = f"select o_orderkey, o_custkey, {_STATUS}, {_PRICE} from orders"


@query(_V3)
def v_head_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced_orders(spark, sf_dir)[0].read()


@query(_V2)
def v_parent_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced_orders(spark, sf_dir)[0].read("main@^")


@query(_V1)
def v_ancestor_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced_orders(spark, sf_dir)[0].read(Ancestor(Ref(), 2))


@query(_V2)
def v_timestamp_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced_orders(spark, sf_dir)[0].read(AsOf(Ref(), 2500))


@query(_V1)
def v_commit_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, ids = priced_orders(spark, sf_dir)
    return store.read(ids[0])


@query(_V2)
def v_prior_checkpoint_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced_orders(spark, sf_dir, 2)[0].read(PriorCheckpoint(Ref()))


@query(_V3)
def v_checkpoint_then_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced_orders(spark, sf_dir, 1)[0].read()


@query("select 3 - k as age, 1000 * k::bigint as timestamp, 'step ' || k as message from range(1, 4) t(k)".replace("3 - k as age", "(3 - k)::int as age"))
def v_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced_orders(spark, sf_dir)[0].history().select("age", "timestamp", "message")


@query(f"select o_orderstatus, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from ({_V3}) t group by o_orderstatus")
def v_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = priced_orders(spark, sf_dir)[0].read(columns=["o_orderstatus", "o_totalprice"])
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query(f"select * from ({_V3}) t order by o_totalprice desc, o_orderkey limit 20")
def v_limit_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced_orders(spark, sf_dir)[0].read().orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query(f"select o_custkey, count(*) as n from ({_V3}) t where o_orderstatus = 'X' group by o_custkey")
def v_sql_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = priced_orders(spark, sf_dir)[0].read()
    return spark.sql("select o_custkey, count(*) as n from {t} where o_orderstatus = 'X' group by o_custkey", t=rows)


@query("select c_custkey, case when c_custkey % 5 = 0 then 'BRANCHED' else c_mktsegment end as segment from customer")
def v_branch_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _segments(spark, sf_dir)
    return store.read(Ref("trial"))


@query("select c_custkey, c_mktsegment as segment from customer")
def v_branch_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).read()


def _segments(spark: SparkSession, sf_dir: str) -> Store:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    store = Store.create(spark, fresh_path(spark, "segments"), T.StructType.fromDDL("c_custkey bigint, segment string"), [Group("all", ("c_custkey",), ("segment",))])
    store.append(rows)
    store.branch("trial")
    store.append(rows.filter("c_custkey % 5 = 0").withColumn("segment", F.lit("BRANCHED")), branch="trial")
    return store


@query("select p_partkey, p_brand, p_size + 1 as p_size, p_type, p_retailprice from part")
def v_multi_column_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    groups = [Group("looks", ("p_partkey",), ("p_brand", "p_size"), KeyHash(("p_partkey",), 4)), Group("trade", ("p_partkey",), ("p_type", "p_retailprice"))]
    store = Store.create(spark, fresh_path(spark, "part"), T.StructType.fromDDL("p_partkey bigint, p_brand string, p_size int, p_type string, p_retailprice double"), groups)
    store.append(part.select("p_partkey", "p_brand", "p_size", "p_type", "p_retailprice"))
    store.append(part.select("p_partkey", (F.col("p_size") + 1).alias("p_size")))
    return store.read()


@query("select l_orderkey, l_linenumber, arg_max(l_partkey, l_partkey) as l_partkey, max(case when l_linenumber = 1 then 0.5 else l_discount end) as l_discount from lineitem group by l_orderkey, l_linenumber")
def v_composite_key_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_discount").alias("l_discount"))
    store = Store.create(spark, fresh_path(spark, "lines"), T.StructType.fromDDL("l_orderkey bigint, l_linenumber int, l_partkey bigint, l_discount double"), [Group("all", ("l_orderkey", "l_linenumber"), ("l_partkey", "l_discount"), KeyHash(("l_orderkey", "l_linenumber"), 4))])
    store.append(rows)
    store.append(rows.filter("l_linenumber = 1").select("l_orderkey", "l_linenumber", F.lit(0.5).alias("l_discount")))
    return store.read()


@query("select c_custkey, case when c_custkey % 4 = 0 then c_acctbal * 2 else c_acctbal end as balance, case when c_custkey % 4 = 0 then 2 else 1 end as seen from customer where c_custkey % 7 <> 0")
def v_merge_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.lit(1).alias("seen"))
    store = Store.create(spark, fresh_path(spark, "balances"), T.StructType.fromDDL("c_custkey bigint, balance double, seen int"), [Group("all", ("c_custkey",), ("balance", "seen"))])
    store.append(rows)
    store.append(rows.filter("c_custkey % 4 = 0"), expressions={"balance": "sum", "seen": "expr:old + new"})
    store.append(rows.filter("c_custkey % 7 = 0").select("c_custkey", F.lit(True).alias("_deleted")))
    return store.read()


@query("select s_suppkey, s_nationkey, s_acctbal from supplier where s_suppkey = 7")
def v_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    store = Store.create(spark, fresh_path(spark, "suppliers"), T.StructType.fromDDL("s_suppkey bigint, s_nationkey int, s_acctbal double"), [Group("all", ("s_suppkey",), ("s_nationkey", "s_acctbal"), KeyHash(("s_suppkey",), 8))])
    store.append(rows)
    return store.get({"s_suppkey": 7})


@query("select count(*) as n, 0::bigint as differ from orders")
def v_fold_equals_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    late = orders.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "Y"))
    a, b = fold([orders, late], ["o_orderkey"]), fold_by_joins([orders, late], ["o_orderkey"])
    both = a.alias("a").join(b.alias("b"), "o_orderkey", "full")
    same = F.col("a.o_orderstatus").eqNullSafe(F.col("b.o_orderstatus")) & F.col("a.o_totalprice").eqNullSafe(F.col("b.o_totalprice"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("differ"))


@query("select event_id // 1000 as bucket, count(*) as n from events group by 1")
def p_window_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(Window("event_id", 1000).column().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n, 8 as parts, true as even from orders")
def p_hash_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "orders").groupBy(KeyHash(("o_orderkey", "o_custkey"), 8).column().alias("p")).agg(F.count(F.lit(1)).alias("c"))
    return parts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).cast("int").alias("parts"), (F.max("c") < 2 * F.min("c")).alias("even"))


# Versions that change their shape

@query("select s_suppkey, s_nationkey, case when s_suppkey = 3 then -1.0 else s_acctbal end as s_acctbal, v from supplier, range(3) t(v) where s_suppkey in (3, 7, 11) and v < 1 union all select s_suppkey, s_nationkey, s_acctbal, v from supplier, range(3) t(v) where s_suppkey in (3, 7, 11) and v = 1 union all select s_suppkey, s_nationkey, case when s_suppkey = 3 then -1.0 when s_suppkey = 7 then -2.0 else s_acctbal end, v from supplier, range(3) t(v) where s_suppkey in (3, 7, 11) and v = 2")
def v_get_after_repartition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups at the version repartitioned (0), the one before it (1) and the newest (2), each laid out by another spec."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    store = Store.create(spark, fresh_path(spark, "moved"), T.StructType.fromDDL("s_suppkey bigint, s_nationkey int, s_acctbal double"), [Group("all", ("s_suppkey",), ("s_nationkey", "s_acctbal"), KeyHash(("s_suppkey",), 8))])
    first = store.append(rows).id
    second = store.append(rows.filter("s_suppkey = 3").select("s_suppkey", F.lit(-1.0).alias("s_acctbal"))).id
    store.checkpoint()
    store.repartition("all", KeyHash(("s_suppkey",), 5))
    third = store.append(rows.filter("s_suppkey = 7").select("s_suppkey", F.lit(-2.0).alias("s_acctbal"))).id
    found = [store.get({"s_suppkey": k}, ref).withColumn("v", F.lit(v).cast("bigint")) for v, ref in enumerate((second, first, third)) for k in (3, 7, 11)]
    return reduce(DataFrame.unionByName, found)


@query("select n_nationkey, case when n_regionkey = 0 then 100 when n_regionkey = 1 then 25 else 10 end::int as value, case when n_regionkey = 0 then [1, 2, 3] when n_regionkey = 1 then [1, 2] else [1] end as seen from nation")
def v_mixed_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set 10, set 20, add 5, set 100: an expression holds for its commit only."""
    nation = table(spark, sf_dir, "nation")
    store = Store.create(spark, fresh_path(spark, "mixed"), T.StructType.fromDDL("n_nationkey int, value int, seen array<int>"), [Group("all", ("n_nationkey",), ("value", "seen"))])
    put = lambda where, number, mark, **how: store.append(nation.filter(where).select("n_nationkey", F.lit(number).alias("value"), F.array(F.lit(mark)).alias("seen")), expressions=how)
    put("true", 10, 1)
    put("n_regionkey <= 1", 20, 2, seen="append")
    put("n_regionkey <= 1", 5, 2, value="sum", seen="expr:array_union(old, new)")
    put("n_regionkey = 0", 100, 3, seen="append")
    return store.read()


@query("select 'x' as kind, count(*) as n, sum(o_custkey)::bigint as total from orders union all select 'rejected', 1, 0")
def v_duplicate_keys_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append that repeats a key fails and leaves nothing; the same rows with one chosen for each key go in."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    store = Store.create(spark, fresh_path(spark, "unique"), T.StructType.fromDDL("o_orderkey bigint, o_custkey bigint"), [Group("all", ("o_orderkey",), ("o_custkey",))])
    repeated = orders.withColumn("at", F.lit(2)).unionByName(orders.filter("o_orderkey % 10 = 1").select("o_orderkey", F.lit(-1).cast("bigint").alias("o_custkey"), F.lit(1).alias("at")))
    rejected = 0
    try:
        store.append(repeated.drop("at"))
    except ValueError:
        rejected = 1
    store.append(store.replace_duplicates(repeated, "at").drop("at"))
    rows = store.read().agg(F.lit("x").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("total"))
    return rows.union(spark.createDataFrame([("rejected", rejected, 0)], "kind string, n bigint, total bigint"))


@query("select p_partkey, p_size, p_brand from part")
def v_tiled_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit of tiles: two parts written from rows, two taken from files that lie elsewhere."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    spec, elsewhere = KeyHash(("p_partkey",), 4), fresh_path(spark, "elsewhere")
    store = Store.create(spark, fresh_path(spark, "tiles"), T.StructType.fromDDL("p_partkey bigint, p_size int, p_brand string"), [Group("all", ("p_partkey",), ("p_size", "p_brand"), spec)])
    parts = [part.filter(spec.column() == k) for k in range(4)]
    for k in (2, 3):
        parts[k].write.parquet(f"{elsewhere}/{k}")
    store.append_tiled([("all", f"_part={k}", parts[k] if k < 2 else [f"{elsewhere}/{k}"]) for k in range(4)], ["p_size", "p_brand"])
    return store.read()


@query("select s_suppkey, s_acctbal, null::varchar as note from supplier where s_suppkey % 2 = 0 union all select s_suppkey, s_acctbal, 'odd' from supplier where s_suppkey % 2 = 1")
def v_new_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that a store gets later is null in the rows before; the store opened again infers the schema from its configuration."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    store = Store.create(spark, fresh_path(spark, "wider"), T.StructType.fromDDL("s_suppkey bigint, s_acctbal double"), [Group("all", ("s_suppkey",), ("s_acctbal",))])
    store.append(rows)
    store.add_columns("all", T.StructType.fromDDL("note string"))
    store.append(rows.filter("s_suppkey % 2 = 1").select("s_suppkey", F.lit("odd").alias("note")))
    return Store.open(spark, store.root).read()


@query("select 2::bigint as commits, 1::bigint as dead, true as sized, count(*) as n from customer")
def v_squash_and_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three commits as one on a new branch, then an abandoned commit's files go and the rest stays."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    store = Store.create(spark, fresh_path(spark, "squash"), T.StructType.fromDDL("c_custkey bigint, c_acctbal double"), [Group("all", ("c_custkey",), ("c_acctbal",))])
    root = store.append(rows.filter("c_custkey % 3 = 0")).id
    store.append(rows.filter("c_custkey % 3 = 1"))
    store.append(rows.filter("c_custkey % 3 = 2"))
    store.squash("main", root, "short")
    store.append(rows.filter("c_custkey = 1"), advance=False)
    dead = len(store.vacuum(age_ms=-60_000))
    return store.read(Ref("short")).agg(F.lit(len(store.log.history(Ref("short")))).cast("bigint").alias("commits"), F.lit(dead).cast("bigint").alias("dead"), F.lit(store.size(Ref("short")) > 0).alias("sized"), F.count(F.lit(1)).alias("n"))


@query("select c_custkey, case when c_custkey % 5 = 0 then 'BRANCHED' when c_custkey % 3 = 0 then 'LATER' else c_mktsegment end as segment from customer")
def v_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch put on top of what main got meanwhile."""
    store = _segments(spark, sf_dir)
    store.append(store.read(columns=["c_custkey"]).filter("c_custkey % 3 = 0").withColumn("segment", F.lit("LATER")))
    store.rebase("trial")
    return store.read(Ref("trial"))


@query("select 3::bigint as checkpoints, 1::bigint as after, count(*) as n, sum(c_custkey)::bigint as total from customer")
def v_checkpoint_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven commits with a checkpoint after every two, each sorted by a z-order."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("c_nationkey"))
    store = Store.create(spark, fresh_path(spark, "often"), T.StructType.fromDDL("c_custkey bigint, c_nationkey int"), [Group("all", ("c_custkey",), ("c_nationkey",), KeyHash(("c_custkey",), 2))])
    for k in range(7):
        store.append(rows.filter(F.col("c_custkey") % 7 == k), checkpoint_every=2)
    made = sum(store.log.has_checkpoint(c.id) for c in store.log.history())
    after = len(store.log.view(Ref())[1])
    store.checkpoint(order=[zorder(F.col("c_custkey"), F.col("c_nationkey"))])
    return store.read().agg(F.lit(made).cast("bigint").alias("checkpoints"), F.lit(after).cast("bigint").alias("after"), F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("total"))


# Documents and names

_DOCS = "select '/doc/' || doc_id as document_uri, case when doc_id % 10 = 0 then 'xx' else lang end as lang, n_chars as size from documents"


def _documents(spark: SparkSession, sf_dir: str) -> Catalog:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("/doc/"), "doc_id").alias("document_uri"), F.col("lang").alias("/std/lang"), F.col("n_chars").alias("/std/size"), "doc_id")
    catalog = Catalog(spark, fresh_path(spark, "catalog"))
    catalog.create("universe", "/web")
    catalog.create_table("/web/docs", "/web", {"/std/lang": "/std/text", "/std/size": "/std/int64"})
    catalog.put("/web/docs", "/web", docs.drop("doc_id"))
    catalog.put("/web/docs", "/web", docs.filter("doc_id % 10 = 0").select("document_uri", F.lit("xx").alias("/std/lang")))
    return catalog


@query(_DOCS)
def doc_put_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).get("/web/docs", "/web")
    return rows.select("document_uri", F.col("__std__lang").alias("lang"), F.col("__std__size").alias("size"))


@query("select n_nationkey, n_name, 'v2' as version from nation")
def doc_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a dataset registered; the newer is read by name."""
    catalog, path = Catalog(spark, fresh_path(spark, "datasets")), fresh_path(spark, "nations")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    for v, rows in (("v1", nation.limit(1)), ("v2", nation)):
        rows.write.parquet(f"{path}/{v}")
        catalog.register_dataset("nations", f"{path}/{v}", v, about={"owner": "tests"})
    newest = catalog.datasets().filter("name = 'nations'").agg(F.max("version").alias("version"))
    return catalog.dataset("nations").crossJoin(F.broadcast(newest))


@query(f"select document_uri, lang from ({_DOCS}) t where document_uri in (select '/doc/' || doc_id from labels)")
def doc_get_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").select(F.concat(F.lit("/doc/"), "doc_id").alias("document_uri"))
    rows = _documents(spark, sf_dir).get("/web/docs", "/web", ids, ["/std/lang"])
    return rows.select("document_uri", F.col("__std__lang").alias("lang"))


@query("select url, regexp_replace(url, '[^\\p{L}\\p{N}_]', '__', 'g') as escaped, 'universe_' || regexp_replace(url, '[^\\p{L}\\p{N}_]', '__', 'g') as keyspace from pages")
def escape_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", uri.escape_uri(F.col("url")).alias("escaped"), uri.keyspace(F.col("url")).alias("keyspace"))


@query("select n_name, case when n_nationkey % 2 = 0 then '/std/' || n_name else n_name end as resolved from nation")
def ns_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("std:"), "n_name")).otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_name", uri.resolve(name).alias("resolved"))


@query("select n_nationkey, n_name as name, n_regionkey::varchar as region from nation")
def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("name="), "n_name", F.lit(",region="), "n_regionkey")
    kv = uri.key_values(text)
    return table(spark, sf_dir, "nation").select("n_nationkey", kv["name"].alias("name"), kv["region"].alias("region"))


@query("select event_id, event_type as as_string, (props->>'$.k')::bigint as as_int, value as as_double from events")
def cells_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", uri.cell(F.concat(F.lit('"'), "event_type", F.lit('"')))["as_string"].alias("as_string"), uri.cell(F.get_json_object("props", "$.k"))["as_int"].alias("as_int"), F.coalesce(uri.cell(F.format_string("%.2f", "value"))["as_double"], uri.cell(F.format_string("%.2f", "value"))["as_int"].cast("double")).alias("as_double"))


@query("select n_nationkey, '(document_uri, ' || 'n__' || n_name || ', x__y)' as columns, chr(39) || replace(n_name, 'N', chr(39) || chr(39)) || chr(39) as quoted, case when n_regionkey = 0 then 'bigint' else 'string' end as kind from nation")
def names_and_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement forms of names: column lists, quoted literals, SQL types of type names."""
    kind = F.when(F.col("n_regionkey") == 0, F.lit("/std/int64")).otherwise(F.lit("/std/text"))
    return table(spark, sf_dir, "nation").select("n_nationkey", uri.update_schema(F.array(F.concat(F.lit("n/"), "n_name"), F.lit("x:y"))).alias("columns"), uri.literal_text(F.replace(F.col("n_name"), F.lit("N"), F.lit("'"))).alias("quoted"), uri.column_type(kind).alias("kind"))


@query("select n_nationkey, '/std/' || n_name as first, 'plain' as second, '/std/a' as key, '/std/' || n_name as value from nation")
def ns_resolve_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces in arrays and maps."""
    name = F.concat(F.lit("std:"), "n_name")
    names, pairs = uri.resolve_all(F.array(name, F.lit("plain"))), uri.resolve_map(F.create_map(F.lit("std:a"), name), values=True)
    return table(spark, sf_dir, "nation").select("n_nationkey", names[0].alias("first"), names[1].alias("second"), F.map_keys(pairs)[0].alias("key"), F.map_values(pairs)[0].alias("value"))
