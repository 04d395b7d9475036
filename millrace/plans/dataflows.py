"""Queries over crawls, metrics, labels, chats, as-of joins, sketches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import bpe, inference, metrics, text
from millrace.operators import agents, asof, crawl
from millrace.plans.registry import query, table
from millrace.ship import ship
from millrace.sources import connectors, generators
from millrace.sources.store import Group, Store
from millrace.streaming import events as streams
from millrace.workspace import fresh_path

_HREF = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"'']"
_RAW = f"(select page_id, url, unnest(regexp_extract_all(html, '{_HREF}', 1)) as raw from pages)"
_PATH = "case when regexp_extract(url, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) end"
_LINK = f"case when regexp_matches(raw, '^[a-z][a-z0-9+.-]*:') then raw when raw like '//%' then regexp_extract(url, '^([a-z][a-z0-9+.-]*)://', 1) || ':' || raw when raw like '/%' then raw else regexp_replace({_PATH}, '[^/]*$', '') || raw end"
_HOST = "regexp_extract(url, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1)"
_OUT = "(regexp_matches(raw, '^[a-z][a-z0-9+.-]*:') or raw like '//%')"


@query(f"select page_id, len(regexp_extract_all(html, '{_HREF}', 1))::int as n_links, len(list_distinct(regexp_extract_all(html, '{_HREF}', 1)))::int as n_distinct from pages")
def crawl_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crawl.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).alias("n_links"), F.size(F.array_distinct(found)).alias("n_distinct"))


@query(f"select page_id, {_LINK} as link, {_OUT} as outlink, count(*) as n from {_RAW} t group by all")
def crawl_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.page_links(table(spark, sf_dir, "pages")).groupBy("page_id", "link", "outlink").agg(F.count(F.lit(1)).alias("n"))


_AWAY = "(select page_id, url, case when page_id % 2 = 0 then '//cdn' || page_id % 5 || '.example.org/x' else 'HTTP'.lower() || '://h' || page_id % 3 || '.example.com' end as raw from pages union all select * from " + _RAW + " r)"


@query(f"select regexp_extract(link, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) as host, count(*) as n from (select {_LINK} as link, {_OUT} as o from {_AWAY} t) u where o group by 1")
def crawl_outlink_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages link to their own hosts only, so each gets one anchor that leads away."""
    away = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<a href="//cdn'), F.col("page_id") % 5, F.lit('.example.org/x">'))).otherwise(F.concat(F.lit("<a href='http://h"), F.col("page_id") % 3, F.lit(".example.com'>")))
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat(away, F.coalesce("html", F.lit(""))))
    out = crawl.page_links(pages).filter("outlink")
    return out.groupBy(crawl.host_of(F.col("link")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select distinct {_LINK} as url from {_RAW} t where {_LINK} not in (select url from pages)")
def crawl_frontier_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return crawl.new_links(crawl.page_links(pages).select(F.col("link").alias("url")), pages)


@query(f"with seeds as (select distinct url from pages), next as (select distinct case when {_OUT} then {_LINK} else regexp_extract(url, '^([a-z][a-z0-9+.-]*)://', 1) || '://' || {_HOST} || {_LINK} end as url from {_RAW} t) select url, 0 as round from seeds union all select url, 1 as round from next where url not in (select url from seeds)")
def crawl_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = crawl.page_links(pages)
    target = F.when(F.col("outlink"), F.col("link")).otherwise(crawl.full_url(crawl.host_of(F.col("url")), F.col("link"), crawl.scheme_of(F.col("url"))))
    web = found.select("url", target.alias("next")).distinct()
    return crawl.crawl(pages.select("url"), lambda wanted: wanted.join(web, "url", "left"))


@query(f"select {_HOST} as host, count(*) as pages, round(avg(strlen(html)), 6) as avg_size, max(strlen(html))::bigint as max_size, sum(strlen(html))::bigint as total_size from pages group by 1")
def crawl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "pages").select(crawl.host_of(F.col("url")).alias("host"), F.octet_length("html").cast("bigint").alias("content_length"), F.lit(0).alias("fetch_time"))
    return crawl.report(captures, "host").select("host", "pages", F.round("avg_size", 6).alias("avg_size"), "max_size", "total_size")


@query(f"select distinct {_HOST} as host, {_PATH} as path, not ({_PATH} like '/fr%' and {_PATH} not like '/fr/1%') as allowed from pages")
def crawl_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "pages").select(crawl.host_of(F.col("url")).alias("host"), crawl.path_of(F.col("url")).alias("path")).distinct()
    rules = paths.select("host").distinct().crossJoin(spark.createDataFrame([("/fr", False), ("/fr/1", True)], "prefix string, allow boolean"))  # two rules a host
    return crawl.allowed(paths, rules)


_ROBOTS = "# all\nUser-agent: other\nUser-agent: *\nDisallow: /\n\nUser-Agent: mill # ours\nDisallow: /fr\nAllow: /fr/1\nDisallow: /*9$\nDisallow:\nCrawl-delay: 2.5\nSitemap: /map\n"


@query(f"select distinct {_HOST} as host, {_PATH} as path, case when {_PATH} like '/fr/1%' then true when {_PATH} like '/fr%' then false when {_PATH} like '/%9' then false else true end as allowed, 2.5::double as delay from pages")
def crawl_robots_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots files read: groups of agents, comments, wildcards, an empty rule, a delay."""
    paths = table(spark, sf_dir, "pages").select(crawl.host_of(F.col("url")).alias("host"), crawl.path_of(F.col("url")).alias("path")).distinct()
    rules = crawl.robots_rules(paths.select("host").distinct().withColumn("body", F.lit(_ROBOTS)), "Millrace/1.0")
    return crawl.allowed(paths, rules).join(rules.select("host", "delay").distinct(), "host")


def _fake_web(url: str) -> tuple[int, bytes]:
    if url.endswith("#top"):
        raise OSError("no answer")
    return 404 if "page=" in url else 200, url.encode()[::-1]


@query("select u as url, case when u like '%#top' then null when u like '%page=%' then 404 else 200 end::int as status_code, case when u like '%#top' then null else strlen(u) end::bigint as content_length, u like '%#top' as failed, 2::bigint as visits, false as due from (select distinct url as u from pages) t")
def crawl_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched twice by a given fetcher: status, size, failures as rows; the visit state of each url, none of which is due again."""
    pages = table(spark, sf_dir, "pages").select("url")
    got = crawl.captures(pages, _fake_web)
    visits = crawl.last_visits(got.unionByName(got))
    due = crawl.due(pages.distinct(), visits, 10**13, 10**13).select(F.col("url").alias("u"))
    known = got.join(visits.select("url", "visits"), "url").join(due, F.col("url") == F.col("u"), "left")
    return known.select("url", "status_code", "content_length", F.col("error").isNotNull().alias("failed"), "visits", F.col("u").isNotNull().alias("due"))


@query("select event_id, user_id from events order by user_id % 4, ts, event_id limit 30")
def frontier_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("user_id") % 4).alias("priority"), F.unix_micros(F.col("ts").cast("timestamp")).alias("enqueued_ns"), F.col("event_id").alias("tiebreak"))
    return crawl.take(queue, 30).select("event_id", "user_id")


@query("select event_id, lpad(upper(to_hex(user_id % 4)), 2, '0') || lpad(upper(to_hex(epoch_us(ts))), 24, '0') || lpad(upper(to_hex(event_id % 16777216)), 6, '0') as key from events")
def frontier_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", crawl.lossy_key(F.col("user_id") % 4, F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")).alias("key"))


# Metrics

@query("select 0::bigint as start_ns, k * 100000000::bigint as time_ns, round(sin(k / 10.0 * 2 * pi()), 9) as value from range(10) t(k)")
def metric_sine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sine_wave(spark, 0, 100_000_000, 10).withColumn("value", F.round("value", 9))


@query("select event_type, round(sum(value) / sum(1 + event_id % 3), 6) as mean from events group by 1")
def metric_mean_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(metrics.weighted_mean(F.col("value"), 1 + F.col("event_id") % 3), 6).alias("mean"))


@query("select event_type, round(sum(value * exp(-1e-6 * (m - s))) / sum(exp(-1e-6 * (m - s))), 6) as mean from (select event_type, value, epoch_us(ts) / 1e6 as s, max(epoch_us(ts) / 1e6) over (partition by event_type) as m from events) t group by 1")
def metric_decay_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    latest = rows.groupBy("event_type").agg(F.max("s").alias("m"))
    return rows.join(latest, "event_type").groupBy("event_type").agg(F.round(metrics.decayed_mean(F.col("value"), F.lit(1.0), F.col("s"), F.col("m"), 1e-6), 6).alias("mean"))


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.99), 6) as p99, round(avg(value), 6) as mean from events group by 1")
def metric_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.round(F.avg("value"), 6).alias("mean"))


@query("select user_id, array_to_string([printf('%.4f', v) for v in vs[1:3]], ' ') as shown from (select user_id, list(value order by ts, event_id) as vs from events group by 1) t")
def metric_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("vs"))
    first = F.slice(F.transform("vs", lambda x: x["value"]), 1, 3)
    return rows.select("user_id", metrics.format_series(first, 200).alias("shown"))


@query("select event_type, true as users_hll, true as users_theta, true as median from events group by event_type")
def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mergeable sketches by event type, made by tile, stored, merged: distinct users by HLL and theta within 5 %, the median by KLL within 3 % of ranks."""
    events = table(spark, sf_dir, "events")
    tiles = events.groupBy("event_type", (F.col("event_id") % 8).alias("tile")).agg(F.hll_sketch_agg("user_id").alias("h"), F.theta_sketch_agg("user_id").alias("t"), F.expr("kll_sketch_agg_double(value)").alias("k"))
    path = fresh_path(spark, "sketches")
    tiles.write.parquet(path)
    merged = spark.read.parquet(path).groupBy("event_type").agg(F.hll_union_agg("h").alias("h"), F.theta_union_agg("t").alias("t"), F.expr("kll_merge_agg_double(k)").alias("k"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.percentile("value", F.lit(0.47)).alias("low"), F.percentile("value", F.lit(0.53)).alias("high"))
    near = lambda c: F.abs(c - F.col("users")) <= F.greatest(0.05 * F.col("users"), F.lit(1.0))
    return merged.join(exact, "event_type").select("event_type", near(F.hll_sketch_estimate("h")).alias("users_hll"), near(F.theta_sketch_estimate("t")).alias("users_theta"), F.expr("kll_sketch_get_quantile_double(k, 0.5D)").between(F.col("low"), F.col("high")).alias("median"))


@query("select 10::bigint as n, 55::bigint as total")
def data_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    generators.register_numbers(spark)
    return spark.read.format("millrace_numbers").load().agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("bigint")).alias("total"))


@query("select 7 + k::int as id, (3 + 2 * k)::int as a, (100 + 2 * k)::int as b from range(50) t(k)")
def generated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.stepped_rows(spark, 7, 50, {"a": 3, "b": 100})


# Joins in time

@query("select e.event_id, o.o_orderkey from (select event_id, user_id, ts - interval 26 year + interval (event_id % 1800) day as at from events) e asof left join (select o_custkey, o_orderdate, max(o_orderkey) as o_orderkey from orders group by 1, 2) o on e.user_id = o.o_custkey and e.at >= o.o_orderdate")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), F.expr("ts - interval '26' year + make_dt_interval(cast(event_id % 1800 as int))").alias("at"))
    right = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return asof.asof_join(left, right, ["k"], "at", "o_orderdate").select("event_id", F.col("r_o_orderkey").alias("o_orderkey"))


@query("select e.event_id, o.o_orderkey from (select event_id, user_id % 2 as k, ts - interval 26 year + interval (event_id % 1800) day as at from events) e asof left join (select o_custkey % 2 as k, o_orderdate, max(o_orderkey) as o_orderkey from orders group by 1, 2) o on e.k = o.k and e.at >= o.o_orderdate")
def asof_join_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys hold all rows: their lines are cut into buckets of 30 days."""
    left = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 2).alias("k"), F.expr("ts - interval '26' year + make_dt_interval(cast(event_id % 1800 as int))").alias("at"))
    right = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 2).alias("k"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    month = F.floor(F.unix_seconds(F.col("_t").cast("timestamp")) / (30 * 86400))
    return asof.asof_join(left, right, ["k"], "at", "o_orderdate", bucket=month).select("event_id", F.col("r_o_orderkey").alias("o_orderkey"))


@query("select p_partkey, band from part join (select * from (values ('low', 0, 10), ('mid', 8, 30), ('high', 25, 51)) v(band, lo, hi)) b on p_size >= lo and p_size < hi")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame([("low", 0, 10), ("mid", 8, 30), ("high", 25, 51)], "band string, lo int, hi int")
    return asof.range_join(table(spark, sf_dir, "part"), bands, "p_size", "lo", "hi", 8).select("p_partkey", "band")


# Labels, text, chats

@query("select doc_id, 'q' || quality as grade, toxic from labels")
def label_answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("<thinking>so</thinking>\n<answer>\n"), F.to_json(F.struct(F.concat(F.lit("q"), "quality").alias("grade"), "toxic")), F.lit("\n</answer>"))
    rows = table(spark, sf_dir, "labels").select("doc_id", text.answer_json(said, "grade string, toxic int").alias("a"))
    return rows.select("doc_id", "a.grade", "a.toxic")


@query("select conv_id, turn, count(*) as n_windows, sum(n)::bigint as n_tokens from (select conv_id, turn, i, least(16, len(w) - i) as n from (select conv_id, turn, w, unnest(range(0, len(w), 8)) as i from (select conv_id, turn, string_split(text, ' ') as w from conversations) a) b) c where n >= 2 group by 1, 2")
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.token_windows(F.split("text", " "), 16, 8)).alias("w"))
    real = F.size(F.filter("w", lambda x: x != "<pad>"))
    return rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_windows"), F.sum(real).cast("bigint").alias("n_tokens"))


@query("select conv_id, count(*) as n_messages, string_agg(role, ',' order by turn, role, text) as roles from conversations group by 1")
def chat_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.chat(table(spark, sf_dir, "conversations")).select("conv_id", "n_messages", F.concat_ws(",", F.transform("messages", lambda m: m["role"])).alias("roles"))


@query("select n_nationkey, case when n_nationkey % 2 = 0 then 'own' else 'r' || n_regionkey end as tone, 'plain' as style from nation")
def agent_template_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("tone"), F.lit("own")))
    requests = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("template"), own.alias("properties"))
    templates = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("template"), F.create_map(F.lit("tone"), F.concat(F.lit("r"), "r_regionkey"), F.lit("style"), F.lit("plain")).alias("properties"))
    out = agents.with_template(requests, templates)
    return out.select("n_nationkey", F.col("properties")["tone"].alias("tone"), F.col("properties")["style"].alias("style"))


@query("select n_nationkey::varchar as agent_id, case when n_nationkey = 3 then 'running' when n_nationkey = 4 then 'paused' else 'stopped' end as status, case when n_nationkey = 3 then 'c3' end as channel_id from nation where n_nationkey not in (7, 8)")
def agent_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents created, started, paused and deleted; a channel opened twice over, one closed again."""
    nation = table(spark, sf_dir, "nation")
    named = nation.select(F.col("n_nationkey").cast("string").alias("agent_id"), F.lit("stopped").alias("status"))
    rows = agents.create(named.filter("agent_id < '5'"), named.filter("agent_id >= '5'"))
    rows = agents.changed(agents.changed(rows, "agent_id", ["3"], "running"), "agent_id", ["4"], "paused")
    rows = agents.without(rows, "agent_id", spark.createDataFrame([("7",), ("8",)], "agent_id string"))
    channels = agents.open_channels(spark.createDataFrame([], agents.CHANNELS), spark.createDataFrame([("c3", "3", "chat"), ("c9", "9", "chat")], agents.CHANNELS), rows)
    channels = agents.without(channels, "channel_id", spark.createDataFrame([("c9",)], "channel_id string"))
    return rows.join(channels.select("agent_id", "channel_id"), "agent_id", "left")


@query("select task_id, name, state from (select n_nationkey::bigint as task_id, 'crawl ' || lower(n_name) as name, 'queued' as state from nation where n_nationkey <> 2) t where name like '%crawl%' order by task_id limit 5 offset 3")
def task_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl tasks submitted, one deleted, a page of those that a term and a state name."""
    wanted = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("task_id"), F.concat(F.lit("crawl "), F.lower("n_name")).alias("name"))
    tasks = agents.submit(spark.createDataFrame([], agents.TASKS), wanted, 1000)
    tasks = agents.without(tasks, "task_id", spark.createDataFrame([(2,)], "task_id bigint"))
    return agents.listed(tasks, "CRAWL", "queued", offset=3, page_size=5).select("task_id", "name", "state")


@query("select event_id, round(epoch_us(ts) / 1e6, 6) as x, value as y from events")
def plot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", metrics.plot_pairs(F.unix_micros(F.col("ts").cast("timestamp")) * 1000, F.col("value")).alias("p"))
    return rows.select("event_id", F.round("p.x", 6).alias("x"), "p.y")


@query("select n_nationkey, case when n_regionkey = 0 then 'own' when n_regionkey = 1 then 'parent' else 'any' end as prompt, 'name (string): its name\nplace (object)\n  town (string)' as fields from nation")
def label_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts by the spec's own name, its lineage or the default; a schema told in lines."""
    schema = {"properties": {"name": {"type": "string", "description": "its name"}, "place": {"type": "object", "properties": {"town": {"type": "string"}}}}}
    prompts = {"leaf": "own", "root": "parent"}
    chosen = {0: text.prompt_for("leaf", prompts, ["root"], "any"), 1: text.prompt_for("other", prompts, ["gone", "root"], "any")}
    pick = F.coalesce(*(F.when(F.col("n_regionkey") == k, F.lit(v)) for k, v in chosen.items()), F.lit(text.prompt_for("other", prompts, [], "any")))
    return table(spark, sf_dir, "nation").select("n_nationkey", pick.alias("prompt"), F.lit(text.describe_json(schema)).alias("fields"))


@query()
def bpe_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 32 token ids every 16, padded with 0, of every turn; the tokenizer's file is a parameter of token_ids()."""
    import public_tokenizers

    ids = bpe.token_ids(F.col("text"), public_tokenizers.path("byte_bpe_50k.json"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("ids"))
    return rows.select("conv_id", "turn", F.size("ids").alias("n_tokens"), F.posexplode(text.token_windows(F.col("ids"), 32, 16, 0)).alias("window", "tokens"))


@query("select conv_id, turn, w[1:-2] as inputs, w[2:] as labels from (select conv_id, turn, string_split(text, ' ')[1:8] as w from conversations) t where len(w) >= 2")
def token_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.slice(F.split("text", " "), 1, 8).alias("w")).filter(F.size("w") >= 2)
    return rows.select("conv_id", "turn", text.inputs_and_labels(F.col("w")).alias("x")).select("conv_id", "turn", "x.inputs", "x.labels")


@query("select 'orders' as name, true as planned, true as listed, count(*) as n from orders where o_totalprice > 300000")
def utility_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE VIEW, SHOW, DESCRIBE, EXPLAIN and CREATE TABLE AS SELECT; what they made is dropped again."""
    name = "millrace_" + fresh_path(spark, "u").rsplit("-", 1)[1]
    path = fresh_path(spark, "ctas")
    table(spark, sf_dir, "orders").createOrReplaceTempView(f"{name}_base")
    spark.sql(f"create temporary view {name}_view as select * from {name}_base where o_totalprice > 300000")
    shown = [r["viewName"] for r in spark.sql("show views").collect()]
    columns = [r["col_name"] for r in spark.sql(f"describe {name}_view").collect()]
    plan = spark.sql(f"explain formatted select * from {name}_view").first()[0]
    spark.sql(f"create table {name}_table using parquet location '{path}' as select * from {name}_view")
    rows = spark.table(f"{name}_table").agg(F.lit("orders").alias("name"), F.lit("PushedFilters" in plan).alias("planned"), F.lit(f"{name}_view" in shown and "o_totalprice" in columns).alias("listed"), F.count(F.lit(1)).alias("n"))
    spark.sql(f"drop table {name}_table")
    for v in ("view", "base"):
        spark.catalog.dropTempView(f"{name}_{v}")
    return rows


@query("select * from (values ('I', 1), ('III', 3), ('IV', 4), ('XC', 90), ('LXXXIX', 89), ('MCMXCIV', 1994)) v(numeral, n)")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in ("I", "III", "IV", "XC", "LXXXIX", "MCMXCIV")], "numeral string")
    return rows.select("numeral", text.roman(F.col("numeral")).alias("n"))


@query("select p_partkey, regexp_full_match(p_name, 'r.*g.*') as hit from part")
def pattern_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.full_match(F.col("p_name"), "r.*g.*").alias("hit"))


@query("select n_nationkey, base64(n_name::blob) as b from nation")
def base64_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.base64(F.col("n_name").cast("binary")).alias("b"))


# Streams

_SUM = "count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.source(spark, f"{sf_dir}/events.parquet")


@query(f"select time_bucket(interval 1 hour, ts) as start, event_type, {_SUM} from events group by 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.finished(streams.tumbling(_events(spark, sf_dir)), "complete", "tumbling")


@query(f"select start, event_type, {_SUM} from (select time_bucket(interval 1 hour, ts) - (interval 1 hour) * k as start, event_type, value from events, range(2) r(k)) t group by 1, 2")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.finished(streams.sliding(_events(spark, sf_dir)), "complete", "sliding")


@query(f"select min(ts) as start, max(ts) + interval 30 minute as end, user_id, {_SUM} from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from (select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minute then 0 else 1 end as new from events) a) b group by user_id, s")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.finished(streams.sessions(_events(spark, sf_dir)), "complete", "sessions")


@query("select distinct user_id, event_type from events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.finished(streams.first_only(_events(spark, sf_dir), "user_id", "event_type"), "append", "dedup")


@query("select user_id, count(*) as events from events group by 1")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.finished(streams.running_totals(_events(spark, sf_dir)), "update", "totals")
    return found.groupBy("user_id").agg(F.max("events").alias("events"))


@query("select event_id, user_id, value from events")
def stream_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.create(spark, fresh_path(spark, "events"), T.StructType.fromDDL("event_id bigint, user_id bigint, value double"), [Group("all", ("event_id",), ("user_id", "value"))])
    streams.commit_stream(_events(spark, sf_dir).select("event_id", "user_id", "value"), store, "events", fresh_path(spark, "state"))
    return store.read()


@query("select 10::bigint as n, 55::bigint as total")
def stream_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    generators.register_numbers(spark)
    found = streams.finished(spark.readStream.format("millrace_numbers").option("rate", 10).load(), "append", "numbers")
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("bigint")).alias("total"))


@query("select quantile_cont(d, 0.5) as p50, quantile_cont(d, 0.9) as p90, count(*) as n from (select (event_id % 97)::double as d from events) t")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("ts").alias("sent"), (F.col("ts").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, cast(event_id % 97 as decimal(18,6)) / 1000)")).alias("received"))
    return connectors.latency(rows, F.col("sent"), F.col("received")).select("p50", "p90", "n")


# Models and table functions

def _length_model():
    return lambda values: values.str.len() * 0.5


@query("select doc_id, cast(length(text) * 0.5 as double) as score from documents")
def infer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.scored(table(spark, sf_dir, "documents"), "text", _length_model).select("doc_id", "score")


@query(f"select page_id, len(regexp_extract_all(html, '{_HREF}', 1)) as n from pages where len(regexp_extract_all(html, '{_HREF}', 1)) > 0")
def udtf_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    spark.udtf.register("anchor_links", inference.AnchorLinks)
    return spark.sql("select page_id, count(*) as n from {pages}, lateral anchor_links(html) group by page_id", pages=table(spark, sf_dir, "pages"))


@query("select n_nationkey, (n_nationkey & 1) | ((n_regionkey & 1) << 1) | (((n_nationkey >> 1) & 1) << 2) | (((n_regionkey >> 1) & 1) << 3)::bigint as z from nation".replace("select n_nationkey, (", "select n_nationkey, ((").replace("<< 3)::bigint", "<< 3))::bigint"))
def zorder_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", inference.zorder(F.col("n_nationkey"), F.col("n_regionkey"), bits=2).alias("z"))
