"""A crawl as a dataflow: links, their normal form, robots rules, the frontier and its fixpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.ship import ship
from millrace.workspace import Files, fresh_path

LINK = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"']*)[\"']"
SCHEME = "^[a-z][a-z0-9+\\-.]*:"
COLUMNS = {c: f"crawler:capture:{c}" for c in ("normalized_url", "body", "fetched_at", "fetch_time", "content_length", "status_code")}
#: Share of its size that a body keeps when it is stored.
COMPRESSION = 0.3


def links(html: Column) -> Column:
    """The href of every anchor, in order, repeats included."""
    return F.regexp_extract_all(html, F.lit(LINK), F.lit(1))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, "^[a-z][a-z0-9+\\-.]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z][a-z0-9+\\-.]*://([^/?#]*)", 1)


def scheme_of(url: Column) -> Column:
    return F.regexp_extract(url, "^([a-z][a-z0-9+\\-.]*)://", 1)


def full_url(host: Column, path: Column, scheme: Column | None = None, port: Column | None = None) -> Column:
    scheme = F.lit("https") if scheme is None else F.coalesce(scheme, F.lit("https"))
    at = F.lit("") if port is None else F.coalesce(F.concat(F.lit(":"), port.cast("string")), F.lit(""))
    return F.concat(scheme, F.lit("://"), host, at, path)


def is_outlink(link: Column) -> Column:
    return link.rlike(SCHEME) | F.startswith(link, F.lit("//"))


def normal_link(link: Column, url: Column) -> Column:
    """Outlinks in full, with the page's scheme if they bring none; inlinks as a path of the page's host."""
    base = F.regexp_replace(path_of(url), "[^/]*$", "")
    return F.when(link.rlike(SCHEME), link).when(F.startswith(link, F.lit("//")), F.concat(scheme_of(url), F.lit(":"), link)).when(F.startswith(link, F.lit("/")), link).otherwise(F.concat(base, link))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, position, link, outlink) for every anchor."""
    found = pages.select("page_id", "url", F.posexplode(links(F.col("html"))).alias("position", "raw"))
    return found.select("page_id", "url", "position", normal_link(F.col("raw"), F.col("url")).alias("link"), is_outlink(F.col("raw")).alias("outlink"))


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, prefix, allow, delay) for one crawler from robots files (host, body).

    A group starts where agent lines follow another kind of line. Of a host's groups those count whose agent names the crawler (or is a
    part of its name) with the longest such name, else those for `*`. Empty patterns say nothing. Comments and unknown fields are left out."""
    lines = robots.select("host", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\\r\\n|\\r|\\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", "#.*$", ""))
    field = F.lower(F.btrim(F.regexp_extract("line", "^([^:]*):", 1)))
    lines = lines.select("host", "at", field.alias("field"), F.btrim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value")).filter(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    line = W.partitionBy("host").orderBy("at")  # one file's lines
    named = F.col("field") == "user-agent"
    starts = (named & (F.coalesce(F.lag("field").over(line), F.lit("")) != "user-agent")).cast("int")
    lines = lines.withColumn("starts", starts).withColumn("group", F.sum("starts").over(line)).filter("group > 0")
    agents = lines.filter(named).select("host", "group", F.lower("value").alias("agent"))
    fits = agents.withColumn("rank", F.when(F.col("agent") == "*", 0).when((F.col("agent") != "") & F.contains(F.lit(agent.lower()), "agent"), F.length("agent"))).filter("rank is not null")
    best = fits.withColumn("best", F.max("rank").over(W.partitionBy("host"))).filter("rank = best").select("host", "group").distinct()
    own = lines.filter(~named).join(best, ["host", "group"])
    delay = own.filter("field = 'crawl-delay'").groupBy("host").agg(F.max(F.try_to_number("value", F.lit("9999.999")).cast("double")).alias("delay"))
    rules = own.filter("field <> 'crawl-delay' and value <> ''").select("host", F.col("value").alias("prefix"), (F.col("field") == "allow").alias("allow")).distinct()
    return rules.join(delay, "host", "left")


def robots_pattern(prefix: Column) -> Column:
    """A rule's pattern as a regular expression: `*` stands for anything, `$` at the end for the path's end."""
    ended = F.endswith(prefix, F.lit("$"))
    body = F.when(ended, F.substring(prefix, F.lit(1), F.length(prefix) - 1)).otherwise(prefix)
    parts = F.transform(F.split(body, "\\*"), lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit("^"), F.array_join(parts, ".*"), F.when(ended, F.lit("$")).otherwise(F.lit("")))


def allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths (host, path) and whether robots rules (host, prefix, allow) let them be fetched: the longest pattern decides, allow wins ties."""
    named = rules.select(F.col("host").alias("rule_host"), "prefix", "allow")
    fits = F.when(F.contains("prefix", F.lit("*")) | F.endswith("prefix", F.lit("$")), F.regexp_like("path", robots_pattern(F.col("prefix")))).otherwise(F.startswith("path", "prefix"))
    hit = paths.join(named, (F.col("host") == F.col("rule_host")) & fits, "left")
    best = F.max_by("allow", F.struct(F.length("prefix").alias("n"), F.col("allow").cast("int").alias("a")))
    return hit.groupBy("host", "path").agg(F.coalesce(best, F.lit(True)).alias("allowed"))


#: url, normalized_url, status_code (null if there was no answer), body, content_length, fetched_at (ms), fetch_time (ms), error.
CAPTURE = "url string, normalized_url string, status_code int, body string, content_length bigint, fetched_at bigint, fetch_time bigint, error string"


def http_get(agent: str = "millrace", timeout: float = 10.0, most: int = 16 << 20) -> Callable[[str], tuple[int, bytes]]:
    """A fetcher over the network: url to status and body; answers beyond `most` bytes are an error, not a cut."""

    def get(url: str) -> tuple[int, bytes]:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
                body = answer.read(most + 1)
                if len(body) > most:
                    raise ValueError(f"more than {most} bytes")
                return answer.status, body
        except HTTPError as e:
            return e.code, e.read(most)

    return get


def captures(frontier: DataFrame, get: Callable[[str], tuple[int, bytes]], delay: float = 0.0) -> DataFrame:
    """What `get` (url to status and body) gives for each url, with sizes and times. Urls of one host go to one task, which waits `delay` seconds
    between two of them; a failure is a row with its error, never a failed task."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        last: dict[str, float] = {}
        for batch in batches:
            rows = []
            for host, url in zip(*(c.to_pylist() for c in batch.columns)):
                if delay and host in last:
                    time.sleep(max(0.0, last[host] + delay - time.monotonic()))
                began, status, body, error = time.time(), None, None, None
                try:
                    status, body = get(url)
                except Exception as e:  # noqa: BLE001 a page's failure is data
                    error = f"{type(e).__name__}: {e}"
                last[host] = time.monotonic()
                rows.append((url, url.partition("#")[0], status, None if body is None else body.decode("utf-8", "replace"), None if body is None else len(body), int(began * 1000), int((time.time() - began) * 1000), error))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["url", "normalized_url", "status_code", "body", "content_length", "fetched_at", "fetch_time", "error"])

    ship(frontier.sparkSession)
    urls = frontier.select(host_of(F.col("url")).alias("host"), "url").filter("url is not null").distinct()
    return urls.repartition("host").mapInArrow(fetch, CAPTURE)


def last_visits(captured: DataFrame) -> DataFrame:
    """(url, visited_at, status_code, visits): the state that a next crawl starts from."""
    return captured.groupBy("url").agg(F.max("fetched_at").alias("visited_at"), F.max_by("status_code", "fetched_at").alias("status_code"), F.count(F.lit(1)).alias("visits"))


def due(frontier: DataFrame, visits: DataFrame, now_ms: int, age_ms: int) -> DataFrame:
    """Frontier urls that were never visited or whose last visit is at least age_ms ago."""
    seen = visits.filter(F.col("visited_at") > F.lit(now_ms - age_ms)).select("url")
    return frontier.join(seen, "url", "left_anti")


def frontier_order() -> list[Column]:
    """Lower priority first, then the earlier, then by chance."""
    return [F.col("priority").asc(), F.col("enqueued_ns").asc(), F.col("tiebreak").asc()]


def lossy_key(priority: Column, enqueued_ns: Column, tiebreak: Column) -> Column:
    """One byte, twelve bytes and three bytes as hex; sorts as frontier_order() does."""
    return F.concat(F.lpad(F.hex(priority), 2, "0"), F.lpad(F.hex(enqueued_ns), 24, "0"), F.lpad(F.hex(F.pmod(tiebreak, F.lit(1 << 24))), 6, "0"))


def take(frontier: DataFrame, n: int) -> DataFrame:
    return frontier.orderBy(*frontier_order()).limit(n)


def new_links(found: DataFrame, visited: DataFrame, key: str = "url") -> DataFrame:
    return found.select(key).distinct().join(visited.select(key), key, "left_anti")


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], budget: int | None = None, rounds: int | None = None, keep: Callable[[DataFrame], DataFrame] | None = None, order: list[Column] | None = None, root: str | None = None) -> DataFrame:
    """(url, round) of everything fetched, breadth first from seeds (url), until nothing new is found. fetch: (url) to (url, next), a row for each
    link, null for none.

    Every round is written to the shared folder, which cuts lineage; the driver holds only counts. Filtered URLs use no budget. A budget takes
    the first of a round by `order` (url). root: a folder for the rounds; a crawl that finds finished rounds there goes on after them. rounds: a bound on depth that the caller wants; with urls left beyond it the crawl fails."""
    spark = seeds.sparkSession
    root, left, k, files = root or fresh_path(spark, "crawl"), budget, 0, Files(spark)
    frontier, kind = seeds.select("url").distinct(), "url string, next string, round int"
    every = lambda: spark.read.option("recursiveFileLookup", "true").schema(kind).parquet(root)
    while files.exists(f"{root}/round={k:06d}/data/_SUCCESS"):
        k += 1
    if k:
        files.delete(f"{root}/round={k:06d}")  # a round that broke off
        left = None if left is None else max(0, left - every().select("url").distinct().count())
        frontier = new_links(spark.read.schema(kind).parquet(f"{root}/round={k - 1:06d}/data").filter("next is not null").select(F.col("next").alias("url")), every().select("url").distinct())
    while left != 0:
        if keep is not None:
            frontier = keep(frontier)
        if left is not None:
            frontier = frontier.orderBy(*(order or [F.col("url")])).limit(left)
        if rounds is not None and k >= rounds:
            if not frontier.isEmpty():
                raise RuntimeError(f"urls are left after {rounds} rounds")
            break
        got = fetch(frontier)
        got.select("url", "next", F.lit(k).alias("round")).write.parquet(f"{root}/round={k:06d}/data")
        now = spark.read.parquet(f"{root}/round={k:06d}/data")
        n = now.select("url").distinct().count()
        k += 1
        if not n:
            break
        left = None if left is None else left - n
        frontier = new_links(now.filter("next is not null").select(F.col("next").alias("url")), every().select("url").distinct())
    return every().groupBy("url").agg(F.min("round").alias("round"))


def report(captures: DataFrame, *by: str) -> DataFrame:
    """Pages, mean latency, mean and largest size; by host or over all."""
    return captures.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), F.avg("fetch_time").alias("avg_fetch_time"), F.avg("content_length").alias("avg_size"), F.max("content_length").alias("max_size"), F.sum("content_length").alias("total_size"))
