"""WARC archives and their capture index.

write_archives() writes one gzip member per record; of pages with equal payloads of at least `least` bytes the one with the largest id is the
response, and the others revisit it. Every task writes archives of its own into the shared folder, and only archives named in the manifest
that Spark commits count, so a repeated task does no harm.

capture_index() is an external merge. Each archive is read back record by record into a run sorted by URL key, timestamp and id; groups of
`fan_in` runs are cut by sampled splitters of that whole key (a URL with very many captures is cut too), and each range is merged from its
slices of the group's runs by a loser tree, pass after pass until one run is left. Ranges are in order, and so are the rows of each: together they
are the globally ordered capture histories.

Cases: a null payload is an empty one; empty payloads and those under `least` bytes are never revisits; equal ids with equal payloads: each
row gets a record, and those with the largest id are responses; a null id is never the response of another page and its record has no page
id; a null URL is an empty one; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import filesystem, fresh_path, modest_batches, staged
from millrace.ship import ship

LEAST, LEVEL, ARCHIVE_BYTES, FAN_IN = 1000, 1, 64 << 20, 64
#: Rows that a range of a merge has, and keys of a run that are sampled in so many rows.
RANGE_ROWS, SAMPLES = 50_000, 50
#: Timestamps of pages that bring none: this moment, and a second more for each id.
EPOCH = 1_704_067_200
_URL = re.compile(r"^(?:([a-z][a-z0-9+.-]*):)?(?://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?)?([^?#]*)(\?[^#]*)?", re.I | re.S)
INDEX = pa.schema([("urlkey", pa.string()), ("ts", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_DDL = "urlkey string, ts bigint, page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, archive string, offset bigint, length bigint"


def urlkey(url: str) -> str:
    """Sort-friendly form: host parts from the last to the first without www, then path and query; no scheme, port or fragment."""
    _, host, _, path, query = _URL.match(url.strip()).groups()
    host = re.sub(r"^www\d*\.", "", (host or "").lower()).strip(".")
    return ",".join(reversed(host.split("."))) + ")" + (path or "/") + (query or "")


def _one_line(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str, payload: bytes, digest: str, head: int | None, ts: int) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers only, whose Content-Length is that of the payload it stands for."""
    revisit = head is not None and page_id is not None and head != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>", f"WARC-Date: {datetime.fromtimestamp(ts, UTC):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {head}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Write:
    def __init__(self, folder: str, level: int, most: int):
        self.folder, self.level, self.most = folder, level, most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(self.folder)
        system.create_dir(root, recursive=True)
        out, name, size, n = None, "", 0, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([f"{self.folder}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])
        for batch in batches:
            ids, heads, stamps, digests, urls = (batch.column(k).to_pylist() for k in range(5))
            for i, head, ts, digest, url, payload in zip(ids, heads, stamps, digests, urls, batch.column(5)):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                member = packer.compress(record(i, url, payload.as_py().encode(), digest, head, ts)) + packer.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= self.most:
                    out.close()
                    yield done()
                    out = None
        if out is not None:
            out.close()
            yield done()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ts_col: str | None = None, least: int = LEAST, level: int = LEVEL, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives; returns their manifest: archive, records, bytes."""
    spark = pages.sparkSession
    ship(spark)
    modest_batches(spark)
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    page = pages[id_col].cast("bigint")
    ts = F.coalesce(pages[ts_col].cast("timestamp").cast("bigint") if ts_col else F.lit(None).cast("bigint"), F.lit(EPOCH) + F.pmod(F.coalesce(page, F.lit(0)), F.lit(10**9)))
    rows = pages.select(page.alias("id"), ts.alias("ts"), F.sha1(payload.cast("binary")).alias("digest"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    large = rows.filter(F.octet_length("payload") >= least)
    # Only digests that come more than once; staged so that their size is known before a join is chosen. A hot digest's pages are split by AQE.
    heads = staged(large.groupBy("digest").agg(F.max("id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "head"), "heads")
    folder = fresh_path(spark, "warc")
    joined = rows.join(heads, "digest", "left").select("id", F.when(F.octet_length("payload") >= least, F.col("head")).alias("head"), "ts", "digest", "url", "payload")
    return staged(joined.mapInArrow(_Write(folder, level, archive_bytes), "archive string, records bigint, bytes bigint"), "manifest")


def records(path: str) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length of the gzip member) of each record; one record is in memory at a time."""
    system, name = filesystem(path)
    with system.open_input_stream(name, compression=None) as source:
        start, data = 0, source.read(1 << 20)
        while data:
            opener, raw, used = zlib.decompressobj(31), [], 0
            while True:
                raw.append(opener.decompress(data))
                used += len(data) - len(opener.unused_data)
                if opener.eof:
                    break
                if not (data := source.read(1 << 20)):
                    raise ValueError(f"{path}: truncated record at {start}")
            head, _, rest = b"".join(raw).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])], start, used
            start += used
            data = opener.unused_data or source.read(1 << 20)


def _entry(fields: dict[str, str], block: bytes, path: str, start: int, used: int) -> tuple:
    number = lambda k: int(fields[k]) if k in fields else None
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    if kind == "response":
        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        n, digest = int(re.search(rb"(?mi)^Content-Length: (\d+)", http)[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    ts = int(datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
    return urlkey(fields["WARC-Target-URI"]), ts, number("X-Page-ID"), kind, n, digest, number("X-Refers-To-Page-ID"), path, start, used


def _key(row: tuple) -> tuple:
    return row[0], row[1], -(1 << 63) if row[2] is None else row[2], row[7], row[8]


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of each match, so the next winner costs one path to the root."""

    def __init__(self, sources: list[Iterator]):
        self.sources, self.k = sources, max(1, len(sources))
        self.heads = [next(s, None) for s in sources] or [None]
        self.keys = [None if h is None else _key(h) for h in self.heads]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        if b < 0 or a < 0:
            return a < 0  # while the tree fills, an empty place passes through
        x, y = self.keys[a], self.keys[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node:
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            if winner < 0:
                return  # the first of two to come waits here
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (w := self.tree[0]) >= 0 and self.heads[w] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.sources[w], None)
            self.keys[w] = None if self.heads[w] is None else _key(self.heads[w])
            self._play(w)


def _slice(path: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Rows of a sorted run with low <= key < high; row groups outside the URL keys are skipped."""
    system, name = filesystem(path)
    with system.open_input_file(name) as f:
        run = pq.ParquetFile(f)
        for g in range(run.num_row_groups):
            stats = run.metadata.row_group(g).column(0).statistics
            if stats is not None and stats.has_min_max and (low and stats.max < low[0] or high and stats.min > high[0]):
                continue
            for row in zip(*(c.to_pylist() for c in run.read_row_group(g).columns)):
                key = _key(row)
                if (low is None or key >= low) and (high is None or key < high):
                    yield row


def _batches(rows: Iterator[tuple], size: int = 5000) -> Iterator[pa.RecordBatch]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), INDEX.types)], schema=INDEX)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), INDEX.types)], schema=INDEX)


_KEY = "struct<u: string, t: bigint, p: bigint, a: string, o: bigint>"
_FILES = f"run bigint, path string, low {_KEY}, high {_KEY}, keys array<{_KEY}>"
_KEY_TYPE = pa.struct([("u", pa.string()), ("t", pa.int64()), ("p", pa.int64()), ("a", pa.string()), ("o", pa.int64())])


def _write_run(rows: Iterator[tuple], folder: str, run: int, every: int) -> pa.RecordBatch | None:
    """Writes sorted rows as a file of a run; its description: run, path, first and last key, and every so many keys."""
    system, root = filesystem(folder)
    system.create_dir(root, recursive=True)
    name, keys, n, first, last = f"{uuid.uuid4().hex}.parquet", [], 0, None, None
    with system.open_output_stream(f"{root}/{name}", compression=None) as f, pq.ParquetWriter(f, INDEX) as out:
        for batch in _batches(rows):
            out.write_batch(batch)
            at = lambda k: _key(tuple(c[k].as_py() for c in batch.columns))  # noqa: B023, E731
            keys += [at(k) for k in range(-n % every, batch.num_rows, every)]
            first, last, n = first or at(0), at(batch.num_rows - 1), n + batch.num_rows
    if not n:
        return None
    key = lambda x: dict(zip("utpao", x))
    return pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([key(first)], _KEY_TYPE), pa.array([key(last)], _KEY_TYPE), pa.array([[key(k) for k in keys]], pa.list_(_KEY_TYPE))], ["run", "path", "low", "high", "keys"])


def _merge_tasks(files: DataFrame, fan_in: int, per_range: int) -> DataFrame:
    """(run, k, low, high, paths): for each group of fan_in runs, ranges of keys in order and the files that may hold rows of each.

    Cuts are every per_range-th of the sampled keys, taken from a distributed sort; a file's first and last range come from its place among the
    cuts. Only cuts and file names meet in a window, one for each file's worth of rows."""
    files = files.withColumn("run", F.floor(F.col("run") / fan_in))
    keys = files.select("run", F.explode("keys").alias("key"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, n = None, 0
        for batch in batches:
            runs, out = batch.column(0).to_pylist(), []
            for k, run in enumerate(runs):
                n = 0 if run != before else n + 1
                before = run
                if n % per_range == 0:
                    out.append(k)
            yield batch.take(pa.array(out, pa.int64()))

    cuts = staged(keys.repartitionByRange("run", "key").sortWithinPartitions("run", "key").mapInArrow(cut, f"run bigint, key {_KEY}").distinct(), "cuts")
    ordered = W.partitionBy("run").orderBy("key")
    ranges = cuts.select("run", (F.row_number().over(ordered) - 1).alias("k"), "key", F.lead("key").over(ordered).alias("high"))
    # Rows before the first cut belong to its range: the smallest key of all is a sampled one, so there are none.
    ends = files.select("run", "path", F.explode(F.array(F.struct(F.col("low").alias("key"), F.lit(0).alias("end")), F.struct(F.col("high").alias("key"), F.lit(1).alias("end")))).alias("x")).select("run", "path", "x.key", "x.end")
    both = cuts.select("run", F.lit(None).cast("string").alias("path"), "key", F.lit(-1).alias("end")).unionByName(ends)
    ranked = both.withColumn("k", F.sum(F.when(F.col("end") == -1, 1).otherwise(0)).over(W.partitionBy("run").orderBy("key", "end").rowsBetween(W.unboundedPreceding, 0)) - 1).filter("end >= 0")
    spans = ranked.groupBy("run", "path").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    held = spans.select("run", "path", F.explode(F.sequence(F.col("a").cast("int"), F.col("b").cast("int"))).alias("k")).groupBy("run", "k").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return ranges.join(held, ["run", "k"]).select("run", "k", F.col("key").alias("low"), "high", "paths")


def _read_tasks(batch: pa.RecordBatch) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(run, merged rows) of each task of a batch (run, k, low, high, paths), in order."""
    tuple_of = lambda x: None if x is None else tuple(x[c] for c in "utpao")
    for run, low, high, paths in zip(*(batch.column(j).to_pylist() for j in (0, 2, 3, 4))):
        yield run, iter(LoserTree([_slice(p, tuple_of(low), tuple_of(high)) for p in paths]))


def capture_index(manifest: DataFrame, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Reads the archives back: one row for each record, in order of (urlkey, ts, page_id). `manifest` is a staged table.

    Every pass merges fan_in runs at a time, each group by ranges of about range_rows rows, so passes keep all executors busy; the driver holds
    only the number of runs."""
    spark = manifest.sparkSession
    ship(spark)
    modest_batches(spark)
    folder, every = fresh_path(spark, "runs"), max(1, range_rows // SAMPLES)
    per_range = max(1, range_rows // every)

    def read(batches):
        for batch in batches:
            for run, path in zip(*(batch.column(j).to_pylist() for j in (0, 1))):
                done = _write_run(iter(sorted((_entry(h, b, path, at, n) for h, b, at, n in records(path)), key=_key)), folder, run, every)
                if done is not None:
                    yield done

    def merge_files(batches):
        for batch in batches:
            for run, rows in _read_tasks(batch):
                done = _write_run(rows, folder, run, every)
                if done is not None:
                    yield done

    def merge_rows(batches):
        for batch in batches:
            for _, rows in _read_tasks(batch):
                yield from _batches(rows)

    runs = manifest.count()
    if not runs:
        return spark.createDataFrame([], _DDL)
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    archives = manifest.select(F.xxhash64("archive").alias("h"), "archive").repartition(min(runs, max(slots, runs // 4)), "h")
    # Runs are numbered by archive, evenly enough for groups: numbers only say which runs are merged together.
    numbered = archives.select(F.pmod("h", F.lit(runs)).alias("run"), "archive")
    files = staged(numbered.mapInArrow(read, _FILES), "runs")
    groups = runs
    while groups > fan_in:
        tasks = _merge_tasks(files, fan_in, per_range)
        files, groups = staged(tasks.repartition("run", "k").mapInArrow(merge_files, _FILES), "runs"), -(-groups // fan_in)
    tasks = staged(_merge_tasks(files, fan_in, per_range), "tasks")
    n = max(1, min(tasks.count(), max(slots, runs)))
    return tasks.repartitionByRange(n, "k").sortWithinPartitions("k").mapInArrow(merge_rows, _DDL)


def archived(pages: DataFrame, **options) -> DataFrame:
    """Archives written and read back: the index of all captures."""
    return capture_index(write_archives(pages, **options))
