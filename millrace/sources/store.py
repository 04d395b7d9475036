"""A versioned table store: column groups of parquet files under a commit log.

A store has column groups that share id columns. append() writes one parquet dataset for each group that the rows have columns of, records a
commit and moves the branch. read() resolves a reference, folds that version's commits and joins the groups that the asked columns need.
"""

from __future__ import annotations

import io
import json
import re
import tarfile
import time
import uuid
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import merge
from millrace.operators.partition import KeyHash, Window
from millrace.sources.log import ROOT, Commit, Log, LogError, Ref
from millrace.workspace import Files

PART_BYTES = 1 << 30
#: Bytes that a task of a write takes at most, shuffled ones or those of files: writing by parts sorts a task's rows, which takes several times
#: their shuffled size, and an aggregation before its shuffle may keep all keys of a scan.
TASK_BYTES, SCAN_BYTES = 64 << 20, 16 << 20
_ADVISED, _SCANNED = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
#: Bytes of files after a checkpoint up to which their keys are broadcast, so that the checkpoint's untouched rows are not shuffled.
SMALL_BYTES = 16 << 20
#: Bytes that a text counts for the most rows of a file.
WIDTH = 64
#: Data younger than this is not vacuumed, as a commit may be on its way.
VACUUM_AGE_MS = 24 * 3600 * 1000


def spec_of(p: KeyHash | Window | None) -> dict | None:
    return None if p is None else {"keys": list(p.keys), "parts": p.parts} if isinstance(p, KeyHash) else {"key": p.key, "size": p.size}


def from_spec(p: dict | None) -> KeyHash | Window | None:
    return None if p is None else KeyHash(tuple(p["keys"]), p["parts"]) if "keys" in p else Window(p["key"], p["size"])


@dataclass(frozen=True)
class Group:
    """Columns stored together. partition: KeyHash, Window or None."""

    name: str
    ids: tuple[str, ...]
    columns: tuple[str, ...]
    partition: KeyHash | Window | None = None


def _configs(files: Files, root: str) -> list[tuple[int, str]]:
    """Numbers and names of a store's configurations."""
    return [(int(n.rpartition(".")[2]) if n != "store.json" else 0, n) for n in files.names(root) if re.fullmatch(r"store\.json(\.\d{8})?", n)]


class Store:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, groups: list[Group]):
        self.spark, self.root, self.schema, self.groups = spark, root.rstrip("/"), schema, groups
        self.files = Files(spark)
        self.log = Log(self.files, f"{self.root}/log")

    # Making and opening

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: T.StructType, groups: list[Group]) -> Store:
        ids = {g.ids for g in groups}
        if len(ids) != 1:
            raise ValueError("column groups share their id columns")
        known = [c for g in groups for c in g.columns]
        if len(set(known)) != len(known) or set(known) | set(groups[0].ids) != set(schema.names):
            raise ValueError("every column that is no id belongs to one group")
        store = cls(spark, root, schema, groups)
        store.log.init()
        store._configure()
        return store

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Store:
        files = Files(spark)
        Log(files, f"{root.rstrip('/')}/log").check()
        newest = max(_configs(files, root.rstrip("/")))
        config = json.loads(files.read(f"{root.rstrip('/')}/{newest[1]}"))
        return cls(spark, root, T.StructType.fromJson(config["schema"]), [Group(g["name"], tuple(g["ids"]), tuple(g["columns"]), from_spec(g["partition"])) for g in config["groups"]])

    @property
    def ids(self) -> list[str]:
        return list(self.groups[0].ids)

    def _types(self, names: list[str]) -> T.StructType:
        return T.StructType([T.StructField(n, self.schema[n].dataType, True, self.schema[n].metadata) for n in names])

    # Writing

    def append(self, df: DataFrame, branch: str = "main", message: str = "", committer: str = "", application: str = "", timestamp: int | None = None, expressions: dict[str, str] | None = None, advance: bool = True, part_bytes: int = PART_BYTES, parent: str | None = None, check_keys: bool = True, checkpoint_every: int | None = None) -> Commit:
        """Writes rows as a new commit and moves the branch to it. Keys must be there and come once (`check_keys` reads the written keys again to
        see to it); null values change nothing. Columns with an entry in `expressions` merge with what was there in this commit.

        checkpoint_every: once so many commits have come after the newest checkpoint, the new head gets one, so that reads stay short.
        A boolean column `_deleted` marks keys to delete. If the write, the check or the move fails, the written files are removed."""
        ids = self.ids
        unknown = set(df.columns) - set(self.schema.names) - {merge.DELETED}
        if unknown or set(ids) - set(df.columns):
            raise ValueError(f"columns do not fit the store: {sorted(unknown or set(ids) - set(df.columns))}")
        for f in df.schema:
            if f.name in self.schema.names and f.dataType != self.schema[f.name].dataType and f.name in ids:
                raise ValueError(f"{f.name} is {self.schema[f.name].dataType.simpleString()}; another id type would go to other parts")
        for c, how in (expressions or {}).items():
            merge.step(how, self.schema[c].dataType.simpleString())
        deletes = merge.DELETED in df.columns
        df = df.select(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in df.columns if c in self.schema.names), *([merge.DELETED] if deletes else []))
        parent = self.log.head_id(branch)[1] if parent is None else parent
        job = uuid.uuid4().hex
        base, tiles = f"{self.root}/objects/{job}", []
        try:
            for g in self.groups:
                own = [c for c in g.columns if c in df.columns]
                if not own and not deletes:
                    continue
                tiles += self._write(df.select(*ids, *own, *([merge.DELETED] if deletes else [])), g, f"{base}/{g.name}", part_bytes)
            if check_keys:
                self._check_keys(tiles)
            fields = {"timestamp": timestamp} if timestamp is not None else {}
            commit = self.log.new(parent, message=message, committer=committer, application=application, columns=[c for c in df.columns if c != merge.DELETED], expressions=expressions or {}, tiles=tiles, deletes=deletes, **fields)
            if advance:
                self.log.fast_forward(branch, commit)
        except Exception:
            self.files.delete(base)
            raise
        if advance and checkpoint_every and len(self.log.view(commit)[1]) >= checkpoint_every:
            self.checkpoint(commit)
        return commit

    def append_tiled(self, tiles: list[tuple[str, str, DataFrame | list[str]]], columns: list[str], branch: str = "main", message: str = "", advance: bool = True, check_keys: bool = True, **fields) -> Commit:
        """A commit made of tiles (group, part, rows or paths): rows are written to their tile as they are, parquet files are taken where they
        lie. `part` is the directory name that the group's spec gives (such as _part=3), or empty for a group without one; rows that belong
        to another part are an error. columns: the value columns that the tiles bring."""
        by, done, base = {g.name: g for g in self.groups}, [], f"{self.root}/objects/{uuid.uuid4().hex}"
        try:
            for k, (name, part, what) in enumerate(tiles):
                g = by[name]
                own = [*g.ids, *(c for c in g.columns if c in columns)]
                if (g.partition is None) != (part == ""):
                    raise ValueError(f"{name} takes {'no' if g.partition is None else 'a'} part")
                rows = self.spark.read.schema(self._types(own)).parquet(*what) if isinstance(what, list) else what.select(*own)
                if part:
                    wrong = rows.filter(F.concat(F.lit("_part="), g.partition.column().cast("string")) != part)
                    if not wrong.isEmpty():
                        raise ValueError(f"rows of another part in {part}")
                if isinstance(what, list):
                    files = [{"path": p, "kind": "data", "size": n} for w in what for p, n in self.files.tree(w) if p.endswith(".parquet")]
                else:
                    at = f"{base}/{name}/{k}/{part}" if part else f"{base}/{name}/{k}"
                    rows.write.parquet(at)
                    files = [{"path": p, "kind": "data", "size": n} for p, n in self.files.tree(at) if p.endswith(".parquet")]
                done.append({"group": name, "part": part, "files": files, "spec": spec_of(g.partition)})
            if check_keys:
                for g in {t["group"] for t in done}:
                    self._check_keys([t for t in done if t["group"] == g])
            commit = self.log.new(self.log.head_id(branch)[1], message=message, columns=[*self.ids, *columns], tiles=done, **fields)
            if advance:
                self.log.fast_forward(branch, commit)
            return commit
        except Exception:
            self.files.delete(base)
            raise

    def _check_keys(self, tiles: list[dict]) -> None:
        """Raises if the files of a commit's first group hold a key twice; only id columns are read."""
        if not tiles:
            return
        own = [f for t in tiles if t["group"] == tiles[0]["group"] for f in t["files"]]
        keys = self.spark.read.schema(self._types(self.ids)).parquet(*(f["path"] for f in own))
        again = merge.together(keys, self.ids, sum(f["size"] for f in own)).groupBy(*self.ids).count().filter("count > 1")
        if row := again.first():
            raise ValueError(f"key {tuple(row)[:-1]} comes {row['count']} times in one append")

    def _write(self, df: DataFrame, g: Group, path: str, part_bytes: int, order: list[Column] | None = None) -> list[dict]:
        checked = df
        for c in g.ids:
            checked = checked.filter(F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null")).cast("boolean")).otherwise(True))
        writer_df = checked
        if g.partition is not None:
            keys = g.partition.keys if isinstance(g.partition, KeyHash) else (g.partition.key,)
            if not set(keys) <= set(df.columns):
                raise ValueError(f"{g.name} is partitioned by columns that these rows lack")
            writer_df = checked.withColumn("_part", g.partition.column())
        # A rebalance, not a repartition: adaptive execution measures what was shuffled, cuts a large part among several tasks and joins small ones,
        # so that a task takes about TASK_BYTES however large the part. The bounds hold for the scans and shuffles of df's own plan too.
        writer_df = writer_df.hint("rebalance", *(["_part"] if g.partition is not None else []))
        if order:
            writer_df = writer_df.sortWithinPartitions(*(["_part"] if g.partition is not None else []), *order)
        writer = writer_df.write.option("maxRecordsPerFile", self._rows(df, part_bytes))
        before = {k: self.spark.conf.get(k) for k in (_ADVISED, _SCANNED)}
        for k, most in ((_ADVISED, min(part_bytes, TASK_BYTES)), (_SCANNED, SCAN_BYTES)):
            self.spark.conf.set(k, f"{min(most, self.spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[k]))}b")
        try:
            (writer.partitionBy("_part") if g.partition is not None else writer).parquet(path)
        finally:
            for k, own in before.items():
                self.spark.conf.set(k, own)
        by: dict[str, list[dict]] = {}
        for p, size in self.files.tree(path):
            if p.endswith(".parquet"):
                folder = p.rsplit("/", 1)[0]
                by.setdefault(folder.rsplit("/", 1)[1] if "_part=" in folder else "", []).append({"path": p, "kind": "data", "size": size})
        return [{"group": g.name, "part": part, "files": files, "spec": spec_of(g.partition)} for part, files in sorted(by.items())]

    def _rows(self, df: DataFrame, part_bytes: int) -> int:
        """Rows that fit a part file if texts are WIDTH bytes wide: an upper bound for narrow rows beside the measured sizes of _write()."""
        width = sum(WIDTH if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)) else 8 for f in df.schema)
        return max(1, part_bytes // max(1, width))

    def replace_duplicates(self, df: DataFrame, newest: str) -> DataFrame:
        """One row for each key, that with the largest `newest`: what an append needs if its input repeats keys."""
        values = [c for c in df.columns if c not in self.ids]
        return df.groupBy(*self.ids).agg(*(F.max_by(c, newest).alias(c) for c in values))

    # Reading

    def _part(self, spec: KeyHash | Window, key: dict[str, object]) -> str:
        typed = self.spark.range(1).select(*(F.lit(v).cast(self.schema[k].dataType).alias(k) for k, v in key.items()))
        return f"_part={typed.select(spec.column()).first()[0]}"

    def _paths(self, c: Commit, g: Group, part: str | None, key: dict[str, object], known: dict) -> list[str]:
        """The folders, and files taken from elsewhere, of a commit's group that can hold a part or key. Every tile is asked by the spec that it was written with."""
        out = set()
        for t in c.tiles:
            if t["group"] != g.name:
                continue
            spec = from_spec(t["spec"]) if "spec" in t else g.partition
            want = part if t["part"] else None
            if want is None and t["part"] and spec is not None and set(spec.keys if isinstance(spec, KeyHash) else (spec.key,)) <= set(key):
                if spec not in known:
                    known[spec] = self._part(spec, key)
                want = known[spec]
            if want is None or t["part"] == want:
                out |= {f["path"].rsplit("/", 1)[0] if self._own(f["path"]) else f["path"] for f in t["files"]}
        return sorted(out)

    def _group(self, g: Group, checkpoint: Commit | None, commits: list[Commit], columns: list[str], part: str | None = None, key: dict[str, object] | None = None) -> DataFrame:
        actions, how, deletes, known, size, late = [], [], False, {}, 0, 0
        for c in [*([checkpoint] if checkpoint else []), *commits]:
            paths = self._paths(c, g, part, key or {}, known)
            if not paths:
                continue
            there = columns if c is checkpoint else [x for x in columns if x in c.columns]
            names = [*g.ids, *there]
            schema = self._types(names)
            if c.deletes:
                schema, deletes = schema.add(merge.DELETED, T.BooleanType()), True
            rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)
            for k, v in (key or {}).items():
                rows = rows.filter(F.col(k) == F.lit(v))
            actions.append(rows)
            how.append({k: v for k, v in c.expressions.items() if k in columns})
            held = sum(f["size"] for t in c.tiles if t["group"] == g.name for f in t["files"])
            size, late = size + held, late + (0 if c is checkpoint else held)
        if not actions:
            return self.spark.createDataFrame([], self._types([*g.ids, *columns]))
        if checkpoint and len(actions) > 1 and late <= SMALL_BYTES and set(actions[0].columns) == {*g.ids, *columns}:
            out = merge.fold_small(actions[0], actions[1:], list(g.ids), how, deletes)
        else:
            out = merge.fold(actions, list(g.ids), how, deletes, 0 if key or part else size)
        return out.select(*g.ids, *(F.col(c) if c in out.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in columns))

    def read(self, ref: object = Ref(), columns: list[str] | None = None, part: str | None = None, key: dict[str, object] | None = None) -> DataFrame:
        """The table at a reference. Only groups that hold asked columns are read; `part` (such as _part=3) reads one partition of each.

        `key` keeps the rows with these ids: every scan filters them, and of files partitioned by some of them only one partition is read."""
        checkpoint, commits = self.log.view(ref)
        wanted = [c for c in (columns or self.schema.names) if c not in self.ids]
        used = [g for g in self.groups if set(g.columns) & set(wanted)] or self.groups[:1]
        tables = [self._group(g, checkpoint, commits, [c for c in g.columns if c in wanted], part, key) for g in used]
        return merge.join_groups(tables, self.ids).select(*(F.col(c).alias(c, metadata=m) if (m := self.schema[c].metadata) else F.col(c) for c in columns or self.schema.names))

    def get(self, key: dict[str, object], ref: object = Ref(), columns: list[str] | None = None) -> DataFrame:
        """The row of one key; of files partitioned by the key only its partition is read, however each commit was partitioned."""
        return self.read(ref, columns, None, key)

    def register(self, name: str, ref: object = Ref(), columns: list[str] | None = None) -> DataFrame:
        df = self.read(ref, columns)
        df.createOrReplaceTempView(name)
        return df

    # Versions

    def branch(self, name: str, at: object = Ref()) -> None:
        self.log.branch(name, at)

    def checkpoint(self, ref: object = Ref(), replace: bool = False, groups: list[Group] | None = None, order: list[Column] | None = None) -> None:
        """Writes the folded version, partitioned as its groups are, so that reads start there. replace: a newer one may take the place of one.
        order: expressions by which rows are sorted in their files, such as a z-order of some columns, so that filters on them skip row groups."""
        commit = self.log.resolve(ref)
        before, commits = self.log.view(commit)
        if self.log.has_checkpoint(commit.id) and not replace:
            raise LogError(f"commit {commit.id[:8]} has a checkpoint")
        tiles = []
        for g in groups or self.groups:
            tiles += self._write(self._group(g, before, commits, list(g.columns)), g, f"{self.root}/objects/checkpoint-{uuid.uuid4().hex}/{g.name}", PART_BYTES, order)
        self.log.put_checkpoint(commit.id, tiles, replace)

    def repartition(self, group: str, partition: KeyHash | Window | None, ref: object = Ref()) -> Store:
        """Gives a group another partition spec: the version is written anew as a checkpoint, then later appends follow the spec.

        Each file's spec is kept with it, so readers of any version find keys before, between and after the two steps."""
        groups = [Group(g.name, g.ids, g.columns, partition) if g.name == group else g for g in self.groups]
        if groups == self.groups:
            return self
        self.checkpoint(ref, replace=True, groups=groups)
        self._configure(groups)
        return self

    def add_columns(self, group: str, fields: T.StructType) -> Store:
        """New columns of a group, null in all rows so far."""
        if set(fields.names) & set(self.schema.names):
            raise ValueError("the store has such a column")
        groups = [Group(g.name, g.ids, (*g.columns, *fields.names), g.partition) if g.name == group else g for g in self.groups]
        if groups == self.groups:
            raise ValueError(f"no group {group}")
        self._configure(groups, T.StructType([*self.schema, *fields]))
        return self

    def describe(self, column: str, metadata: dict) -> Store:
        """Sets a column's metadata, which readers find in the schema."""
        fields = [T.StructField(f.name, f.dataType, f.nullable, metadata) if f.name == column else f for f in self.schema]
        if column not in self.schema.names:
            raise ValueError(f"no column {column}")
        self._configure(self.groups, T.StructType(fields))
        return self

    def _configure(self, groups: list[Group] | None = None, schema: T.StructType | None = None) -> None:
        """Writes the next configuration; creation is exclusive, so of two rivals one fails and nothing is ever missing."""
        groups, schema = groups or self.groups, schema or self.schema
        config = {"schema": schema.jsonValue(), "groups": [{"name": g.name, "ids": g.ids, "columns": g.columns, "partition": spec_of(g.partition)} for g in groups]}
        last = max(_configs(self.files, self.root), default=(-1, ""))[0]
        name = "store.json" if last < 0 else f"store.json.{last + 1:08d}"
        if not self.files.create(f"{self.root}/{name}", json.dumps(config).encode()):
            raise LogError("the store was configured meanwhile")
        self.groups, self.schema = groups, schema

    def squash(self, branch: str, onto: object, name: str, message: str = "squash") -> Commit:
        """A new branch at `onto` with all that another branch holds as one commit on top."""
        self.log.branch(name, onto)
        return self.append(self.read(Ref(branch)), branch=name, message=message)

    def rebase(self, branch: str, onto: object = Ref()) -> list[Commit]:
        """Puts what a branch has beyond its common ancestor with `onto` on top of that; files are shared, and commits that fall away go with
        vacuum(). A branch that moves meanwhile makes this fail."""
        seq, head = self.log.head_id(branch)
        base = self.log.resolve(onto)
        known = {c.id for c in self.log.lineage(base)}
        own = []
        for c in self.log.lineage(self.log.commit(head)):
            if c.id in known:
                break
            own.append(c)
        parent, made = base.id, []
        for c in reversed(own):
            made.append(self.log.new(parent, **{k: v for k, v in asdict(c).items() if k not in ("id", "parent")}))
            parent = made[-1].id
        self.log.move(branch, parent, seq)
        return made

    def inferred_schema(self) -> T.StructType:
        """The schema that the newest files show, for a store whose configuration is doubted: ids first, then each group's columns."""
        checkpoint, commits = self.log.view(Ref())
        found: dict[str, T.StructField] = {}
        for c in [*reversed(commits), *([checkpoint] if checkpoint else [])]:
            for g in {t["group"] for t in c.tiles}:
                first = next((f["path"] for t in c.tiles if t["group"] == g for f in t["files"] if f["kind"] == "data"), None)
                for field in self.spark.read.parquet(first).schema if first else []:
                    if field.name not in ("_part", merge.DELETED):
                        found.setdefault(field.name, field)
        return T.StructType([*(found.pop(c) for c in self.ids if c in found), *found.values()])

    def vacuum(self, age_ms: int = VACUUM_AGE_MS) -> list[str]:
        """Deletes data that no commit or checkpoint reachable from a branch names and that is older than age_ms; returns the folders."""
        used = set()
        for b in self.log.branches():
            _, head = self.log.head_id(b)
            for c in self.log.lineage(self.log.commit(head)) if head != ROOT else []:
                used |= {self._own(f["path"]) for t in [*c.tiles, *self.log.checkpoint_tiles(c.id)] for f in t["files"]}
        old = int(time.time() * 1000) - age_ms
        dead = [n for n in self.files.names(f"{self.root}/objects") if n not in used and self.files.modified(f"{self.root}/objects/{n}") <= old]
        for n in dead:
            self.files.delete(f"{self.root}/objects/{n}")
        return dead

    def _own(self, path: str) -> str | None:
        """The folder below the store's objects that a path lies in; None for files from elsewhere."""
        _, found, rest = path.partition(f"/{self.root.rsplit('/', 1)[-1]}/objects/")
        return rest.split("/")[0] if found else None

    def history(self, ref: object = Ref(), n: int | None = None) -> DataFrame:
        """The log as rows, newest first by `age`."""
        rows = [(k, c.id, c.parent, c.timestamp, c.message, c.committer, c.columns, sum(f["size"] for t in c.tiles for f in t["files"]), self.log.has_checkpoint(c.id)) for k, c in enumerate(self.log.history(ref, n))]
        return self.spark.createDataFrame(rows, "age int, commit_id string, parent_id string, timestamp bigint, message string, committer string, columns array<string>, bytes bigint, checkpoint boolean")

    def size(self, ref: object = Ref()) -> int:
        checkpoint, commits = self.log.view(ref)
        return sum(f["size"] for c in [*([checkpoint] if checkpoint else []), *commits] for t in c.tiles for f in t["files"])

    # Blobs

    def commit_blob(self, folder: str, branch: str = "main", message: str = "") -> Commit:
        """Packs a folder of the driver into one tracked archive."""
        data = io.BytesIO()
        with tarfile.open(fileobj=data, mode="w:gz") as tar:
            tar.add(folder, arcname=".")
        name = f"{self.root}/objects/blob-{uuid.uuid4().hex}/archive.tar.gz"
        self.files.create(name, data.getvalue())
        _, head = self.log.head_id(branch)
        commit = self.log.new(head, message=message, tiles=[{"group": "", "part": "", "files": [{"path": name, "kind": "blob", "size": len(data.getvalue())}]}])
        self.log.fast_forward(branch, commit)
        return commit

    def restore_blob(self, commit: Commit, folder: str) -> None:
        for t in commit.tiles:
            for f in t["files"]:
                if f["kind"] == "blob":
                    Path(folder).mkdir(parents=True, exist_ok=True)
                    with tarfile.open(fileobj=io.BytesIO(self.files.read(f["path"])), mode="r:gz") as tar:
                        tar.extractall(folder, filter="data")
