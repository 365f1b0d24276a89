"""A vector store of Parquet folders: points in buckets, metadata and a manifest, and pages of tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA_VERSION = "3"
POINTS = "id string, vector array<float>, file_path string, file_hash string, code_chunk string, start_line int, end_line int, segment_hash string"
MANIFEST = "rel_path string, hash string, size long, mtime_ms double, indexed_at long"
METADATA = "key string, value string"
REQUIRED = ("file_path", "code_chunk", "start_line", "end_line")


class Mismatch(ValueError):
    """The store holds vectors of another kind; it is never recreated silently."""


def upserted(target: DataFrame, rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """``target`` with ``rows`` in place of those with the same key.  Of rows that share a key the
    last by ``order`` stays, if it is given; else all do.  Rows without required fields go."""
    fields = [c for c in REQUIRED if c in rows.columns]
    good = rows.dropna(subset=fields) if fields else rows
    if order:
        one = F.max_by(F.struct(*[c for c in good.columns if c != key]), order)
        good = good.groupBy(key).agg(one.alias("row")).select(key, "row.*").select(*good.columns)
    return target.join(good.select(key).distinct(), key, "left_anti").unionByName(good)


def without_paths(target: DataFrame, paths: DataFrame) -> DataFrame:
    """``target`` without rows of the given files (file_path); slashes of both kinds are equal."""
    gone = paths.select(F.translate("file_path", "\\", "/").alias("gone_")).distinct()
    return target.join(gone, F.translate("file_path", "\\", "/") == F.col("gone_"), "left_anti")


def projected(df: DataFrame, wanted: list[str], schema: str = POINTS) -> DataFrame:
    """The wanted columns that are there; null for the rest, of the type that ``schema`` says."""
    kinds = dict(x.split(" ", 1) for x in schema.split(", "))
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in wanted])


def metadata_row(metadata: DataFrame) -> DataFrame:
    """Metadata (key, value) as one row of provider, model, dimension, complete, schema; a profile
    without a provider, a model or a positive dimension is null."""
    value = lambda k: F.nullif(F.trim(F.max(F.when(F.col("key") == k, F.col("value")))), F.lit(""))
    one = metadata.agg(*[value(k).alias(k) for k in ("provider", "model", "dimension", "complete", "schema")])
    dim = F.col("dimension").try_cast("int")
    good = F.col("provider").isNotNull() & F.col("model").isNotNull() & F.coalesce(dim > 0, F.lit(False))
    return one.select(F.when(good, F.concat_ws(":", "provider", "model", "dimension")).alias("profile"), F.coalesce(F.col("complete") == "true", F.lit(False)).alias("complete"), "schema")


def page(df: DataFrame, key: str, after: object = None, limit: int = 100) -> DataFrame:
    """A page of ``df`` in the order of a unique ``key``: up to ``limit`` rows beyond ``after``, with
    ``next``, the key to go on after, or null on the last page."""
    if limit < 1:
        raise ValueError("a page has a row at least")
    rows = (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one page
    return rows.withColumn("next", F.when(F.count("*").over(whole) == limit, F.max(key).over(whole)))


def prefix_page(pairs: DataFrame, prefix: str, after: str | None = None, limit: int = 100) -> DataFrame:
    """A page of the pairs (key, value) whose keys begin with ``prefix``."""
    return page(pairs.where(F.startswith("key", F.lit(prefix))), "key", after, limit)


def looked_up(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``target`` with these ids, each once; ids that aren't there give none."""
    return target.join(ids.select(key).distinct(), key, "left_semi")


def without_prefixes(target: DataFrame, paths: DataFrame) -> DataFrame:
    """``target`` without the given files and all that lie under them as folders (file_path): each
    path is met by its own heads, so no row is compared with every prefix."""
    parts = F.filter(F.split(F.translate("file_path", "\\", "/"), "/"), lambda p: p != "")
    gone = paths.select(F.array_join(parts, "/").alias("gone_")).where("gone_ <> ''").distinct()
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    met = target.select("file_path").distinct().withColumn("gone_", F.explode(heads)).join(gone, "gone_").select("file_path").distinct()
    return target.join(met, "file_path", "left_anti")


def baseline_of(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """(root, name): of each root's candidates (root, name, rank, cached) that the catalog (name) has,
    the cached one, else the first by rank."""
    there = candidates.join(catalog.select("name").distinct(), "name")
    first = F.min_by("name", F.struct(~F.coalesce("cached", F.lit(False)), "rank", "name"))
    return there.groupBy("root").agg(first.alias("name"))


class Store:
    """Points and manifest in buckets by a hash of their path, and ``heads``: one small text file a
    state, which names the folders of each bucket.

    A write makes new folders for the buckets that it changes, then renames a new head to the next
    number.  So a write that is interrupted changes nothing, readers see one state or the other,
    and a change costs its buckets, not the index.  Of two writers that begin from one state the
    second to commit fails where the file system refuses to rename to a name that is there, as HDFS
    does.  Local disks and object stores may overwrite it, so there a store has one writer at a time."""

    #: Buckets of a new store, points of a bucket that ``grow`` aims at, and most buckets.
    BUCKETS, POINTS_OF_BUCKET, MOST_BUCKETS = 64, 50_000, 65_536

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._scratch = spark, root.rstrip("/"), []

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _heads(self) -> list[str]:
        fs, path = self._fs(), self._path(f"{self.root}/heads")
        names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
        return [n for n in names if n.endswith(".json")]

    def head(self) -> dict | None:
        names = self._heads()
        return json.loads(self.spark.read.text(f"{self.root}/heads/{names[-1]}", wholetext=True).first()[0]) if names else None

    def exists(self) -> bool:
        return self.head() is not None

    def _commit(self, parent: dict | None, **changes) -> None:
        """The head after ``parent``: written beside the heads, then renamed to the next number, unless
        another writer has taken it."""
        head = (parent or {"number": 0, "metadata": {}, "n": self.BUCKETS, "buckets": {}, "manifest": {}}) | changes
        head["number"] += 1
        fs, name = self._fs(), self._path(f"{self.root}/heads/{head['number']:012d}.json")
        own = self._path(f"{self.root}/heads/.{uuid.uuid4().hex}")
        out = fs.create(own, False)
        out.write(json.dumps(head).encode())
        out.close()
        if fs.exists(name) or not fs.rename(own, name):
            fs.delete(own, False)
            raise Mismatch("another writer has changed the store")

    def ensure(self, profile: str, dimension: int) -> None:
        """Create the store, or check that it holds vectors of this kind."""
        head = self.head()
        if head is None:
            self._commit(None, metadata={"schema": SCHEMA_VERSION, "profile": profile, "dimension": dimension, "complete": False})
            return
        m = head["metadata"]
        if m.get("schema") != SCHEMA_VERSION:
            raise Mismatch(f"schema {m.get('schema')}, not {SCHEMA_VERSION}")
        if m.get("dimension") != dimension:
            raise Mismatch(f"dimension {m.get('dimension')}, not {dimension}")
        if m.get("profile") != profile:
            if not self.points().isEmpty():
                raise Mismatch(f"profile {m.get('profile')}, not {profile}")
            self._commit(head, metadata=m | {"profile": profile})

    def _bucket(self, column: str, n: int):
        return F.pmod(F.xxhash64(F.translate(column, "\\", "/")), F.lit(n)).cast("int")

    def _write(self, kind: str, rows: DataFrame, schema: str, path: str, n: int) -> dict[str, str]:
        """Write rows by the bucket of their ``path``, sorted by it; the folder of each bucket that
        has any."""
        name = f"{kind}-{uuid.uuid4().hex}"
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = projected(rows, [x.split()[0] for x in schema.split(", ")], schema).withColumn("bucket", self._bucket(path, n)).repartitionByRange(width, "bucket", path)
        writer = dealt.sortWithinPartitions("bucket", path).write.partitionBy("bucket")
        if kind == "points":  # ids aren't in the order of paths, so files say by a Bloom filter which ids they may have
            writer = writer.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.root}/{name}")
        made = (s.getPath().getName() for s in self._fs().listStatus(self._path(f"{self.root}/{name}")))
        return {m.split("=")[1]: f"{name}/{m}" for m in made if m.startswith("bucket=")}

    def _read(self, folders, schema: str) -> DataFrame:
        paths = [f"{self.root}/{x}" for x in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def points(self) -> DataFrame:
        head = self.head()
        return self._read(sorted(head["buckets"].values()) if head else [], POINTS)

    def lookup(self, ids: list[str]) -> DataFrame:
        """The points with these ids, for some hundreds of them: comparisons go down to the files, whose
        Bloom filters tell which parts can't have them, and those aren't read.  For large sets of ids
        ``looked_up`` joins."""
        wanted = F.lit(False)
        for i in dict.fromkeys(ids):
            wanted = wanted | (F.col("id") == F.lit(i))
        return self.points().where(wanted)

    def manifest(self) -> DataFrame | None:
        head = self.head()
        return None if head is None else self._read(sorted(head["manifest"].values()), MANIFEST)

    def info(self) -> dict:
        head = self.head()
        return {"exists": False} if head is None else {"exists": True, "points": self.points().count(), **head["metadata"]}

    def replace(self, points: DataFrame, manifest: DataFrame | None = None, complete: bool | None = None, n: int | None = None) -> None:
        """Write all points anew, and the manifest if it is given, in ``n`` buckets."""
        head = self._begun()
        n = n or head["n"]
        if n != head["n"] and manifest is None:
            manifest = self.manifest()
        changes = {"n": n, "buckets": self._write("points", points, POINTS, "file_path", n)}
        if manifest is not None:
            changes["manifest"] = self._write("manifest", manifest, MANIFEST, "rel_path", n)
        if complete is not None:
            changes["metadata"] = head["metadata"] | {"complete": complete}
        self._commit(head, **changes)

    def grow(self, points: int) -> bool:
        """Deal a store of so many points to more buckets once they have four times what they should,
        so that a change rewrites a bounded part of it.  As buckets double, the work is in
        proportion to the points that came in since."""
        head = self._begun()
        if head["n"] >= self.MOST_BUCKETS or points <= 4 * self.POINTS_OF_BUCKET * head["n"]:
            return False
        n = head["n"]
        while n < self.MOST_BUCKETS and n * self.POINTS_OF_BUCKET < points:
            n *= 2
        self.replace(self.points(), n=n)
        return True

    def scratch(self, df: DataFrame) -> DataFrame:
        """Write an intermediate table beside the store and read it back, so that it is made once."""
        path = f"{self.root}/scratch-{uuid.uuid4().hex}"
        self._scratch.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear_scratch(self) -> None:
        """Delete the intermediate tables that were made through this object."""
        while self._scratch:
            self._fs().delete(self._path(self._scratch.pop()), True)

    def clean(self, keep: int = 2) -> list[str]:
        """Delete the folders that none of the last ``keep`` heads names, and older heads; what is
        deleted is returned.  Not while another writer or a reader of an older state runs."""
        fs, names = self._fs(), self._heads()
        heads = [json.loads(self.spark.read.text(f"{self.root}/heads/{n}", wholetext=True).first()[0]) for n in names[-keep:]]
        used = {p.split("/")[0] for h in heads for p in [*h["buckets"].values(), *h["manifest"].values()]}
        old = [f"heads/{n}" for n in names[:-keep]]
        old += [n for s in fs.listStatus(self._path(self.root)) if (n := s.getPath().getName()).startswith(("points-", "manifest-", "scratch-")) and n not in used]
        for name in old:
            fs.delete(self._path(f"{self.root}/{name}"), True)
        return old

    def _begun(self) -> dict:
        head = self.head()
        if head is None:
            raise Mismatch("there is no store")
        return head

    def apply(self, paths: DataFrame, points: DataFrame, manifest: DataFrame | None = None, complete: bool | None = None) -> list[str]:
        """Clear the files ``paths`` (rel_path), insert ``points`` and the rows of ``manifest`` in their
        place, and write only the buckets that these lie in, which are returned."""
        head = self._begun()
        n = head["n"]
        gone = paths.select(F.translate("rel_path", "\\", "/").alias("file_path")).distinct()
        rows = projected(points, [x.split()[0] for x in POINTS.split(", ")])

        def touched(*parts: DataFrame) -> list[str]:
            found = parts[0]
            for part in parts[1:]:
                found = found.unionByName(part)
            return sorted(str(r["b"]) for r in found.select(self._bucket("file_path", n).alias("b")).distinct().collect())  # n rows at most

        names = touched(gone, rows.select("file_path"))
        old = self._read((head["buckets"][b] for b in names if b in head["buckets"]), POINTS)
        made = self._write("points", without_paths(old, gone).unionByName(rows), POINTS, "file_path", n)
        changes: dict = {"buckets": {b: p for b, p in head["buckets"].items() if b not in names} | made}
        if manifest is not None:
            told = paths.select("rel_path").unionByName(manifest.select("rel_path")).distinct()
            marks = touched(told.select(F.col("rel_path").alias("file_path")))
            known = self._read((head["manifest"][b] for b in marks if b in head["manifest"]), MANIFEST)
            noted = self._write("manifest", known.join(told, "rel_path", "left_anti").unionByName(manifest.select(*(c.split()[0] for c in MANIFEST.split(", ")))), MANIFEST, "rel_path", n)
            changes["manifest"] = {b: p for b, p in head["manifest"].items() if b not in marks} | noted
        if complete is not None:
            changes["metadata"] = head["metadata"] | {"complete": complete}
        self._commit(head, **changes)
        return names

    def upsert(self, rows: DataFrame) -> None:
        """Insert ``rows`` in place of those with the same ids, which may lie under other paths."""
        rows = projected(rows, [x.split()[0] for x in POINTS.split(", ")]).dropna(subset=list(REQUIRED))
        old = looked_up(self.points(), rows)
        paths = old.select(F.col("file_path").alias("rel_path")).distinct()
        same = self.points().join(paths.withColumnRenamed("rel_path", "file_path"), "file_path", "left_semi")
        self.apply(paths, upserted(same, rows))

    def delete_paths(self, paths: DataFrame) -> None:
        self.apply(paths.select(F.col("file_path").alias("rel_path")), self.spark.createDataFrame([], POINTS))

    def delete_prefixes(self, paths: DataFrame) -> None:
        """Delete files and all that lies under them as folders."""
        kept = without_prefixes(self.points(), paths)
        gone = self.points().select("file_path").distinct().join(kept.select("file_path").distinct(), "file_path", "left_anti")
        self.delete_paths(gone)

    def delete_all(self) -> None:
        self._commit(self._begun(), buckets={}, manifest={})

    def mark_complete(self, complete: bool) -> None:
        head = self.head()
        if head is None:
            raise Mismatch("there is no store to mark")
        self._commit(head, metadata=head["metadata"] | {"complete": complete})

    def drop(self) -> None:
        self._fs().delete(self._path(self.root), True)

    def recreate(self, profile: str, dimension: int) -> None:
        """Drop, then create anew."""
        self.drop()
        self.ensure(profile, dimension)


def stores(spark: SparkSession, parent: str) -> list[str]:
    """Names of the folders under ``parent`` that hold a store, in order."""
    top = spark._jvm.org.apache.hadoop.fs.Path(parent)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory()) if fs.exists(top) else []
    return [n for n in names if Store(spark, f"{parent.rstrip('/')}/{n}").exists()]
