"""Tables kept as snapshots in hash buckets: merges and comparisons touch only buckets that change.

A version of a table is a manifest: for each bucket the folder that holds it, its number of rows and a digest of
them. A merge writes the buckets its source falls into and then one new manifest, which switches readers over at once; all
other buckets are taken over unread. Two versions are compared by digests first, of groups of buckets, then of the
buckets of groups that differ, and only the rest is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passagework.operators.quality import immutability_violations
from passagework.operators.tables import upsert

BUCKETS = 64
#: Buckets that share one digest of digests.
GROUP = 8


@dataclass(frozen=True)
class Part:
    path: str
    rows: int
    digest: str


@dataclass(frozen=True)
class Snapshot:
    """One version of a table: its parts by bucket; an empty bucket has none."""

    folder: str
    version: int
    keys: tuple[str, ...]
    buckets: int
    schema: StructType
    parts: dict[int, Part]

    def read(self, spark: SparkSession, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of the table, of the given buckets only where there are some."""
        chosen = sorted(self.parts if buckets is None else set(buckets) & set(self.parts))
        if not chosen:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[self.parts[b].path for b in chosen])

    def groups(self) -> dict[int, str]:
        """One digest for each group of buckets."""
        out: dict[int, str] = {}
        for b in sorted(self.parts):
            out[b // GROUP] = out.get(b // GROUP, "") + f"{b}:{self.parts[b].digest};"
        return out


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(df: DataFrame, folder: str, keys: Sequence[str], buckets: int) -> dict[int, Part]:
    """Write rows in folders by bucket and take a digest of each that doesn't depend on their order."""
    spark, path = df.sparkSession, f"{folder}/data-{uuid.uuid4().hex}"
    df.withColumn("_bucket", bucket_of(keys, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
    row = [F.xxhash64(F.lit(seed), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})) for seed in (1, 2)]
    told = (
        spark.read.schema(df.withColumn("_bucket", F.lit(0)).schema).parquet(path).groupBy("_bucket")
        .agg(F.count("*").alias("n"), *[F.sum(h.cast("decimal(38,0)")).cast("string").alias(f"h{i}") for i, h in enumerate(row)])
    )
    return {r["_bucket"]: Part(f"{path}/_bucket={r['_bucket']}", r.n, f"{r.n}/{r.h0}/{r.h1}") for r in told.collect()}  # one row a bucket


def _publish(spark: SparkSession, s: Snapshot) -> Snapshot:
    """Write the manifest under its own name; it counts from the moment it has it."""
    said = {"version": s.version, "keys": s.keys, "buckets": s.buckets, "schema": s.schema.json(), "parts": {b: [p.path, p.rows, p.digest] for b, p in s.parts.items()}}
    new, name = (spark._jvm.org.apache.hadoop.fs.Path(f"{s.folder}/{n}") for n in (f"_writing-{uuid.uuid4().hex}", f"manifest-{s.version:08d}.json"))
    fs = name.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(new)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()
    if not fs.rename(new, name):
        raise RuntimeError(f"version {s.version} of {s.folder} is there already: another merge came first")
    return s


def create(df: DataFrame, keys: Sequence[str], folder: str, buckets: int = BUCKETS) -> Snapshot:
    """Version 0 of a table; a key stands in one row."""
    return _publish(df.sparkSession, Snapshot(folder, 0, tuple(keys), buckets, df.schema, _write(df, folder, keys, buckets)))


def latest(spark: SparkSession, folder: str) -> Snapshot:
    """The newest published version under `folder`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    newest = max(f.getPath().toString() for f in fs.listStatus(path) if f.getPath().getName().startswith("manifest-"))
    said = json.loads("\n".join(r.value for r in spark.read.text(newest, wholetext=True).collect()))
    parts = {int(b): Part(*p) for b, p in said["parts"].items()}
    return Snapshot(folder, said["version"], tuple(said["keys"]), said["buckets"], StructType.fromJson(json.loads(said["schema"])), parts)


def touched(s: Snapshot, rows: DataFrame) -> list[int]:
    """Buckets that the keys of `rows` fall into."""
    return sorted(r.b for r in rows.select(bucket_of(s.keys, s.buckets).alias("b")).distinct().collect())  # as many as buckets at most


def merge(s: Snapshot, source: DataFrame, rules: dict[str, str]) -> Snapshot:
    """The next version, after `tables.upsert` of `source`; only buckets that it falls into are read and written."""
    spark = source.sparkSession
    hit = touched(s, source)
    merged = upsert(s.read(spark, hit), source.select(*[f.name for f in s.schema]), list(s.keys), rules).select(*[f.name for f in s.schema])
    parts = {b: p for b, p in s.parts.items() if b not in hit}
    if hit:
        parts |= _write(merged, s.folder, s.keys, s.buckets)
    return _publish(spark, Snapshot(s.folder, s.version + 1, s.keys, s.buckets, s.schema, parts))


def changed_buckets(old: Snapshot, new: Snapshot) -> list[int]:
    """Buckets whose digests differ, looked for only in groups whose digests differ."""
    a, b = old.groups(), new.groups()
    differing = [g for g in a.keys() | b.keys() if a.get(g) != b.get(g)]
    inside = [k for g in differing for k in range(g * GROUP, (g + 1) * GROUP)]
    return sorted(k for k in inside if (p := old.parts.get(k)) != (q := new.parts.get(k)) and (p is None or q is None or p.digest != q.digest))


def violations_between(spark: SparkSession, old: Snapshot, new: Snapshot, key: str, columns: dict[str, bool]) -> DataFrame:
    """`quality.immutability_violations` of two versions with the same buckets, reading changed buckets only."""
    if (old.buckets, old.keys) != (new.buckets, new.keys):
        raise ValueError("the snapshots are dealt differently")
    changed = changed_buckets(old, new)
    return immutability_violations(old.read(spark, changed), new.read(spark, changed), key, columns)
