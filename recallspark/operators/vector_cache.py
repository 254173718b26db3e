"""A content-addressed vector cache on shared storage, for any number of writers.

Every put is a folder of its own, partitioned by the first two hexadecimal digits of the key, that becomes
visible once it is whole; writers never touch each other's files, so none can lose a row of another. A lookup
reads the partitions of its keys. Uses are noted in a log that is only appended to; eviction orders
entries by their last use. ``compact`` merges folders, less the entries evicted; it drops what it has read
and nothing that was put meanwhile.

A key is the digest of model and text, so an entry never changes: of entries with one key the oldest stands.

Defined results: null texts are not cached; vectors that are null or empty are not kept; a text without an
entry has a null vector; keys that were evicted count as never put; an empty cache finds nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "key string, embedding array<float>, created_at long, prefix string"
TOUCH = "key string, used_at long"
#: Milliseconds of a step of the histogram by which eviction finds its bound.
STEP_MS = 3_600_000


def cache_key(text: Column, model: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}\0"), text).cast("binary"), 256)


@dataclass(frozen=True)
class VectorCache:
    spark: SparkSession
    path: str

    def _folders(self, kind: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        path_of = jvm.org.apache.hadoop.fs.Path
        fs = path_of(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        base = path_of(f"{self.path}/{kind}")
        if not fs.exists(base):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(base)]
        return sorted(f"{self.path}/{kind}/{n}" for n in names if fs.exists(path_of(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def _drop(self, folders: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        path_of = jvm.org.apache.hadoop.fs.Path
        for f in folders:
            path_of(f).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path_of(f), True)

    def _scan(self, folders: list[str], schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f) for f in folders]
        out = parts[0] if parts else self.spark.createDataFrame([], schema)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _put(self, rows: DataFrame) -> str:
        folder = f"{self.path}/entries/{uuid.uuid4().hex}"
        dealt = rows.withColumn("prefix", F.substring("key", 1, 2)).repartition("prefix")
        dealt.write.partitionBy("prefix").parquet(folder)
        return folder

    def put(self, rows: DataFrame, model: str, at: int) -> None:
        """Adds vectors of texts (text, embedding); what is there already stays as it is."""
        new = rows.where("text is not null and size(embedding) > 0").select(cache_key(F.col("text"), model).alias("key"), F.col("embedding").cast("array<float>").alias("embedding"), F.lit(at).cast("long").alias("created_at"))
        self._put(new.dropDuplicates(["key"]))

    def entries(self) -> DataFrame:
        """(key, embedding, created_at), each key once."""
        rows = self._scan(self._folders("entries"), ENTRY)
        first = F.min(F.struct("created_at", "embedding")).alias("e")
        return rows.groupBy("prefix", "key").agg(first).select("key", "e.embedding", "e.created_at", "prefix")

    def get(self, texts: DataFrame, model: str, at: int) -> DataFrame:
        """(text, embedding) of every different text, and a note of the use of those that were found.

        Rows with no entry have a null vector: they are to be embedded and put.
        """
        asked = texts.where("text is not null").select("text").distinct().withColumn("key", cache_key(F.col("text"), model)).withColumn("prefix", F.substring("key", 1, 2))
        found = asked.join(self.entries().select("prefix", "key", "embedding"), ["prefix", "key"], "left")
        self.touch(found.where("embedding is not null").select("key"), at)
        return found.select("text", "embedding")

    def touch(self, keys: DataFrame, at: int) -> None:
        """Notes a use of each key."""
        keys.select("key", F.lit(at).cast("long").alias("used_at")).distinct().write.parquet(f"{self.path}/touches/{uuid.uuid4().hex}")

    def last_uses(self, entries: DataFrame | None = None) -> DataFrame:
        """(key, used_at): the last use of every entry, its first put where it wasn't used."""
        rows = (self.entries() if entries is None else entries).select("key", F.col("created_at").alias("used_at"))
        noted = self._scan(self._folders("touches"), TOUCH).join(rows.select("key"), "key", "left_semi")
        return rows.unionByName(noted).groupBy("key").agg(F.max("used_at").alias("used_at"))

    def kept(self, capacity: int, entries: DataFrame | None = None) -> DataFrame:
        """(key): the ``capacity`` most recently used entries, ties to the smaller key.

        A histogram over time tells the step in which the bound lies; only that step's entries are ordered.
        """
        uses = self.last_uses(entries).withColumn("step", F.floor(F.col("used_at") / STEP_MS))
        left, edge = capacity, None
        for r in uses.groupBy("step").count().orderBy(F.desc("step")).toLocalIterator():  # one row for each hour
            if r["count"] >= left:
                edge = r["step"]
                break
            left -= r["count"]
        if edge is None:
            return uses.select("key")
        last = uses.where(F.col("step") == edge).orderBy(F.desc("used_at"), "key").limit(left)
        return uses.where(F.col("step") > edge).select("key").unionByName(last.select("key"))

    def compact(self, capacity: int | None = None) -> None:
        """Merges all folders there are now into one of entries and one of uses, with at most ``capacity`` entries."""
        put, used = self._folders("entries"), self._folders("touches")
        if not put:
            return
        rows = self._scan(put, ENTRY)
        first = F.min(F.struct("created_at", "embedding")).alias("e")
        rows = rows.groupBy("prefix", "key").agg(first).select("key", "e.embedding", "e.created_at")
        if capacity is not None:
            rows = rows.join(self.kept(capacity, rows), "key", "left_semi")
        merged = self.spark.read.schema(ENTRY).parquet(self._put(rows))
        noted = self._scan(used, TOUCH).groupBy("key").agg(F.max("used_at").alias("used_at")).join(merged.select("key"), "key", "left_semi")
        noted.write.parquet(f"{self.path}/touches/{uuid.uuid4().hex}")
        self._drop([*put, *used])
