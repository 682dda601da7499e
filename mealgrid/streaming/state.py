"""State tables for ``foreachBatch``: a batch rewrites only the buckets whose keys it names.

Rows live in ``rows/slot=S/bucket=B``, dealt to buckets by a hash of the key. A batch reads the buckets that its own keys fall
into, computes their next content, and writes it to the other slot of each of them, so that what is current stays untouched.
It becomes visible by one small file: the manifest of the version, which names slot and version of every bucket. Until that
file is there, readers see the version before; a killed batch leaves at most rows that no manifest names.

A batch that runs again after a failure starts from the version before it and replaces its own rows, so each batch counts once,
also where values are added up. Slots are written over in turn: nothing older than the newest version and the one before it is
kept, and the table never holds more than ``SLOTS`` copies of a bucket, however many batches there were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOTS = 2  # copies of a bucket: the current one and the one before
TURNS = 3  # manifests that are kept
PLACE = "slot INT, bucket INT"
MANIFEST = "version BIGINT, bucket INT, slot INT, since BIGINT"


class VersionedTable:
    """A table of rows per ``key``, which batches number by number replace in parts, below ``root``.

    ``buckets`` bounds what a batch about one key rewrites: a share of 1/``buckets`` of the state. A table that is there already
    is opened as it is; it must have been made with the same number of buckets.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "user_id", buckets: int = 64):
        self.root, self.key, self.buckets = root, key, buckets
        self.schema = T.StructType.fromDDL(schema)
        stored = [*self.schema.fields, T.StructField("since", T.LongType()), *T.StructType.fromDDL(PLACE).fields]
        self.stored = T.StructType(stored)
        # empty appends make the folders and leave what is there
        spark.createDataFrame([], self.stored).write.mode("append").partitionBy("slot", "bucket").parquet(f"{root}/rows")
        spark.createDataFrame([], MANIFEST).write.mode("append").parquet(f"{root}/manifest/turn=-1")

    def bucket(self) -> Column:
        """Bucket of a row."""
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets of the keys of a batch; at most ``buckets`` numbers are collected."""
        return sorted(r.bucket for r in batch.select(self.bucket().alias("bucket")).distinct().collect())

    def _manifest(self, spark: SparkSession, before: int | None) -> tuple[int, dict[int, tuple[int, int]]]:
        """The newest version (older than ``before``) and (slot, since) of each bucket that it holds."""
        rows = spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        if before is not None:
            rows = rows.where(F.col("version") < before)
        newest = rows.agg(F.max("version").alias("v")).first().v
        if newest is None:
            return -1, {}
        return newest, {r.bucket: (r.slot, r.since) for r in rows.where(F.col("version") == newest).collect() if r.bucket is not None}

    def version(self, spark: SparkSession, before: int | None = None) -> int:
        """Number of the newest published batch, or the newest one older than ``before``; -1 if there is none."""
        return self._manifest(spark, before)[0]

    def read(self, spark: SparkSession, before: int | None = None, only: Iterable[int] | None = None) -> DataFrame:
        """The newest version, or the newest one older than ``before``; of all buckets or ``only`` some."""
        _, named = self._manifest(spark, before)
        wanted = named if only is None else {b: named[b] for b in only if b in named}
        rows = spark.read.schema(self.stored).parquet(f"{self.root}/rows")
        columns = [f.name for f in self.schema.fields]
        if not wanted:
            return rows.where("false").select(*columns)
        # a list indexed by bucket; folders of other slots and buckets are pruned before any file is opened
        slots = F.array(*[F.lit(wanted.get(b, (-1, 0))[0]) for b in range(self.buckets)])
        since = F.array(*[F.lit(wanted.get(b, (0, -1))[1]).cast("long") for b in range(self.buckets)])
        here = rows.where(F.get(slots, F.col("bucket")) == F.col("slot"))
        # rows of an older turn, or of a batch that was not published, are no part of the bucket
        return here.where(F.get(since, F.col("bucket")) == F.col("since")).select(*columns)

    def write(self, df: DataFrame, version: int, only: Iterable[int]) -> None:
        """Publish a version in which the buckets ``only`` hold the rows of ``df``, and all others what they held before."""
        spark, only = df.sparkSession, list(only)
        _, named = self._manifest(spark, version)
        if only:
            slots = {b: (named[b][0] + 1) % SLOTS if b in named else 0 for b in only}
            place = F.get(F.array(*[F.lit(slots.get(b, 0)) for b in range(self.buckets)]), F.col("bucket"))
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
            rows = df.select(*columns, F.lit(version).cast("long").alias("since"), self.bucket().alias("bucket"))
            (
                rows.withColumn("slot", place).repartition("bucket").write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic").partitionBy("slot", "bucket").parquet(f"{self.root}/rows")
            )
            named = named | {b: (slots[b], version) for b in only}
        self._publish(spark, version, named)

    def _publish(self, spark: SparkSession, version: int, named: dict[int, tuple[int, int]]) -> None:
        rows = [(version, b, slot, since) for b, (slot, since) in named.items()] or [(version, None, None, None)]
        turn = f"{self.root}/manifest/turn={version % TURNS}"
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(turn)


def each_batch(
    table: VersionedTable, step: Callable[[DataFrame, DataFrame], DataFrame]
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: ``step(state, batch)`` gives the next state of the keys' buckets.

    ``step`` must treat keys one by one: it sees, and replaces, only the buckets that the batch touches.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        only = table.touched(batch)
        table.write(step(table.read(batch.sparkSession, batch_id, only), batch), batch_id, only)
        batch.unpersist()

    return run
