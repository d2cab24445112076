"""The index kept up to date by a stream of converted files: each micro-batch replaces the documents that it holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.manifest import index_diff

TABLES = ("documents", "blocks", "sections", "chunks")


def replaced(spark: SparkSession, tables: dict[str, DataFrame], root: str, slugs: DataFrame | None = None, buckets: int = 64) -> None:
    """Write ``tables`` below ``root`` in place of what is there of the same documents; ``slugs`` names more documents to delete.

    Tables are partitioned by a hash of slug, and only the partitions of documents at hand are rewritten, so a run repeated after a
    failure gives the same tables.
    """
    key = F.pmod(F.xxhash64("slug"), F.lit(buckets)).cast("int")
    gone = tables["documents"].select("slug")
    gone = gone.unionByName(slugs.select("slug")) if slugs is not None else gone
    gone.distinct().write.mode("overwrite").parquet(f"{root}/_gone")
    gone = spark.read.schema(gone.schema).parquet(f"{root}/_gone")
    touched = [r[0] for r in gone.select(key.alias("b")).distinct().collect()]  # at most ``buckets``
    for name in TABLES:
        rows = tables[name].withColumn("bucket", key)
        try:
            old = spark.read.schema(rows.schema).parquet(f"{root}/{name}").where(F.col("bucket").isin(touched)).join(gone, "slug", "left_anti")
            rows = old.select(*rows.columns).unionByName(rows)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        # What is read is what is overwritten: the new partitions are complete in a folder of their own before they take the old ones' place.
        spare = f"{root}/_next/{name}"
        rows.write.mode("overwrite").partitionBy("bucket").parquet(spare)
        fresh = spark.read.schema(rows.schema).parquet(spare)
        spark.catalog.refreshByPath(f"{root}/{name}")
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/{name}")
        _emptied(spark, f"{root}/{name}", set(touched) - {r[0] for r in fresh.select("bucket").distinct().collect()})


def _emptied(spark: SparkSession, path: str, buckets: set[int]) -> None:
    """Partitions whose last document went: a dynamic overwrite leaves those alone."""
    jvm = spark.sparkContext._jvm
    for b in buckets:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    for name in TABLES:
        spark.catalog.refreshByPath(f"{root}/{name}")
    return {name: spark.read.parquet(f"{root}/{name}").drop("bucket") for name in TABLES}


def update(spark: SparkSession, files: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]], root: str, complete: bool = True) -> DataFrame:
    """Bring the index below ``root`` in line with ``files`` (slug, kb_sha256, ...); returns slug, action.

    Only new and changed files are parsed; ``complete``: documents without a file are deleted. What is to be done is written before the
    index is touched, so nothing that comes later reads the state that it replaces.
    """
    try:
        indexed = spark.read.parquet(f"{root}/documents").select("slug", "kb_sha256")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        indexed = spark.createDataFrame([], "slug string, kb_sha256 string")
    actions = index_diff(files, indexed)
    actions = actions if complete else actions.where("action <> 'deleted'")
    actions.write.mode("overwrite").parquet(f"{root}/_actions")
    actions = spark.read.schema(actions.schema).parquet(f"{root}/_actions")
    todo = files.join(actions.where("action IN ('indexed', 'reindexed')").select("slug"), "slug", "left_semi")
    replaced(spark, build(todo), root, actions.where("action = 'deleted'"))
    return actions


def start(spark: SparkSession, stream: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]], root: str, checkpoint: str, **trigger):
    """A streaming query that applies each micro-batch of files (slug, kb_sha256, ...); a batch repeated after a failure changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        latest = batch.dropDuplicates(["slug"])
        update(batch.sparkSession, latest, build, root, complete=False)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
