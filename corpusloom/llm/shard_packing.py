"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

A group is the documents of equal text, and it is placed whole in the shard where the dot product of its (bytes, tokens, rows) vector with
the shard's residual capacity is highest, from the largest group down. Only a group that exceeds a shard's share in some
dimension is cut, by doc_id, into pieces of ``PIECE`` of a shard. Groups of ``HEAVY`` of a shard or more are placed first, one after
another on the driver; there are at most 3 * shards / HEAVY of them, whatever the corpus. One pass on one machine cannot grow with the number of
all others, so these are dealt by hash into blocks of about ``BLOCK`` groups, and each block places its groups in the same way into
its equal part of the capacity that the heavy ones left: every block comes out balanced by itself. The law kept is ``bytes``:
sizes come out near equal, as far as single texts allow.

Tokens are words `[^\\x20\\x09-\\x0D]+`. Slots number a shard's rows by doc_id without a gap; they come from a range sort over the
cluster plus the counts of the partitions before, never from one task over a shard.

Defined results: a null text has no bytes and forms a group with other nulls; an empty table gives no rows; rows that
repeat a doc_id get a slot each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import CHUNK, bounded_rows, clean_select, documents, shared_dir, stored, tidy, word_counts
from corpusloom.llm.rowwise import with_computed

SHARDS = 24
#: Groups of this part of a shard, in any dimension, are placed first, on the driver.
HEAVY = 1 / 64
#: Pieces of a group that exceeds a shard take at most this part of one.
PIECE = 1 / 32
#: Lighter groups in a block, about.
BLOCK = 50_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, tokens, text_crc32, g1, g2 (the group's hashes)."""
    text = F.coalesce("text", F.lit(""))
    rows = clean_select(docs, doc_id="long", text="string").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("g1"),
        F.xxhash64(F.col("text").isNull(), F.lit(7), "text").alias("g2"),
        "text",
    )
    return with_computed(rows, "tokens long", lambda texts, _: {"tokens": word_counts(texts)}, CHUNK).drop("text")


def pack(shares: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each vector: from the largest down, where its dot product with ``residual`` (a row for each shard, used up) is highest."""
    out = np.zeros(len(shares), dtype=np.int64)
    for i in np.lexsort((np.arange(len(shares)), -shares.max(axis=1, initial=0))).tolist():
        out[i] = shard = int((residual @ shares[i]).argmax())
        residual[shard] -= shares[i]
    return out


def assign(rows: DataFrame, shards: int, path: str) -> DataFrame:
    """``rows`` (as of ``sized``) with a column ``shard``."""
    spark, dims = rows.sparkSession, ("size", "tokens", "rows")
    sums = (F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    whole = rows.agg(*sums).first()
    whole = {d: float(whole[d] or 1) / shards for d in dims}  # of one shard
    groups = stored(rows.groupBy("g1", "g2").agg(*sums), f"{path}/groups")
    share = F.greatest(*(F.col(d) / F.lit(whole[d]) for d in dims))
    heavy = bounded_rows(groups.where(share >= HEAVY).select("g1", "g2", *dims), int(3 * shards / HEAVY) + 1, "heavy groups")
    vector = lambda r: [r[d] / whole[d] for d in dims]
    large = {(r["g1"], r["g2"]): int(np.ceil(max(vector(r)) / PIECE)) for r in heavy if max(vector(r)) > 1}
    cut = F.broadcast(spark.createDataFrame([(*k, n) for k, n in sorted(large.items())], "g1 long, g2 long, pieces int"))
    piece = F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int")
    of_large = rows.join(cut, ["g1", "g2"]).groupBy("g1", "g2", piece.alias("piece")).agg(*sums)
    units = [(r["g1"], r["g2"], 0, vector(r)) for r in heavy if (r["g1"], r["g2"]) not in large]
    units += [(r["g1"], r["g2"], r["piece"], vector(r)) for r in bounded_rows(of_large, sum(large.values()), "pieces")]
    units.sort()
    residual = np.ones((shards, len(dims)))
    where = pack(np.array([u[3] for u in units]).reshape(-1, len(dims)), residual)
    table = [(g1, g2, large.get((g1, g2), 1), k, int(s)) for (g1, g2, k, _), s in zip(units, where, strict=True)]
    first = spark.createDataFrame(table, "g1 long, g2 long, pieces int, piece int, shard int").groupBy("g1", "g2", "pieces").agg(F.map_from_entries(F.collect_list(F.struct("piece", "shard"))).alias("shards"))
    light = groups.where(share < HEAVY)
    blocks = light.count() // BLOCK + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:  # in the order of blocks: one is complete when the next begins
            for block in pc.unique(batch.column("block")).to_pylist():
                for done in [b for b in held if b != block]:
                    yield placed(held.pop(done))
                held.setdefault(block, []).append(batch.filter(pc.equal(batch.column("block"), block)))
        for done in held.values():
            yield placed(done)

    def placed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        shares = np.stack([table.column(d).to_numpy() / whole[d] for d in dims], axis=1)
        shard = pack(shares, residual / blocks)
        return pa.RecordBatch.from_arrays([table.column("g1").combine_chunks(), table.column("g2").combine_chunks(), pa.array(shard, pa.int32())], names=["g1", "g2", "shard"])

    dealt = light.select("g1", "g2", *dims, F.pmod("g2", F.lit(blocks)).alias("block"))
    dealt = dealt.repartition(max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block").sortWithinPartitions("block", "g1", "g2")
    spots = stored(dealt.mapInArrow(tidy(place), "g1 long, g2 long, shard int"), f"{path}/spots")
    # Rows of heavy groups meet a small table; no other group is a large key.
    marked = rows.join(F.broadcast(first), ["g1", "g2"], "left")
    of_heavy = marked.where("pieces IS NOT NULL").withColumn("shard", F.col("shards")[piece]).drop("pieces", "shards")
    return of_heavy.unionByName(marked.where("pieces IS NULL").drop("pieces", "shards").join(spots, ["g1", "g2"]))


def numbered(rows: DataFrame, group: str, keys: list[str], path: str) -> DataFrame:
    """``rows`` with ``slot``: its number within ``group`` in the order of ``keys``, without a gap from 0.

    Rows are dealt by range of (group, keys), so one large group spans partitions; only a count for each partition and
    group meets in one place.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(n, group, *keys).sortWithinPartitions(group, *keys).withColumn("mid", F.monotonically_increasing_id()), path)
    ranged = ranged.withColumn("part", F.shiftright("mid", 33))
    parts = ranged.groupBy(group, "part").agg(F.min("mid").alias("least"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(group, "part", "least", before.alias("before"))
    return ranged.join(parts, [group, "part"]).withColumn("slot", F.col("before") + F.col("mid") - F.col("least")).drop("mid", "part", "least", "before")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, tokens, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    base = shared_dir(spark, "shards")
    rows = stored(sized(docs), f"{base}/sized")
    return numbered(assign(rows, shards, base), "shard", ["doc_id", "g1"], f"{base}/ranged").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
