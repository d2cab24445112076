"""Media columns: content-addressed payloads in tar shards; rows carry digest, shard, offset and length.

A payload is kept as an 8-bit greyscale PNG, 576 samples wide, without row filters: lossless, and the size and depth stand in the
first 33 bytes. A member is named by the SHA-256 of its PNG, and each content is stored once: contents that only one document
holds are written by the task that reads them; the others, marked in a bitmap of fixed size that is sent to every task (a false
mark costs a shuffle, nothing else), are gathered by digest first. A task writes tar shards of at most ``SHARD`` bytes through the
file system that its folder names, under names of its own, and reports members in rows; the stored table of these rows is
the index. Shards that a lost or repeated task left are in no row.

``headers`` fills width, height and bit depth from range reads of the first bytes of each member; ``features`` reads whole members,
decodes the samples and computes from them. Members that lie near each other are read together.

Defined results: a null text is an empty one, and an empty text is one row of 255s; equal texts share one member and all
values; rows that repeat a doc_id stay; extra columns are ignored; an empty table writes nothing.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import as_bytes, bits, documents, filesystem, marked, shared_dir, small_batches, stored, tidy

WIDTH = 576
PAD = 255
#: Bytes after which a tar shard is closed.
SHARD = 256 << 20
LEVEL = 6
MAP_BITS = 24
#: Bytes of a PNG up to the end of its IHDR chunk.
HEADER = 33
#: Whole members nearer than this are read in one range; headers are read by themselves.
NEAR = 64 << 10
#: Bytes that are read at a time, or one member.
READ = 8 << 20

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    return text + bytes([PAD]) * (-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """8-bit greyscale; a row is a filter byte of 0 and WIDTH samples."""
    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), dtype=np.uint8)
    raw[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, WIDTH)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header_of(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first bytes of a PNG."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(png: bytes) -> bytes:
    """The samples of a PNG as ``to_png`` makes it; its checksums are checked."""
    width, height, _ = header_of(png)
    at, data = 8, []
    while at < len(png):
        (n,) = struct.unpack(">I", png[at : at + 4])
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("row filters are not used here")
    return raw[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Sixteen hexadecimal digits: which of 64 equal stretches of the samples are lighter than their mean stretch."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    means = samples.reshape(64, -1).mean(axis=1)
    return np.packbits(means > means.mean()).tobytes().hex()


class _Shards:
    """Tar shards of one task."""

    def __init__(self, folder: str):
        self.folder, self.sink, self.at = folder, None, 0

    def add(self, name: str, body: bytes) -> tuple[str, int]:
        if self.sink is None:
            fs, path = filesystem(self.folder)
            fs.create_dir(path)
            self.shard = f"shard-{uuid.uuid4().hex}.tar"
            self.sink, self.at = fs.open_output_stream(f"{path}/{self.shard}"), 0
        info = tarfile.TarInfo(name)
        info.size = len(body)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.sink.write(head + body + b"\0" * (-len(body) % 512))
        found = self.shard, self.at + len(head)
        self.at += len(head) + len(body) + -len(body) % 512
        if self.at >= SHARD:
            self.close()
        return found

    def close(self) -> None:
        if self.sink is not None:
            self.sink.write(b"\0" * 1024)
            self.sink.close()
            self.sink = None


_INDEX = "digest binary, shard string, offset long, length long, media_sha256 binary"


def write_shards(texts: DataFrame, folder: str) -> DataFrame:
    """The index of ``texts`` (digest, text; each digest once): members are PNGs named by their own SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(folder)
        for batch in batches:
            rows: list[tuple] = []
            for digest, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                png = to_png(payload_of(text))
                name = hashlib.sha256(png)
                rows.append((digest, *shards.add(f"{name.hexdigest()}.png", png), len(png), name.digest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["digest", "shard", "offset", "length", "media_sha256"])
        shards.close()

    return texts.select("digest", "text").mapInArrow(tidy(run), _INDEX)


def store(docs: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n_bytes of each document; the index of the members in the shards below ``base``/shards)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("mark", F.xxhash64("digest"))
    owners = stored(rows.select("doc_id", "digest", "mark", F.octet_length("text").cast("long").alias("n_bytes")), f"{base}/owners")
    shared = owners.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.first("mark").alias("mark")).where("n > 1")
    sent = spark.sparkContext.broadcast(bits(shared, "mark", MAP_BITS))

    @F.pandas_udf("boolean")
    def is_marked(mark):
        import pandas as pd

        return pd.Series(marked(sent.value, mark.to_numpy().view(np.uint64)))

    alone = write_shards(rows.where(~is_marked("mark")), f"{base}/shards")
    several = write_shards(rows.where(is_marked("mark")).groupBy("digest").agg(F.first("text").alias("text")), f"{base}/shards")
    index = stored(alone.unionByName(several), f"{base}/index")
    return owners.select("doc_id", "digest", "n_bytes"), index


def _ranges(rows: list[dict], size, near: int) -> Iterator[tuple[list[dict], int, int]]:
    """Runs of members of one shard, in order, and the range of bytes that covers their first ``size(row)`` bytes."""
    held: list[dict] = []
    begin = end = 0
    for row in sorted(rows, key=lambda r: (r["shard"], r["offset"])):
        a, b = row["offset"], row["offset"] + size(row)
        if held and (row["shard"] != held[0]["shard"] or a - end > near or b - begin > READ):
            yield held, begin, end
            held = []
        if not held:
            begin = a
        held.append(row)
        end = b
    if held:
        yield held, begin, end


def _read(index: DataFrame, folder: str, size, values, schema: str, near: int) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shard, source = None, None
        for batch in batches:
            for members, begin, end in _ranges(batch.to_pylist(), size, near):
                if open_shard != members[0]["shard"]:
                    if source is not None:
                        source.close()
                    open_shard = members[0]["shard"]
                    fs, path = filesystem(folder)
                    source = fs.open_input_file(f"{path}/{open_shard}")
                body = source.read_at(end - begin, begin)
                rows = [(m["digest"], *values(m, body[m["offset"] - begin : m["offset"] - begin + size(m)])) for m in members]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
        if source is not None:
            source.close()

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = index.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset")
    return ordered.select("digest", "shard", "offset", "length", "media_sha256").mapInArrow(tidy(run), schema)


def headers(index: DataFrame, folder: str) -> DataFrame:
    """digest, width, height, bit_depth: from range reads of the members' first bytes alone."""
    return _read(index, folder, lambda m: HEADER, lambda m, head: header_of(head), "digest binary, width long, height long, bit_depth long", 0)


def features(index: DataFrame, folder: str) -> DataFrame:
    """digest, shard, offset, length, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: from the stored members."""

    def values(member: dict, png: bytes) -> tuple:
        payload = from_png(png)
        name = hashlib.sha256(png).digest()
        if name != member["media_sha256"]:
            raise ValueError("a member is not what its name says")
        return member["shard"], member["offset"], member["length"], len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-32:]), len(png), name, feature_of(payload)

    schema = "digest binary, shard string, offset long, length long, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"
    return _read(index, folder, lambda m: m["length"], values, schema, NEAR)


def media(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_bytes, its member's place and header, and what its samples say."""
    base = shared_dir(docs.sparkSession, "media")
    owners, index = store(docs, base)
    about = features(index, f"{base}/shards").join(headers(index, f"{base}/shards"), "digest")
    rows = owners.join(about, "digest")
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("digest", "payload_sha256", "media_sha256")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth", "digest", "offset", "length"
    )
