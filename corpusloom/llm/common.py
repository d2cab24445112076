"""What the operators of this subpackage share: tables in the shared folder, word hashes, chunks of text."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted when the application ends.

    Where the session names no such folder, a local master gets a temporary one; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where, fs = _hadoop(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as two underscores) for the actions inside; the caller's come back at the end."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Arrow batches of at most so many bytes: long texts make the default of 10000 rows too large for a worker.
BATCH_BYTES = 8 << 20


def at_work(spark: SparkSession):
    """For an operator's own actions: small Arrow batches, and shuffle files that go with the action that wrote them."""
    return settings(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES), spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Arrow batches of at most ``size`` bytes from here on: for results that run when the caller wants them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("b")) > size:
        spark.conf.set(key, str(size))


def tidy(run):
    """``run`` for mapInArrow, giving Arrow's unused memory back at its end: later tasks of other stages use the same Python workers."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def stored(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` and read it back: lineage ends here, and a lost executor costs no recomputation of what came before.

    The shuffle files of the write are deleted with it.
    """
    spark = df.sparkSession
    with at_work(spark):
        df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        where, fs = _hadoop(spark, path)
        fs.delete(where, True)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder in the shared store; works on executors as well."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


# --- words of many texts at once -------------------------------------------------------------

#: Bytes of text that are worked on at a time; a longer text is a chunk of its own.
CHUNK = 2 << 20

#: ``[^\x20\x09-\x0D]+`` over UTF-8: these bytes separate words.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: digits, a-z and whatever is not ASCII make words.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Words longer than this are hashed one at a time, by BLAKE2b.
LONG = 64
#: The first n bytes of a little-endian word of 8.
BYTES = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def spread(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each stretch of ``buf``, which has 8 bytes to spare at its end.

    Eight bytes at a time go through a mixing step that is not linear, so no family of words collides by construction;
    memory goes with the number of stretches and not with their bytes. Stretches of up to 8 bytes and equal length never collide.
    """
    size = ends - starts
    eight = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    out = mixed(size.astype(np.uint64) * _SEEDS[0] + _SEEDS[int(second)])
    which, at, left = np.arange(len(starts)), starts, size
    if len(size) and size.max() > LONG:
        which = np.flatnonzero(size <= LONG)
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = np.frombuffer(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8, salt=b"2" if second else b"1").digest(), dtype=np.uint64)[0]
        at, left = starts[which], size[which]
    first = len(which) == len(out)
    while len(which):
        block = eight[at] & BYTES[np.minimum(left, 8)]
        if first:
            out = mixed(out ^ block)
        else:
            out[which] = mixed(out[which] ^ block)
        more = np.flatnonzero(left > 8)
        which, at, left, first = which[more], at[more] + 8, left[more] - 8, False
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, a place of each, which one stands at each place)."""
    order = np.argsort(x)
    values = x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    begins, back = np.flatnonzero(new), np.empty(len(x), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return values[begins], order[begins], back


class Words:
    """The words of a run of texts: byte spans, 64-bit hashes, and where each text's words begin.

    ``first[i]:first[i + 1]`` are text i's words.
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray = BLANKS, lower: bool = True):
        buf = np.frombuffer(b" " + b" ".join(texts) + b" " * 9, dtype=np.uint8)
        self.buf = LOWER[buf] if lower else buf
        sep = separators[self.buf]
        edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        self.starts, self.ends = np.ascontiguousarray(edge[0::2]), np.ascontiguousarray(edge[1::2])
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.at = np.concatenate(([1], 1 + np.cumsum(lengths)))
        self.first = np.searchsorted(self.starts, self.at)

    def hashes(self, second: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``second``: another one."""
        return spread(self.buf, self.starts, self.ends, second)


def word_counts(texts: list[bytes], size: int = CHUNK) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; long ones are counted in slices."""
    if all(len(t) <= size for t in texts):
        return np.diff(Words(texts, lower=False).first)
    return np.array([sum(len(Words([t[a:b]], lower=False).starts) for a, b in slices(t, size)) for t in texts], dtype=np.int64)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null: empty."""
    return [x or b"" for x in column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``size`` bytes."""
    begin = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield begin, i
            begin, total = i, 0
        total += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def slices(text: bytes, size: int) -> list[tuple[int, int]]:
    """``text`` in stretches of about ``size`` bytes, cut before white space; a longer word stays whole."""
    cuts = [0]
    while len(text) - cuts[-1] > size:
        found = _BLANK.search(text, cuts[-1] + size)
        if found is None:
            break
        cuts.append(found.start())
    return list(zip(cuts, [*cuts[1:], len(text)], strict=True))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def clean_select(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the columns named, cast to the types given; whatever else the table holds cannot clash."""
    return df.select(*(df[name].cast(kind).alias(name) for name, kind in kinds.items()))


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows for the driver, where a bound is known; more than that is an error rather than a surprise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


def bits(df: DataFrame, column: str, log2_size: int) -> np.ndarray:
    """A bitmap of fixed size that marks ``column``'s 64-bit hashes by their top bits: set for every one that is in ``df``."""
    slots = df.select(F.shiftrightunsigned(F.col(column), 64 - log2_size).alias("slot"))
    words = slots.selectExpr("shiftright(slot, 6) AS w", "shiftleft(1L, cast(slot % 64 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (log2_size - 6), dtype=np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    log2_size = len(bitmap).bit_length() - 1 + 6
    slot = hashes >> np.uint64(64 - log2_size)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


class HashTable:
    """Numbers 0, 1, 2, ... for 64-bit keys (with a second key to tell equal ones apart), looked up many at a time."""

    def __init__(self, log2_slots: int):
        self.shift = np.uint64(64 - log2_slots)
        self.mask = (1 << log2_slots) - 1
        self.key = np.zeros(1 << log2_slots, dtype=np.uint64)
        self.check = np.zeros(1 << log2_slots, dtype=np.uint64)
        self.number = np.full(1 << log2_slots, -1, dtype=np.int32)
        self.n = 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for none."""
        slot = (key >> self.shift).astype(np.int64)
        out = self.number[slot]
        open_ = np.flatnonzero((out >= 0) & ((self.key[slot] != key) | (self.check[slot] != check)))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            found = self.number[slot]
            out[open_] = found
            more = (found >= 0) & ((self.key[slot] != key[open_]) | (self.check[slot] != check[open_]))
            open_, slot = open_[more], slot[more]
        return out

    def add(self, key: np.ndarray, check: np.ndarray) -> None:
        """Keys that are new and differ from each other; they get the next numbers in order."""
        number = np.arange(self.n, self.n + len(key), dtype=np.int32)
        self.n += len(key)
        slot = (key >> self.shift).astype(np.int64)
        while len(key):
            free = self.number[slot] < 0
            self.number[slot[free]] = number[free]
            mine = self.number[slot] == number
            self.key[slot[mine]], self.check[slot[mine]] = key[mine], check[mine]
            rest = ~mine
            key, check, number, slot = key[rest], check[rest], number[rest], (slot[rest] + 1) & self.mask
