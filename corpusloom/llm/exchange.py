"""Questions that chunks of a corpus ask of the whole corpus, by 64-bit names, without a row for each name.

A chunk sends, for each bucket of the hash space, one blob: its sorted distinct names and what it says of them. The task of a bucket merges
the blobs of all chunks and answers each with one of its own, in the order of the chunk's names. So a name is asked once a chunk,
however often it occurs: no key is hot, and no task holds more than a chunk or a bucket. Chunks, and the answers of each, are
written to files by the tasks; tables hold where they stand, and a file counts only through the rows that name it.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusloom.llm.common import distinct, filesystem, stored, tidy

#: Names in a bucket, about.
KEYS = 4 << 20

BLOBS = "bucket int, chunk long, kind int, blob binary, tally array<long>"
FIELDS = ["bucket", "chunk", "kind", "blob", "tally"]


def narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them all."""
    if a.dtype.kind not in "iu" or a.min(initial=0) < 0:
        return a
    most = int(a.max(initial=0))
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def planes_of(a: np.ndarray) -> np.ndarray:
    """The first bytes of all values, then the second ones, ...: what is alike compresses."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)


def values_of(planes: np.ndarray, dtype) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def pack(*arrays: np.ndarray) -> bytes:
    return pickle.dumps([narrow(np.ascontiguousarray(a)) for a in arrays], protocol=5)


def listed(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of few distinct values: the values, and which one stands where."""
    values, _, back = distinct(a)
    return values, narrow(back)


def ranked(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes by falling frequency, whose high bytes are mostly 0; the code of each rank)"""
    order = np.argsort(-np.bincount(code, minlength=n), kind="stable").astype(np.int32)
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    return rank[code], order


def names_packed(key: np.ndarray) -> np.ndarray:
    """Sorted names, by their differences."""
    return planes_of(np.diff(key, prepend=np.uint64(0)))


def names_of(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(values_of(planes, np.uint64), dtype=np.uint64)


def pack_keyed(key: np.ndarray, *arrays: np.ndarray) -> bytes:
    """With sorted names first."""
    return pickle.dumps([names_packed(key), *(narrow(a) for a in arrays)], protocol=5)


def unpack_keyed(blob: bytes) -> list[np.ndarray]:
    planes, *arrays = pickle.loads(blob)
    return [names_of(planes), *arrays]


def row_of(bucket: int, chunk: int, kind: int, blob: bytes | None, tally: list[int] | None = None) -> pa.RecordBatch:
    values = [pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary()), pa.array([tally], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(values, names=FIELDS)


class Blobs:
    """Compressed blobs in a file of the task's own; where each stands counts only through the row that says so."""

    def __init__(self, folder: str):
        self.folder, self.sink = folder, None

    def add(self, *arrays: np.ndarray) -> bytes:
        if self.sink is None:
            fs, path = filesystem(self.folder)
            fs.create_dir(path)
            self.name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
            self.sink = fs.open_output_stream(f"{path}/{self.name}")
        whole = pack(*arrays)
        small = pa.compress(whole, codec="zstd", asbytes=True)
        where = pickle.dumps((f"{self.folder}/{self.name}", self.sink.tell(), len(small), len(whole)))
        self.sink.write(small)
        return where

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()


def read(where: bytes) -> list[np.ndarray]:
    uri, begin, size, whole = pickle.loads(where)
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as source:
        return pickle.loads(pa.decompress(source.read_at(size, begin), whole, codec="zstd", asbytes=True))


#: Of an n-gram: the first of the chunks that learn it gets OWN; ALONE where no other chunk has it; HELD where any document outside the training has it.
OWN, ALONE, HELD = 1, 2, 4


def counted_by(tally: Callable | None) -> Callable:
    """The reducer of (names, twice the times that a chunk counts one, and one if it has one that does not count)."""
    return lambda blobs: _counted(blobs, tally)


def _counted(blobs: list[list[np.ndarray]], tally: Callable | None) -> tuple[list[tuple[np.ndarray, ...]], list[int]]:
    """Answers to (names, asks): the corpus's count and flags."""
    key, asked = (np.concatenate(x) for x in zip(*blobs, strict=True))
    order = np.argsort(key)
    key, asked = key[order], asked[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    begins = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    total = np.add.reduceat((asked >> 1).astype(np.int64), begins)
    of_all = ALONE * (np.diff(np.append(begins, len(key))) == 1) + HELD * np.bitwise_or.reduceat((asked & 1).astype(np.uint8), begins)
    flags = of_all[group].astype(np.uint8)
    learning = np.flatnonzero(asked > 1)
    head = np.ones(len(learning), dtype=bool)
    head[1:] = group[learning[1:]] != group[learning[:-1]]
    flags[learning[head]] += OWN
    count, flag = np.empty(len(key), dtype=np.int64), np.empty(len(key), dtype=np.uint8)
    count[order], flag[order] = total[group], flags
    cuts = np.cumsum([len(b[0]) for b in blobs])[:-1]
    return list(zip(np.split(count, cuts), np.split(flag, cuts), strict=True)), tally(total) if tally else None


def exchanged(asked: DataFrame, path: str, buckets: int, chunks: int, reducers: dict[int, Callable]) -> DataFrame:
    """Requests (bucket, chunk, kind, names and values) merged by kind and bucket, and each chunk's answers written as one blob a kind.

    Returns where those stand; rows of tallies (chunk below 0) pass through.
    """

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list[np.ndarray]]] = []
        held_key = None

        def done() -> Iterator[pa.RecordBatch]:
            kind, bucket = held_key
            answers, tally = reducers[kind]([b for _, b in held])
            for (chunk, _), answer in zip(held, answers, strict=True):
                yield row_of(bucket, chunk, kind, pack(*answer))
            if tally:
                yield row_of(bucket, -1 - bucket, kind, None, tally)

        for batch in batches:
            for bucket, chunk, kind, blob, tally in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if blob is None:
                    yield row_of(bucket, chunk, kind, None, tally)
                    continue
                if held and held_key != (kind, bucket):
                    yield from done()
                    held = []
                held_key = (kind, bucket)
                held.append((chunk, unpack_keyed(blob)))
        if held:
            yield from done()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, held_key = Blobs(f"{path}-files"), [], None
        done = lambda: row_of(0, *held_key, files.add(*(np.concatenate(x) for x in zip(*held, strict=True))))
        for batch in batches:
            for bucket, chunk, kind, blob, tally in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if blob is None:
                    yield row_of(bucket, chunk, kind, None, tally)
                    continue
                if held and held_key != (chunk, kind):
                    yield done()
                    held = []
                held_key = (chunk, kind)
                held.append(pickle.loads(blob))
        if held:
            yield done()
        files.close()

    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = asked.repartition(max(n, buckets), "kind", "bucket").sortWithinPartitions("kind", "bucket", "chunk").mapInArrow(tidy(reduced), BLOBS)
    rows = rows.repartition(max(n, chunks // 4), "chunk").sortWithinPartitions("chunk", "kind", "bucket").mapInArrow(tidy(gathered), BLOBS)
    return stored(rows, path)


def requests(kind: int, chunk: int, log2_buckets: int, key: np.ndarray, *values: np.ndarray, packed: Callable = pack_keyed) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that sorted names fall in."""
    if not len(key):
        return
    bucket = (key >> np.uint64(64 - log2_buckets)).astype(np.int64)
    cuts = np.searchsorted(bucket, np.arange((1 << log2_buckets) + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        at = slice(cuts[b], cuts[b + 1])
        yield row_of(b, chunk, kind, packed(key[at], *(v[at] for v in values)))


def over_chunks(tables: list[DataFrame], chunks: int, schema: str, each: Callable) -> DataFrame:
    """``each(chunk number, what its file holds, answers by kind)`` of every chunk; ``tables`` say where it and its answers stand."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t.where("chunk >= 0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, found = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            yield from each(number, found.pop(0), found)

        for batch in batches:
            for mine, kind, blob in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if mine != number:
                    if found:
                        yield from done()
                    number, found = mine, {}
                found[kind] = read(blob)
        if found:
            yield from done()

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks // 4)
    return rows.repartition(n, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(tidy(run), schema)


def log2_buckets(keys: int, keys_a_bucket: int = KEYS) -> int:
    return max(3, (max(keys, 1) // keys_a_bucket).bit_length())
