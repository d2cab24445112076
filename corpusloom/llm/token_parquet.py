"""Token-ID output: Parquet files of id lists that can be read in part.

Documents are dealt by range of doc_id and sorted, so the files in order of their part number hold them in ascending
order. Each task encodes its texts and writes one file with pyarrow: an id list (dictionary pages by default, delta
binary packing as the other choice), delta-packed doc_id, length and offset within the file, dictionary-coded metadata,
row groups closed after ``GROUP_IDS`` ids, and page indexes. So the lengths of a corpus, or the ids of a few documents, are read
without the rest. A task writes under a name of its own and reports it in a row; the table of these rows, the
manifest, makes a file part of the output. Whatever a lost or repeated task left behind is not in it. Only the files'
id counts are summed over all parts to place each file in the corpus.

The library encodes each distinct word of the stretches between ASCII white space once and keeps its ids and its bytes (at most
``WORDS`` words a task). A word is looked up by a 64-bit hash and its bytes are compared, so a text with a word whose hash
is that of another one is encoded whole. This holds for tokenizers that lower-case and cut at white space and between letters and marks
themselves, which ``cuts_words`` reads from the definition (``WORD_CUTS``); texts of any other tokenizer are encoded whole.

Defined results: null and empty texts have no ids but the end id; rows that repeat a doc_id stand beside each other,
in the order of their texts' hashes; a null doc_id comes first; metadata columns are named by the caller and must not
be named like the file's own, other extra columns are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import BLANKS, BYTES, HashTable, Words, as_bytes, chunks, distinct, documents, filesystem, shared_dir, small_batches, stored, tidy

END_ID = 2
#: Ids in a row group, or those of one document.
GROUP_IDS = 1 << 20
#: Bytes in a data page before encoding.
PAGE = 64 << 10
#: Words whose ids a task keeps; then it keeps the half that came first.
WORDS = 1_000_000
CHUNK = 1 << 20

#: What a tokenizer's definition says if it lower-cases, drops white space, and never joins what stands on both sides of a cut.
WORD_CUTS = {
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


@lru_cache(maxsize=1)
def cuts_words(definition: str) -> bool:
    """Whether a tokenizer's ids of a text are those of its words, one after another."""
    d = json.loads(definition)
    cuts = (d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first = cuts[0]
    return (
        (d.get("normalizer") or {}).get("normalizers") == WORD_CUTS["normalizers"]
        and first.get("type") == "Split" and first.get("pattern") == {"Regex": WORD_CUTS["split"]} and first.get("behavior") == "Removed" and first.get("invert") is True
        and all(c.get("type") == "ByteLevel" and not c.get("use_regex") and not c.get("add_prefix_space") for c in cuts[1:])
        and all(t["content"].startswith("<|") for t in d.get("added_tokens") or [])
    )


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in ",.;:!?|%$#&*()\"-"]] = True


class _Pieces(Words):
    """Stretches between white space, cut also where a letter a-z is followed by a mark other than an apostrophe.

    The tokenizer cuts there as well. All-ASCII texts are lower-cased, as the tokenizer would. Neither is done where a text may
    hold the string of a control token.
    """

    def __init__(self, texts: list[bytes]):
        plain = [b"<|" not in t for t in texts]
        super().__init__([t.lower() if p and t.isascii() else t for t, p in zip(texts, plain, strict=True)], BLANKS, lower=False)
        cut = np.zeros(len(self.buf) + 1, dtype=bool)
        cut[1:-1] = _LETTER[self.buf[:-1]] & _MARK[self.buf[1:]]
        if not all(plain):
            for i in np.flatnonzero(~np.array(plain)):
                cut[self.at[i] : self.at[i + 1]] = False
        at = np.flatnonzero(cut)
        self.starts, self.ends = np.sort(np.concatenate((self.starts, at))), np.sort(np.concatenate((self.ends, at)))
        self.first = np.searchsorted(self.starts, self.at)


@lru_cache(maxsize=1)
def _tokenizer(definition: str):
    """One for each Python worker: building it anew in every task leaves memory behind."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_str(definition)


class WordEncoder:
    """Ids of whole texts by way of their words' ids; words are told apart by their bytes."""

    def __init__(self, definition: str, end_id: int, most: int = WORDS):
        self.tokenizer, self.end_id, self.most, self.whole_words = _tokenizer(definition), end_id, most, cuts_words(definition)
        self._forget()

    def _forget(self) -> None:
        self.table = HashTable(max(8, self.most.bit_length() + 1))
        self.starts, self.lengths, self.flat, self.used = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.int32), 0
        self.raw, self.raw_at, self.raw_used = np.zeros(1 << 16, np.uint8), np.zeros(1025, np.int64), 0

    def _forget_half(self) -> None:
        """Keep the words that came first: frequent ones come early."""
        old, half = self.table, self.most // 2
        kept = np.flatnonzero((old.number >= 0) & (old.number < half))
        kept = kept[np.argsort(old.number[kept])]
        self.table = HashTable(max(8, self.most.bit_length() + 1))
        self.table.add(old.key[kept], old.check[kept])
        self.used = int(self.starts[len(kept) - 1] + self.lengths[len(kept) - 1]) if len(kept) else 0
        self.raw_used = int(self.raw_at[len(kept)])

    def _other(self, words: Words, code: np.ndarray) -> np.ndarray:
        """The words whose bytes are not those of the word that their hash found."""
        size, at = words.ends - words.starts, self.raw_at[code]
        differs = size != self.raw_at[code + 1] - at
        mine = np.ndarray((len(words.buf) - 7,), dtype="<u8", buffer=words.buf, strides=(1,))
        kept = np.ndarray((len(self.raw) - 7,), dtype="<u8", buffer=self.raw, strides=(1,))
        which, a, b, left = np.arange(len(size)), words.starts, at, size
        while len(which):
            keep = BYTES[np.minimum(left, 8)]
            differs[which[(mine[a] ^ kept[b]) & keep != 0]] = True
            more = np.flatnonzero((left > 8) & ~differs[which])
            which, a, b, left = which[more], a[more] + 8, b[more] + 8, left[more] - 8
        return np.flatnonzero(differs)

    def _ids_of(self, words: list[bytes], run: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word): words are encoded in runs; an id's offset tells its word."""
        some = [w.decode(errors="replace") for w in words]
        runs = [some[k : k + run] for k in range(0, len(some), run)]
        ids, lengths = [], []
        for own, found in zip(runs, self.tokenizer.encode_batch([" ".join(x) for x in runs], add_special_tokens=False), strict=True):
            begins = np.cumsum(np.fromiter((len(w) + 1 for w in own), np.int64, len(own)))
            at = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(found))[0::2]
            lengths.append(np.bincount(np.searchsorted(begins, at, side="right"), minlength=len(own)))
            ids.append(np.array(found.ids, dtype=np.int32))
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, words: list[bytes], key: np.ndarray) -> None:
        for i in range(0, len(words), 8192):
            some = words[i : i + 8192]
            ids, lengths = self._ids_of(some)
            n, need = self.table.n, self.table.n + len(some)
            sizes = np.fromiter(map(len, some), np.int64, len(some))
            while need > len(self.starts):
                self.starts, self.lengths, self.raw_at = (np.concatenate((x, np.zeros(len(self.starts), dtype=x.dtype))) for x in (self.starts, self.lengths, self.raw_at))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            while self.raw_used + int(sizes.sum()) + 8 > len(self.raw):
                self.raw = np.concatenate((self.raw, np.zeros_like(self.raw)))
            self.lengths[n:need] = lengths
            self.starts[n:need] = self.used + np.cumsum(lengths) - lengths
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.raw_at[n + 1 : need + 1] = self.raw_used + np.cumsum(sizes)
            self.raw[self.raw_used : self.raw_used + int(sizes.sum())] = np.frombuffer(b"".join(some), dtype=np.uint8)
            self.raw_used += int(sizes.sum())
            self.table.add(key[i : i + 8192], key[i : i + 8192])

    def _whole(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode(errors="replace") for t in texts], add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text); the end id closes each text."""
        if not self.whole_words:
            found = self._whole(texts)
            lengths = np.fromiter((len(x) + 1 for x in found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(chain(x, (self.end_id,)) for x in found), np.int32, int(lengths.sum())), lengths
        words = _Pieces(texts)
        key = words.hashes()
        code = self.table.find(key, key)
        if (code < 0).any():
            for again in (False, True):
                missing = np.flatnonzero(code < 0)
                missing = missing[distinct(key[missing])[1]]
                if again or self.table.n + len(missing) <= self.most:
                    break
                self._forget_half()
                code = self.table.find(key, key)
            if self.table.n + len(missing) > self.table.mask // 2:
                self.table = _larger(self.table, self.table.n + len(missing))
            raw = words.buf.tobytes()
            self._learn([raw[a:b] for a, b in zip(words.starts[missing].tolist(), words.ends[missing].tolist(), strict=True)], key[missing])
            code = self.table.find(key, key)
        other = self._other(words, code)
        n = np.diff(words.first)
        lengths = self.lengths[code].astype(np.int64)
        ends = np.cumsum(lengths)
        texts_ids = np.concatenate(([0], ends))[words.first]
        ids = self.flat[np.repeat(self.starts[code] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        sizes = np.diff(texts_ids) + 1
        out = np.full(int(sizes.sum()), self.end_id, dtype=np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), sizes - 1)] = ids
        if len(other):  # a hash that two words share: their texts are encoded whole
            which = np.unique(np.searchsorted(words.first, other, side="right") - 1).tolist()
            each = np.split(out, np.cumsum(sizes)[:-1])
            for i, found in zip(which, self._whole([texts[i] for i in which]), strict=True):
                each[i] = np.array([*found, self.end_id], dtype=np.int32)
            return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)
        return out, sizes


def _larger(table: HashTable, n: int) -> HashTable:
    """For a text of more words than are kept: the same numbers in a table of room enough."""
    at = np.flatnonzero(table.number >= 0)
    at = at[np.argsort(table.number[at])]
    out = HashTable((2 * n).bit_length())
    out.add(table.key[at], table.check[at])
    return out


def _schema(docs: DataFrame, meta: list[str]) -> pa.Schema:
    own = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("offset", pa.int64())]
    clash = {"doc_id", "n_tokens", "offset", "tokens", "start", "ids_crc32"} & set(meta)
    if clash:
        raise ValueError(f"metadata columns named like the output's own: {sorted(clash)}")
    return pa.schema([*own, *((m, pa.string()) for m in meta), ("tokens", pa.list_(pa.int32()))])


def write_tokens(docs: DataFrame, out: str, definition: str, end_id: int = END_ID, meta: tuple[str, ...] = (), encoding: str = "dictionary", partitions: int | None = None) -> DataFrame:
    """Write ``docs`` below ``out``; returns the manifest: part, path, rows, ids, groups, before (ids of the parts before)."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(m).cast("string").alias(f"meta_{i}") for i, m in enumerate(meta)))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    schema, sent, data = _schema(docs, list(meta)), spark.sparkContext.broadcast(definition), f"{out}/data"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        part = TaskContext.get().partitionId()
        encoder = WordEncoder(sent.value, end_id)
        writer, groups, total, count, held, waiting = None, 0, 0, 0, [], 0

        def flush() -> None:
            nonlocal groups, held, waiting
            if held:
                writer.write_table(pa.Table.from_batches(held), row_group_size=1 << 40)
                groups, held, waiting = groups + 1, [], 0

        for batch in batches:
            texts = as_bytes(batch.column(1))
            for begin, end in chunks(texts, CHUNK):
                ids, lengths = encoder.encode(texts[begin:end])
                ends = np.cumsum(lengths)
                if writer is None:
                    fs, path = filesystem(data)
                    fs.create_dir(path)
                    path = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.parquet"
                    tokens = {"tokens.list.element": "DELTA_BINARY_PACKED"} if encoding == "delta" else {}
                    sink = fs.open_output_stream(path)
                    writer = pq.ParquetWriter(
                        sink, schema, compression="zstd", write_page_index=True, data_page_size=PAGE, write_statistics=True,
                        use_dictionary=[*meta, *([] if encoding == "delta" else ["tokens.list.element"])],
                        column_encoding={"doc_id": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED", "offset": "DELTA_BINARY_PACKED", **tokens},
                    )
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids))
                some = batch.slice(begin, end - begin)
                made = pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(lengths), pa.array(total + ends - lengths), *(some.column(2 + i) for i in range(len(meta))), lists], schema=schema
                )
                at = 0
                for i in np.append(np.flatnonzero(np.diff((waiting + ends) // GROUP_IDS) > 0) + 1, len(lengths)):
                    held.append(made.slice(at, int(i) - at))
                    waiting += int(lengths[at : int(i)].sum())
                    at = int(i)
                    if waiting >= GROUP_IDS or at < len(lengths):
                        flush()
                total, count = total + len(ids), count + len(lengths)
        if writer is not None:
            flush()
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{data}/{path.rsplit('/', 1)[1]}"], "rows": [count], "ids": [total], "groups": [groups]})

    written = stored(rows.mapInArrow(tidy(run), "part long, path string, rows long, ids long, groups long"), f"{out}/parts")
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored(written.withColumn("before", before), f"{out}/manifest")


def read_tokens(spark: SparkSession, out: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The output's rows, by Spark's own reader: only the columns asked for, and what filters leave of groups and pages."""
    paths = sorted(r["path"] for r in spark.read.parquet(f"{out}/manifest").select("path").collect())  # one for each file
    if not paths:
        return spark.createDataFrame([], "doc_id long, n_tokens long, offset long, tokens array<int>").select(*(columns or ("*",)))
    return spark.read.parquet(*paths).select(*(columns or ("*",)))


def digests(manifest: DataFrame, meta: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and metadata, read back from the files, a row group at a time."""
    names = ["doc_id", "n_tokens", "offset", *meta, "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["path"])
                with fs.open_input_file(path) as source:
                    table = pq.ParquetFile(source).read_row_group(row["group"], columns=names).combine_chunks()
                if not table.num_rows:
                    continue
                lists = table.column("tokens").chunk(0)
                ids = np.ascontiguousarray(lists.values.to_numpy(), dtype="<u4")
                at = lists.offsets.to_numpy()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                start = table.column("offset").to_numpy() + row["before"]
                columns = [table.column("doc_id").chunk(0), pa.array(start), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *(table.column(m).chunk(0) for m in meta)], names=["doc_id", "start", "n_tokens", "ids_crc32", *meta])

    groups = manifest.select("path", "before", F.explode(F.sequence(F.lit(0), F.col("groups").cast("int") - 1)).alias("group"))
    tasks = groups.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "group")
    return tasks.mapInArrow(tidy(run), ", ".join(["doc_id long, start long, n_tokens long, ids_crc32 long", *(f"`{m}` string" for m in meta)]))


def definition_of(name: str = "word_bpe_49k.json", path: str | None = None) -> str:
    """The tokenizer's JSON, from ``path`` or the installed vocabulary files; read once by the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return text


def encoded(docs: DataFrame, meta: tuple[str, ...] = ()) -> DataFrame:
    """Write ``docs`` to a new folder of the shared store and return what its files hold, by document."""
    out = shared_dir(docs.sparkSession, "tokens")
    return digests(write_tokens(docs, out, definition_of(), meta=meta), meta)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir), ("lang", "source"))
