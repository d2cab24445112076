"""N-gram Jaccard join: a blocked sparse matrix product of documents by their word 5-grams.

Rows of the matrix are the distinct shingle sets (documents with equal sets are one row with a weight), columns are
shingles. Entries that cannot matter are dropped before anything is multiplied, and no link is lost:

1. Texts are read once and become chunks: words as codes, and each document's set by size and name (64 bits over its hashes). Chunks
   ask (``exchange``) for the names of their sets; one chunk owns each set, and only there it goes on.
2. Chunks ask for their shingles, and learn how many sets have each. A row of n shingles that shares fewer than t * n with any other
   row goes: it can reach similarity t with none. This leaves near copies, not documents that merely share a passage.
3. In an order of columns by their counts, then hashes, two rows of similarity t or more share a column within both their
   prefixes, the first n - ceil(t * n) + 1 shingles; those that one row alone holds come first and are counted, not kept. Chunks ask
   for the columns of their prefixes, and learn the smallest row that has each: a column ties its rows to that one, never to each other.
   Connected components of these ties are the candidate clusters.
4. Clusters are cut, by set size, into blocks of at most ``BLOCK`` shingles, and the product is taken for each pair of blocks of one
   cluster whose sizes are near enough: overlap counts accumulate, column by column for columns that few rows hold and over
   tiles for those that many hold, and pairs whose sizes alone rule out
   the threshold, or whose counts stay below the bound, are discarded. A task returns for each row its number of links and
   the smallest row that it reaches in the block - rows, never pairs. Components of those give the result.

Defined results: null, empty and blank texts have the empty set, link with nothing, and are their own component; rows
that repeat a doc_id with the same text are in one component and counted as links of each other; a null doc_id takes
part, and a component of null ids alone is null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Words, as_bytes, at_work, clean_select, distinct, documents, dropped, mixed, shared_dir, signed, slices, stored, tidy
from corpusloom.llm.components import connected_components
from corpusloom.llm.exchange import BLOBS, KEYS, OWN, Blobs, counted_by, exchanged, log2_buckets, names_of, names_packed, over_chunks, planes_of, ranked, requests, row_of, values_of

WORDS_A_SHINGLE = 5
#: Two sets link when PER_CENT * union <= 100 * intersection.
PER_CENT = 75
#: Shingles in a block of rows.
BLOCK = 1 << 20
#: Columns in a tile of the product, rows in a strip.
TILE, STRIP = 4096, 1024
#: Columns of at most so many rows are multiplied entry by entry.
FEW = 16
#: Bytes of text in a chunk, about.
CHUNK = 4 << 20

_SALTS = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sets_of_words(h: np.ndarray, first: np.ndarray, size: int = WORDS_A_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): text i's set, sorted, is hashes[first[i]:first[i + 1]]; its words are h[first[i]:first[i + 1]]."""
    n, texts = np.diff(first), len(first) - 1
    out = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    for j in range(size):
        out += h[j : j + len(out)] * _SALTS[j]
    out = mixed(out)
    full = np.maximum(n - size + 1, 0)
    owner = np.repeat(np.arange(texts), full)
    out = out[np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + np.repeat(first[:-1], full)] if len(owner) else out[:0]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):  # the whole sequence is the only shingle
        rest = np.array([(h[first[i] : first[i + 1]] * _SALTS[8 : 8 + n[i]]).sum(dtype=np.uint64) + np.uint64(n[i]) for i in short], dtype=np.uint64)
        out, owner = np.concatenate((out, mixed(rest))), np.concatenate((owner, short))
    # One sort by text and the hash's top bits; the rest of the hash decides only where those are equal.
    bits = np.uint64(max(1, texts).bit_length())
    order = np.argsort((owner.astype(np.uint64) << (np.uint64(64) - bits)) | (out >> bits))
    tops, owned = out[order] >> bits, owner[order]
    tied = (tops[1:] == tops[:-1]) & (owned[1:] == owned[:-1])
    if (tied & (out[order[1:]] != out[order[:-1]])).any():
        order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.searchsorted(owner[new], np.arange(texts + 1))


def set_names(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 bits for each set, the same for the same set, 1 or more; 0 names the empty set alone."""
    name = lambda x: int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little") or 1
    return np.array([name(hashes[a:b]) if b > a else 0 for a, b in zip(first[:-1], first[1:], strict=True)], dtype=np.uint64)


def _word_hashes(texts: list[bytes], size: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, where each text's begin); a long text is hashed in slices."""
    if sum(map(len, texts)) <= 2 * size:
        words = Words(texts)
        return words.hashes(), words.first
    parts = [np.concatenate([Words([t[a:b]]).hashes() for a, b in slices(t, size)]) for t in texts]
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def _chunks(docs: DataFrame, out: str, size: int) -> DataFrame:
    """Write ``docs`` (doc_id, text) as chunks; a row for where each stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, files = TaskContext.get().partitionId() << 33, 0, Blobs(out)
        held: list[tuple] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, waiting, made
            words, first = _word_hashes([t for _, t in held], size)
            vocab, _, code = distinct(words)
            rank, order = ranked(code, len(vocab))
            hashes, at = sets_of_words(words, first)
            ids = np.array([i or 0 for i, _ in held], dtype=np.int64), np.array([i is not None for i, _ in held])
            where = files.add(names_packed(vocab), planes_of(order), planes_of(rank), np.diff(first), *ids, set_names(hashes, at), np.diff(at))
            held, waiting, made = [], 0, made + 1
            return row_of(0, part + made - 1, 0, where, [int(at[-1]), len(vocab)])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if held and waiting + len(text) > size:
                    yield flush()
                held.append((doc, text))
                waiting += len(text) + 1
        if held:
            yield flush()
        files.close()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), BLOBS)


class _Sets:
    """A chunk's documents and the distinct sets that it owns, or that it may own before ``answers`` tell."""

    def __init__(self, held: list[np.ndarray], answers: dict):
        vocab, order, rank, n_words, self.doc_id, self.named, names, self.sizes = held
        self.names = names.astype(np.uint64)
        self.n_words = n_words.astype(np.int64)
        self.held = vocab, order, rank
        self.key, self.first, back = distinct(self.names)
        self.asks = np.bincount(back, minlength=len(self.key)).astype(np.uint64) * np.uint64(2)
        some = self.key != 0
        self.key, self.first, self.asks = self.key[some], self.first[some], self.asks[some]
        self.mine = np.sort(self.first[answers[1][1] & OWN > 0]) if 1 in answers else self.first

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first) of the sets that it owns, in the order of ``mine``."""
        vocab, order, rank = self.held
        words = names_of(vocab)[values_of(order, np.int32)[values_of(rank, np.int32)]]
        n, begins = self.n_words[self.mine], (np.cumsum(self.n_words) - self.n_words)[self.mine]
        first = np.concatenate(([0], np.cumsum(n)))
        return sets_of_words(words[np.arange(first[-1]) + np.repeat(begins - first[:-1], n)], first)


class _Shared:
    """Of a chunk's own sets, those that share enough: their shared shingles, rarest first."""

    def __init__(self, sets: _Sets, answers: dict, per_cent: int):
        hashes, first = sets.shingles()
        key, _, back = distinct(hashes)
        times = answers[2][0].astype(np.int64)[back] if len(key) else np.zeros(0, dtype=np.int64)
        n = np.diff(first)
        owner = np.repeat(np.arange(len(n)), n)
        shared = times > 1
        count = np.bincount(owner[shared], minlength=len(n))
        good = count * 100 >= n * per_cent
        keep = shared & good[owner]
        owner, hashes, times = owner[keep], hashes[keep], times[keep]
        order = np.lexsort((hashes, times, owner))
        self.owner, self.hashes = (np.cumsum(good) - 1)[owner[order]], hashes[order]
        self.names, self.n, self.count = sets.names[sets.mine[good]], n[good], count[good]
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        # The prefix is counted from the rarest: those that no other row has are not in the list.
        size = self.n - -(-self.n * per_cent // 100) + 1 - (self.n - self.count)
        place = np.arange(len(self.hashes)) - self.first[self.owner]
        self.prefix = place < size[self.owner]


def _least(blobs: list[list[np.ndarray]]) -> tuple[list[tuple[np.ndarray, ...]], None]:
    """Answers to (columns, the smallest of a chunk's rows with each): the smallest of all."""
    key, row = (np.concatenate(x) for x in zip(*blobs, strict=True))
    order = np.lexsort((row, key))
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    out = np.empty(len(key), dtype=np.uint64)
    out[order] = row[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return [(x,) for x in np.split(out, np.cumsum([len(b[0]) for b in blobs])[:-1])], None


_REDUCERS = {1: counted_by(None), 2: counted_by(None), 3: _least}


def candidates(docs: DataFrame, base: str, per_cent: int = PER_CENT, size: int = CHUNK, keys: int = KEYS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, name, n of every document; name, n, hashes (binary), ties of the sets that may have a link).

    ``ties``: the smallest sets that share a column of both prefixes.
    """
    chunks = stored(_chunks(docs, f"{base}/files", size), f"{base}/chunks")
    n_chunks, most = chunks.agg(F.count(F.lit(1)), F.sum(F.col("tally")[0])).first()
    chunks, log2, names = chunks.withColumn("tally", F.lit(None).cast("array<long>")), log2_buckets(most or 0, keys), []

    def exchange(tables: list[DataFrame], name: str, each) -> DataFrame:
        names.append(name)
        return exchanged(over_chunks(tables, n_chunks, BLOBS, each), f"{base}/{name}", 1 << log2, n_chunks, _REDUCERS)

    def of_sets(number: int, held: list, answers: dict) -> Iterator[pa.RecordBatch]:
        s = _Sets(held, answers)
        yield from requests(1, number, log2, s.key, s.asks)

    def of_columns(number: int, held: list, answers: dict) -> Iterator[pa.RecordBatch]:
        key, _, back = distinct(_Sets(held, answers).shingles()[0])
        yield from requests(2, number, log2, key, np.bincount(back, minlength=len(key)).astype(np.uint64) * np.uint64(2))

    def of_prefixes(number: int, held: list, answers: dict) -> Iterator[pa.RecordBatch]:
        s = _Shared(_Sets(held, answers), answers, per_cent)
        column, row = s.hashes[s.prefix], s.names[s.owner[s.prefix]]
        order = np.lexsort((row, column))
        key, at = np.unique(column[order], return_index=True)
        yield from requests(3, number, log2, key, row[order][at])

    def ids_of(number: int, held: list, answers: dict) -> Iterator[pa.RecordBatch]:
        s = _Sets(held, answers)
        columns = [pa.array(s.doc_id.astype(np.int64), mask=~s.named), pa.array(signed(s.names)), pa.array(s.sizes.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "name", "n"])

    def tied(number: int, held: list, answers: dict) -> Iterator[pa.RecordBatch]:
        s = _Shared(_Sets(held, answers), answers, per_cent)
        if not len(s.names):
            return
        column, owner = s.hashes[s.prefix], s.owner[s.prefix]
        least = answers[3][0].astype(np.uint64)[np.unique(column, return_inverse=True)[1]] if len(column) else np.zeros(0, dtype=np.uint64)
        pairs = np.unique(np.stack([owner.astype(np.uint64), least]), axis=1)
        pairs = pairs[:, pairs[1] != s.names[pairs[0].astype(np.int64)]]
        cuts = np.searchsorted(pairs[0], np.arange(len(s.names) + 1).astype(np.uint64))
        ties = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(signed(pairs[1])))
        blobs = pa.array([s.hashes[a:b].tobytes() for a, b in zip(s.first[:-1], s.first[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(signed(s.names)), pa.array(s.n.astype(np.int64)), blobs, ties], names=["name", "n", "hashes", "ties"])

    one = exchange([chunks], "sets-1", of_sets)
    two = exchange([chunks, one], "columns-2", of_columns)
    three = exchange([chunks, one, two], "prefixes-3", of_prefixes)
    sets = stored(over_chunks([chunks], n_chunks, "doc_id long, name long, n long", ids_of), f"{base}/sets")
    found = stored(over_chunks([chunks, one, two, three], n_chunks, "name long, n long, hashes binary, ties array<long>", tied), f"{base}/shared")
    dropped(docs.sparkSession, f"{base}/files", f"{base}/chunks", *(f"{base}/{t}" for t in names), *(f"{base}/{t}-files" for t in names))
    return sets, found


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``parent`` (each entry a root) after joining i[k] with j[k] for every k; the smaller root stays."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def linked_rows(sizes: np.ndarray, counts: np.ndarray, hashes: np.ndarray, split: int | None, weights: np.ndarray, per_cent: int = PER_CENT) -> tuple[np.ndarray, np.ndarray]:
    """(summed weights of the rows that each row links with, smallest row that each reaches by these links).

    Row i is a set of ``sizes[i]`` shingles, of which it lists ``counts[i]`` of ``hashes``, one row after another. With ``split``, only rows before it are multiplied with rows
    from it on. Columns that only one row holds cannot count towards an overlap and are left out.
    """
    n = len(sizes)
    owner = np.repeat(np.arange(n), counts)
    _, code, times = np.unique(hashes, return_inverse=True, return_counts=True)
    useful = (times > 1)[code]
    row, col = owner[useful], (np.cumsum(times > 1) - 1)[code[useful]]
    few = times[times > 1] <= FEW
    links, parent = np.zeros(n), np.arange(n)
    first, second = ((0, n), (0, n)) if split is None else ((0, split), (split, n))
    pairs, counts_of = _few(row[few[col]], col[few[col]], n)
    order = np.lexsort((row[~few[col]], col[~few[col]] // TILE))
    row, col = row[~few[col]][order], (np.cumsum(~few) - 1)[col[~few[col]][order]]
    order = np.lexsort((row, col // TILE))
    row, col = row[order], col[order]
    width = int((~few).sum())
    tiles = np.searchsorted(col // TILE, np.arange(-(-width // TILE) + 1))
    for a in range(*first, STRIP):
        rows = np.arange(a, min(a + STRIP, first[1]))
        mine = slice(*np.searchsorted(pairs, [rows[0] * n, (rows[-1] + 1) * n]))
        for b in range(a if split is None else second[0], second[1], STRIP):
            others = np.arange(b, min(b + STRIP, second[1]))
            both = sizes[rows][:, None] + sizes[others][None, :]
            # 100 * overlap >= p * union is (100 + p) * overlap >= p * both; no overlap exceeds the smaller set
            possible = (100 + per_cent) * np.minimum(sizes[rows][:, None], sizes[others][None, :]) >= per_cent * both
            if not possible.any():
                continue
            overlap = np.zeros(both.shape, dtype=np.int64)
            i, j = pairs[mine] // n, pairs[mine] % n
            here = (j >= others[0]) & (j <= others[-1])
            overlap[i[here] - rows[0], j[here] - others[0]] = counts_of[mine][here]
            for t in range(len(tiles) - 1):
                r, c, wide = row[tiles[t] : tiles[t + 1]], col[tiles[t] : tiles[t + 1]] - t * TILE, min(TILE, width - t * TILE)
                dense = []
                for z in (rows, others):
                    lo, hi = np.searchsorted(r, [z[0], z[-1] + 1])
                    if lo == hi:
                        break
                    x = np.zeros((len(z), wide), dtype=np.float32)
                    x[r[lo:hi] - z[0], c[lo:hi]] = 1
                    dense.append(x)
                if len(dense) == 2:
                    overlap += (dense[0] @ dense[1].T).astype(np.int64)
            linked = possible & ((100 + per_cent) * overlap >= per_cent * both)
            if a == b:
                linked |= linked.T
                np.fill_diagonal(linked, False)
            links[rows] += linked @ weights[others]
            if a != b:
                links[others] += weights[rows] @ linked
            i, j = np.nonzero(linked)
            parent = _unite(parent, rows[i], others[j])
    return links, parent


def _few(row: np.ndarray, col: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs i * n + j with i < j, how many of these columns both rows hold), of columns that few rows hold."""
    order = np.lexsort((row, col))
    row, col = row[order], col[order]
    found = [(row[:-k] * n + row[k:])[col[:-k] == col[k:]] for k in range(1, FEW)]
    return np.unique(np.concatenate(found), return_counts=True) if len(row) else (np.zeros(0, dtype=np.int64),) * 2


def _products(rows: DataFrame, per_cent: int) -> DataFrame:
    """name, root, links: of rows (cluster, i, j, block, name, n, weight, hashes), each (cluster, i, j) multiplied on its own."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_key = None

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t.column("hashes").to_pylist()
            counts, hashes = np.array([len(x) // 8 for x in lists]), np.frombuffer(b"".join(lists), dtype=np.uint64)
            blocks, names = t.column("block").to_numpy(), t.column("name").to_numpy()
            split = None if held_key[1] == held_key[2] else int(np.searchsorted(blocks, held_key[2]))
            links, parent = linked_rows(t.column("n").to_numpy(), counts, hashes, split, t.column("weight").to_numpy().astype(float), per_cent)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[parent]), pa.array(links.astype(np.int64))], names=["name", "root", "links"])

        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in range(3)]
            cuts = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0) | (np.diff(keys[2]) != 0)) + 1 if batch.num_rows else []
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                key = tuple(int(k[a]) for k in keys)
                if held and key != held_key:
                    yield done()
                    held = []
                held_key = key
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    by = ["cluster", "i", "j"]
    ordered = rows.repartition(*by).sortWithinPartitions(*by, "block", "name").select(*by, "block", "name", "n", "weight", "hashes")
    return ordered.mapInArrow(tidy(solve), "name long, root long, links long")


def link(docs: DataFrame, per_cent: int = PER_CENT, block: int = BLOCK, size: int = CHUNK, keys: int = KEYS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: a row for each row of ``docs``.

    component_id is the smallest doc_id that the row's links reach, itself included; n_links counts the other rows that it links with.
    """
    spark = docs.sparkSession
    with at_work(spark):
        return _linked(clean_select(docs, doc_id="long", text="string"), shared_dir(spark, "jaccard"), per_cent, block, size, keys)


def _linked(docs: DataFrame, base: str, per_cent: int, block: int, size: int, keys: int) -> DataFrame:
    spark = docs.sparkSession
    sets, shared = candidates(docs, base, per_cent, size, keys)
    edges = stored(shared.select(F.col("name").alias("a"), F.explode("ties").alias("b")), f"{base}/edges")
    clusters = connected_components(edges, f"{base}/candidates").select(F.col("node").alias("name"), F.col("root").alias("cluster"))
    sizes = sets.where("n > 0").groupBy("name").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("least"))
    by_size = Window.partitionBy("cluster").orderBy("n", "name").rowsBetween(Window.unboundedPreceding, 0)
    members = clusters.join(sizes, "name").withColumn("block", F.floor((F.sum("n").over(by_size) - F.col("n")) / block))
    members = stored(members, f"{base}/members")
    # Blocks whose sizes lie too far apart hold no link.
    spans = members.groupBy("cluster", "block").agg(F.min("n").alias("small"), F.max("n").alias("large"))
    left, right = (spans.select("cluster", *(F.col(c).alias(f"{c}_{k}") for c in ("block", "small", "large"))) for k in ("i", "j"))
    pairs = left.join(right, "cluster").where((F.col("block_i") <= F.col("block_j")) & (F.col("large_i") * 100 >= F.col("small_j") * per_cent))
    pairs = pairs.select("cluster", F.col("block_i").alias("i"), F.col("block_j").alias("j"))
    places = pairs.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = shared.select("name", "hashes").join(members.select("name", "n", "cluster", "block", "weight"), "name").join(places, ["cluster", "block"])
    links = stored(_products(rows, per_cent), f"{base}/links")
    dropped(spark, f"{base}/edges", f"{base}/candidates")
    found = connected_components(links.select(F.col("name").alias("a"), F.col("root").alias("b")), f"{base}/found")
    counted = links.groupBy("name").agg(F.sum("links").alias("links"))
    named = sizes.join(found.withColumnRenamed("node", "name"), "name", "left").join(counted, "name", "left")
    named = named.select("name", F.coalesce("root", "name").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "least")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(roots, "root").select("name", "component_id", "n_links")
    rows = sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("name")).alias("name"))
    out = rows.where("n > 0").join(named, "name").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component (its smallest doc_id; of rows that repeat it, the one whose text hash is least), with its own columns.

    Documents of empty sets link with nothing and all stay. Rows that repeat a doc_id with the same text are one document; those
    that repeat it with another text, and rows of null doc_id, cannot be told apart by it and stay if one of them does.
    """
    found = link(docs).where("n_shingles > 0").select(F.col("doc_id").alias("_id"), F.col("component_id").alias("_component"))
    firsts = found.where(F.col("_id").eqNullSafe(F.col("_component"))).select("_id").distinct()
    others = found.select("_id").distinct().join(firsts.select(F.col("_id").alias("_first")), F.col("_id").eqNullSafe(F.col("_first")), "left_anti")
    kept = docs.join(others, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_anti")
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    blank = F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return kept.withColumn("_nth", F.when(blank, F.lit(1)).otherwise(F.row_number().over(order))).where("_nth = 1").drop("_nth")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p + 1:p + 5], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS p FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)
),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id LEFT JOIN k ON k.a = w.doc_id
"""
