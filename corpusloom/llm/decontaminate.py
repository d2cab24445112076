"""Benchmark decontamination with suffix arrays over the training documents.

Each task cuts its documents into shards of about ``SHARD`` bytes and builds a suffix array over the shard's words.
Words outside the test set's vocabulary share one code that no test suffix holds, so suffixes that begin with one are
left out; they could match nothing. The array is sorted by blocks of several word codes packed into 62 bits, and only
ties are sorted on. Every test suffix of a window or more is then found by binary search: the range of the array that
begins with its window gives all locations, and narrowing the range word by word gives the longest verbatim match. Windows that
several items hold are looked up once. A text longer than a shard is searched in slices that overlap by the longest item.

The test set is read and sent to every task in parts of at most ``TEST_BYTES``, one after another; with several parts each pass is
written and the next one adds to it, so a larger test set costs time and not memory.

``match_benchmark`` gives the spans, items and longest match of every document and the rule on the share of hit words;
``remove_affected`` drops every document that holds a window of the test set, however short it is beside the document.

Defined results: null or wordless texts have no words and no hits; null or wordless items have no windows; items that
repeat an item_id count as one; rows that repeat a doc_id are judged one by one; extra columns pass through, those named
like a result go; an empty table gives no rows, an empty test set no hits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import NOT_ALNUM, Words, clean_select, documents, dropped, shared_dir, slices, stored
from corpusloom.llm.rowwise import kept_rows, with_computed

#: Words in a window.
WINDOW = 13
#: Contaminated: at least one hit word, and this many times the hits reach the words.
SHARE = 20
#: Bytes of training text in a suffix array.
SHARD = 4 << 20
#: Bytes of test text that a task holds at a time.
TEST_BYTES = 32 << 20


@dataclass
class TestSet:
    """Test items as word codes: 0 ends an item, 1.. is a place in ``vocabulary`` plus one."""

    ids: list[str]
    vocabulary: np.ndarray
    codes: np.ndarray
    starts: np.ndarray  # of the suffixes that are looked for
    lengths: np.ndarray  # of their windows
    window: np.ndarray  # which distinct window each begins with
    first: np.ndarray  # a suffix of each distinct window
    items: np.ndarray  # the items of window i: items[item_at[i]:item_at[i + 1]]
    item_at: np.ndarray
    longest: int  # words of the longest item


def test_set(items: list[tuple[str, bytes]], window: int = WINDOW) -> TestSet:
    words = Words([text for _, text in items], NOT_ALNUM)
    hashes = words.hashes()
    vocabulary = np.unique(hashes)
    coded = np.searchsorted(vocabulary, hashes) + 1
    codes = _with_ends(coded, words.first)
    n = np.diff(words.first)
    size = np.minimum(n, window)
    each = np.where(n > 0, n - size + 1, 0)
    item = np.repeat(np.arange(len(items)), each)
    starts = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + (words.first[:-1] + np.arange(len(items)))[item]
    lengths = size[item]
    named, first = _window_names(codes, starts, lengths)
    pairs = np.unique(named * max(1, len(items)) + item)
    owned = pairs // max(1, len(items))
    return TestSet([i for i, _ in items], vocabulary, codes, starts, lengths, named, first, pairs % max(1, len(items)), np.searchsorted(owned, np.arange(len(first) + 1)), int(n.max(initial=0)))


def _window_names(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each stretch, the same for equal ones; one stretch of each number), by naming stretches of 1, 2, 4, ... codes."""
    out, first, used = np.zeros(len(starts), dtype=np.int64), [], 0
    for length in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == length)
        name, done, step, ranks = np.zeros(len(mine), dtype=np.int64), 0, 1, codes
        while step <= length:
            if length & step:
                part = ranks[starts[mine] + done]
                name = np.unique(name * (int(part.max(initial=0)) + 1) + part, return_inverse=True)[1]
                done += step
            after = np.zeros(len(ranks), dtype=np.int64)
            after[: max(0, len(ranks) - step)] = ranks[step:]
            ranks, step = np.unique(ranks * (int(after.max(initial=0)) + 1) + after, return_inverse=True)[1], step * 2
        _, at, name = np.unique(name, return_index=True, return_inverse=True)
        out[mine] = name + used
        first.append(mine[at])
        used += len(at)
    return out, np.concatenate(first) if first else np.zeros(0, dtype=np.int64)


def _with_ends(coded: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Codes with a 0 after each text."""
    out = np.zeros(len(coded) + len(first) - 1, dtype=np.int64)
    out[np.arange(len(coded)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = coded
    return out


class SuffixArray:
    """The suffixes of ``codes`` that begin with a code above 0, in the order of their codes up to the first 0."""

    def __init__(self, codes: np.ndarray, n_codes: int, depth: int):
        self.bits = max(1, int(n_codes).bit_length())
        self.block = 62 // self.bits  # the key after a block's highest one is still below 2 ** 63
        self.text = np.concatenate((codes, np.zeros(self.block + 1, dtype=np.int64)))
        self.n = len(codes)
        at = np.flatnonzero(codes)
        key = self._packed(at, 0)
        order = np.argsort(key, kind="stable")
        self.at, self.key = at[order], key[order]
        self._sort_ties(depth)

    def _packed(self, at: np.ndarray, offset: int) -> np.ndarray:
        """The ``block`` codes from ``offset`` on, in one integer; nothing after the end."""
        out = np.zeros(len(at), dtype=np.int64)
        last = len(self.text) - 1
        for j in range(self.block):
            out = (out << self.bits) | self.text[np.minimum(at + (offset + j), last)]
        return out

    def _full(self, key: np.ndarray) -> np.ndarray:
        """Whether no code in the block is 0: only then what follows can matter."""
        mask, full = (1 << self.bits) - 1, np.ones(len(key), dtype=bool)
        for j in range(self.block):
            full &= (key >> (self.bits * j)) & mask != 0
        return full

    def _sort_ties(self, depth: int) -> None:
        places = np.arange(len(self.at))
        group, key, offset = np.zeros(len(self.at), dtype=np.int64), self.key, 0
        while offset < depth and len(places):
            opens = np.ones(len(places), dtype=bool)
            opens[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
            number = np.cumsum(opens) - 1
            tied = (np.bincount(number)[number] > 1) & self._full(key)
            places, group, offset = places[tied], number[tied], offset + self.block
            key = self._packed(self.at[places], offset)
            order = np.lexsort((key, group))
            self.at[places] = self.at[places][order]
            key = key[order]

    def _bound(self, lo: np.ndarray, hi: np.ndarray, value, keys) -> np.ndarray:
        """For each range the first place whose key is ``value`` or more; all ranges take their steps together."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            i = np.flatnonzero(open_)
            mid = (lo[i] + hi[i]) >> 1
            less = keys(self.at[mid], i) < value[i]
            lo[i[less]] = mid[less] + 1
            hi[i[~less]] = mid[~less]
        return lo

    def find(self, test: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which distinct windows, from, to): the places whose suffixes begin with them."""
        query = SuffixArray.__new__(SuffixArray)
        query.bits, query.block, query.text = self.bits, self.block, np.concatenate((test.codes, np.zeros(self.block + 1, dtype=np.int64)))
        starts, lengths = test.starts[test.first], test.lengths[test.first]
        which = np.arange(len(starts))
        lo, hi = np.zeros(len(which), dtype=np.int64), np.full(len(which), len(self.at))
        offset = 0
        while len(which) and offset < int(lengths.max()):
            left = np.minimum(lengths[which] - offset, self.block)
            done = left <= 0
            shift = (self.block - np.maximum(left, 0)) * self.bits
            low = (query._packed(starts[which], offset) >> shift) << shift
            high = low + (np.int64(1) << shift)
            if offset == 0:
                lo, hi = np.searchsorted(self.key, low), np.searchsorted(self.key, high)
            else:
                keys = lambda at, i, offset=offset: self._packed(at, offset)
                lo, hi = np.where(done, lo, self._bound(lo, hi, low, keys)), np.where(done, hi, self._bound(lo, hi, high, keys))
            found = lo < hi
            which, lo, hi, offset = which[found], lo[found], hi[found], offset + self.block
        return which, lo, hi

    def longest(self, test: TestSet, which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each suffix found: the words of its longest verbatim match, and the places that have it."""
        lo, hi, length = lo.copy(), hi.copy(), test.lengths[which].copy()
        last = len(self.text) - 1
        alive = np.arange(len(which))
        while len(alive):
            offset = length[alive]
            want = test.codes[test.starts[which[alive]] + offset]
            keys = lambda at, i, offset=offset: self.text[np.minimum(at + offset[i], last)]
            a = self._bound(lo[alive], hi[alive], want, keys)
            b = self._bound(lo[alive], hi[alive], want + 1, keys)
            more = (a < b) & (want > 0)
            alive, a, b = alive[more], a[more], b[more]
            lo[alive], hi[alive] = a, b
            length[alive] += 1
        return length, lo, hi


def _expanded(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and the range of each."""
    n = hi - lo
    owner = np.repeat(np.arange(len(lo)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[owner], owner


#: Locations that are listed at a time.
LISTED = 4 << 20


def matches(texts: list[bytes], test: TestSet, shard: int = SHARD) -> tuple[list, list, list, list]:
    """For each text: words, hit spans as [begin, end, ...] in words, items whose windows occur, longest verbatim match."""
    if all(len(t) <= shard for t in texts):
        return _matches(Words(texts, NOT_ALNUM), test)
    out: tuple[list, list, list, list] = [], [], [], []
    for text in texts:
        if len(text) <= shard:
            found = [x[0] for x in _matches(Words([text], NOT_ALNUM), test)]
        else:
            found, before = [0, [], [], 0], b""
            for a, b in slices(text, shard):
                words = Words([before + text[a:b]], NOT_ALNUM)
                again = int(np.searchsorted(words.starts, len(before) + 1))  # words of the slice before
                n, spans, items, longest = (x[0] for x in _matches(words, test))
                spans = [x + found[0] - again for x in spans]
                found = [found[0] + n - again, _merged(found[1], spans), sorted({*found[2], *items}), max(found[3], longest)]
                if len(words.starts):
                    before = words.buf[words.starts[max(0, len(words.starts) - max(1, test.longest - 1))] : 1 + len(before) + b - a].tobytes()
        for column, x in zip(out, found, strict=True):
            column.append(x)
    return out


def _matches(words: Words, test: TestSet) -> tuple[list, list, list, list]:
    n_words = np.diff(words.first)
    n_texts = len(n_words)
    spans, items, longest = [[] for _ in range(n_texts)], [[] for _ in range(n_texts)], np.zeros(n_texts, dtype=np.int64)
    if not len(test.vocabulary) or not n_words.sum():
        return n_words.tolist(), spans, items, longest.tolist()
    hashes = words.hashes()
    place = np.minimum(np.searchsorted(test.vocabulary, hashes), len(test.vocabulary) - 1)
    coded = np.where(test.vocabulary[place] == hashes, place + 1, 0)
    codes = _with_ends(coded, words.first)
    begins = words.first[:-1] + np.arange(n_texts)  # of the texts among the codes
    array = SuffixArray(codes, len(test.vocabulary), test.longest)
    which, lo, hi = array.find(test)
    if len(which):
        # A place begins one window of each length at most, so there are no more pairs than that.
        at, owner = _expanded(lo, hi)
        at, found = array.at[at], which[owner]
        size = test.lengths[test.first[found]]
        change = np.bincount(at, minlength=len(codes) + 1) - np.bincount(at + size, minlength=len(codes) + 1)
        hit = np.cumsum(change) > 0
        edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0))
        for b, e in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            t = int(np.searchsorted(begins, b, side="right")) - 1
            spans[t] += [b - int(begins[t]), e - int(begins[t])]
        in_text = np.searchsorted(begins, at, side="right") - 1
        for pair in np.unique(in_text * len(test.first) + found).tolist():
            w = pair % len(test.first)
            items[pair // len(test.first)] += test.items[test.item_at[w] : test.item_at[w + 1]].tolist()
        items = [[test.ids[i] for i in sorted(set(x))] for x in items]
        spot = np.full(len(test.first), -1, dtype=np.int64)
        spot[which] = np.arange(len(which))
        spot = spot[test.window]
        suffixes = np.flatnonzero(spot >= 0)
        length, lo, hi = array.longest(test, suffixes, lo[spot[suffixes]], hi[spot[suffixes]])
        ranges = np.unique(np.stack([lo, hi, length]), axis=1)
        for part in np.split(np.arange(ranges.shape[1]), np.flatnonzero(np.diff(np.cumsum(ranges[1] - ranges[0]) // LISTED)) + 1):
            at, owner = _expanded(ranges[0, part], ranges[1, part])
            np.maximum.at(longest, np.searchsorted(begins, array.at[at], side="right") - 1, ranges[2, part][owner])
    return n_words.tolist(), spans, items, longest.tolist()


def _merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for begin, end in sorted(zip((a + b)[0::2], (a + b)[1::2], strict=True)):
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


_SCHEMA = "n_words long, hit_spans array<int>, items array<string>, longest long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _items(benchmark: DataFrame) -> DataFrame:
    rows = clean_select(benchmark, item_id="string", text="string")
    return rows.where("text is not null").select(F.coalesce("item_id", F.lit("")).alias("item_id"), "text")


def part_count(benchmark: DataFrame, most: int = TEST_BYTES) -> int:
    """How many parts of about ``most`` bytes the test set is read in."""
    return int((_items(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most) + 1


def test_part(benchmark: DataFrame, k: int, parts: int) -> TestSet:
    """Part k of the test set, the only one that the driver holds."""
    rows = _items(benchmark).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
    return test_set(sorted((r["item_id"], r["text"].encode()) for r in rows))


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, test_bytes: int = TEST_BYTES, shard: int = SHARD) -> DataFrame:
    """``docs`` with n_words, hit_spans, items, longest, n_hit, n_items, items_sha256, contaminated."""
    spark, parts, out, path = docs.sparkSession, part_count(benchmark, test_bytes), docs, None
    for k in range(parts):
        test = spark.sparkContext.broadcast(test_part(benchmark, k, parts))

        def compute(texts: list[bytes], state: dict, test=test) -> dict:
            n_words, spans, items, longest = matches(texts, test.value, shard)
            if state:
                spans = [_merged(a, b) for a, b in zip(state["hit_spans"].to_pylist(), spans, strict=True)]
                items = [[*a, *b] for a, b in zip(state["items"].to_pylist(), items, strict=True)]
                longest = [max(a, b) for a, b in zip(state["longest"].to_pylist(), longest, strict=True)]
            items = [sorted(set(x)) for x in items]
            n_hit = [sum(x[1::2]) - sum(x[0::2]) for x in spans]
            return {
                "n_words": n_words, "hit_spans": spans, "items": items, "longest": longest, "n_hit": n_hit, "n_items": [len(x) for x in items],
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
                "contaminated": [h > 0 and SHARE * h >= n for h, n in zip(n_hit, n_words, strict=True)],
            }

        out = with_computed(out, _SCHEMA, compute, shard, state=("hit_spans", "items", "longest") if k else ())
        if parts > 1:  # what this part adds is written, and only then the next part read
            path, before = f"{path.rsplit('/', 1)[0] if path else shared_dir(spark, 'hits')}/part-{k}", path
            out = stored(out, path)
            test.destroy()
            if before:
                dropped(spark, before)
    return out


def remove_affected(docs: DataFrame, benchmark: DataFrame, test_bytes: int = TEST_BYTES) -> DataFrame:
    """The documents that hold no window of the test set, with their own columns."""
    spark, parts, path = docs.sparkSession, part_count(benchmark, test_bytes), None
    for k in range(parts):
        test = spark.sparkContext.broadcast(test_part(benchmark, k, parts))
        docs = kept_rows(docs, lambda texts, test=test: [not x for x in matches(texts, test.value)[1]], SHARD)
        if parts > 1:
            path, before = f"{path.rsplit('/', 1)[0] if path else shared_dir(spark, 'clean')}/part-{k}", path
            docs = stored(docs, path)
            test.destroy()
            if before:
                dropped(spark, before)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = clean_select(documents(spark, sf_dir), doc_id="long", text="string")
    found = match_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p + 1:p + m], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS m, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS p FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, p, m, array_to_string(w[p + 1:p + m], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
),
h AS (SELECT doc_id, p, m, item_id FROM dw JOIN bw USING (m, g)),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS pos FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
