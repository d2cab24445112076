"""Language-model scores: order-3 Katz backoff with Good-Turing discounts, learned from some documents and applied to all.

Tokens are words (lower-cased A-Z) and one end per document; a document's tokens follow an end that is context only. An
n-gram is named by a 64-bit hash made from the names of its first and its last n - 1 words.

Texts are read once and become chunks of about ``TOKENS`` tokens: a chunk's distinct words and a code for each token. A text
longer than a chunk goes on in the next one, which is given the last two tokens before it. From then on tables hold a blob
of sorted 64-bit names for each (chunk, bucket of the hash space), never a row for each n-gram. Order by order

1. a chunk asks for each of its distinct n-grams once, with the times it holds it in training documents; the task of a bucket
   merges what all chunks ask, whatever the number of chunks, and answers with the count over the corpus. It also tells which one
   chunk owns the n-gram (so that sums over distinct n-grams count it once), whether no other chunk holds it, and whether
   any document that is not learned from does;
2. an n-gram with a part that no other chunk holds is counted where it stands, without asking. Every n-gram is counted, also those
   that occur once;
3. Good-Turing factors come from the counts of counts over all buckets;
4. a context's weight is (1 - its discounted mass) / (1 - the lower order's mass of the same words): chunks send the sums over the
   n-grams they own, buckets add them and answer with the weight. So every conditional distribution over the vocabulary
   and one unknown word sums to 1. Contexts that stand in one chunk alone are weighed there, and weights that no text can need (every n-gram
   of a learned text is there) are not made.

Counts and weights are written by chunk, and a table says where they stand; at the end each chunk evaluates, for each distinct n-gram
of its tokens, the recursion log p(w | h) = log p*(w | h) if hw was seen, else log a(h) + log p(w | h'). No task holds more
than a chunk or a bucket (about ``KEYS`` names); frequent n-grams are one name a chunk.

Defined results: null and empty texts are one end; without training documents every token is unknown with probability 1
and base_score counts V = N = 0; rows that repeat a doc_id are scored one by one; ids may be null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Words, as_bytes, at_work, clean_select, distinct, documents, dropped, mixed, remainder, shared_dir, slices, stored, tidy
from corpusloom.llm.exchange import ALONE, BLOBS, HELD, KEYS, OWN, Blobs, counted_by, exchanged, listed, log2_buckets, names_of, names_packed, over_chunks, pack_keyed, planes_of, ranked, requests, row_of, values_of

#: Counts above this are not discounted.
K = 5
#: Tokens in a chunk, about; a text is read in slices of ``SLICE`` bytes.
TOKENS = 1 << 20
SLICE = 4 << 20

#: The end's hash: no word holds a line feed.
END = np.uint64(0x1F83D9ABFB41BD6B)

def joined(first: np.ndarray, last: np.ndarray, order: int) -> np.ndarray:
    """The names of n-grams from those of their first and last n - 1 words."""
    return mixed(first * np.uint64(0xFF51AFD7ED558CCD) + last * np.uint64(0xC4CEB9FE1A85EC53) + np.uint64(order))


# --- chunks ----------------------------------------------------------------------------------
@dataclass
class Chunk:
    """Tokens of runs of texts ("segments"), as codes into the sorted hashes of the chunk's distinct words.

    A segment's first ``lead`` tokens are context only: the end before a document, or the two tokens before a slice.
    """

    vocab: np.ndarray
    code: np.ndarray
    row: np.ndarray  # the document, numbered within the input
    doc_id: np.ndarray
    named: np.ndarray  # whether it has an id
    train: np.ndarray
    size: np.ndarray
    lead: np.ndarray

    def packed(self) -> list[np.ndarray]:
        """What the file holds."""
        rank, order = ranked(self.code, len(self.vocab))
        return [names_packed(self.vocab), planes_of(order), planes_of(rank), self.row, self.doc_id, self.named, self.train, self.size, self.lead]

    @classmethod
    def of(cls, vocab: np.ndarray, order: np.ndarray, rank: np.ndarray, *rest: np.ndarray) -> Chunk:
        return cls(names_of(vocab), values_of(order, np.int32)[values_of(rank, np.int32)], *rest)

    def __post_init__(self) -> None:
        self.size = self.size.astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.owner = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(self.code)) - self.first[self.owner]
        self.counts = self.place >= self.lead[self.owner]
        self.learns = self.counts & self.train[self.owner]
        self.held = ~self.train[self.owner]

    def asks(self, at: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        """Of n n-grams, those that stand ``at`` tokens: twice the times that the model learns it, and one if another document has it."""
        times = np.bincount(gram, weights=self.learns[at], minlength=n).astype(np.uint64)
        return times * np.uint64(2) + (np.bincount(gram, weights=self.held[at], minlength=n) > 0)


def _segments(docs: DataFrame, out: str, tokens: int = TOKENS, size: int = SLICE) -> DataFrame:
    """Write ``docs`` (doc_id, train, text) as chunks, a file a task; where each stands is a row, and only chunks with a row count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 33, 0
        files = Blobs(out)
        held: list[tuple] = []  # (row, doc_id, train, lead tokens, word hashes, ends)
        waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, waiting, made
            parts = []
            for *_, lead, words, ends in held:
                parts += [lead, words, np.array([END] if ends else [], dtype=np.uint64)]
            vocab, _, code = distinct(np.concatenate(parts))
            lead, sizes = np.array([len(h[3]) for h in held]), np.array([len(h[3]) + len(h[4]) + h[5] for h in held])
            ids = np.array([h[1] or 0 for h in held], dtype=np.int64), np.array([h[1] is not None for h in held])
            columns = [np.array([h[i] for h in held]) for i in (0, 2)]
            row = row_of(0, part + made, 0, files.add(*Chunk(vocab, code, columns[0], *ids, columns[1], sizes, lead).packed()), [len(code), len(vocab)])
            held, waiting, made = [], 0, made + 1
            return row

        start, n_rows = np.array([END]), 0
        for batch in batches:
            ids, train = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = range(part + n_rows, part + n_rows + len(ids))
            n_rows += len(ids)
            texts = as_bytes(batch.column(2))
            group: list[int] = []
            for i, text in enumerate(texts):
                if len(text) <= size:
                    group.append(i)
                if len(text) > size or sum(len(texts[k]) for k in group) > size or i + 1 == len(texts):
                    words = Words([texts[k] for k in group])
                    hashes = words.hashes()
                    for n, k in enumerate(group):
                        held.append((rows[k], ids[k], train[k], start, hashes[words.first[n] : words.first[n + 1]], True))
                        waiting += len(held[-1][4]) + 2
                        if waiting >= tokens:
                            yield flush()
                    group = []
                if len(text) > size:
                    lead, cuts = start, slices(text, size)
                    for n, (a, b) in enumerate(cuts):
                        hashes, ends = Words([text[a:b]]).hashes(), n + 1 == len(cuts)
                        held.append((rows[i], ids[i], train[i], lead, hashes, ends))
                        waiting += len(hashes) + 2
                        lead = np.concatenate((lead, hashes))[-2:]
                        if not ends or waiting >= tokens:
                            yield flush()
        if held:
            yield flush()
        files.close()

    return docs.select("doc_id", "train", "text").mapInArrow(tidy(run), BLOBS)


# --- what the bucket tasks do ----------------------------------------------------------------
def _tally(c: np.ndarray) -> list[int]:
    """How many n-grams have each count up to K + 1, how many there are, and how often they occur."""
    c = c[c > 0]
    return [*np.bincount(np.minimum(c, K + 2), minlength=K + 3)[: K + 2].tolist(), len(c), int(c.sum())]


def weight(mass: np.ndarray, lower: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log a, 1 or 0) of contexts that occur c times: masses are shares of c, or of c + 1 where the second is 1.

    So does a context whose mass is all kept, that something is left for other words.
    """
    plus = (mass > c - 1e-6).astype(np.uint8)
    return np.log10((1 - mass / (c + plus)) / np.maximum(1 - lower, 1e-300)), plus


def _sums_packed(key: np.ndarray, c: np.ndarray, needs: np.ndarray, mass: np.ndarray, lower: np.ndarray) -> bytes:
    some = lower > 0
    return pack_keyed(key, c, np.packbits(needs), np.packbits(some), *listed(mass[some]), *listed(lower[some]))


def _weighed(blobs: list[list[np.ndarray]]) -> tuple[list[tuple[np.ndarray, ...]], None]:
    """Answers to (names of contexts, their counts, which ones need an answer, masses and lower masses of what a chunk owns): ``weight``."""
    sums = []
    for _, c, _, some, *values in blobs:
        at = np.flatnonzero(np.unpackbits(some, count=len(c)))
        both = np.zeros((2, len(c)))
        both[:, at] = values[0][values[1]], values[2][values[3]]
        sums.append(both)
    key, c, (mass, lower) = np.concatenate([b[0] for b in blobs]), np.concatenate([b[1] for b in blobs]), np.concatenate(sums, axis=1)
    _, first, group = distinct(key)
    found = weight(np.bincount(group, weights=mass), np.bincount(group, weights=lower), c[first].astype(np.int64))
    ends, out = np.cumsum([len(b[0]) for b in blobs]), []
    for b, end in zip(blobs, ends, strict=True):
        mine = group[end - len(b[0]) : end][np.unpackbits(b[2], count=len(b[0])) > 0]
        out.append(tuple(x[mine] for x in found))
    return out, None


_REDUCERS = {1: counted_by(_tally), 2: counted_by(_tally), 3: counted_by(_tally), 11: _weighed, 12: _weighed}


# --- counts and weights ----------------------------------------------------------------------
def discounts(n: dict[int, int], least: int, k: int = K) -> dict[int, float]:
    """The factor of each count from ``least`` to k (Katz, 1987), from how many n-grams have each count; counts above k keep all.

    Where the counts of counts give no factor between 0 and 1, absolute discounting by n1 / (n1 + 2 n2) for counts up to k.
    """
    if all(n.get(r, 0) for r in range(1, k + 2)):
        rest = (k + 1) * n[k + 1] / n[1]
        out = {r: ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if rest != 1 else 0.0 for r in range(least, k + 1)}
        if all(0 < d <= 1 for d in out.values()):
            return out
    one, two = n.get(1, 0), n.get(2, 0)
    away = min(0.9, one / (one + 2 * two)) if one else 0.5
    return {r: (r - away) / r for r in range(least, k + 1)}


@dataclass
class Model:
    """Counts of counts and factors of each order, and what the unigrams come to."""

    n: int  # training tokens
    v: int  # distinct ones
    times: list[dict[int, int]]  # n-grams of each count from 1 to K + 1, by order
    factors: list[np.ndarray]  # discounted counts of 0 to K, by order
    unknown: float  # probability of the unknown word
    share: float  # of the whole that known words' discounted counts are scaled by

    @classmethod
    def of(cls, tallies: list[list[int]]) -> Model:
        times = [{r: t[r] for r in range(1, K + 2)} for t in tallies]
        factors = [np.array([0.0, *(r * d for r, d in sorted(discounts(t, 1).items()))]) for t in times]
        v, n = tallies[0][K + 2], tallies[0][K + 3]
        left = sum(times[0][r] * (r - factors[0][r]) for r in range(1, K + 1)) / n if n else 1.0
        share = 1.0
        if v and left < 0.5 / n:  # no count below k: the unknown word takes half a token from the whole
            share, left = 1 - 0.5 / n, 0.5 / n
        return cls(n, v, times, factors, left, share)

    def mass(self, order: int, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        f = self.factors[order - 1]
        return np.where(c <= K, f[np.minimum(c, K)], c)

    def small(self, order: int) -> int:
        """Contexts up to this count never keep all their mass in n-grams of ``order``."""
        return K if (self.factors[order - 1][1:] < np.arange(1, K + 1) - 1e-6).all() else 0


class _Grams:
    """A chunk's distinct bigrams and trigrams, what it asks of them, and which token has which."""

    def __init__(self, chunk: Chunk, order: int):
        names = chunk.vocab[chunk.code]
        at = np.flatnonzero(chunk.place >= 1)
        self.two, first, back = distinct(joined(names[at - 1], names[at], 2))
        self.two_at = np.full(len(names), -1, dtype=np.int64)  # of the bigram that ends with each token
        self.two_at[at] = back
        self.two_asks = chunk.asks(at, back, len(self.two))
        self.two_first, self.two_last = chunk.code[at[first] - 1], chunk.code[at[first]]
        if order < 3:
            return
        at = np.flatnonzero((chunk.place >= 2) & chunk.counts)
        before, last = self.two_at[at - 1], self.two_at[at]
        self.three, first, back = distinct(joined(self.two[before], self.two[last], 3))
        self.three_at = np.full(len(names), -1, dtype=np.int64)
        self.three_at[at] = back
        self.three_asks = chunk.asks(at, back, len(self.three))
        self.three_ctx, self.three_suf = before[first], last[first]


class _Counts:
    """Counts of a chunk's n-grams of one order, from the answers and from what needed none."""

    def __init__(self, asked: np.ndarray, asks: np.ndarray, answer: list[np.ndarray] | None):
        self.mine = asks % np.uint64(2) == 1  # whether this chunk has a text with it that is not learned from
        self.c, self.alone, self.owns, self.held = (asks >> np.uint64(1)).astype(np.int64), ~asked, asks > 1, self.mine.copy()
        if answer is not None:
            self.c[asked], flags = answer[0], answer[1]
            self.alone[asked], self.owns[asked], self.held[asked] = flags & ALONE > 0, flags & OWN > 0, flags & HELD > 0

    def contexts(self, small: int, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The contexts that are weighed here, as no other chunk has them; those that a bucket weighs; and whose weights are needed here.

        In a text that the model learns every n-gram is there, so a context that no other text has needs no weight, only what
        its masses are shares of: its count, if that is ``small`` or if an n-gram with it is ``rare`` enough to be discounted.
        """
        seen, large = self.c > 0, self.c > small
        there = seen & ~self.alone & (self.held | large)
        return seen & self.alone, there, there & (self.mine | (large & ~rare))

    def asked(self, small: int, rare: np.ndarray, sums: tuple[np.ndarray, np.ndarray], names: np.ndarray) -> tuple[np.ndarray, ...]:
        """What the buckets are sent: names, counts, which need an answer, and the sums."""
        _, there, needs = self.contexts(small, rare)
        at = np.flatnonzero(there & (needs | (sums[1] > 0)))
        return names[at], self.c[at], needs[at], sums[0][at], sums[1][at]

    def weights(self, small: int, rare: np.ndarray, sums: tuple[np.ndarray, np.ndarray], answer: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """(log a, what masses are shares of)"""
        here, _, needs = self.contexts(small, rare)
        loga, of = np.zeros(len(self.c)), np.maximum(self.c, 1)
        loga[here], plus = weight(sums[0][here], sums[1][here], self.c[here])
        of[here] += plus
        if answer is not None:
            loga[needs] = answer[0]
            of[needs] += answer[1]
        return loga, of


class _Scored:
    """Probabilities of a chunk's distinct n-grams, as far as the answers go."""

    def __init__(self, chunk: Chunk, answers: dict, model: Model, order: int = 3):
        self.model, self.chunk, self.g = model, chunk, _Grams(chunk, order)
        g, n = self.g, len(chunk.vocab)
        self.one = _Counts(np.ones(n, dtype=bool), chunk.asks(np.arange(len(chunk.code)), chunk.code, n), answers[1])
        self.p1 = np.where(self.one.c > 0, model.mass(1, self.one.c) * (model.share / max(model.n, 1)), model.unknown)
        self.two = _Counts(~(self.one.alone[g.two_first] | self.one.alone[g.two_last]), g.two_asks, answers.get(2))
        if order == 3:
            self.ask3 = ~(self.two.alone[g.three_ctx] | self.two.alone[g.three_suf])

    def sums(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(mass, lower mass) by context of the n-grams that this chunk owns."""
        g = self.g
        if order == 2:
            mine, ctx, lower, c, n = self.two.owns, g.two_first, self.p1[g.two_last], self.two.c, len(self.p1)
        else:
            mine, ctx, lower, c, n = self.three.owns, g.three_ctx, 10.0 ** self.log2[g.three_suf], self.three.c, len(g.two)
        at = np.flatnonzero(mine)
        return np.bincount(ctx[at], weights=self.model.mass(order, c[at]), minlength=n), np.bincount(ctx[at], weights=lower[at], minlength=n)

    def rare(self, order: int) -> np.ndarray:
        """Contexts with an n-gram in this chunk whose count is discounted."""
        c, ctx, n = (self.two.c, self.g.two_first, len(self.p1)) if order == 2 else (self.three.c, self.g.three_ctx, len(self.g.two))
        out = np.zeros(n, dtype=bool)
        out[ctx[(c > 0) & (c <= self.model.small(order))]] = True
        return out

    def up_to_two(self, answers: dict) -> None:
        """Counts of trigrams, and log p(w | v) of the bigrams."""
        g = self.g
        self.three = _Counts(self.ask3, g.three_asks, answers.get(3))
        loga, of = self.one.weights(self.model.small(2), self.rare(2), self.sums(2), answers.get(11))
        ctx, seen = g.two_first, self.two.c > 0
        self.log2 = loga[ctx] + np.log10(self.p1)[g.two_last]
        self.log2[seen] = np.log10(self.model.mass(2, self.two.c[seen]) / of[ctx[seen]])

    def up_to_three(self, answers: dict) -> None:
        # A bigram that ends a document is no context: its weight, of no mass, is never used.
        loga, of = self.two.weights(self.model.small(3), self.rare(3), self.sums(3), answers.get(12))
        ctx, seen = self.g.three_ctx, self.three.c > 0
        self.log3 = loga[ctx] + self.log2[self.g.three_suf]
        self.log3[seen] = np.log10(self.model.mass(3, self.three.c[seen]) / of[ctx[seen]])


def whole_chunk(each):
    return lambda number, held, answers: each(number, Chunk.of(*held), answers)


def score(docs: DataFrame, base: str, tokens: int = TOKENS, keys: int = KEYS, size: int = SLICE) -> tuple[DataFrame, Model]:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability) of ``docs`` (doc_id long, train boolean, text).

    What the model learns comes from the rows marked ``train``; its tables are written below ``base``.
    """
    spark = docs.sparkSession
    with at_work(spark):
        chunks = stored(_segments(docs, f"{base}/files", tokens, size), f"{base}/chunks")
        n_chunks, most = chunks.agg(F.count(F.lit(1)), F.sum(F.col("tally")[0] + F.col("tally")[1])).first()
        chunks, log2 = chunks.withColumn("tally", F.lit(None).cast("array<long>")), log2_buckets(most or 0, keys)
        empty, names = [0] * (K + 4), []

        def tallied(table: DataFrame, kind: int) -> list[int]:
            rows = table.where(F.col("tally").isNotNull() & (F.col("kind") == kind)).select(F.posexplode("tally")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
            out = list(empty)
            for r in rows:
                out[r["pos"]] = r["n"]
            return out

        def words(number: int, chunk: Chunk, _: dict) -> Iterator[pa.RecordBatch]:
            yield from requests(1, number, log2, chunk.vocab, chunk.asks(np.arange(len(chunk.code)), chunk.code, len(chunk.vocab)))

        def bigrams(number: int, chunk: Chunk, answers: dict) -> Iterator[pa.RecordBatch]:
            g, alone = _Grams(chunk, 2), answers[1][1] & ALONE > 0
            asked = ~(alone[g.two_first] | alone[g.two_last])
            yield from requests(2, number, log2, g.two[asked], g.two_asks[asked])
            yield row_of(0, -1 - number, 2, None, _tally((g.two_asks[~asked] >> np.uint64(1)).astype(np.int64)))

        def exchange(tables: list[DataFrame], name: str, each) -> DataFrame:
            names.append(name)
            return exchanged(over_chunks(tables, n_chunks, BLOBS, whole_chunk(each)), f"{base}/{name}", 1 << log2, n_chunks, _REDUCERS)

        one = exchange([chunks], "counts-1", words)
        two = exchange([chunks, one], "counts-2", bigrams)
        tallies = [tallied(one, 1), tallied(two, 2), empty]
        so_far = Model.of(tallies)

        def words_as_contexts(number: int, chunk: Chunk, answers: dict) -> Iterator[pa.RecordBatch]:
            s = _Scored(chunk, answers, so_far, 2)
            yield from requests(11, number, log2, *s.one.asked(so_far.small(2), s.rare(2), s.sums(2), chunk.vocab), packed=_sums_packed)

        def trigrams(number: int, chunk: Chunk, answers: dict) -> Iterator[pa.RecordBatch]:
            s = _Scored(chunk, answers, so_far)
            yield from requests(3, number, log2, s.g.three[s.ask3], s.g.three_asks[s.ask3])
            yield row_of(0, -1 - number, 3, None, _tally((s.g.three_asks[~s.ask3] >> np.uint64(1)).astype(np.int64)))

        three = exchange([chunks, one, two], "counts-3", trigrams)
        first = exchange([chunks, one, two], "weights-2", words_as_contexts)
        tallies[2] = tallied(three, 3)
        model = Model.of(tallies)

        def contexts(number: int, chunk: Chunk, answers: dict) -> Iterator[pa.RecordBatch]:
            s = _Scored(chunk, answers, model)
            s.up_to_two(answers)
            yield from requests(12, number, log2, *s.two.asked(model.small(3), s.rare(3), s.sums(3), s.g.two), packed=_sums_packed)

        second = exchange([chunks, one, two, three, first], "weights-3", contexts)
        whole = model.n + 0.5 * (model.v + 1)

        def scored(number: int, chunk: Chunk, answers: dict) -> Iterator[pa.RecordBatch]:
            s = _Scored(chunk, answers, model)
            s.up_to_two(answers)
            s.up_to_three(answers)
            at = np.flatnonzero(chunk.counts)
            code, owner, three = chunk.code[at], chunk.owner[at], s.g.three_at[at]
            p = s.log2[s.g.two_at[at]]
            p[three >= 0] = s.log3[three[three >= 0]]
            base_p = np.log10((s.one.c + 0.5) / whole)
            n = len(chunk.size)
            sums = [np.bincount(owner, weights=w, minlength=n) for w in (base_p[code], p)]
            tokens, known = np.bincount(owner, minlength=n), np.bincount(owner, weights=s.one.c[code] > 0, minlength=n).astype(np.int64)
            columns = [pa.array(chunk.row.astype(np.int64)), pa.array(chunk.doc_id.astype(np.int64), mask=~chunk.named), *(pa.array(x) for x in (chunk.train, tokens, known, *sums))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

        schema = "row long, doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"
        parts = over_chunks([chunks, one, two, three, first, second], n_chunks, schema, whole_chunk(scored))
        # A text in several chunks has a part in each.
        sums = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("train").alias("train"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
        out = stored(sums.drop("row").withColumn("train_tokens", F.lit(model.n).cast("long")), f"{base}/scores")
    dropped(spark, f"{base}/files", f"{base}/chunks", *(f"{base}/{t}" for t in names), *(f"{base}/{t}-files" for t in names))
    return out, model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = clean_select(documents(spark, sf_dir), doc_id="long", text="string").withColumn("train", remainder(F.col("doc_id"), 5) != 1)
    found, _ = score(docs, shared_dir(spark, "katz"))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
