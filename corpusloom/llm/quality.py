"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates.

A text is cut into words (runs of letters, digits and non-ASCII bytes) and marks (runs of other visible characters).
Features are hashed into ``2 ** BITS`` weights: unigrams and bigrams of the lower-cased tokens, and n-grams of one to three
token shapes (capitals, capitalised, lower case, digits, the marks themselves, "same as before"), which carry over to words never
seen. A family's features have the value count / tokens, so a score is a sparse dot product over the tokens, without counting them; a text
longer than ``CHUNK`` is scored in slices, each with the three tokens before it. Only text is a feature: no label, language, source or id.

Training takes at most ``SAMPLE`` labelled rows, those of smallest id hash; that is the only bound, and it fits the model
alone. Their features are made on the executors, sorted by id hash and epoch, and one task runs the sequential FTRL-proximal
updates over the stream. The model is one array of fixed size, sent to all tasks.

Defined results: null and empty texts have no features and score by the bias; without any label the score is 0.5 and
nothing is rejected; ids with several labels count each; a null label is no label; extra columns pass through in ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, Words, as_bytes, chunks, clean_select, documents, mixed, remainder, slices, small_batches, tidy
from corpusloom.llm.rowwise import kept_rows, with_computed

BITS = 18
#: Most labelled rows that the model is fitted on.
SAMPLE = 12_000
EPOCHS = 3
#: FTRL-proximal: step size, smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-5, 1e-4
#: Scores below this reject a document.
THRESHOLD = 0.3
#: A family's counts sum to this.
SCALE = 8.0
CHUNK = 1 << 20

# Kinds of bytes: 0 blank, 1 word, 2 mark.
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E), 0]] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_UPPER = np.zeros(256, dtype=np.int32)
_UPPER[0x41:0x5B] = 1
_LOW = np.zeros(256, dtype=np.int32)
_LOW[0x61:0x7B] = 1
_DIGIT = np.zeros(256, dtype=np.int32)
_DIGIT[0x30:0x3A] = 1


class _Tokens(Words):
    """Words and marks rather than words between separators."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" " + b" ".join(texts) + b" " * 9, dtype=np.uint8)
        kind = _KIND[raw]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        spans = kind[edge] != 0
        self.starts = edge[spans]
        self.ends = np.append(edge[1:], len(raw))[spans]
        self.kind = kind[self.starts]
        self.raw, self.buf = raw, LOWER[raw]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.first = np.searchsorted(self.starts, np.concatenate(([1], 1 + np.cumsum(lengths))))


def _count(table: np.ndarray, tokens: _Tokens) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(table[tokens.raw], dtype=np.int32)))
    return total[tokens.ends] - total[tokens.starts]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, first): text i's features are first[i]:first[i + 1]; a feature that occurs twice is there twice."""
    t = _Tokens(texts)
    if not len(t.starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), np.zeros(len(texts) + 1, dtype=np.int64)
    n = np.diff(t.first)
    owner = np.repeat(np.arange(len(texts)), n)
    h = t.hashes()
    upper, low, digit, size = _count(_UPPER, t), _count(_LOW, t), _count(_DIGIT, t), t.ends - t.starts
    shape = np.where(digit > 0, 1, np.where((upper > 1) & (low == 0), 2, np.where(upper > 1, 3, np.where(_UPPER[t.raw[t.starts]] > 0, 4, 5)))).astype(np.uint64)
    shape = shape * np.uint64(4) + np.where(size == 1, 0, np.where(size < 14, 1, 2)).astype(np.uint64)
    shape = np.where(t.kind == 2, h, shape)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    shape = mixed(np.where(same, np.uint64(99), shape) + np.uint64(1))

    def pairs(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        """a with the token before it; the first token of a text with none."""
        before = np.concatenate((np.zeros(1, dtype=np.uint64), b[:-1]))
        before[t.first[:-1][n > 0]] = 0
        return mixed(a * np.uint64(3) + before * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))

    two = pairs(shape, shape, 12)
    families = [mixed(h + np.uint64(10)), pairs(h, h, 11), mixed(shape + np.uint64(13)), two, pairs(shape, two, 14)]
    slots = np.stack([(f >> np.uint64(64 - BITS)).astype(np.int64) for f in families], axis=1).reshape(-1)
    values = np.repeat((SCALE / n[owner]).astype(np.float32), len(families))
    return slots, values, t.first * len(families)


def _sums(weights: np.ndarray, slots: np.ndarray, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(weights[slots] * values, dtype=np.float64)))
    return total[first[1:]] - total[first[:-1]]


def training_rows(docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """epoch, at (id hash), label, slots, values: the features of at most ``sample`` labelled rows, once for each epoch."""
    known = clean_select(labels, doc_id="long", quality="int").where("quality is not null and doc_id is not null").where(learn(F.col("doc_id")))
    known = known.groupBy("doc_id", "quality").count().select("doc_id", "quality", F.xxhash64("doc_id", F.lit(17)).alias("at"))
    total = known.count()
    part = min(1.0, sample / max(total, 1))
    chosen = known.where(F.shiftrightunsigned("at", 11) <= int(part * 0.97 * (1 << 53)) if total > sample else F.lit(True)).orderBy("at").limit(sample)
    small_batches(docs.sparkSession)
    rows = clean_select(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").select("at", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for begin, end in chunks(texts, CHUNK):
                slots, values, first = features(texts[begin:end])
                packed = [[], []]
                for i in range(end - begin):
                    mine = slice(first[i], first[i + 1])
                    which, back = np.unique(slots[mine], return_inverse=True)
                    packed[0].append(which.astype(np.int32).tobytes())
                    packed[1].append(np.bincount(back, weights=values[mine], minlength=len(which)).astype(np.float32).tobytes())
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary())], names=["at", "label", "slots", "values"])

    made = rows.mapInArrow(tidy(run), "at long, label int, slots binary, values binary")
    return made.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def fit(docs: DataFrame, labels: DataFrame, learn=None, sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias last. ``learn``: of an id column, whether its labels may be used."""
    rows = training_rows(docs, labels, learn or (lambda _: F.lit(True)), sample, epochs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << BITS) + 1
        z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
        for batch in batches:
            for label, slots, values in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("label", "slots", "values")), strict=True):
                at = np.append(np.frombuffer(slots, dtype=np.int32), size - 1)
                x = np.append(np.frombuffer(values, dtype=np.float32), np.float32(1))
                zi, ni = z[at], n[at]
                wi = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
                g = (1 / (1 + np.exp(-np.clip(wi @ x, -35, 35))) - label) * x
                step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
                z[at] = zi + g - step * wi
                n[at] = ni + g * g
        w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    model = rows.repartition(1).sortWithinPartitions("epoch", "at", "label", F.crc32("values")).mapInArrow(tidy(run), "weights binary").first()
    return np.frombuffer(model["weights"], dtype=np.float32) if model else np.zeros((1 << BITS) + 1, dtype=np.float32)


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The probability of each text's label 1: a sparse dot product and the logistic function."""
    long = [i for i, t in enumerate(texts) if len(t) > CHUNK]
    sums = _sums(weights, *features([b"" if len(t) > CHUNK else t for t in texts]))
    sums[long] = [_long_sum(texts[i], weights) for i in long]
    return 1 / (1 + np.exp(-np.clip(sums + float(weights[-1]), -35, 35)))


#: Tokens before a token that its features look at, and features a token.
_BEFORE, _FAMILIES = 3, 5


def _long_sum(text: bytes, weights: np.ndarray) -> float:
    """The sparse dot product of one text, slice by slice."""
    total, n, before, again = 0.0, 0, b"", 0
    for a, b in slices(text, CHUNK):
        piece = before + text[a:b]
        tokens = _Tokens([piece])
        slots, _, _ = features([piece])
        total += float(weights[slots[again * _FAMILIES :]].sum(dtype=np.float64))
        n += len(tokens.starts) - again
        if len(tokens.starts):
            again = min(_BEFORE, len(tokens.starts))
            before = tokens.raw[tokens.starts[-again] : 1 + len(piece)].tobytes()
    return SCALE * total / max(n, 1)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with score (0 to 1; higher: good quality likelier) and predicted (1 from the threshold on)."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def compute(texts: list[bytes], _: dict) -> dict:
        s = scores(texts, model.value)
        return {"score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

    return with_computed(docs, "score double, predicted int", compute, CHUNK)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier, fitted on all labels, does not reject; with their own columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return kept_rows(docs, lambda texts: (scores(texts, model.value) >= THRESHOLD).tolist(), CHUNK)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = clean_select(documents(spark, sf_dir), doc_id="long", text="string")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = fit(docs, labels, learn=lambda doc_id: remainder(doc_id, 5) != 0)
    return score(docs, weights).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
