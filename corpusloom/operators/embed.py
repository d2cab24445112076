"""Embedding: batches of texts through an injected function, with retries and shrinking, on the executors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts and characters in a request, tries after the first, seconds between them, what an over-long text keeps, and its least length. Fixed values.
MOST_TEXTS, MOST_CHARS, RETRIES, PAUSE, KEEP, LEAST = 32, 40_000, 2, 2.0, 0.75, 256


class TooLong(ValueError):
    """What an embedding function raises for a text beyond its context."""


class Transient(RuntimeError):
    """What it raises for a failure that may pass; anything else is final."""


def batches(sizes: list[int], most_texts: int = MOST_TEXTS, most_chars: int = MOST_CHARS) -> list[tuple[int, int]]:
    """Runs of neighbours within both bounds; a text over the second one is alone."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and (i - begin >= most_texts or total + n > most_chars):
            out.append((begin, i))
            begin, total = i, 0
        total += n
    return out + ([(begin, len(sizes))] if begin < len(sizes) else [])


def batch_numbers(sizes: Column, most_texts: int = MOST_TEXTS, most_chars: int = MOST_CHARS) -> Column:
    """The same bounds over an array of sizes: which batch each text is in, from 0."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("texts"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("out"))

    def step(at: Column, n: Column) -> Column:
        full = (at["texts"] > 0) & ((at["texts"] >= most_texts) | (at["chars"] + n > most_chars))
        batch = at["batch"] + full.cast("int")
        return F.struct(batch.alias("batch"), F.when(full, 1).otherwise(at["texts"] + 1).alias("texts"), F.when(full, n).otherwise(at["chars"] + n).alias("chars"), F.concat(at["out"], F.array(batch)).alias("out"))

    return F.aggregate(sizes, start, step, lambda at: at["out"])


def _tried(embed: Callable[[list[str]], list], texts: list[str], pause: float) -> list:
    for k in range(RETRIES + 1):
        try:
            return embed(texts)
        except Transient:
            if k == RETRIES:
                raise
            time.sleep(pause)
    raise AssertionError


def embedded_texts(embed: Callable[[list[str]], list], texts: list[str], dim: int, pause: float = PAUSE) -> tuple[list, list[int]]:
    """(vectors, characters kept): over-long texts are sent alone and shortened until accepted."""
    vectors, kept = [], []
    for a, b in batches([len(t) for t in texts]):
        part = texts[a:b]
        try:
            got, sizes = _tried(embed, part, pause), [len(t) for t in part]
        except TooLong:
            got, sizes = [], []
            for t in part:
                n = len(t)
                while True:
                    try:
                        got += _tried(embed, [t[:n]], pause)
                        break
                    except TooLong:
                        n = int(n * KEEP)
                        if n < LEAST:
                            raise
                sizes.append(n)
        if len(got) != len(part) or any(len(v) != dim for v in got):
            raise ValueError(f"{len(part)} texts gave {len(got)} vectors, or not of {dim} numbers")
        vectors += got
        kept += sizes
    return vectors, kept


def with_embedding(rows: DataFrame, text: str, embed: Callable[[list[str]], list], dim: int, prefix: str = "", pause: float = PAUSE) -> DataFrame:
    """``rows`` with embedding and kept_chars of prefix plus ``text``."""
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", embedding array<float>, kept_chars int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            vectors, kept = embedded_texts(embed, [prefix + (t or "") for t in pdf[text]], dim, pause)
            yield pdf.assign(embedding=vectors, kept_chars=kept)

    return rows.mapInPandas(run, fields)
