r"""Mixing sources to target weights: budgets down a domain-language-source tree, token prefixes of seeded epochs.

The tree's nodes are few (at most ``LEAVES`` leaves, checked) and their token counts are what the driver sees. A
node's budget is shared among its children by weight; a child that cannot hold its share (its tokens times ``MAX_EPOCHS``) takes what
it can, and its siblings share the rest by weight, again and again. Only what no child can hold goes unspent
there - and since a node is never given more than its leaves hold, it has then already gone to the node's own siblings.
A weight that is not given is the node's tokens to the power ``TEMPERATURE``. Budgets are whole tokens.

Each epoch of a leaf is its documents in the order of ``place``, a hash of (seed, epoch, doc_id, text). A leaf of b tokens' budget and
a tokens gives b // a whole epochs and a prefix of b % a tokens of one more. The prefix needs no sort of the leaf: tokens are summed by
ranges of the hash, of about ``RANGE`` documents of the largest leaf, ranges before the one where the budget ends are taken whole,
and only that range's documents are put in order. Texts are read once: their tokens and hashes are written beside the
columns that are kept, and what follows reads these.

Defined results: tokens are words `[^\x20\x09-\x0D]+`; null texts have none; null domains, languages and sources are
leaves named ''; a leaf without tokens gives nothing; a document is in the prefix if the budget is not yet spent before it, and
``take_tokens`` is the part of it that the budget covers; repeated rows are taken one by one, ties of the hash in any order
of equal rows; other columns pass through, in ``mix`` without those named like a result; an empty table or a budget of 0 gives no rows;
more than ``LEAVES`` leaves are an error, as a tree of that size is no metadata any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import CHUNK, bounded_rows, clean_select, documents, shared_dir, stored, word_counts
from corpusloom.llm.rowwise import with_computed

LEAVES = 100_000
MAX_EPOCHS = 4
TEMPERATURE = 0.7
SEED = 20_240_601
#: Documents in a range of the hash, about.
RANGE = 4096
LEVELS = ("domain", "lang", "source")

#: Production weights of the query; what is not listed goes by its tokens.
WEIGHTS = {("crawl",): 0.4, ("curated",): 0.6, ("crawl", "en"): 0.4, ("crawl", "de"): 0.25, ("crawl", "fr"): 0.2, ("crawl", "es"): 0.15}
#: Tokens of the query's mix, of those there are.
SHARE = 0.8


def domain_of(source: Column) -> Column:
    """The sources' domains here: the one large source is a crawl."""
    return F.when(source.isNull(), "").when(source == "src0", "crawl").otherwise("curated")


def counted(docs: DataFrame, keep: list[str], path: str, domain=domain_of) -> DataFrame:
    """row (the columns kept), domain, lang, source, tokens, mark (a hash of id and text): read once, written to ``path``."""
    level = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*keep).alias("row"),
        level(domain(F.col("source").cast("string"))).alias("domain"),
        level(F.col("lang")).alias("lang"),
        level(F.col("source")).alias("source"),
        F.xxhash64("doc_id", "text").alias("mark"),
        F.col("text").cast("string").alias("text"),
    )
    return stored(with_computed(rows, "tokens long", lambda texts, _: {"tokens": word_counts(texts)}, CHUNK).drop("text"), path)


def _shared(budget: int, caps: list[int], weights: list[float]) -> list[int]:
    """``budget`` by weight, nobody above their cap; shortages go to the others by weight. Whole numbers that sum to min(budget, caps)."""
    given = [0] * len(caps)
    open_ = [i for i, (c, w) in enumerate(zip(caps, weights, strict=True)) if c > 0 and w > 0]
    left = budget
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if caps[i] <= left * (weights[i] / total)]
        if full:
            for i in full:
                given[i] = caps[i]
                left -= caps[i]
            open_ = [i for i in open_ if i not in set(full)]
            continue
        exact = {i: left * (weights[i] / total) for i in open_}
        for i in open_:
            given[i] = min(caps[i], int(exact[i]))
        rest = left - sum(given[i] for i in open_)
        for i in sorted(open_, key=lambda i: (int(exact[i]) - exact[i], i)):
            if rest <= 0:
                break
            if given[i] < caps[i]:
                given[i], rest = given[i] + 1, rest - 1
        break
    return given


def budgets(leaves: dict[tuple, int], budget: int, weights: dict[tuple, float], max_epochs: int = MAX_EPOCHS, temperature: float = TEMPERATURE) -> dict[tuple, int]:
    """Each leaf's tokens of ``budget``; ``leaves``: the tokens each has, by its path."""

    def down(path: tuple, mine: dict[tuple, int], budget: int) -> dict[tuple, int]:
        if path in mine:
            return {path: min(budget, mine[path] * max_epochs)}
        children: dict[tuple, dict[tuple, int]] = {}
        for leaf, n in sorted(mine.items()):
            children.setdefault(leaf[: len(path) + 1], {})[leaf] = n
        sums = [sum(x.values()) for x in children.values()]
        parts = _shared(budget, [n * max_epochs for n in sums], [weights.get(c, n**temperature if n else 0.0) for c, n in zip(children, sums, strict=True)])
        return {k: v for (child, own), part in zip(children.items(), parts, strict=True) for k, v in down(child, own, part).items()}

    return down((), leaves, budget) if leaves else {}


def taken(docs: DataFrame, budget: float, weights: dict[tuple, float], seed: int = SEED, max_epochs: int = MAX_EPOCHS, domain=domain_of, temperature: float = TEMPERATURE, keep: list[str] | None = None, span: int = RANGE) -> DataFrame:
    """row (a document's columns, or those to ``keep``), leaf (its path), epoch, place, tokens, take_tokens: a row for each time a document is taken.

    ``budget``: tokens, or if 1 or less a share of those there are.
    """
    spark = docs.sparkSession
    rows = counted(docs, keep or docs.columns, f"{shared_dir(spark, 'mix')}/rows", domain)
    sums = bounded_rows(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("docs")), LEAVES, "leaves of the tree")
    have = {(r["domain"], r["lang"], r["source"]): r["n"] for r in sums}
    whole = int(budget * sum(have.values())) if budget <= 1 else int(budget)
    plan = budgets(have, whole, weights, max_epochs, temperature)
    listed = [(*leaf, b // have[leaf], b % have[leaf]) for leaf, b in sorted(plan.items()) if have[leaf]]
    leaves = F.broadcast(spark.createDataFrame(listed, "domain string, lang string, source string, epochs long, part long"))
    bits = (max((r["docs"] for r in sums), default=0) // span).bit_length()
    place = lambda epoch: F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, "mark"), 1)
    rows = rows.join(leaves, list(LEVELS)).withColumn("at", place(F.col("epochs"))).withColumn("span", F.shiftright("at", 63 - bits) if bits else F.lit(0).cast("long"))
    by = Window.partitionBy(*LEVELS).orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.groupBy(*LEVELS, "part", "span").agg(F.sum("tokens").alias("n")).withColumn("upto", F.sum("n").over(by))
    # The range of the hash in which the budget ends: the first whose running sum reaches it.
    cuts = spans.where("part > 0 AND upto >= part").groupBy(*LEVELS).agg(F.min("span").alias("cut"), F.min_by(F.col("upto") - F.col("n"), "span").alias("before"))
    rows = rows.join(F.broadcast(cuts), list(LEVELS), "left").withColumn("cut", F.coalesce("cut", F.lit(-1)))
    whole_ones = rows.where(F.col("span") != F.col("cut")).withColumn("last", F.when(F.col("span") < F.col("cut"), F.col("tokens")))
    order = Window.partitionBy(*LEVELS).orderBy("at", "mark").rowsBetween(Window.unboundedPreceding, -1)
    ending = rows.where(F.col("span") == F.col("cut")).withColumn("spent", F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    ending = ending.withColumn("last", F.when(F.col("spent") < F.col("part"), F.least("tokens", F.col("part") - F.col("spent")))).drop("spent")
    found = whole_ones.unionByName(ending).withColumn("times", F.col("epochs") + F.col("last").isNotNull().cast("long")).where("times > 0")
    found = found.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return found.select("row", F.struct(*LEVELS).alias("leaf"), "epoch", place(F.col("epoch")).alias("place"), "tokens", F.when(F.col("epoch") < F.col("epochs"), F.col("tokens")).otherwise(F.col("last")).alias("take_tokens"))


ADDED = ("leaf", "epoch", "place", "tokens", "take_tokens")


def mix(docs: DataFrame, budget: float, weights: dict[tuple, float], **options) -> DataFrame:
    """``taken`` with the documents' columns beside the added ones."""
    columns = [c for c in options.pop("keep", None) or docs.columns if c not in ADDED]
    return taken(docs, budget, weights, keep=columns, **options).select("row.*", *ADDED)


def mixed_documents(docs: DataFrame, budget: float, weights: dict[tuple, float], **options) -> DataFrame:
    """The documents as often as the mix takes them, whole and with their own columns."""
    return taken(docs, budget, weights, **options).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = clean_select(documents(spark, sf_dir), doc_id="long", text="string", lang="string", source="string")
    return mix(docs, SHARE, WEIGHTS, keep=["doc_id", "lang", "source"]).select("doc_id", "leaf.domain", "lang", "source", "epoch", "place", "tokens", "take_tokens")
