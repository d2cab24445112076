"""Each operator against a brute-force version, on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import chat_format, common, decontaminate, katz_lm, line_dedup, media_columns, ngram_jaccard, quality, shard_packing, source_mix, token_parquet
from corpusloom.llm.components import connected_components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def split_words(text, pattern=rb"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").encode().translate(LOWER))


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


# --- shared ---------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_are_found_as_by_the_pattern(texts):
    raw = [t.encode("utf-8", "ignore") for t in texts]
    w = common.Words(raw)
    found = [w.buf[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
    assert [found[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)] == [re.findall(rb"[^\x20\x09-\x0D]+", t.translate(LOWER)) for t in raw]
    assert len(set(w.hashes().tolist())) == len(set(found)) == len(set(w.hashes(second=True).tolist()))


def test_hash_table_numbers_keys_in_order():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    table = common.HashTable(14)
    table.add(keys[:2000], keys[:2000])
    table.add(keys[2000:], keys[2000:])
    assert (table.find(keys, keys) == np.arange(len(keys))).all()
    assert (table.find(keys, keys + np.uint64(1)) == -1).all()


def test_components(spark, tmp_path):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000, 1000 + i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(60)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}/cc").collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


# --- 1 --------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(token_parquet.definition_of())


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_tokens_round_trip(spark, corpus, tokenizer, tmp_path, encoding):
    rows, df = corpus
    out = f"file://{tmp_path}/tokens"
    manifest = token_parquet.write_tokens(df, out, token_parquet.definition_of(), meta=("lang",), encoding=encoding)
    got = sorted(token_parquet.digests(manifest, ("lang",)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in rows)
    text, start = {r[0]: r[1] for r in rows}, 0
    for r in got:
        ids = [*tokenizer.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    lengths = token_parquet.read_tokens(spark, out, ("doc_id", "n_tokens")).collect()
    assert sum(r["n_tokens"] for r in lengths) == start
    path = manifest.first()["path"].removeprefix("file://")
    meta = pq.ParquetFile(path).metadata
    column = meta.row_group(0).column(meta.num_columns - 1)
    assert column.has_offset_index and ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAzZ é́̌ JjI 's,.!<|>12\n\t  ß"), st.characters(codec="utf-8")), max_size=30), min_size=1, max_size=5))
def test_word_encoder_gives_the_ids_of_whole_texts(tokenizer_text, texts):
    encoder, whole = tokenizer_text
    ids, lengths = encoder.encode([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]


@pytest.fixture(scope="module")
def tokenizer_text(tokenizer):
    return token_parquet.WordEncoder(token_parquet.definition_of(), 2, most=200), tokenizer


def test_words_of_equal_hash_are_told_apart(tokenizer, monkeypatch):
    monkeypatch.setattr(token_parquet.Words, "hashes", lambda self, second=False: (self.ends - self.starts).astype(np.uint64) << np.uint64(60))
    encoder = token_parquet.WordEncoder(token_parquet.definition_of(), 2)
    texts = ["one two", "six two one", "", "abcdefghij abcdefghik", "abcdefghij", "a" * 100 + " " + "a" * 99 + "b"]
    for _ in range(2):
        ids, lengths = encoder.encode([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_encode_whole_texts(spark, corpus, tmp_path, name):
    from tokenizers import Tokenizer

    rows, df = corpus
    definition = token_parquet.definition_of(name)
    assert token_parquet.cuts_words(token_parquet.definition_of()) and not token_parquet.cuts_words(definition)
    whole, text = Tokenizer.from_str(definition), {r[0]: r[1] for r in rows}
    manifest = token_parquet.write_tokens(df, f"file://{tmp_path}/tokens", definition)
    for r in token_parquet.digests(manifest).collect():
        ids = [*whole.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_tokens_of_nothing(nothing):
    assert token_parquet.encoded(nothing).count() == 0


# --- 2 --------------------------------------------------------------------------------------
def test_budgets_go_to_siblings_first():
    leaves = {("a", "en", "s1"): 10, ("a", "en", "s2"): 1000, ("a", "de", "s1"): 1000, ("b", "en", "s1"): 1000}
    w = {("a",): 0.5, ("b",): 0.5, ("a", "en"): 0.5, ("a", "de"): 0.5, ("a", "en", "s1"): 0.5, ("a", "en", "s2"): 0.5, ("a", "de", "s1"): 1, ("b", "en"): 1, ("b", "en", "s1"): 1}
    got = source_mix.budgets(leaves, 800, w, max_epochs=2)
    assert got == {("a", "en", "s1"): 20, ("a", "en", "s2"): 180, ("a", "de", "s1"): 200, ("b", "en", "s1"): 400}
    got = source_mix.budgets(leaves, 10_000, w, max_epochs=1)  # more than there is
    assert got == leaves
    assert sum(source_mix.budgets(leaves, 777, {}, 3).values()) == 777


def brute_budgets(leaves, budget, weights, epochs, path=()):
    """Water-filling by a slow rise of the level: what each child gets of the node's budget, in real numbers."""
    if path in leaves:
        return {path: min(budget, leaves[path] * epochs)}
    children = sorted({leaf[: len(path) + 1] for leaf in leaves if leaf[: len(path)] == path})
    sums = {c: sum(n for leaf, n in leaves.items() if leaf[: len(c)] == c) for c in children}
    w = {c: weights.get(c, sums[c] ** source_mix.TEMPERATURE if sums[c] else 0.0) for c in children}
    low, high = 0.0, max((sums[c] * epochs / w[c] for c in children if w[c]), default=0.0)
    for _ in range(200):  # the level at which the children's shares, none above what it has, make the budget
        level = (low + high) / 2
        if sum(min(sums[c] * epochs, level * w[c]) for c in children) < budget:
            low = level
        else:
            high = level
    return {k: v for c in children for k, v in brute_budgets(leaves, min(sums[c] * epochs, high * w[c]), weights, epochs, c).items()}


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), st.sampled_from("123")), st.integers(0, 500), min_size=1), st.integers(0, 4000), st.integers(1, 3))
def test_budgets_are_water_filled(leaves, budget, epochs):
    weights = {("a",): 0.3, ("b",): 0.7, ("a", "x"): 2.0, ("a", "y"): 1.0}
    got, want = source_mix.budgets(leaves, budget, weights, epochs), brute_budgets(leaves, min(budget, sum(leaves.values()) * epochs), weights, epochs)
    assert sum(got.values()) == min(budget, sum(leaves.values()) * epochs) or any(n == 0 for n in leaves.values())
    assert all(abs(got[k] - want[k]) <= 4 for k in got)  # whole tokens on three levels


@pytest.mark.parametrize("span", [source_mix.RANGE, 2])
def test_mix_takes_prefixes_of_seeded_epochs(spark, corpus, span):
    """Against a plain sort of every epoch: the very documents, and how much of the last one."""
    rows, df = corpus
    df = df.withColumn("epoch", F.lit("mine")).withColumn("domain", F.lit("mine")).withColumn("tokens", F.lit("mine"))
    share, weights = 0.6, {("crawl",): 0.7, ("curated",): 0.3}
    got = source_mix.mix(df, share, weights, max_epochs=3, span=span)
    have, mine = Counter(), defaultdict(list)
    marks = {(r["doc_id"], r["text"]): [r[f"e{e}"] for e in range(3)] for r in df.select("doc_id", "text", *(F.shiftrightunsigned(F.xxhash64(F.lit(source_mix.SEED), F.lit(e).cast("long"), F.xxhash64("doc_id", "text")), 1).alias(f"e{e}") for e in range(3))).collect()}
    for r in rows:
        leaf = ("crawl" if r[3] == "src0" else "curated", r[2] or "", r[3])
        have[leaf] += len(split_words(r[1]))
        mine[leaf].append((r[0], r[1], len(split_words(r[1]))))
    want = []
    for leaf, budget in source_mix.budgets(dict(have), int(share * sum(have.values())), weights, 3).items():
        for epoch in range(3):
            for i, t, n in sorted(mine[leaf], key=lambda d: marks[d[0], d[1]][epoch]):
                if budget > 0 or (n == 0 and epoch < budget):
                    want.append((*leaf, epoch, i, n, min(n, budget), marks[i, t][epoch]))
                    budget -= min(n, budget)
    found = [(r["leaf"]["domain"], r["leaf"]["lang"], r["leaf"]["source"], r["epoch"], r["doc_id"], r["tokens"], r["take_tokens"], r["place"]) for r in got.collect()]
    some = lambda x: sorted(r for r in x if r[5])  # noqa: E731  documents without tokens come with whole epochs
    assert some(found) == some(want)
    assert got.columns == ["doc_id", "text", "lang", "source", "extra", "domain", "leaf", "epoch", "place", "tokens", "take_tokens"]
    whole = source_mix.mixed_documents(df, share, weights, max_epochs=3, span=span)
    assert whole.columns == df.columns and whole.where("epoch <> 'mine' OR tokens <> 'mine'").count() == 0 and whole.count() == len(found)
    again = source_mix.mix(df.repartition(7), share, weights, max_epochs=3, span=span)
    assert again.exceptAll(got).count() == 0


def test_mix_of_nothing(nothing):
    assert source_mix.mix(nothing, 0.5, {}).count() == 0


# --- 3 --------------------------------------------------------------------------------------
def brute_links(rows):
    sets = []
    for r in rows:
        w = split_words(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    n, root, links = len(rows), list(range(len(rows))), Counter()
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
    least = defaultdict(lambda: math.inf)
    for i, r in enumerate(rows):
        least[root[i]] = min(least[root[i]], r[0])
    return sorted((r[0], len(sets[i]), least[root[i]], links[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block, size, keys", [(ngram_jaccard.BLOCK, ngram_jaccard.CHUNK, ngram_jaccard.KEYS), (300, 2000, 400)])
def test_jaccard_links(corpus, block, size, keys):
    """In one chunk, bucket and block, and in many."""
    rows, df = corpus
    got = ngram_jaccard.link(df, block=block, size=size, keys=keys)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "n_links").collect())) == brute_links(rows)


def test_jaccard_on_a_chain_and_shared_passages(spark):
    rng = random.Random(9)
    rows, base = [], [f"a{i}" for i in range(60)]
    for k in range(25):  # each is near the one before, the ends are far apart
        rows.append((k, " ".join(base[k:] + [f"b{i}" for i in range(k)])))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(100 + k, " ".join(f"q{rng.randrange(10**9)}" for _ in range(40)) + " " + passage) for k in range(40)]
    got = ngram_jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), block=400)
    assert sorted(map(tuple, got.collect())) == brute_links(rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), max_size=12), min_size=1, max_size=40), st.integers(1, 5), st.sampled_from([None, 3]), st.sampled_from([1, 2, 16]))
def test_blocked_products(sets, strip, split, few):
    """Links and reach of a block, or across two, as by comparing every pair; columns of few rows and of many."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ngram_jaccard, "STRIP", strip)
        m.setattr(ngram_jaccard, "TILE", 7)
        m.setattr(ngram_jaccard, "FEW", few)
        split = min(split, len(sets)) if split else None
        weights = np.arange(1, len(sets) + 1).astype(float)
        sizes = np.array([len(x) for x in sets])
        links, parent = ngram_jaccard.linked_rows(sizes, sizes, np.array([h for x in sets for h in sorted(x)], dtype=np.uint64), split, weights)
    want, root = np.zeros(len(sets)), list(range(len(sets)))
    for j in range(len(sets)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]) and (split is None or i < split <= j):
                want[i] += weights[j]
                want[j] += weights[i]
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    some = sizes > 0
    assert links[some].tolist() == want[some].tolist()
    assert [parent[i] == parent[j] for i in np.flatnonzero(some) for j in np.flatnonzero(some)] == [root[i] == root[j] for i in np.flatnonzero(some) for j in np.flatnonzero(some)]


def test_jaccard_keeps_one_of_each(spark, corpus, nothing):
    rows, df = corpus
    kept = sorted(r["doc_id"] for r in ngram_jaccard.first_of_each(df).select("doc_id").collect())
    assert kept == sorted({r[0] for r in brute_links(rows) if r[0] == r[2]})
    assert ngram_jaccard.link(nothing).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted(((r["component_id"], r["n_links"]) for r in ngram_jaccard.link(odd).collect()), key=str) == [(3, 2), (3, 2), (3, 2), (None, 0)]


# --- 4 --------------------------------------------------------------------------------------
def test_quality_learns_shapes(spark, nothing):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.8
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 60))]
        rows.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((i, int(good)))
    rows += [(1000, None), (1001, "")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(1000, None)], "doc_id long, quality int")
    weights = quality.fit(docs, known, learn=lambda i: common.remainder(i, 5) != 0)
    assert np.array_equal(weights, quality.fit(docs.repartition(5), known, learn=lambda i: common.remainder(i, 5) != 0))
    got = {r["doc_id"]: r for r in quality.score(docs, weights).collect()}
    held = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == q for i, q in held) / len(held) > 0.97
    assert 0 <= got[1000]["score"] == got[1001]["score"] <= 1
    assert quality.kept(docs, known.where("false")).count() == len(rows)  # without labels nothing is rejected
    assert quality.kept(nothing, known).columns == nothing.columns


def test_quality_updates_as_written(spark):
    """The weights of a plain follow-the-regularised-leader loop over dictionaries, in the order of id hash and epoch; ties, clashing names, nulls."""
    rng = random.Random(31)
    rows = [(i, " ".join(rng.choice(["good", "bad", "Fine!", "NO", "7", "so-so"]) for _ in range(rng.randrange(0, 12))), "x", "y") for i in range(60)]
    rows += [(60, None, "x", "y"), (3, rows[3][1], "x", "y")]
    labels = [(i, i % 2) for i in range(61)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, quality string")
    got = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    at = {r["doc_id"]: r["at"] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("at")).collect()}
    z, n, size = defaultdict(float), defaultdict(float), len(got)
    weight = lambda k: 0.0 if abs(z[k]) <= quality.L1 else (math.copysign(quality.L1, z[k]) - z[k]) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)
    for _ in range(quality.EPOCHS):
        for i, text, *_ in sorted(rows, key=lambda r: at[r[0]]):
            slots, values, _ = quality.features([(text or "").encode()])
            x = Counter({size - 1: 1.0})
            for k, v in zip(slots.tolist(), values.tolist(), strict=True):
                x[k] += v
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - i % 2) * v
                step = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA
                z[k] += g - step * w[k]
                n[k] += g * g
    want = np.zeros(size)
    for k in list(z):
        want[k] = weight(k)
    assert np.allclose(got, want, atol=1e-4) and np.abs(want).max() > 0.01
    scored = quality.score(docs, got)
    assert scored.columns == ["doc_id", "text", "quality", "score", "predicted"] and scored.where("score BETWEEN 0 AND 1").count() == len(rows)


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="aB7 .,!\n", max_size=400), st.integers(5, 60))
def test_quality_of_long_texts_in_slices(text, chunk):
    weights = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    whole = quality.scores([text.encode()], weights)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "CHUNK", chunk)
        assert np.allclose(quality.scores([text.encode(), b"a b"], weights)[0], whole[0], atol=1e-5)


# --- 5 --------------------------------------------------------------------------------------
class BruteKatz:
    """Katz from plain counts of the texts: probabilities by the recursion over dictionaries."""

    def __init__(self, texts):
        seqs = [[b"\n", *split_words(t), b"\n"] for t in texts]
        self.counts = [Counter(w for s in seqs for w in s[1:]), *(Counter(g for s in seqs for g in zip(*(s[i:] for i in range(k)), strict=False)) for k in (2, 3))]
        self.counts[0] = Counter({(w,): c for w, c in self.counts[0].items()})
        self.n, self.v = sum(self.counts[0].values()), len(self.counts[0])
        self.d = [katz_lm.discounts(Counter(c.values()), 1) for c in self.counts]
        self.after = defaultdict(list)
        for table in self.counts[1:]:
            for g in table:
                self.after[g[:-1]].append(g[-1])
        known = sum(self.d[0].get(c, 1) * c / self.n for c in self.counts[0].values()) if self.n else 0.0
        self.scale, self.unknown = (1 - 0.5 / self.n, 0.5 / self.n) if self.n and 1 - known < 0.5 / self.n else (1.0, 1 - known)
        self.weights = {}

    def mass(self, g):
        c = self.counts[len(g) - 1][g]
        return self.d[len(g) - 1].get(c, 1) * c

    def weight(self, context):
        """(what masses are shares of, the backoff weight)"""
        if context not in self.weights:
            c = self.counts[len(context) - 1][context]
            mass, lower = math.fsum(self.mass((*context, w)) for w in self.after[context]), math.fsum(self.p(context[1:], w) for w in self.after[context])
            of = c + 1 if mass > c - 1e-6 else c
            self.weights[context] = of, (1 - mass / of) / (1 - lower)
        return self.weights[context]

    def p(self, context, word):
        if not context:
            return self.mass((word,)) / self.n * self.scale if (word,) in self.counts[0] else self.unknown
        if (*context, word) in self.counts[len(context)]:
            return self.mass((*context, word)) / self.weight(context)[0]
        return (self.weight(context)[1] if self.after[context] else 1.0) * self.p(context[1:], word)

    def score(self, text):
        s = [b"\n", *split_words(text), b"\n"]
        return sum(math.log10(self.p(tuple(s[max(0, i - 2) : i]), s[i])) for i in range(1, len(s)))


def katz_rows(extra=()):
    rng = random.Random(4)
    rows = [(i, " ".join(f"v{min(int(rng.paretovariate(1)), 30)}" for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    rows += [(900, None), (901, "zzz unseen V1"), (901, "zzz unseen V1"), (None, "v1 v2"), (-7, "v2 v3 v2"), (902, "ab" * 2000 + " v1 " + "ba" * 2000)]
    return rows + [(3000 + i, t) for i, t in enumerate(extra)]


@pytest.mark.parametrize("tokens, keys, size", [(katz_lm.TOKENS, katz_lm.KEYS, katz_lm.SLICE), (300, 200, 4096), (40, 20, 90)])
def test_katz_scores(spark, tmp_path, tokens, keys, size):
    """In one chunk and bucket, in several, and with texts cut into slices: as the recursion over plain counts."""
    rows = katz_rows([" ".join(f"v{i % 7}" for i in range(700)), "seen once only here"])
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string").withColumn("train", F.coalesce(common.remainder(F.col("doc_id"), 5) != 1, F.lit(True)))
    found, model = katz_lm.score(df.repartition(3), f"file://{tmp_path}/katz", tokens, keys, size)
    got = found.collect()
    train = [t for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    brute = BruteKatz(train)
    assert (model.n, model.v) == (brute.n, brute.v) and len(got) == len(rows)
    for k in range(3):  # counts of counts of every order
        times = Counter(brute.counts[k].values())
        assert model.times[k] == {r: times[r] for r in range(1, katz_lm.K + 2)} and times[1] > 0
    for (i, t), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r["doc_id"], dict(rows)[r["doc_id"]]))), strict=True):
        mine = [*split_words(t), b"\n"]
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, len(mine), sum((w,) in brute.counts[0] for w in mine), brute.n)
        assert math.isclose(r["base_score"], sum(math.log10((brute.counts[0][w,] + 0.5) / (brute.n + 0.5 * (brute.v + 1))) for w in mine), rel_tol=1e-9)
        assert math.isclose(r["score"], brute.score(t), rel_tol=1e-9)
    vocabulary = [w for (w,) in brute.counts[0]]
    for context in [(b"v1",), (b"v2", b"v1"), (b"v1", b"v1"), (b"\n",), (b"v30",), (b"v3", b"v4")]:  # every distribution sums to 1
        assert math.isclose(sum(brute.p(context, w) for w in vocabulary) + brute.p(context, b"never"), 1.0, rel_tol=1e-9)


def test_katz_keeps_what_occurs_once(spark, tmp_path):
    texts = ["the red fox ran home", "the red fox ran off", "a quiet owl slept", "the red hen slept"]
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(10, "a quiet owl slept", False), (11, "owl a slept quiet", False)]
    found, model = katz_lm.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), f"file://{tmp_path}/katz")
    for k in (2, 3):
        grams = Counter(g for t in texts for s in [["\n", *t.split(), "\n"]] for g in zip(*(s[i:] for i in range(k)), strict=False))
        times = Counter(grams.values())
        assert model.times[k - 1] == {r: times[r] for r in range(1, katz_lm.K + 2)} and times[1]
    got = {r["doc_id"]: r for r in found.collect()}
    assert got[10]["base_score"] == pytest.approx(got[11]["base_score"]) and got[10]["score"] > got[11]["score"] + 1  # a passage with one training copy


def test_katz_without_training(spark, nothing, tmp_path):
    one = spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, train boolean")
    r = katz_lm.score(one, f"file://{tmp_path}/one")[0].first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (3, 0, 0, 0.0)
    assert katz_lm.score(nothing.withColumn("train", F.lit(True)), f"file://{tmp_path}/none")[0].count() == 0


def test_words_that_polynomials_confuse(spark, tmp_path):
    """Thue-Morse words and their complements: equal under any polynomial hash modulo a power of two from 1024 letters on."""
    for n in (64, 1024, 2048, 4096):
        a = thue_morse(n)
        b = a.translate(str.maketrans("ab", "ba"))
        w = common.Words([a.encode(), b.encode()])
        assert len(set(w.hashes().tolist()) | set(w.hashes(second=True).tolist())) == 4
        docs = spark.createDataFrame([(2, f"{a} x y z q"), (3, f"{b} x y z q")], "doc_id long, text string")
        assert {r["component_id"] for r in ngram_jaccard.link(docs).collect()} == {2, 3}
        found = {r["doc_id"]: r for r in token_parquet.encoded(docs).collect()}
        whole = token_parquet.WordEncoder(token_parquet.definition_of(), 2).tokenizer
        for r in docs.collect():
            ids = [*whole.encode(r["text"], add_special_tokens=False).ids, 2]
            assert found[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        hits = decontaminate.match_benchmark(docs, spark.createDataFrame([("i", a)], "item_id string, text string"))
        assert {r["doc_id"]: r["n_hit"] for r in hits.collect()} == {2: 1, 3: 0}
    learn = docs.withColumn("train", F.col("doc_id") == 2)
    scored = {r["doc_id"]: r["n_known"] for r in katz_lm.score(learn, f"file://{tmp_path}/katz")[0].collect()}
    assert scored == {2: 6, 3: 5}


def test_discounts():
    d = katz_lm.discounts({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 5}, 1)
    assert all(0 < x < 1 for x in d.values())
    kept = sum(r * n * d.get(r, 1) for r, n in {1: 100, 2: 40, 3: 20, 4: 12, 5: 8}.items())
    assert math.isclose(sum(r * n for r, n in {1: 100, 2: 40, 3: 20, 4: 12, 5: 8}.items()) - kept, 100)  # the mass of what occurs once
    assert set(katz_lm.discounts({}, 1)) == {1, 2, 3, 4, 5}


# --- 6 --------------------------------------------------------------------------------------
def test_chat(spark, tmp_path, nothing):
    rng = random.Random(6)
    rows = []
    for c in range(80):
        for t in range(rng.randrange(1, 6)):
            text = rng.choice(["hi", "<|im_end|>", "a<\\|b", "<|", "é\n", "", None, "long " * 30]) if t else "shared first turn"
            rows.append((c, t, ["user", "assistant"][t % 2], text))
    rows += [(200, 0, "we\nird\\n|<|", "x"), (200, 0, None, "y"), (200, 0, None, "y"), (None, None, "assistant", "z")]
    df = chat_format.with_planted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    tables = chat_format.build(df, f"file://{tmp_path}/chat")
    got = {r["conv_id"]: r for r in chat_format.read_back(tables).collect()}
    by = defaultdict(list)
    for r in rows + [(-1, 0, "user", chat_format.PLANTED), (-1, 1, "assistant", chat_format.PLANTED)]:
        by[r[0]].append(r)
    assert set(got) == set(by)
    for c, mine in by.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[c]["n_turns"] == len(mine) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(token_parquet.definition_of(chat_format.TOKENIZER))
    nodes = sorted(tables["nodes"].collect(), key=lambda r: r["start"])
    at, path = 0, []
    for n in nodes:  # one emission without gaps, depth first; ancestors are the stretches of the path
        formatted = tokenizer.decode(n["tokens"], skip_special_tokens=False)
        assert n["start"] == at and formatted.count("<|") == 2 and n["end"] - n["start"] == len(n["tokens"])
        masked = tokenizer.decode(n["tokens"][n["loss_from"] : n["loss_to"]], skip_special_tokens=False)
        role, body = formatted.removeprefix("<|im_start|>").removesuffix("<|im_end|>\n").split("\n", 1)
        assert masked == (body if role == "assistant" else "")
        at = n["end"]
        path = path[: n["depth"] - 1] + [n]
        stretches = []
        for a in path[:-1]:
            if stretches and stretches[-1][1] == a["start"]:
                stretches[-1][1] = a["end"]
            else:
                stretches.append([a["start"], a["end"]])
        assert [[a["begin"], a["end"]] for a in n["ancestors"]] == stretches
        assert n["position"] == sum(a["end"] - a["start"] for a in path[:-1]) and n["tree"] == path[0]["start"]
    paths = {tuple((r[2] or "", r[3] or "") for r in m[: k + 1]) for m in by.values() for k in range(len(m))}
    assert len(nodes) == len(paths)  # a shared turn is there once
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.build(empty, f"file://{tmp_path}/none")).count() == 0


# --- 7 --------------------------------------------------------------------------------------
ALNUM = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_hits(texts, items):
    windows = defaultdict(set)
    for item, text in items:
        w = split_words(text, ALNUM)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = []
    for text in texts:
        w, hit, found = split_words(text, ALNUM), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[x]
        out.append((len(w), len(hit), sorted(map(str, found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_decontaminate(spark, corpus, nothing):
    rng = random.Random(8)
    rows, _ = corpus
    items = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice([1, 5, 13, 14, 40])))) for i in range(30)] + [(30, None), (31, "..."), (32, items_text := "W1 w2, w3 " * 20), (32, items_text), (10, "É é ñ ß")]
    texts = [r[1] for r in rows] + [" ".join(["pad"] * 7 + i[1].split()[2:] + ["pad"] * 9) for i in items if i[1]] + [i[1] for i in items]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(texts, items)
    for limit, shard in ((decontaminate.TEST_BYTES, 20_000), (600, 20_000), (decontaminate.TEST_BYTES, 700)):  # in one part, in several, and texts in slices
        got = decontaminate.match_benchmark(docs, bench, test_bytes=limit, shard=shard).orderBy("doc_id").collect()
        assert [(r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got] == want
    for r in got:
        assert (r["longest"] > 0) == (r["n_hit"] > 0) and r["longest"] <= r["n_hit"]
    for limit in (decontaminate.TEST_BYTES, 600):
        kept = decontaminate.remove_affected(docs, bench, limit)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i, w in enumerate(want) if not w[1]]
    assert decontaminate.match_benchmark(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.match_benchmark(nothing, bench).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 31, 127, 511])
def test_vocabularies_of_every_width(n):
    """Items of one word each, and longer ones over the same words: all found, wherever they stand."""
    items = [(str(i), f"a{i:03}") for i in range(n)] + [(f"w{i}", " ".join(f"a{(i + k) % n:03}" for k in range(20))) for i in range(0, n, 50)]
    texts = [f"x {t} y" for _, t in items] + [t for _, t in items] + [" ".join(f"a{i:03}" for i in range(n)), "x y"]
    test = decontaminate.test_set([(i, t.encode()) for i, t in items])
    n_words, spans, found, _ = decontaminate.matches([t.encode() for t in texts], test)
    got = [(w, sum(s[1::2]) - sum(s[0::2]), sorted(i)) for w, s, i in zip(n_words, spans, found, strict=True)]
    assert got == [x[:3] for x in brute_hits(texts, items)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), max_size=5), st.lists(st.lists(st.sampled_from("abcd"), max_size=60), min_size=1, max_size=4), st.sampled_from([20, 1000]))
def test_hits_of_repetitive_texts(items, texts, shard):
    items, texts = [(str(i), " ".join(x)) for i, x in enumerate(items)], [" ".join(x) for x in texts]
    test = decontaminate.test_set([(i, t.encode()) for i, t in items])
    n_words, spans, found, longest = decontaminate.matches([t.encode() for t in texts], test, shard)
    got = [(w, sum(s[1::2]) - sum(s[0::2]), sorted(i)) for w, s, i in zip(n_words, spans, found, strict=True)]
    assert got == [x[:3] for x in brute_hits(texts, items)]
    for t, n, x in zip(texts, longest, spans, strict=True):
        runs = [k for _, i in items for a in range(len(i.split())) for k in range(min(13, len(i.split())), len(i.split()) - a + 1) if f" {' '.join(i.split()[a : a + k])} " in f" {t} "]
        assert n == max(runs, default=0) or not x


def test_longest_match():
    item = [f"b{i}" for i in range(30)]
    text = ["x"] * 4 + item[3:25] + ["y"] + item[:14]
    test = decontaminate.test_set([("1", " ".join(item).encode())])
    assert decontaminate.matches([" ".join(text).encode()], test)[3] == [22]


# --- 8 --------------------------------------------------------------------------------------
def test_shards(spark, corpus, nothing):
    rows, df = corpus
    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text in a third of all rows").otherwise(F.concat(F.lit("own "), F.repeat(F.lit("z"), (F.col("id") % 50).cast("int")), F.col("id").cast("string"))).alias("text"))
    got = shard_packing.shard_documents(big).toPandas()
    sums = got.groupby("shard").agg(size=("size", "sum"), n=("size", "count"), tokens=("tokens", "sum"))
    assert len(sums) == 24 and (sums["size"].max() - sums["size"].min()) / sums["size"].mean() < 0.1
    assert ((sums.n.max() - sums.n.min()) / sums.n.mean() < 0.2) and ((sums.tokens.max() - sums.tokens.min()) / sums.tokens.mean() < 0.2)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part))) and list(part.sort_values("slot").doc_id) == sorted(part.doc_id)
    small = {r["doc_id"]: r for r in shard_packing.shard_documents(df).collect()}
    for r in rows:
        raw = (r[1] or "").encode()
        assert (small[r[0]]["size"], small[r[0]]["text_crc32"], small[r[0]]["law"], small[r[0]]["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    assert shard_packing.shard_documents(nothing).count() == 0


def test_groups_stay_whole(spark, monkeypatch):
    """Unless a group exceeds a shard; the light ones in one block and in many."""
    rng = random.Random(12)
    texts = [f"{'group ' * rng.randrange(1, 30)}{g}" for g in range(600) for _ in range(rng.choice([1, 1, 2, 5, 25]))] + ["a\tlarge\n group"] * 900
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    for block in (shard_packing.BLOCK, 100):
        monkeypatch.setattr(shard_packing, "BLOCK", block)
        got = shard_packing.shard_documents(df, 8).toPandas()
        text = dict(rows)
        where = defaultdict(set)
        for r in got.itertuples():
            where[text[r.doc_id]].add(r.shard)
            assert r.tokens == len(split_words(text[r.doc_id]))
        share = Counter(texts)
        assert {t for t, s in where.items() if len(s) > 1} == {t for t, n in share.items() if n > len(texts) / 8}
        sums = got.groupby("shard").agg(size=("size", "sum"), n=("size", "count"))
        assert (sums["size"].max() - sums["size"].min()) / sums["size"].mean() < 0.15 and (sums.n.max() - sums.n.min()) / sums.n.mean() < 0.3


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 20)] * 3), max_size=30), st.integers(1, 5))
def test_pack_takes_the_highest_dot_product(vectors, shards):
    shares = np.array(vectors, dtype=float).reshape(-1, 3) / 16
    residual, out = [[1.0] * 3 for _ in range(shards)], [0] * len(vectors)
    for i in sorted(range(len(vectors)), key=lambda i: (-max(vectors[i]), i)):
        dots = [sum(a * b for a, b in zip(r, shares[i], strict=True)) for r in residual]
        out[i] = dots.index(max(dots))
        residual[out[i]] = [a - b for a, b in zip(residual[out[i]], shares[i], strict=True)]
    assert shard_packing.pack(shares, np.ones((shards, 3))).tolist() == out


# --- 9 --------------------------------------------------------------------------------------
@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_png_round_trip(raw):
    payload = media_columns.payload_of(raw)
    png = media_columns.to_png(payload)
    assert len(payload) % 576 == 0 and payload and media_columns.from_png(png) == payload
    assert media_columns.header_of(png[: media_columns.HEADER]) == (576, len(payload) // 576, 8)


def test_media(corpus, nothing, tmp_path):
    rows, df = corpus
    got = media_columns.media(df).toPandas()
    assert len(got) == len(rows)
    by = got.drop_duplicates("doc_id").set_index("doc_id")
    for r in rows:
        raw = (r[1] or "").encode()
        payload, x = media_columns.payload_of(raw), by.loc[r[0]]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (x.media_sha256, x.height, x.feature) == (hashlib.sha256(media_columns.to_png(payload)).hexdigest(), len(payload) // 576, media_columns.feature_of(payload))
    assert by.drop_duplicates(["shard", "offset"]).shape[0] == len({r[1] or "" for r in rows})  # each content once
    assert media_columns.media(nothing).count() == 0


def test_tar_shards_are_tar_files(corpus, tmp_path):
    import tarfile

    rows, df = corpus
    _, index = media_columns.store(df, f"file://{tmp_path}/media")
    for shard in {r["shard"] for r in index.collect()}:
        with tarfile.open(f"{tmp_path}/media/shards/{shard}") as t:
            for m in t.getmembers():
                assert hashlib.sha256(t.extractfile(m).read()).hexdigest() + ".png" == m.name


# --- 10 -------------------------------------------------------------------------------------
def brute_dedup(rows):
    first, gone = {}, defaultdict(set)
    for r in sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0], r[1] or "")):
        lines = (r[1] or "").split("\n") if r[1] is not None else []
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not "".join(w).strip(" "):
                continue
            at = first.setdefault(w, (r, i))
            if at[0] != r or i >= at[1] + 3:
                gone[r] |= {i, i + 1, i + 2}
    return {r: (None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone[r]), len(gone[r])) for r in {(r[0], r[1]) for r in rows}}


def test_line_dedup(spark, corpus, nothing):
    rng = random.Random(11)
    rows = [(i, "\n".join(rng.choice("abcde") for _ in range(rng.randrange(0, 12)))) for i in range(60)] + [(70, None), (71, ""), (72, "\n\n\n\n\n\n\n"), (73, "s\n" * 12), (5, "a\nb")]
    rows += [(r[0] + 100, r[1]) for r in corpus[0]] + [rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_dedup(rows)
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(rows)
    mine = sorted((r["doc_id"], str(r["text"]), r["n_removed"]) for r in got)
    assert mine == sorted((i, str(want[i, t][0]), want[i, t][1]) for i, t in rows)
    assert line_dedup.dedup_lines(nothing).count() == 0


# --- the pipeline ---------------------------------------------------------------------------
def test_pipeline_stages_in_sequence(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, copies, benchmark passages and clashing names go through all stages; no table is too small."""
    import corpus_pipeline

    rng = random.Random(21)
    words = lambda rng, n, size=4000: [f"w{rng.randrange(size)}" for _ in range(n)]
    plain = [" ".join(words(rng, rng.randrange(30, 120))) + "." for _ in range(120)]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}", "mine") for i, t in enumerate(plain)]
    passage = " ".join(f"bench{k}" for k in range(14))
    rows += [(200 + k, plain[k], "en", "src1", "copy") for k in range(10)]  # exact copies
    rows += [(220 + k, plain[k].replace(plain[k].split()[3], "changed", 1), "en", "src2", "near") for k in range(10) if len(plain[k].split()) > 60]
    rows += [(240, f"{' '.join(words(rng, 2000))} {passage} end", "en", "src0", "hit"), (241, passage.upper(), "en", "src3", "hit")]
    rows += [(260, None, None, None, "null"), (261, "", "en", "src0", "empty"), (262, " ".join(words(rng, 20_000, 9000)), "en", "src0", "long"), rows[5], rows[5], (None, "no id here " * 10, "en", "src0", "none")]
    columns = "doc_id long, text string, lang string, source string, epoch string, tokens string, n_hit string, score string, leaf string"
    docs = spark.createDataFrame([(*r[:4], *[r[4]] * 5) for r in rows], columns)
    sf = f"{tmp_path}/sf"
    spark.createDataFrame([(i, 1) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([("i", passage), ("n", None)], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        before, kept = kept, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert kept.columns == docs.columns, name
            assert kept.distinct().exceptAll(docs.distinct()).count() == 0  # rows as they were
        mine = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if k == 1:
            assert not mine & set(range(200, 230)) and set(range(120)) <= mine  # the first of each group stays
            assert kept.where("doc_id = 5").count() == 1
        if k == 2:
            assert not mine & {240, 241} and {r["doc_id"] for r in before.select("doc_id").collect()} - mine == {240, 241}
    tokens = {r["doc_id"]: r["n_tokens"] for r in kept.collect()}
    assert set(tokens) <= mine | {None} and all(n >= 1 for n in tokens.values())
    none = docs.where("false")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, none, sf).count() == 0, name
