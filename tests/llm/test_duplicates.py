"""Near-duplicates by odd sketches against all pairs."""

import random

import numpy as np
import pytest

from tapewright.llm import ngram_join, odd_sketch

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ka") for b in ("ra", "ne", "ti", "lo", "mu", "sa", "ve")]


def word_sets(docs):
    out = []
    for _, text in docs:
        words = (text or "").encode().lower().split()
        n = min(4, len(words))
        out.append(frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset())
    return out


def brute(docs):
    sets, root = word_sets(docs), list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, len(sets[k]), least[top(k)], least[top(k)] == i) for k, (i, _) in enumerate(docs))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


def corpus():
    rng = random.Random(11)
    texts = [None, "", " \t\n", "one two", "One\ttwo", "one TWO three", "É a b c d", "é a b c d", "no break is one word", "no break is one word"]
    for _ in range(4):
        base = [rng.choice(WORDS) for _ in range(150)]
        texts += [" ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 5, 7]))) for _ in range(30)]
    chain = [rng.choice(WORDS) for _ in range(200)]
    for _ in range(40):  # each is near the one before, but far from the first
        chain = edited(rng, chain, 2)
        texts.append(" ".join(chain))
    base = [rng.choice(WORDS) for _ in range(200)]
    texts += [" ".join(edited(rng, base, 4)) for _ in range(120)]  # near copies about an original that comes last
    texts.append(" ".join(base))
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    texts += [" ".join(rng.choice(WORDS) for _ in range(50)) + " " + passage for _ in range(30)]
    texts += [" ".join(rng.choice(WORDS) for _ in range(40_000)), "x" * 1_000_000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("block, block_bytes, dense", [(1024, 8 << 20, 8), (16, 50_000, 0), (16, 50_000, 10**6)])
def test_components(spark, monkeypatch, block, block_bytes, dense):
    for name, value in (("BLOCK", block), ("BLOCK_BYTES", block_bytes), ("DENSE", dense)):
        monkeypatch.setattr(odd_sketch, name, value)
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x", [1], 0) for i, t in docs], "doc_id bigint, text string, node string, bands array<int>, row_id int")
    got = sorted((r.id, r.n_shingles, r.component_id, r.kept) for r in odd_sketch.join(df).collect())
    assert got == brute(docs)


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(3)
    for similarity in (0.95, 0.9, 0.8):
        n, errors = 2000, []
        for _ in range(40):
            both = rng.integers(0, 2**64, int(n * similarity), np.uint64)
            own = rng.integers(0, 2**64, (2, (n - len(both)) // 2), np.uint64)
            a, b = (odd_sketch.odd_sketch(ngram_join.signature(np.unique(np.concatenate([both, x])))) for x in own)
            ones = int(np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum())
            assert ones <= odd_sketch.most_ones()
            errors.append(odd_sketch.estimated_similarity(ones) - similarity)
        assert abs(np.mean(errors)) < 0.02
    unlike = [odd_sketch.odd_sketch(ngram_join.signature(rng.integers(0, 2**64, 500, np.uint64))).view(np.uint64) for _ in range(30)]
    assert all(np.bitwise_count(x ^ y).sum() > odd_sketch.most_ones() for k, x in enumerate(unlike) for y in unlike[:k])


def test_limit_is_that_of_simulated_sketches():
    rng = np.random.default_rng(5)
    differ = rng.binomial(odd_sketch.SAMPLES, 0.2, 4000)
    ones = [int((np.bincount(rng.integers(0, odd_sketch.BITS, 2 * d), minlength=odd_sketch.BITS) & 1).sum()) for d in differ]
    assert max(ones) <= odd_sketch.most_ones() < odd_sketch.BITS / 4


def test_nulls_repeats_and_no_rows(spark):
    text, other = " ".join(WORDS), " ".join(reversed(WORDS))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, other), (None, other), (5, None), (None, ""), (6, text + " more")], "doc_id bigint, text string")
    got = sorted(((r.id, r.component_id, r.kept) for r in odd_sketch.join(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (None, None, True), (5, 5, True), (None, None, True), (6, 1, False)], key=str)
    assert odd_sketch.join(df.limit(0)).count() == 0


def test_near_copies_meet_once(spark):
    """Buckets of near copies are one group, so a class isn't dealt out once for each band that it shares."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(400), rng.choice([4, 8, 12, 16])):
            words[at] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    with odd_sketch.Scratch.noted() as places:
        got = sorted((r.id, r.n_shingles, r.component_id, r.kept) for r in odd_sketch.join(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())
    assert got == brute(docs)
    members = spark.read.parquet(next(p for p in places if "/members-" in p))
    dealt = members.groupBy("node").count().toPandas()["count"]
    assert dealt.mean() <= 6
