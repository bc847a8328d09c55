"""Collocations against counting every phrase."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapewright.llm import collocations
from tapewright.llm.shared import Scratch


def phrases(docs, max_words=3):
    counts, totals = Counter(), Counter()
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, max_words + 1):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    return counts, totals


def brute(docs, max_words=3, min_count=10, best=2000):
    counts, totals = phrases(docs, max_words)
    found = {k: f for k, f in counts.items() if f >= min_count and len(k[1]) > 1}
    inside = lambda g, b: any(b[i : i + len(g)] == g for i in range(len(b) - len(g) + 1))
    out = {}
    for (lang, g), a in found.items():
        if any(x == lang and len(b) > len(g) and inside(g, b) and 100 * f >= 50 * a for (x, b), f in found.items()):
            continue
        score, _, l, r = min((10**6 * a * a // (counts[lang, g[:k]] * counts[lang, g[k:]]), k, counts[lang, g[:k]], counts[lang, g[k:]]) for k in range(1, len(g)))
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), l, r))
    rows = []
    for lang, of_lang in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(of_lang)[:best], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(rows)


def corpus():
    rng = random.Random(13)
    words = ["the", "The", "of", "né", "Né", "x y", "\x01", "a\x1fb", "日本", "to", "be", "or", "not"]
    docs = []
    for _ in range(400):
        text = ""
        for _ in range(rng.randrange(30)):
            text += rng.choice(["new york city", "hello hello hello hello", "of the", *words]) + rng.choice([" ", " ", "\t", "  ", ", ", ".\n", "\r", "\x0b"])
        docs.append((text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return [*docs, (None, "en"), ("", None), ("...", "fr"), ("alone", "fr"), *[("again and again", "en")] * 12]


@pytest.mark.parametrize("block, tokens", [(1 << 20, 2_000_000), (64, 100), (5, 1)])
def test_mine(spark, monkeypatch, block, tokens):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    monkeypatch.setattr(collocations, "FLUSH_TOKENS", tokens)
    docs = corpus()
    df = spark.createDataFrame([(t, l, "x", 1) for t, l in docs], "text string, lang string, phrase string, f int")
    assert sorted(tuple(r) for r in collocations.mine(df).collect()) == brute(docs)


def test_longer_phrases_and_limits(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MAYBE_BITS", 1 << 10)  # most bits are set by chance
    docs = corpus()
    df = spark.createDataFrame(docs, "text string, lang string")
    got = collocations.mine(df, max_words=5, min_count=4, best=7)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, 5, 4, 7)
    assert collocations.mine(df.limit(0)).count() == 0


def test_one_first_word_over_many_ranges(spark):
    """A common first word's n-grams lie in many ranges, each of which gets the word's own count."""
    rng = random.Random(1)
    docs = [(f"the w{rng.randrange(400)} v{rng.randrange(3)}. u{rng.randrange(400)} the the.", "en") for _ in range(20_000)]
    df = spark.createDataFrame(docs, "text string, lang string")
    scratch = Scratch(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    grams = collocations.count_phrases(df, scratch).filter("phrase != ''").select("lang", F.split("phrase", " ").alias("key"), "f")
    streamed = collocations.stream(scratch.cut(grams, "grams"), scratch, "stream")
    assert streamed.filter("not carried").filter(F.col("key")[0] == "the").select("part").distinct().count() > 1
    assert streamed.filter("carried").count() > 1
    assert sorted(tuple(r) for r in collocations.mine(df).collect()) == brute(docs)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_texts_in_blocks(spark):
    docs = [("one two three four " * 200_000 + ". end", "en"), ("y" * 3_000_000 + " z", "en")]
    df = spark.createDataFrame(docs, "text string, lang string")
    assert sorted(tuple(r) for r in collocations.mine(df).collect()) == brute(docs)


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**14
    rows = [("en", ["a"], big), ("en", ["b"], big - 1), ("en", ["a", "b"], big - 7), ("en", ["c"], 10**13), ("en", ["b", "c"], 3), ("en", ["a", "b", "c"], 3)]
    grams = spark.createDataFrame(rows, "lang string, words array<string>, f bigint")
    got = {tuple(r.words): (r.l, r.r, r.score) for r in collocations.scored(grams, Scratch(spark)).collect()}
    assert got["a", "b"] == (big, big - 1, 10**6 * (big - 7) ** 2 // (big * (big - 1)))
    assert got["a", "b", "c"] == (big, 3, 0)  # both cuts give 0, so the first counts
