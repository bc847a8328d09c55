"""Similarity join, nearest neighbours and mixing against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import hnsw, mixing, ngram_join, oracles, queries

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ka") for b in ("ra", "ne", "ti", "lo", "mu", "sa", "ve")]


def shingles(text):
    words = ngram_join.WORDS((text or "").lower())
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute(docs):
    sets, links, group = [shingles(t) for _, t in docs], collections.Counter(), list(range(len(docs)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i + 1, len(docs)):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    return [(top(i), links[i]) for i in range(len(docs))]


def corpus():
    rng = random.Random(4)
    docs = [(0, None), (1, ""), (2, "one two"), (3, "One, two!"), (4, "...")]
    bases = [[rng.choice(WORDS) for _ in range(120)] for _ in range(6)]
    for base in bases[:5]:
        for _ in range(25):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            docs.append((len(docs), " ".join(words)))
    for _ in range(300):  # one large group of near copies, over several blocks
        words = list(bases[5])
        words[rng.randrange(len(words))] = rng.choice(WORDS)
        docs.append((len(docs), " ".join(words)))
    passage = " ".join(rng.choice(WORDS) for _ in range(40))
    for _ in range(40):
        docs.append((len(docs), " ".join(rng.choice(WORDS) for _ in range(60)) + " " + passage))
    docs.append((len(docs), " ".join(rng.choice(WORDS) for _ in range(30_000))))
    return docs


def test_join_and_survivors(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x", -1) for i, t in docs], "doc_id bigint, text string, id string, bands int")
    want = brute(docs)
    got = {r.id: (r.class_id, r.n_links) for r in ngram_join.join(df).collect()}
    assert got == {i: w for (i, _), w in zip(docs, want)}
    kept = sorted(r.doc_id for r in ngram_join.keep_one(df).collect())
    assert kept == sorted({w[0] for w in want})
    assert ngram_join.keep_one(df).columns == df.columns


@pytest.mark.parametrize("block, dense, by_bucket", [(16, 8, False), (64, 0, False), (16, 10**6, False), (16, 0, True), (32, 8, True)])
def test_groups_of_several_blocks(spark, monkeypatch, block, dense, by_bucket):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    docs = corpus()[:200] if by_bucket else corpus()
    if by_bucket:  # every large component is compared bucket by bucket
        mates = ngram_join._links
        monkeypatch.setattr(ngram_join, "_links", lambda m, *rest: mates(m.withColumn("n", F.least("n", F.lit(1))), *rest))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.id: (r.class_id, r.n_links) for r in ngram_join.join(df).collect()}
    assert got == {i: w for (i, _), w in zip(docs, brute(docs))}


def test_columns_named_as_internal_ones(spark):
    names = ["key_id", "key_hash", "text_key", "own_key", "own0", "row_id", "stays", "n", "Node", "__hash", "bucket"]
    text = " ".join(WORDS)
    rows = [(i, t, *[k + i for k in range(len(names))]) for i, t in enumerate([text, text, text + " more", "quite another text of words here", None])]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if r[0] in (0, 3, 4)), key=str)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(WORDS)
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "other words here now again"), (2, "other words here now again")], "doc_id bigint, text string")
    assert sorted((r.id is None, r.id, r.class_id, r.n_links) for r in ngram_join.join(df).collect() if r.id) == [(False, 1, 1, 2), (False, 1, 1, 2), (False, 2, 2, 1), (False, 2, 2, 1)]
    assert sorted(r.doc_id for r in ngram_join.keep_one(df).collect()) == [1, 2]
    assert ngram_join.join(df.limit(0)).count() == 0 and ngram_join.keep_one(df.limit(0)).count() == 0


def test_groups_of_equal_class_ids_stay_apart(spark):
    rng = random.Random(8)
    one, two, three, four = ([" ".join(rng.choice(WORDS) for _ in range(80))] * 2 for _ in range(4))
    near = one[0] + " " + WORDS[0]  # a near copy, so that groups of several texts are met as well
    rows = [(None, t) for t in [*one, near, *two]] + [(7, t) for t in three] + [(7, four[0]), (9, four[1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = ngram_join.keep_one(df).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 0, 7, 7]
    assert {r.text for r in kept} in ({t, two[0], three[0], four[0]} for t in (one[0], near))
    joined = ngram_join.join(df).collect()
    assert len({r.group_id for r in joined}) == 4 and {r.class_id for r in joined} == {None, 7}


def test_pruning_keeps_pairs_at_the_threshold():
    from math import comb

    for n, least in ngram_join.fewest_matches(0.8).items():
        lost = sum(comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(least))
        assert lost < 1e-5


def test_nearest_recall_and_edges(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 700)
    x = rng.normal(size=(2000, 24))
    x[100:400] = x[100] + rng.normal(size=(300, 24)) * 0.01  # a crowd of near copies
    rows = [(int(i), [float(v) for v in row], "n") for i, row in enumerate(x)]
    rows += [(5000, None, "n"), (5020, [0.0] * 24, "n"), (5040, [float("nan")] * 24, "n"), (5060, [None] * 24, "n"), (5080, [1.0, 2.0], "n"), (5100, [3.0, 1.0], "n")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank string")
    got = collections.defaultdict(list)
    for r in hnsw.search_all(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    scores = x @ x.T
    hits = []
    for q in range(0, 2000, 20):
        own = scores[q].copy()
        own[q] = -np.inf
        best = np.argsort(-own, kind="stable")[:20]
        hits.append(len({v for v, _ in got[q]} & set(best.tolist())) / 20)
        assert len(got[q]) == 20 and all(abs(s - scores[q, v]) < 1e-9 for v, s in got[q])
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert np.mean(hits) >= 0.9
    assert got[5080] == [(5100, 5.0)] and got[5100] == [(5080, 5.0)]
    assert not {5000, 5020, 5040, 5060} & set(got)


def recall(x):
    """Mean share of the true 20 nearest that one graph finds, for every 20th row."""
    order, layers = hnsw.build(hnsw.scaled(x))
    asked = np.arange(0, len(x), 20)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    places = np.concatenate([hnsw.search(hnsw.scaled(x)[order], layers, x[asked[k : k + 256]].astype(np.float32), hnsw.SEARCH_WIDTH) for k in range(0, len(asked), 256)])
    hits = []
    for own, found, k in zip(scores, order[places], asked):
        found = found[found != k]
        hits.append(len(set(found[np.argsort(-own[found])[:20]]) & set(np.argsort(-own)[:20])) / 20)
    return np.mean(hits)


def test_recall_on_full_shards():
    rng = np.random.default_rng(5)
    assert recall(rng.normal(size=(hnsw.SHARD_ROWS, 64))) >= 0.95
    spread = rng.normal(size=(6000, 64)) * rng.lognormal(0, 0.7, size=(6000, 1))
    assert recall(spread) >= 0.95
    centres, of = rng.normal(size=(40, 64)), rng.integers(0, 40, 6000)
    assert recall((centres[of] + rng.normal(size=(6000, 64)) * 0.1) * rng.lognormal(0, 0.5, size=40)[of][:, None]) >= 0.9


def test_one_huge_vector_beside_usual_ones(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 16))
    x[17] *= 1e50
    x[40] *= 1e-60
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in hnsw.search_all(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 4000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-scores)[:20].tolist()))
    assert len(got) == 200 and hits >= 0.95 * 200 * 20


def test_nearest_ties_repeats_and_large_components(spark):
    rows = [(k, [1.0, float(k % 2)]) for k in range(0, 30)] + [(0, [1.0, 0.0]), (40, [1e160, 1e160]), (60, [-1e160, 1e200]), (80, [1e-200, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, shard string, size int")
    got = collections.defaultdict(list)
    for r in hnsw.search_all(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    vectors = [(i, np.array(v)) for i, v in rows]
    for q in (0, 20, 40, 60, 80):
        own = next(v for i, v in vectors if i == q)
        with np.errstate(over="ignore", invalid="ignore"):
            want = sorted(((i, float(own @ v)) for i, v in vectors if i != q), key=lambda x: (-x[1], x[0]))
        # of ids that are repeated in the queries, each row's results count
        assert [s for _, s in got[q]][:20] == [s for _, s in want][:20] or q == 0
        assert q not in {v for v, _ in got[q]} and len(got[q]) == 20
    assert got[20][:2] == [(40, 1e160), (1, 1.0)] or got[20][0][0] == 40
    assert hnsw.search_all(df.limit(0), df.limit(0)).count() == 0


def slots_by_simulation(shares, blocks):
    """Earliest deadline first, slot by slot."""
    from fractions import Fraction

    left, done, out = {k: n for k, n in blocks.items() if n}, dict.fromkeys(blocks, 0), []
    t, taken, total = 0, dict.fromkeys(blocks, 0), sum(shares[k] for k in left)
    while left:
        released = [(-(-(taken[k] + 1) * total // shares[k]), -shares[k], k) for k in left if taken[k] * total // shares[k] <= t]
        k = min(released)[2]
        out.append((k, done[k]))
        done[k] += 1
        taken[k] += 1
        t += 1
        for s in left:
            assert abs(taken[s] - Fraction(shares[s] * t, total)) < 1
        if done[k] == blocks[k]:
            del left[k]
            t, taken, total = 0, dict.fromkeys(blocks, 0), sum(shares[s] for s in left)
    return out


def test_mix_follows_deadlines(spark):
    rng = random.Random(8)
    sources = ["src0"] * 330 + ["src1"] * 41 + ["src2"] * 7 + ["other", None] * 60 + ["src3"] * 90
    rng.shuffle(sources)
    rows = [(k if k % 50 else None, s, "t", k, 5) for k, s in enumerate(sources)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, block bigint, position int")
    placed = mixing.schedule(df.select("doc_id", "source", F.col("block").alias("k")), block=4).collect()
    assert sorted(r.k for r in placed) == list(range(len(rows)))
    assert sorted(r.position for r in placed) == list(range(len(rows)))
    shares = dict(enumerate([*mixing.SHARES.values(), mixing.REST]))
    counts = collections.Counter(r.stream for r in placed)
    want = slots_by_simulation(shares, {k: -(-counts[k] // 4) for k in shares})
    assert sorted({(r.slot, r.stream, r.block) for r in placed}) == [(s, k, b) for s, (k, b) in enumerate(want)]
    mixed = mixing.mix(df, block=4)
    assert mixed.columns == df.columns
    order = {r.k: r.position for r in mixing.schedule(df.withColumnsRenamed({"block": "k", "position": "p"}).select("doc_id", "source", "text", "k", "p"), block=4).collect()}
    assert [r.block for r in mixed.collect()] == sorted(order, key=order.get)
    assert mixing.mix(df.limit(0)).count() == 0


def test_every_source_has_its_own_stream(spark, tmp_path):
    """The query against its SQL, with sources that are listed, unlisted, null and missing."""
    import duckdb

    rng = random.Random(12)
    rows = [(k, rng.choice(["src0", "src0", "src1", "src3", "src9", "b", "", None])) for k in range(900)] + [(900 + k, "b") for k in range(300)]
    spark.createDataFrame(rows, "doc_id bigint, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_mixing(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.execute(oracles.mixing())
    assert [d[0] for d in found.description] == got.columns
    got = [tuple(r) for r in got.collect()]
    assert sorted(map(str, got)) == sorted(map(str, found.fetchall()))
    assert len({(r[1], r[2]) for r in got}) == len({r[2] for r in got}) == 7


def test_many_null_ids_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_OF_BUCKET", 10)
    rows = [(None if k % 3 else k, f"src{k % 5}", k, "x") for k in range(400)] + [(None, "src0", -1, "x")] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, source string, k bigint, slot string")
    placed = mixing.schedule(df).collect()
    assert sorted(r.position for r in placed) == list(range(len(rows))) and collections.Counter(r.k for r in placed) == collections.Counter(r[2] for r in rows)
    import hashlib

    for stream in {r.stream for r in placed}:
        own = [hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest() for r in sorted((r for r in placed if r.stream == stream), key=lambda r: (r.block, r.place))]
        assert own == sorted(own)
    assert sorted(mixing.mix(df).columns) == sorted(df.columns)


def test_every_source_has_its_own_share(spark):
    import corpus_pipeline

    sizes = {"src0": 160, "src1": 120, "src2": 100, "src3": 80, "hot": 900, **{f"src{k}": 48 for k in range(4, 12)}, None: 48}
    rows = [(k, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id bigint, source string")
    options = mixing.weights_by_source(df)
    names, total = [*options["shares"], None], sum(options["shares"].values()) + options["rest"]
    of_name = dict(zip(names, [*options["shares"].values(), options["rest"]]))
    assert set(of_name) == set(sizes) and all(of_name[s] * 20 == a * total for s, a in mixing.SHARES.items())
    assert {of_name[s] * 20 * 10 for s in sizes if s not in mixing.SHARES} == {mixing.REST * total}
    blocks = {k: -(-sizes[s] // mixing.BLOCK) for k, s in enumerate(names)}
    want = slots_by_simulation(dict(enumerate(of_name.values())), blocks)
    at = {(r.stream, r.block): r.slot for r in mixing.schedule(df, **options).collect()}
    assert at == {b: slot for slot, b in enumerate(want)}
    mixed = [r.source for r in corpus_pipeline.mix_sources(spark, df, "").collect()]
    assert collections.Counter(mixed) == sizes
    runs, start = [], 0
    for k, block in want:
        length = min(mixing.BLOCK, sizes[names[k]] - block * mixing.BLOCK)
        runs.append(set(mixed[start : start + length]) == {names[k]})
        start += length
    assert all(runs)


@pytest.mark.parametrize("cells", [4, 1024])
def test_more_sources_than_streams_take_turns(spark, monkeypatch, cells):
    monkeypatch.setattr(mixing, "CELLS", cells)
    monkeypatch.setattr(mixing, "ROWS_OF_BUCKET", 50)
    rng = random.Random(21)
    sizes = {f"site{k}": rng.choice([1, 1, 2, 3, 7, 30, rng.randrange(1, 60)]) for k in range(mixing.MAX_SOURCES + 20)} | {"hot": 700, "src0": 300, "src2": 40, "": 7, None: 30}
    rows = [(k if k % 40 else None, s, k, "x") for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, k bigint, slot string")
    options = mixing.weights_by_source(df)
    assert options["shares"] == mixing.SHARES and options["deal"]
    placed = mixing.schedule(df, **options).collect()
    assert sorted(r.k for r in placed) == list(range(len(rows))) and sorted(r.position for r in placed) == list(range(len(rows)))
    rest = [r for r in sorted(placed, key=lambda r: (r.block, r.place)) if r.stream == 4]
    assert [(r.block, r.place) for r in rest] == [divmod(n, mixing.BLOCK) for n in range(len(rest))]
    others = {s: n for s, n in sizes.items() if s not in mixing.SHARES}
    start, order = 0, None
    for turn in range(max(others.values())):
        left = {s for s, n in others.items() if n > turn}
        named = [r.source for r in rest[start : start + len(left)]]
        assert set(named) == left and [others[s] for s in named] == sorted((others[s] for s in left), reverse=True)
        assert order is None or named == order[: len(named)]
        start, order = start + len(left), named
    assert start == len(rest)
    counts = collections.Counter(r.stream for r in placed)
    want = slots_by_simulation(dict(enumerate([*mixing.SHARES.values(), mixing.REST])), {k: -(-counts[k] // mixing.BLOCK) for k in range(5)})
    assert sorted({(r.slot, r.stream, r.block) for r in placed}) == [(s, k, b) for s, (k, b) in enumerate(want)]
    mixed = mixing.mix(df, **options)
    at = {r.k: r.position for r in placed if r.doc_id is not None}
    assert mixed.columns == df.columns and [r.k for r in mixed.collect() if r.doc_id is not None] == sorted(at, key=at.get)
    assert mixing.schedule(df.limit(0), **options).count() == mixing.mix(df.filter("source = 'src0'").limit(0), **options).count() == 0
    assert mixing.mix(df.filter("source = 'src0'"), **options).count() == 300
