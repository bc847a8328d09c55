"""Merkle manifests and multiproofs against a plain tree."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tapewright.llm import merkle


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes):
    """The root, and for each leaf its (before, after) on each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
        for i, k in enumerate(at):
            run, j = runs[k // 16], k % 16
            paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
        at = [k // 16 for k in at]
        nodes = [H("".join(run)) for run in runs]
    return nodes[0], paths


def brute(rows):
    def leaf(i, source, lang, n, text):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    by_source = {}
    for i, text, lang, source, n in rows:
        own = leaf(i, source, lang, n, text)
        hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        claimed = leaf(i, source, lang, n, text.translate(lower) if text is not None else None) if hit else own
        by_source.setdefault(source, []).append(((i is not None, i or 0), own, claimed, i))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([r[1] for r in sorted(by_source[s], key=lambda r: r[:3])]) for s in order}
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for r, path in zip(sorted(by_source[s], key=lambda r: r[:3]), trees[s][1]):
            path, h = [*path, *tops[k]], r[2]
            for before, after in path:
                h = H(before + h + after)
            out.append((r[3], r[1], trees[s][0], root, H("".join(b + a for b, a in path)), h, h == root))
    return sorted(out, key=str)


def table(n):
    rng = random.Random(n)
    rows = [(i, f"Text {i} É" if i % 7 else None, rng.choice(["en", None]), rng.choice(["hot"] * 6 + ["b", "é", "z", None]), i) for i in range(n)]
    rows += [(5, "Text 5 É", "en", "hot", 5)] * 3 + [(None, "A", "en", "hot", None), (None, "", None, None, 0), (n + 5, "Only one", "en", "lone", 1), (-3, "B" * 200_000, "en", "lone two", 1)]
    return rows


@pytest.mark.parametrize("n, chunk, upper", [(0, 4096, 3), (16, 4096, 3), (700, 4096, 3), (700, 48, 1), (700, 7, 0), (700, 1, 2)])
def test_proofs(spark, monkeypatch, n, chunk, upper):
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    monkeypatch.setattr(merkle, "UPPER", upper)
    rows = table(n)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, leaf int, chunk int")
    got = sorted((tuple(r) for r in merkle.proofs(merkle.tampered_documents(df), "claimed").collect()), key=str)
    assert got == brute(rows)


def test_many_sources_and_none(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(merkle, "CHUNK", 50)
    rows = [(i, f"T{i}", "en", f"s{i % 300}", 3) for i in range(620)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted((tuple(r) for r in merkle.proofs(merkle.tampered_documents(df), "claimed").collect()), key=str) == brute(rows)
    assert merkle.proofs(merkle.tampered_documents(df.limit(0)), "claimed").count() == 0


def test_missing_nodes_are_fewest():
    """Every node that is asked for is needed, and with them the root can be worked out, for any set of leaves."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 16, 17, 255, 256, 257, 5000):
        for _ in range(20):
            known = np.unique(rng.integers(0, n, rng.integers(1, 40)))
            levels, size, have = dict(merkle.missing(known, n)), n, set(known.tolist())
            for level in range(merkle.height(n)):
                lacking = set(levels.get(level, np.zeros(0, int)).tolist())
                runs = {i // merkle.FAN for i in have}
                assert not lacking & have and {i // merkle.FAN for i in lacking} <= runs
                assert have | lacking == {i for r in runs for i in range(r * merkle.FAN, min(size, (r + 1) * merkle.FAN))}
                have, size = runs, -(-size // merkle.FAN)
            assert size == 1 and have == {0}


def test_tampered_rows_alone_fail(spark):
    rows = [(i, "Upper" if i % 2 else "lower", "en", "s", 5) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    failed = {r.id for r in merkle.proofs(merkle.tampered_documents(df), "claimed").collect() if not r.verified}
    assert failed == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0 and i % 2}
    assert all(r.verified for r in merkle.proofs(merkle.tampered_documents(df).drop("claimed")).collect())
