"""Secrets, languages, line labels, preferences and the pipeline."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import language_id, line_quality, preferences, secret_scan

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_secret_spans(spark):
    key, secret = "AKIA" + "ABCDEFGH12345678", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY01"
    texts = {
        1: f'id={key}\nsecret: "{secret}"\nhttps://api.example.com/v1',
        2: "see https://example.com/page and nothing else",
        3: "token=abc and password = longenough1, TOKEN : 'x.y_z-w=='",
        4: "é" * 9 + "0123456789abcdef01234567 user=someone",
        5: "far user=someone" + " " * 500 + "deadbeefdeadbeefdeadbeef",
        6: "",
        7: None,
        8: "secret=token:abcdefg api_key='123456' ſecret=abcdefgh",
        9: (f"{key} " + "0123456789abcdef01234567 ") * 300,
    }
    df = spark.createDataFrame([(k, v, "c") for k, v in texts.items()] + [(6, "", "c")], "doc_id bigint, text string, parts string")
    rows = collections.defaultdict(list)
    for r in secret_scan.digests(secret_scan.scan(df)).collect():
        rows[r.doc_id].append(r)
    assert {k: len(v) for k, v in rows.items()} == {**dict.fromkeys(texts, 1), 6: 2}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for k, text in texts.items():
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text or "") if len(m[2]) >= 6]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
        r = rows[k][0]
        assert r.base_sha256 == hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == n for s in spans) for n in range(3))
        assert {s for *_, s in spans} <= set(r.spans.split(","))
    kinds = lambda k: [s.split(":")[0] for s in rows[k][0].spans.split(",")]
    assert "endpoint" in kinds(1) and rows[2][0].spans == "" and kinds(4) == ["hex", "account"] and kinds(5) == ["hex"]
    masked = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert key not in masked[1] and secret not in masked[1] and masked[2] == texts[2] and masked[7] is None and masked[4].startswith("é" * 9 + "[secret]")
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_assigned_key_pairs_are_masked(spark):
    key, secret = "AKIA" + "IOSFODNN7EXAMPLE", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    texts = {
        1: f"AWS_ACCESS_KEY_ID={key}\nAWS_SECRET_ACCESS_KEY={secret}\n",
        2: f"aws_access_key_id = {key}, aws_secret_access_key = '{secret[:30]}'",
        3: f"The id is {key} and the key is {secret}.",
        4: f"DB_HOST=db.example.com and then {secret}",
        5: f"{secret} at HTTPS://db.example.com",
        6: f"id {key} with MY_KEY={secret}",
        7: f"AWS_SECRET_ACCESS_KEY={secret}",
        8: f"id {key} and a file {secret}.txt",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    masked = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    for k in (1, 2, 3, 4, 5, 6):
        assert key not in masked[k] and secret[:13] not in masked[k] and secret[14:30] not in masked[k], masked[k]
    assert masked[4].startswith("DB_[secret]") and masked[3] == "The id is [secret] and the key is [secret]."
    assert masked[7] == texts[7]  # a secret alone, its name isn't an account of its own
    assert masked[8].endswith(f"{secret}.txt")


def test_linking_equals_comparison_of_all_pairs(spark):
    rng = random.Random(11)
    pieces = ["AKIA" + "Q" * 20, "AKIASHORT", "user=somebody", "token=abc", "password: longenough", "https://a.example/x", "host=db.example.org", "deadbeef" * 4, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKE1", "secret access key = zzzzzzzz"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "\n", " x" * rng.choice([1, 20, 90, 120])]) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [(p.start, p.rank, p.end) for p in r.spans] for r in secret_scan.scan(df).collect()}
    role = lambda p: secret_scan.ROLE_OF[secret_scan.KINDS[p[1]]]
    weak_kept = 0
    for k, text in enumerate(texts):
        parts = secret_scan.parts_of(text)
        near = lambda w: any(role(o) != role(w) and "secret" in (role(o), role(w)) and o[0] < w[2] + secret_scan.SCOPE and o[2] > w[0] - secret_scan.SCOPE for o in parts)  # noqa: E731, B023
        want = [p for p in parts if p[1] < 3 or near(p)]
        weak_kept += sum(p[1] > 2 for p in want)
        assert got[k] == sorted(want), text
    assert weak_kept > 100


def test_names_beside_links_are_no_credentials(spark):
    texts = {1: "Write to user: john42 or see https://example.com/page for more.", 2: "account: standard, server: mail.example.org", 3: "client=acme endpoint: api.example.org access id: visitor", 4: "user: john42, password: abc at https://example.com"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    masked = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert all(masked[k] == texts[k] for k in (1, 2, 3)) and "john42" not in masked[4] and "abc" not in masked[4]


def test_masking_many_spans_and_clashing_columns(spark):
    text = "token=abcdefgh9 " * 40_000
    df = spark.createDataFrame([(None, text, 1, 2, 3, 4), (2, "nothing", 1, 2, 3, 4), (2, "nothing", 1, 2, 3, 4), (3, None, 1, 2, 3, 4)], "doc_id bigint, text string, key int, spans int, starts int, own1 int")
    got = secret_scan.redact(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert sorted((r.text or "")[:20] for r in rows) == ["", "[secret] [secret] [s", "nothing", "nothing"] and len(max((r.text or "" for r in rows), key=len)) == 9 * 40_000
    assert {(r.key, r.spans, r.starts, r.own1) for r in rows} == {(1, 2, 3, 4)}


def direct_probability(counts, context, symbol):
    """Interpolated Kneser-Ney by its definition, for one language's counts of the highest order."""
    levels = [dict(counts)]
    for _ in range(language_id.ORDER - 1):
        below = collections.Counter()
        for g in levels[-1]:
            below[g[1:]] += 1
        levels.append(dict(below))

    def p(k, context):
        if k == language_id.ORDER:
            return 1 / (len({g[-1] for g in counts}) + 1)
        grams = levels[k]
        once, twice = (sum(c == n for c in grams.values()) for n in (1, 2))
        d = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
        after = {g[-1]: c for g, c in grams.items() if g[:-1] == context}
        lower = p(k + 1, context[1:])
        if not after:
            return lower
        total = sum(after.values())
        return max(after.get(symbol, 0) - d, 0) / total + d * len(after) / total * lower

    return p(0, context)


def test_language_model_equals_direct_computation():
    rng, counts = random.Random(3), collections.Counter()
    for _ in range(200):
        padded = "^^^^" + "".join(rng.choice("aabcd") for _ in range(rng.randint(1, 6))) + "$"
        counts.update(padded[i : i + 5] for i in range(len(padded) - 4))
    model = language_id.build({"x": dict(counts)})
    for context, symbol in [("^^^^", "a"), ("^^ab", "c"), ("abca", "$"), ("dddd", "d"), ("zzab", "b"), ("zzzz", "a")]:
        assert np.isclose(model.probability(language_id._points([context + symbol]))[0, 0], direct_probability(counts, context, symbol))


@needs_data
def test_unlearned_languages_and_clashing_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    rng = random.Random(5)
    odd = {
        1: "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. " * 4,
        2: "Όλες οι ευτυχισμένες οικογένειες μοιάζουν, κάθε δυστυχισμένη οικογένεια είναι δυστυχισμένη με τον τρόπο της. " * 3,
        3: "吾輩は猫である名前はまだ無いどこで生れたかとんと見当がつかぬ" * 8,
        4: "".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(600)),
    }
    names = ["score", "n_symbols", "rejected", "lang_pred", "cross_entropy", "other_entropy", "own0", "__text", "Held"]
    rows = [(k, t, *[7] * len(names)) for k, t in odd.items()] + [(None, docs.filter("length(text) > 400 and lang = 'fr'").first().text, *[7] * len(names))] * 2
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = language_id.accepted(df, model)
    assert kept.columns == df.columns
    assert [(r.doc_id, *[r[n] for n in names]) for r in kept.collect()] == [(None, *[7] * len(names))] * 2
    found = language_id.identify(df, model, ["doc_id", "score", "rejected"])
    assert found.columns == ["doc_id", "own_score", "own_rejected", *language_id.RESULT_NAMES]
    assert {r.doc_id for r in found.filter("rejected").collect()} == set(odd) and {r.own_rejected for r in found.collect()} == {7}
    assert language_id.accepted(df.limit(0), model).count() == 0


def test_languages_of_one_row_or_of_long_rows_are_learned(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    langs = [f"l{k:02}" for k in range(23)]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    words = {lang: ["".join(rng.choice(letters[k : k + 4]) for _ in range(5)) for _ in range(30)] for k, lang in enumerate(langs)}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(ids[k], text(lang, 50), lang) for k, lang in enumerate(langs)] + [(ids[30 + k], text("l00", 30_000).replace("a", "z"), "long") for k in range(3)] + [(ids[40], "x y z", "often")] * 3000
    model = language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == sorted([*langs, "long", "often"])


def test_totals_of_long_texts_add_up(monkeypatch):
    counts = {"a": {"^^^^x": 5, "^^^xy": 4, "^^xy$": 2}, "b": {"^^^^y": 3, "^^^yx": 2, "^^yx$": 2}}
    model = language_id.build(counts)
    scorer = language_id.Scorer(model)
    texts = ["xy yx " * 50 + "x", None, "", "yx", "..", "xy"]
    want, sizes = scorer.totals(texts)
    monkeypatch.setattr(language_id, "CHUNK_WORDS", 2)
    got, again = scorer.totals(texts)
    assert np.allclose(got, want) and (sizes == again).all() and sizes.tolist() == [50 * 6 + 2, 0, 0, 3, 0, 3]
    one = {w: scorer.totals([w])[0][0] for w in ("xy", "yx", "x")}
    assert np.allclose(want[0], 50 * one["xy"] + 50 * one["yx"] + one["x"]) and not want[1].any()


def test_language_model_sums_to_one():
    counts = {"x": collections.Counter(), "y": collections.Counter()}
    rng = random.Random(1)
    for lang, letters in (("x", "abc"), ("y", "bcd")):
        for _ in range(300):
            padded = "^^^^" + "".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) + "$"
            counts[lang].update(padded[i : i + 5] for i in range(len(padded) - 4))
    model = language_id.build(counts)
    symbols = sorted({g[-1] for c in counts.values() for g in c})
    for context in ("^^^^", "^^ab", "abca", "zzzz"):
        p = model.probability(language_id._points([context + s for s in symbols])).sum(0)
        missing = model.probability(language_id._points([context + "?"]))[0]  # one place is kept for what was never seen
        assert np.allclose(p + missing, 1)
    scores, sizes = model.word_scores(["abc", "q"])
    assert sizes.tolist() == [4, 2] and scores[0, 0] > scores[0, 1]


@needs_data
def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    found = language_id.identify(docs.withColumn("held", language_id.held_out()), model, ["lang", "held"]).filter("held")
    assert found.filter("lang = lang_pred").count() >= 0.97 * found.count()
    assert found.filter("rejected").count() <= 0.01 * found.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ½²"), (4, "le " * 20000)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in language_id.identify(odd, model, ["doc_id"]).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and all(got[k].rejected and got[k].score == 0 for k in (1, 2, 3)) and got[4].lang_pred == "fr"
    none = language_id.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.identify(odd, none, ["doc_id"]).collect()} == {"und"}


def slow_windows(words):
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    return {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}


def slow_repeated(words):
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(inside)


def test_base_rules():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "c ", "d\n", "#x ", "\t", "é "]) for _ in range(rng.randint(0, 60)))
        (n, chars, symbols, dup, repeated), sizes, features = line_quality.measure(text)
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (n, chars, symbols, dup, repeated) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), slow_repeated(words))
        assert sum(sizes) == n and len(features) == len(lines)


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(30):
        field = line_quality.Field(rng.normal(size=4), rng.normal(size=(2, 2)), rng.normal(size=2))
        x = rng.normal(size=(6, 4))
        gain = x @ field.weights

        def score(y):
            return field.start[y[0]] + sum(field.change[a, b] for a, b in zip(y, y[1:])) + sum(g for g, s in zip(gain, y) if s)

        assert tuple(map(int, field.labels(x))) == max(product((0, 1), repeat=6), key=score)


def test_fit_is_a_maximum():
    from itertools import product

    rng, decay = np.random.default_rng(4), 1e-3
    sequences = [(np.column_stack([np.ones(n), rng.normal(size=(n, 2))]), rng.integers(0, 2, n)) for n in (4, 3, 5, 1)]
    field = line_quality.Field.fit(sequences, rounds=1500, rate=0.02)
    total = sum(len(y) for _, y in sequences)

    def objective(params):
        weights, change, start = params[:3], params[3:7].reshape(2, 2), params[7:]
        value = 0.0
        for x, y in sequences:
            gain = x @ weights
            score = lambda y: start[y[0]] + sum(change[a, b] for a, b in zip(y, y[1:])) + sum(g for g, s in zip(gain, y) if s)  # noqa: E731, B023
            value += score(y) - np.log(sum(np.exp(score(z)) for z in product((0, 1), repeat=len(y))))
        return value / total - decay / 2 * (params**2).sum()

    best = np.concatenate([field.weights, field.change.ravel(), field.start])
    for k in range(len(best)):
        for step in (-0.1, 0.1):
            moved = best.copy()
            moved[k] += step
            assert objective(moved) < objective(best) + 1e-5


@needs_data
def test_line_labels_part_good_from_bad(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learned = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    field = line_quality.train(docs, labels.filter(learned))
    labels = labels.filter(~learned)  # measured on labels kept out
    found = line_quality.with_verdict(line_quality.label(docs.withColumn("kept", F.lit(1)), field)).join(labels, "doc_id").filter("not base_failed")
    assert found.filter("quality = 1 and kept").count() >= 0.98 * found.filter("quality = 1").count()
    assert found.filter("quality = 0 and not kept").count() >= 0.9 * found.filter("quality = 0").count()
    assert line_quality.train(docs, labels.limit(0)) is None
    assert line_quality.label(docs.limit(0), field).count() == 0
    long = "\n".join(f"word{k} and some more of it." for k in range(60_000))
    same = spark.createDataFrame([(None, long), (None, long)], "doc_id bigint, text string")
    assert [(r.n_words, r.n_repeat_words) for r in line_quality.label(same, field).collect()] == [(360_000, len(slow_windows(long.split())))] * 2
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert [r.kept for r in line_quality.with_verdict(line_quality.label(empty, field)).collect()] == [False, False]


def slow_pairs(turns):
    out = {}
    sides = collections.defaultdict(lambda: {"chosen": [], "rejected": []})
    for pair, side, turn, role, text in turns:
        sides[pair][side].append((turn, role or "", text or "", role, text))
    for pair, both in sides.items():
        a, b = ([(x[3], x[4]) for x in sorted(both[s], key=lambda x: (x[0], x[3] is not None, x[1], x[4] is not None, x[2]))] for s in ("chosen", "rejected"))
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        for part, own in (("prompt", a[:n]), ("chosen", a[n:]), ("rejected", b[n:])):
            text, spans = "", []
            for role, body in own:
                head = f"<|{role or ''}|>\n"
                if part != "prompt" and role == "assistant":
                    spans.append(f"{len(text) + len(head)}:{len(text) + len(head) + len(body or '') + len('<|end|>')}")
                text += head + (body or "") + "<|end|>\n"
            if own:
                out[pair, part] = (len(own), text, ",".join(spans))
    return out


def test_preferences(spark, monkeypatch):
    rng, turns = random.Random(6), []
    for pair in range(60):
        for side in ("chosen", "rejected"):
            for turn in range(rng.randint(0, 6)):
                turns.append((pair, side, turn, rng.choice(["user", "assistant", "assistant", None]), rng.choice(["hi", "ho", "", None])))
    df = spark.createDataFrame(turns, "pair_id bigint, side string, turn bigint, role string, text string")
    got = {(r.pair_id, r.part): (r.n_turns, r.text, r.loss_spans) for r in preferences.format_pairs(df).collect()}
    assert got == slow_pairs(turns)
    monkeypatch.setattr(preferences, "CHUNK", 2)
    assert preferences._short_and_long(df, "pair_id")[1] is not None
    joined = collections.defaultdict(str)
    for r in preferences.format_pairs(df).orderBy("pair_id", "part", "chunk").collect():
        assert r.n_turns <= 2
        joined[r.pair_id, r.part] += r.text
    assert joined == {k: v[1] for k, v in slow_pairs(turns).items()}
    assert preferences.format_pairs(df.limit(0)).count() == 0


def test_pairs_made_from_conversations(spark, monkeypatch):
    rng, turns, pairs = random.Random(9), [], []
    for conv in range(-3, 40):
        own = [(k, rng.choice(["user", "assistant", "assistant", None]), rng.choice(["hi", "ho", "", None])) for k in range(rng.randint(0, 9))]
        own += own[-1:] * (conv % 4 == 1)  # a repeated turn
        turns += [(conv, *t) for t in own]
        answers = sorted({t[0] for t in own if t[1] == "assistant"})
        if not answers:
            continue
        at = next((t for t in answers if 4 * t >= (1 + conv % 4) * answers[-1]), answers[-1])
        earlier = [t for t in own if t[1] == "assistant" and t[0] < at]
        stale = max(earlier, key=lambda t: (t[0], t[2] is not None, t[2] or ""))[2] if earlier else None
        pairs += [(conv, "chosen", *t) for t in own]
        pairs += [(conv, "rejected", t[0], t[1], (stale or "") if t[0] == at and t[1] == "assistant" else t[2]) for t in own if t[0] <= at]
    turns += [(None, 1, "user", "x"), (5, None, "user", "x")]
    df = spark.createDataFrame([(*t, "p", 1) for t in turns], "conv_id bigint, turn bigint, role string, text string, part string, at int")
    want = slow_pairs(pairs)
    assert {(r.pair_id, r.part): (r.n_turns, r.text, r.loss_spans) for r in preferences.format_stale_answer_pairs(df).collect()} == want
    monkeypatch.setattr(preferences, "CHUNK", 4)
    joined = collections.defaultdict(str)
    for r in preferences.format_stale_answer_pairs(df).orderBy("pair_id", "part", "chunk").collect():
        joined[r.pair_id, r.part] += r.text
    assert joined == {k: v[1] for k, v in want.items()}


def test_equal_conversations_have_a_prompt_alone(spark):
    turns = [(1, side, k, "user" if k == 0 else "assistant", "same") for side in ("chosen", "rejected") for k in range(2)] + [(2, "chosen", 0, "user", "alone"), (3, "other", 0, "user", "x")]
    df = spark.createDataFrame(turns, "pair_id bigint, side string, turn bigint, role string, text string")
    assert sorted((r.pair_id, r.part) for r in preferences.format_pairs(df).collect()) == [(1, "prompt"), (2, "chosen")]


def test_stages_on_empty_and_odd_tables(spark):
    import corpus_pipeline

    rows = [(None, None, None, None, None, 1, 2), (1, "", "en", "s", 0, 1, 2), (2, "the same words here", "en", None, 19, 1, 2), (2, "the same words here", "en", None, 19, 1, 2), (3, "secret=abcdefgh", None, "s", 15, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, slot int")
    for name, stage in corpus_pipeline.STAGES[:4]:
        for docs in (df, df.limit(0)):
            out = stage(spark, docs, "")
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            n = out.count()
            assert n == {"language_id": 0, "ngram_join": 4, "secret_scan": 5, "mixing": 5}[name] * (docs is df), name  # no language is learned from so few rows, so every text is rejected
    assert corpus_pipeline.encode(spark, df, "").count() == 5
    assert not [p for p in corpus_pipeline._read_before.get() if "pipeline" in p]


@needs_data
def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, "en", "src0", 0), (900_002, "12345", "en", None, 5), (900_003, "token = abcdefgh1 and the rest of the text is here", "en", "src1", 50)], docs.schema)
    place = spark.conf.get("spark.checkpoint.dir") + "/pipeline-test"
    docs.unionByName(extra).write.mode("overwrite").parquet(f"{place}/documents.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, place).collect()}
    assert not {900_001, 900_002} & set(rows) and 900_003 in rows
    from tests.llm.test_joins import brute

    pairs = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert set(rows) - {900_003} == {pairs[g][0] for g, _ in brute(pairs)}
    from tapewright.llm import byte_bpe, queries

    own = byte_bpe.codec(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.pattern())
    texts = dict(pairs) | {900_003: "token = abcdefgh1 and the rest of the text is here"}
    spans = {r.doc_id: [(p.start, p.end) for p in r.spans] for r in secret_scan.scan(docs.unionByName(extra)).collect()}
    assert sum(bool(spans[k]) for k in rows) >= 1
    for k, r in rows.items():
        masked = secret_scan.masked(texts[k], spans[k])
        ids = np.frombuffer(own.encode(masked), "<i4").tolist()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(masked.encode()).hexdigest())
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages == ["language_id", "ngram_join", "secret_scan", "mixing", "byte_bpe"]
