"""Stored periods, retention, facts of any depth and verdicts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tapewright.functions import fmt
from tapewright.operators import periods
from tapewright.operators import textcheck as tc

LEVELS = [periods.Level("week", "day", fmt.week_start), periods.Level("quarter", "week", fmt.quarter_start, 2), periods.Level("year", "quarter", fmt.year_start)]


def day_rows(spark, table):
    return spark.createDataFrame([(d, k, m, n) for d, rows in table.items() for (k, m), n in rows.items()], "trading_date date, kind string, member string, n bigint")


def test_refresh_touches_what_changed_alone(spark, tmp_path):
    store, start = periods.Store(spark, str(tmp_path / "store")), dt.date(2024, 1, 1)
    table = {start + dt.timedelta(7 * w + d): {("scorer", "sweep"): w + d + 1, ("symbol", f"S{d}"): 5, ("symbol", "T"): w} for w in range(3) for d in range(2)}
    verified = spark.createDataFrame([("day", d) for d in table] + [("week", start + dt.timedelta(7 * w)) for w in range(3)] + [("quarter", start)], "level string, period date")
    acts = lambda done: sorted((r.level, r.period, r.action) for r in done.collect())
    first = acts(periods.refresh(store, day_rows(spark, table), verified, LEVELS))
    assert len(first) == 6 + 3 + 1 + 1 and all(a == "rewritten" for *_, a in first)
    assert acts(periods.refresh(store, day_rows(spark, table), verified, LEVELS)) == []
    day = start + dt.timedelta(8)
    table[day]["scorer", "sweep"] = 100
    assert acts(periods.refresh(store, day_rows(spark, table), verified, LEVELS)) == sorted([("day", day, "rewritten"), ("week", start + dt.timedelta(7), "rewritten"), ("quarter", start, "rewritten"), ("year", start, "rewritten")])
    year = {(r.kind, r.member): r.n for r in store.rows("year").collect()}
    assert year["scorer", "sweep"] == sum(rows["scorer", "sweep"] for rows in table.values())
    # With one verified week left, the quarter has too few; its year goes with it.
    few = verified.filter("level != 'week' or period = date'2024-01-01'")
    table[day]["scorer", "sweep"] = 101
    assert acts(periods.refresh(store, day_rows(spark, table), few, LEVELS)) == sorted([("day", day, "rewritten"), ("week", start + dt.timedelta(7), "rewritten"), ("quarter", start, "dropped"), ("year", start, "dropped")])
    assert store.rows("quarter").count() == 0 and store.rows("year").count() == 0
    del table[start]
    assert ("day", start, "dropped") in acts(periods.refresh(store, day_rows(spark, table), verified, LEVELS))


def test_hash_of_a_set_of_rows(spark):
    rows = [("k", "a", "b"), ("k", "ab", ""), ("k", None, "x"), ("l", "a", "b")] + [("m", str(n), None) for n in range(1000)]
    of = lambda r: {x.key: x.content_hash for x in periods.chunked_hash(spark.createDataFrame(r, "key string, p string, q string"), ["key"], ["p", "q"]).collect()}
    one = of(rows)
    assert one == of(rows[::-1]) and len(set(one.values())) == 3
    for changed in ([("k", "a", "b"), ("k", "a", "b"), ("k", None, "x")], [("k", "a", "b"), ("k", "ab", None), ("k", None, "x")]):
        assert of(changed)["k"] != one["k"]


def test_a_sweep_without_policy_deletes_nothing(spark, tmp_path):
    spark.createDataFrame([("2024-01-01", 1)], "trading_date string, n int").write.partitionBy("trading_date").parquet(str(tmp_path / "wire"))
    with pytest.raises(ValueError, match="no policy for odd"):
        periods.sweep(spark, {"wire": ("wire", str(tmp_path / "wire")), "odd": ("cache", str(tmp_path / "odd"))}, "2024-06-01", 1)
    assert periods.partition_days(spark, str(tmp_path / "wire")) == ["2024-01-01"]
    swept = periods.sweep(spark, {"wire": ("wire", str(tmp_path / "wire")), "none": ("derived", str(tmp_path / "none"))}, "2024-06-01", 1)
    assert [tuple(r) for r in swept.collect()] == [("wire", dt.date(2024, 1, 1))] and periods.partition_days(spark, str(tmp_path / "wire")) == []


def nodes(value, path="$"):
    inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in inner:
        at = f"{path}.{k}" if isinstance(value, dict) else f"{path}[{k}]"
        yield at, v
        yield from nodes(v, at)


def test_nodes_of_any_depth(spark):
    deep = {"a": 1}
    for k in range(12):
        deep = {"b": [deep, {"c": f"x{k} }}]["}]}
    texts = [json.dumps(deep), '{"a":{},"b":[],"c":null,"d":[[1,[true]],"s"]}', "[1,2]", "no json {", None, "7", "{}"]
    got = {}
    for r in tc.json_nodes(spark.createDataFrame(list(enumerate(texts)), "doc_id int, facts string")).collect():
        got.setdefault(r.doc_id, {})[r.path] = r.value
    for k, text in enumerate(texts):
        try:
            value = json.loads(text or "no")
        except ValueError:
            value = None
        want = {p: None if isinstance(v, (dict, list)) or v is None else str(v).lower() if isinstance(v, bool) else str(v) for p, v in nodes(value)}
        assert got.get(k, {}) == want


def test_verdicts(spark):
    texts = [None, "", "It spoofs", "a 2nd straight week", "a tenth consecutive week", "seen 1,200 and 7 times in 2025", "seen 1,201 times", "bad \x07"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("v", tc.verdict(F.col("text"), F.array(F.lit("1200")), F.lit(2)))
    got = {r.doc_id: [name for name, ok in r.v.asDict().items() if not ok] for r in df.collect()}
    assert got == {0: [], 1: [], 2: ["intent"], 3: [], 4: ["streak"], 5: [], 6: ["numbers"], 7: ["characters"]}
    stored = df.select("doc_id", F.struct(F.lit(True).alias("intent"), F.lit(False).alias("streak")).alias("verdict"))
    changes = {(r.doc_id, r.check_name): r.change for r in tc.changed_verdicts(stored, df.select("doc_id", F.col("v").alias("verdict"))).collect()}
    assert changes[2, "intent"] == "regressed" and changes[0, "streak"] == "mended" and (4, "streak") not in changes


def test_texts_are_read_once_whatever_their_depth(spark):
    texts = ['{"a":[{"b":{"c":[1,null,"x"]}},[]],"d":{},"e":-1.50}', "7", "null", '"s"', "[]", "no json", None, '[[["y"]],{"k":true}]']
    nodes = tc.json_nodes(spark.createDataFrame(list(enumerate(texts)), "doc_id int, facts string"))
    assert nodes._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    got = {(r.doc_id, r.path): r.value for r in nodes.collect()}
    first = {"$.a": None, "$.a[0]": None, "$.a[0].b": None, "$.a[0].b.c": None, "$.a[0].b.c[0]": "1", "$.a[0].b.c[1]": None, "$.a[0].b.c[2]": "x", "$.a[1]": None, "$.d": None, "$.e": "-1.5"}
    last = {"$[0]": None, "$[0][0]": None, "$[0][0][0]": "y", "$[1]": None, "$[1].k": "true"}
    assert got == {**{(0, p): v for p, v in first.items()}, **{(7, p): v for p, v in last.items()}}
