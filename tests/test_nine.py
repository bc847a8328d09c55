"""The shared step of queries on all nine detectors does each part once, and only what is asked for."""

from datetime import date

from pyspark.sql import functions as F

from tapewright.operators import daybook
from tapewright.operators import detectors as dt
from tapewright.plans import facts, registry

SMALL = "/root/testdata/sf0.001"


def test_bursts_at_hand_give_the_same_events(spark):
    rows = [(date(2024, 1, 2), "A", k, "8", 1_000 + k * 10, 100 + k % 3, 10 + k, "deleted", 5 + k) for k in range(30)]
    life = spark.createDataFrame(rows, "trading_date date, symbol string, order_id long, side string, add_ts_nanos long, add_price_raw long, add_size int, terminal_state string, lifetime_ns long")
    bursts, least = dt.short_lived_bursts(life, least_orders=4), {"least_orders": 4}
    told = lambda df: [r.asDict(True) for r in df.collect()]
    assert told(dt.post_cancel_clusters(None, **least, bursts=bursts)) == told(dt.post_cancel_clusters(life, **least))
    assert told(dt.layering(None, **least, least_levels=3, bursts=bursts)) == told(dt.layering(life, **least, least_levels=3))
    few = dt.with_breakdown(dt.post_cancel_clusters(None, **least, bursts=dt.short_lived_bursts(life, **least, only=["n_rows"])), ["n_rows"]).collect()
    assert [(r.breakdown, r.source_refs) for r in few] == [('{"n_rows":30}', "[]")]


def test_facts_that_are_not_asked_for_are_not_worked_out(spark):
    rows = [(date(2024, 1, 2), "A", k, k, 10, 100 + k % 4, k) for k in range(12)]
    executed = spark.createDataFrame(rows, "trading_date date, symbol string, ts_nanos long, order_id long, size int, price_raw long, trade_id long")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan(dt.with_breakdown(dt.sweeps(executed)))
    assert "collect_list" not in plan(dt.with_breakdown(dt.sweeps(executed), daybook.TOLD_FACTS))


def test_the_strongest_are_chosen_before_they_are_told(spark):
    rows = [(date(2024, 1, 2), f"S{k % 3}", k % 2, "halt" if k % 2 else "sweep", float(k // 6), '{"n_levels":%d}' % k) for k in range(60)]
    events = spark.createDataFrame(rows, "trading_date date, symbol string, ts_nanos long, scorer_id string, score double, breakdown string")
    chosen = daybook.strongest(events, 5)
    assert chosen.count() < 10
    assert daybook.headlines(daybook.told(chosen)).collect() == daybook.headlines(daybook.told(events)).collect()


def test_the_lifecycle_and_the_bursts_are_worked_out_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(facts, "written", lambda df, name: names.append(name) or df)
    rows = facts._nine_events(spark, SMALL)
    assert names == ["lifecycle", "bursts"]
    assert rows.columns == [*dt.COMMON, "n_rows", "total_shares", "event_id"]
    assert rows.filter(F.col("event_id").isNull()).count() == 0
    assert "week_headlines" in registry.QUERIES
