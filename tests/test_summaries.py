"""Queries of summaries over made-up events, where the driver's tables are too small."""

from tapewright.plans import summaries


def test_bullets_of_busy_days(spark, monkeypatch):
    rows = "select date '2024-03-01' + cast(id >= 1234 as int) trading_date, id event_id, 'SYM' || id % 3 symbol, 'sweep' scorer_id, cast(id as double) score, id ts_nanos from range(1244)"
    monkeypatch.setattr(summaries.ev, "events", lambda spark, sf_dir: spark.sql(rows))
    got = {str(r.trading_date): r.bullet for r in summaries.day_bullets(spark, "").collect()}
    assert set(got) == {"2024-03-01", "2024-03-02"}
    assert got["2024-03-01"].startswith("1,234 events on 3 symbols") and got["2024-03-02"].startswith("10 events on 3 symbols")


def test_fano_collects_no_symbol(spark, monkeypatch):
    rows = "select 'S' || id % 2 symbol, cast(id * id as bigint) ts_nanos from range(400) union all select 'ONE', 5L union all select 'SAME', 7L from range(3)"
    monkeypatch.setattr(summaries.fx, "trades", lambda spark, sf_dir: spark.sql(rows))
    found = summaries.fano(spark, "")
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.symbol: (r.n, r.fano) for r in found.collect()}
    assert got["ONE"] == (1, None) and got["SAME"] == (3, None)
    for odd in (0, 1):
        times = [k * k for k in range(odd, 400, 2)]
        bins = [0] * 10
        for t in times:
            bins[min(9, int((t - times[0]) / (times[-1] - times[0]) * 10))] += 1
        want = (sum(c * c for c in bins) / 10 - 400) / 20
        assert got[f"S{odd}"][0] == 200 and abs(float(got[f"S{odd}"][1]) - want) < 1e-5
