"""Registered queries against their SQL in DuckDB. TAPEWRIGHT_ALL=1 runs all of them."""

import math
import os

import pytest

from tapewright.plans import registry

DATA = "/root/testdata/sf0.001"
SOME = ["order_lifecycle", "sweep_events", "layering_clusters", "halt_pairs", "robust_stats", "level_running_size", "protected_bbo", "price_path", "volume_reconcile", "prune_report", "number_grounding", "wire_decode_roundtrip", "fano", "asof_price", "word_numbers", "ticker_check", "company_agree", "streak_claims", "streak_phrases", "symbol_named", "stitched_texts"]
NAMES = sorted(registry.ORACLE_SQL) if os.environ.get("TAPEWRIGHT_ALL") else SOME
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{name}')")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert [x.replace("Decimal", "") for x in got] == [x.replace("Decimal", "") for x in want]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
