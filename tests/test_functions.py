"""Golden values of statistics and formats."""

import math

import pytest
from pyspark.sql import functions as F

from tapewright.functions import fmt, stats


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs]).cast("array<double>")


def lit(x):
    return F.lit(None if x is None else float(x)).cast("double")


def statistics_cases():
    return [
        (stats.slippage_bps(lit(1000000), lit(1001100)), 11),
        (stats.slippage_bps(lit(1000000), lit(999000)), -10),
        (stats.slippage_bps(lit(0), lit(500000)), 0),
        (stats.one_sidedness(lit(80), lit(20)), 0.8),
        (stats.one_sidedness(lit(0), lit(0)), 0),
        (stats.percent_of(lit(10000), lit(50000)), 20),
        (stats.percent_of(lit(1), lit(0)), None),
        (stats.median(arr(3, 1, 2)), 2),
        (stats.median(arr(1, 2, 3, 4)), 2.5),
        (stats.mad(arr(1, 2, 3, 4, 5)), 1),
        (stats.robust_z(lit(10), lit(4), lit(1)), 6 / 1.4826),
        (stats.robust_z(lit(10), lit(4), lit(0)), 0),
        (stats.percentile_rank(arr(1, 2, 3, 4), lit(5)), 100),
        (stats.percentile_rank(arr(1, 2, 3, 4), lit(2)), 25),
        (stats.variation(arr(2, 2, 2)), 0),
        (stats.variation(arr(1, 2, 3, 4, 5)), 0.5270463),
        (stats.variation(arr(5)), None),
        (stats.variation(arr(-1, 1)), None),
        (stats.reversion(lit(100), lit(110), lit(102)), 0.8),
        (stats.reversion(lit(100), lit(100), lit(102)), None),
        (stats.effective_spread_bps(lit(100.05), lit(100)), 10),
        (stats.order_to_trade(lit(131), lit(0)), math.inf),
        (stats.order_to_trade(lit(100), lit(4)), 25),
        (stats.order_to_trade(lit(0), lit(0)), None),
        (stats.realized_volatility(arr(100, 110, 100)), math.sqrt(2 * math.log(1.1) ** 2)),
        (stats.jump_ratio(arr(2, 2, 2, 2, 2)), 0),
        (stats.jump_ratio(arr(0, 0, 5, 0, 0)), 1),
        (stats.concentration(arr(1, 1, 1, 1)), 0.25),
        (stats.concentration(arr(10, 0, 0)), 1),
        (stats.normalised_entropy(arr(1, 1, 1)), 1),
        (stats.normalised_entropy(arr(1)), None),
        (stats.autocorrelation(arr(1, 2, 3, 4, 5)), 0.4),
        (stats.autocorrelation(arr(1, -1, 1, -1)), -0.75),
        (stats.cusum(arr(0, 0, 0, 5, 5, 5)), 0.5),
        (stats.cusum(arr(1, 1, 1)), None),
        (stats.branching_ratio(lit(4)), 0.5),
        (stats.branching_ratio(lit(1)), None),
        (stats.flow_imbalance(lit(100), lit(0), lit(0), lit(0)), 1),
        (stats.flow_imbalance(lit(50), lit(0), lit(50), lit(0)), 0),
        (stats.vpin(lit(80), lit(20)), 0.6),
        (stats.fano(arr(*range(10)), 5), 0),
        (stats.fano(arr(7), 5), None),
        (fmt.rounded(lit(2.5), 0), 3),
    ]

NS = 1_000_000_000
UTC = 1778457600 * NS  # 2026-05-11 00:00 UTC, in New York's summer
MINUTE = 60 * NS
def text_cases():
    return [
        (fmt.duration(F.lit(999)), "999 ns"),
        (fmt.duration(F.lit(12_340)), "12.34 μs"),
        (fmt.duration(F.lit(65 * NS)), "1m 5s"),
        (fmt.duration(F.lit(5400 * NS)), "1h 30m"),
        (fmt.duration(F.lit(-1)), "unknown"),
        (fmt.duration_words(F.lit(1)), "1 second"),
        (fmt.duration_words(F.lit(65)), "1 minute 5 seconds"),
        (fmt.duration_words(F.lit(300)), "5 minutes"),
        (fmt.duration_words(F.lit(5400)), "1 hour 30 minutes"),
        (fmt.halt_span(F.lit(UTC + 660 * MINUTE), F.lit(UTC + 1050 * MINUTE)), "starting in pre-market trading and resuming around midday"),
        (fmt.halt_span(F.lit(UTC + 990 * MINUTE), F.lit(UTC + 1050 * MINUTE)), "lasting through midday"),
        (fmt.halt_reason(F.lit("LUDP")), "LULD price-band halt"),
        (fmt.halt_reason(F.lit(None).cast("string")), "trading halt"),
        (fmt.dollars(F.lit(1047129.4)), "$1,047,129.40"),
        (fmt.thousands(F.lit(2377027)), "2,377,027"),
        (fmt.company(F.lit("Broadcom Inc. - Common Stock")), "Broadcom Inc."),
        (fmt.company(F.lit("Toast, Inc. Class A Common Stock")), "Toast, Inc."),
        (fmt.company(F.lit("Accenture plc Class A Ordinary Shares (Ireland)")), "Accenture plc"),
        (fmt.company(F.lit("Invesco QQQ Trust, Series 1")), "Invesco QQQ Trust"),
        (fmt.company(F.lit("Vanguard Russell 2000 ETF")), "Vanguard Russell 2000 ETF"),
        (fmt.listed(F.array(*map(F.lit, "abcde"))), "a, b, c and 2 others"),
        (fmt.listed(F.array(*map(F.lit, "abc"))), "a, b and c"),
        (fmt.ordinal(F.lit(112)), "112th"),
        (fmt.retention_boundary(F.lit("2026-05-27").cast("date"), 2).cast("string"), "2026-05-11"),
        (fmt.retention_boundary(F.lit("2026-06-01").cast("date"), 2).cast("string"), "2026-05-18"),
    ]


def test_statistics(spark):
    STATS = statistics_cases()
    row = spark.range(1).select(*[c.cast("double").alias(f"c{k}") for k, (c, _) in enumerate(STATS)]).first()
    for k, (_, want) in enumerate(STATS):
        assert row[k] is None if want is None else row[k] == pytest.approx(want, abs=1e-6), k


def test_texts(spark):
    TEXTS = text_cases()
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(TEXTS)]).first()
    assert list(row) == [want for _, want in TEXTS]


@pytest.mark.parametrize("minute,weight", [(812, 1.10), (960, 0.98), (1196, 1.10), (660, 0.95), (360, 0.80)])
def test_phase_weights(spark, minute, weight):
    assert spark.range(1).select(fmt.phase_weight(F.lit(UTC + minute * MINUTE))).first()[0] == weight
