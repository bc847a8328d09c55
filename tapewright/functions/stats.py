"""Market-structure statistics as column builders.

Functions of one sample take an array column of doubles in its own order;
undefined results are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _mean(xs: Column) -> Column:
    return _total(xs) / F.size(xs)


def _squares(xs: Column) -> Column:
    m = _mean(xs)
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))


def _steps(xs: Column) -> Column:
    """Pairs (a, b) of neighbours."""
    n = F.size(xs)
    return F.when(n < 2, F.array().cast("array<struct<a:double,b:double>>")).otherwise(
        F.arrays_zip(F.slice(xs, F.lit(1), F.greatest(n - 1, F.lit(1))).alias("a"), F.slice(xs, F.lit(2), F.greatest(n - 1, F.lit(1))).alias("b")).cast("array<struct<a:double,b:double>>")
    )


def slippage_bps(first: Column, last: Column) -> Column:
    return F.when(first <= 0, 0.0).otherwise((last - first) / first * 10_000.0)


def one_sidedness(buys: Column, sells: Column) -> Column:
    both = buys + sells
    return F.when(both == 0, 0.0).otherwise(F.greatest(buys, sells) / both)


def dominant_side(buys: Column, sells: Column) -> Column:
    return F.when(buys + sells == 0, "none").when(buys > sells, "buy").when(sells > buys, "sell").otherwise("balanced")


def percent_of(value: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, value / baseline * 100.0)


def robust_z(value: Column, median: Column, mad: Column) -> Column:
    return F.when(mad > 0, (value - median) / (1.4826 * mad)).otherwise(0.0)


def median(xs: Column) -> Column:
    s, n = F.sort_array(xs), F.size(xs)
    at = lambda k: F.element_at(s, F.greatest(k.cast("int"), F.lit(1)))
    return F.when(n == 0, F.lit(None)).when(n % 2 == 1, at(F.floor(n / 2) + 1)).otherwise((at(F.floor(n / 2)) + at(F.floor(n / 2) + 1)) / 2)


def mad(xs: Column) -> Column:
    m = median(xs)
    return median(F.transform(xs, lambda x: F.abs(x - m)))


def percentile_rank(xs: Column, value: Column) -> Column:
    return F.when(F.size(xs) > 0, F.size(F.filter(xs, lambda x: x < value)) * 100.0 / F.size(xs))


def variation(xs: Column) -> Column:
    """Coefficient of variation, with the sample's standard deviation."""
    n, m = F.size(xs), _mean(xs)
    return F.when((n >= 2) & (m > 0), F.sqrt(_squares(xs) / (n - 1)) / m)


def reversion(before: Column, peak: Column, after: Column) -> Column:
    """Share of a price move that is taken back."""
    return F.when(F.abs(peak - before) > 1e-9, (peak - after) / (peak - before))


def effective_spread_bps(price: Column, mid: Column) -> Column:
    return F.when(mid > 0, 2 * F.abs(price - mid) / mid * 10_000.0)


def order_to_trade(orders: Column, trades: Column) -> Column:
    return F.when(trades > 0, orders / trades).when(orders > 0, float("inf"))


def realized_volatility(prices: Column) -> Column:
    moves = F.transform(F.filter(_steps(prices), lambda p: (p["a"] > 0) & (p["b"] > 0)), lambda p: F.log(p["b"] / p["a"]))
    return F.sqrt(F.aggregate(moves, F.lit(0.0), lambda a, x: a + x * x))


def jump_ratio(returns: Column) -> Column:
    """Share of the variance that neighbouring moves don't explain, from 0 to 1."""
    variance = F.aggregate(returns, F.lit(0.0), lambda a, x: a + x * x)
    smooth = F.aggregate(_steps(returns), F.lit(0.0), lambda a, p: a + F.abs(p["a"]) * F.abs(p["b"])) * (3.141592653589793 / 2)
    return F.when((F.size(returns) >= 3) & (variance > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - smooth / variance)))


def fano(times: Column, bins: int) -> Column:
    """Variance over mean of the counts in equal bins of time; the last bin is closed."""
    low, n = F.array_min(times), F.size(times)
    span = F.array_max(times) - low
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(times, lambda t: F.least(F.floor((t - low) / span * bins), F.lit(bins - 1)) == b)))
    mean = n / F.lit(float(bins))
    return F.when((n >= 2) & (span > 0) & F.lit(bins >= 2), (F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) / bins - mean * mean) / mean)


def concentration(counts: Column) -> Column:
    """Herfindahl index."""
    total = _total(counts)
    return F.when(total > 0, F.aggregate(counts, F.lit(0.0), lambda a, x: a + (x / total) * (x / total)))


def entropy(counts: Column) -> Column:
    """Entropy in nats."""
    total = _total(counts)
    return F.when(total > 0, F.aggregate(F.filter(counts, lambda x: x > 0), F.lit(0.0), lambda a, x: a - x / total * F.log(x / total)))


def normalised_entropy(counts: Column) -> Column:
    return F.when(F.size(counts) >= 2, entropy(counts) / F.log(F.size(counts).cast("double")))


def autocorrelation(xs: Column) -> Column:
    m, ss = _mean(xs), _squares(xs)
    return F.when((F.size(xs) >= 3) & (ss > 0), F.aggregate(_steps(xs), F.lit(0.0), lambda a, p: a + (p["a"] - m) * (p["b"] - m)) / ss)


def cusum(xs: Column) -> Column:
    """Largest distance of the running sum of deviations from 0, over n population standard deviations."""
    n, m = F.size(xs), _mean(xs)
    sd = F.sqrt(_squares(xs) / n)
    walk = F.aggregate(xs, F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("top")), lambda a, x: F.struct((a["at"] + x - m).alias("at"), F.greatest(a["top"], F.abs(a["at"] + x - m)).alias("top")), lambda a: a["top"])
    return F.when((n >= 2) & (sd > 0), walk / (n * sd))


def branching_ratio(fano_factor: Column) -> Column:
    return F.when(fano_factor > 1, F.least(F.lit(0.999), 1 - 1 / F.sqrt(fano_factor)))


def fano_class(f: Column) -> Column:
    return F.when(f > 5, "highly").when(f > 2, "moderately").when(f > 1, "weakly")


def lean_class(value: Column, up: str, down: str) -> Column:
    """up beyond 0.1, down below -0.1, else balanced; null for null."""
    return F.when(value > 0.1, up).when(value < -0.1, down).when(value.isNotNull(), "balanced")


def flow_class(imbalance: Column) -> Column:
    return lean_class(imbalance, "buyer-leaning", "seller-leaning")


def depth_class(imbalance: Column) -> Column:
    return lean_class(imbalance, "bid-skewed", "ask-skewed")


def flow_imbalance(bid_added: Column, bid_removed: Column, ask_added: Column, ask_removed: Column) -> Column:
    total = bid_added + bid_removed + ask_added + ask_removed
    return F.when(total > 0, ((bid_added - bid_removed) - (ask_added - ask_removed)) / total)


def vpin(buys: Column, sells: Column) -> Column:
    return F.when(buys + sells > 0, F.abs(buys - sells) / (buys + sells))


def depth_imbalance(bid: Column, ask: Column) -> Column:
    return F.when(bid + ask > 0, (bid - ask) / (bid + ask))
