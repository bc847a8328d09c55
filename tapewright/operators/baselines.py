"""What a symbol's volume and order lifetime usually are: of one day, and over trailing days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import lifecycle as lc


class Baselines:
    """Baselines from daily tables (day, symbol, total_volume; day, symbol, avg_lifetime_ns, order_count).

    Each gives a table that is met by day and symbol, so a detector asks for all
    its symbols at once.
    """

    def __init__(self, volumes: DataFrame, lifetimes: DataFrame):
        self._daily = {"volume": (volumes, "total_volume"), "lifetime": (lifetimes, "avg_lifetime_ns")}

    def day(self, kind: str) -> DataFrame:
        """day, symbol, value of every day."""
        rows, value = self._daily[kind]
        return rows.select("day", "symbol", F.col(value).alias("value"))

    def trailing_window(self, kind: str, days: int = 14) -> DataFrame:
        """day, symbol, value, and n_days and values of the calendar days before."""
        rows, value = self._daily[kind]
        return lc.trailing(rows, value, days).select("day", "symbol", F.col(value).alias("value"), "n_days", "values")

    def trailing_median(self, kind: str, days: int = 14, least_days: int = 1) -> DataFrame:
        """day, symbol, value, n_days and the median of the calendar days before; days with too few before them are left out."""
        window = self.trailing_window(kind, days).filter(F.col("n_days") >= least_days)
        return window.select("day", "symbol", "value", "n_days", stats.median(F.col("values")).alias("median"))
