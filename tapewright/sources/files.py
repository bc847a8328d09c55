"""Reference-data files: listings, titles and closing prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.patterns import first_rows

# Exchange codes of listing files.
EXCHANGES = {"A": "NYSE MKT", "N": "NYSE", "P": "NYSE Arca", "Z": "Cboe BZX", "V": "IEX"}


def read_listing(spark: SparkSession, path: str, symbol: str = "Symbol", name: str = "Security Name", exchange: str | None = None) -> DataFrame:
    """symbol, company_name, listing_exchange, is_etf, round_lot of a pipe-delimited listing, without test issues and the trailer."""
    raw = spark.read.csv(path, sep="|", header=True)
    if symbol not in raw.columns or len(raw.columns) < 7:
        raise ValueError(f"{path} is no listing: {raw.columns}")
    rows = raw.filter(~F.col(symbol).startswith("File Creation Time") & (F.trim(F.coalesce("Test Issue", F.lit("N"))) != "Y"))
    codes = F.create_map(*[F.lit(x) for pair in EXCHANGES.items() for x in pair])
    where = F.coalesce(codes[F.trim(exchange)], F.trim(exchange)) if exchange else F.lit("NASDAQ")
    return rows.select(F.trim(symbol).alias("symbol"), F.trim(name).alias("company_name"), where.alias("listing_exchange"), (F.trim("ETF") == "Y").alias("is_etf"), F.trim("Round Lot Size").cast("int").alias("round_lot"))


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """ticker and title of a JSON object of objects."""
    raw = spark.read.text(path, wholetext=True)  # one small reference file
    return raw.select(F.explode(F.map_values(F.from_json("value", "map<string,struct<ticker:string,title:string>>"))).alias("x")).select("x.ticker", "x.title")


def merge_symbols(listings: list[DataFrame], titles: DataFrame, securities: DataFrame | None = None) -> DataFrame:
    """Listings in order of precedence, overlaid by titles of known tickers, then by the latest security record (symbol, ts_nanos, round_lot_size)."""
    union = None
    for k, listing in enumerate(listings):
        part = listing.withColumn("__order", F.lit(k))
        union = part if union is None else union.unionByName(part)
    known = first_rows(union, ["symbol"], ["__order"]).drop("__order")
    titled = known.join(titles.groupBy(F.col("ticker").alias("symbol")).agg(F.min("title").alias("title")), "symbol", "left").withColumn("company_name", F.coalesce("title", "company_name")).drop("title")
    if securities is None:
        return titled
    latest = securities.groupBy("symbol").agg(F.max_by("round_lot_size", "ts_nanos").alias("lot"))
    return titled.join(latest, "symbol", "left").withColumn("round_lot", F.coalesce("lot", "round_lot")).drop("lot")


def recent_records(securities: DataFrame, today: str, days: int = 60) -> DataFrame:
    """Security records (symbol, ts_nanos, ...) of the days up to today: older ones no longer say anything about a symbol."""
    end = (F.datediff(F.lit(today).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") + 1) * 86_400_000_000_000
    return securities.filter((F.col("ts_nanos") < end) & (F.col("ts_nanos") >= end - (days + 1) * 86_400_000_000_000))


def prior_close(trades: DataFrame) -> DataFrame:
    """The last trade's price of each symbol."""
    return trades.groupBy("symbol").agg(F.max_by("price_raw", F.struct("ts_nanos", "seq")).alias("price_raw"))


def write_prior_close(closes: DataFrame, path: str) -> None:
    closes.select("symbol", "price_raw").coalesce(1).sortWithinPartitions("symbol").write.mode("overwrite").csv(path, header=True)  # one row for each symbol


def read_prior_close(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("symbol string, price_raw bigint").csv(path, header=True)
