"""Tables on files: reading, staleness, and writing what is stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.numbers import stale_by_days, stale_by_hours
from quillspark.functions.text import strip
from quillspark.schemas import STALE_DAYS, TABLES


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A parquet table of the test layout."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def load(spark: SparkSession, root: str, name: str, date_from=None) -> DataFrame:
    """A declared table, from a date on. Names that are not declared are errors, and so are tables without files."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(sorted(TABLES))}")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        raise FileNotFoundError(f"{root}/{name}")
    df = spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")
    return df if date_from is None else df.where(F.col("date") >= F.lit(date_from))


def symbols(bars: DataFrame) -> DataFrame:
    """Distinct tickers; the scan reads that column alone."""
    return bars.select("ticker").distinct()


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """(ticker) of a text list: comments after ``#`` and blank lines are dropped."""
    return watchlist_lines(spark.read.text(path))


def watchlist_lines(text: DataFrame) -> DataFrame:
    ticker = F.upper(strip(F.split_part("value", F.lit("#"), F.lit(1))))
    return text.select(ticker.alias("ticker")).where("ticker <> ''")


def write_watchlist(tickers: DataFrame, path: str) -> None:
    tickers.orderBy("ticker").select(F.col("ticker").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def keyed_json(text: DataFrame, value_schema: str, body: str = "body") -> DataFrame:
    """(key, value) of JSON objects keyed by ticker."""
    return text.select(F.explode(F.from_json(body, f"map<string,{value_schema}>")).alias("key", "value"))


def write_side_file(rows: DataFrame, path: str) -> None:
    """A small table (unmatched symbols, the ledger, metadata) as JSON lines in one file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def stale(control: DataFrame, names: DataFrame, now: Column, freq: str | None = None, hours: float | None = None, force: bool = False) -> DataFrame:
    """Which of ``names`` are to be built again: by UTC dates for a frequency (unknown ones are daily), or by hours of age."""
    both = names.join(control, "name", "left")
    old = stale_by_hours(F.col("written_at"), now, hours) if hours is not None else stale_by_days(F.col("written_at"), now, STALE_DAYS.get(freq, 1))
    return both.select("name", (old | F.lit(force)).alias("stale"))


def mark_written(control: DataFrame, name: str, now: Column) -> DataFrame:
    """The control table after ``name`` was written, which must be done only once its data are durable."""
    row = control.sparkSession.range(1).select(F.lit(name).alias("name"), now.alias("written_at"))
    return control.where(F.col("name") != name).unionByName(row)
