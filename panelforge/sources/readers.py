"""Readers of the raw layouts, each with an explicit schema; broken files fail the read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import timeops as T

ARTICLE = "article_id string, title string, body string, timestamp long, pushes array<string>"
PRICE = "data array<struct<date:string,stock_id:string,Trading_Volume:bigint,Trading_money:bigint,open:double,max:double,min:double,close:double,Trading_turnover:bigint>>"
INSTITUTION = "data array<struct<date:string,stock_id:string,name:string,buy:bigint,sell:bigint>>"
REVENUE = "data array<struct<date:string,stock_id:string,revenue:double,revenue_month:int,revenue_year:int,revenue_yoy:double,revenue_mom:double,create_time:string>>"
POSITIONAL = "fields array<string>, data array<array<string>>"
NEWS = "items struct<data:array<struct<newsId:bigint,publishAt:bigint,title:string,content:string>>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST", recursiveFileLookup=True)


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Forum articles; a missing time is taken from a file name like ``M.1700000000.json``."""
    raw = _json(spark, path, ARTICLE).withColumn("file", F.col("_metadata.file_name"))
    named = F.regexp_extract("file", r"M\.(\d{10})\.", 1).try_cast("bigint")
    reply, cat = X.is_reply(F.col("title")), X.title_category(F.col("title"))
    out = raw.withColumns({"timestamp": F.coalesce("timestamp", named), "category": cat, "is_reply": reply, "effort": X.effort_tier(cat, reply), "n_pushes": F.coalesce(F.size("pushes"), F.lit(0))})
    return out.withColumn("posted_at", T.epoch_local(F.col("timestamp")))


def prices(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars; a zero price is missing."""
    rows = _json(spark, path, PRICE).select(F.explode("data").alias("d"))
    if rows.isEmpty():
        raise ValueError(f"no price rows under {path}")
    zero = lambda c: F.nullif(F.col(f"d.{c}"), F.lit(0.0))
    return rows.select(F.col("d.stock_id").alias("ticker"), F.to_date("d.date").alias("date"), zero("open").alias("open"), zero("max").alias("high"), zero("min").alias("low"), zero("close").alias("close"), F.col("d.Trading_Volume").alias("volume"), F.col("d.Trading_money").cast("double").alias("value"), F.col("d.Trading_turnover").alias("n_transactions"))


def institutions(spark: SparkSession, path: str) -> DataFrame:
    """Long buy/sell rows by investor -> inst_buy, inst_sell per entity and day."""
    rows = _json(spark, path, INSTITUTION).select(F.explode("data").alias("d"))
    if rows.isEmpty():
        raise ValueError(f"no institution rows under {path}")
    return rows.groupBy(F.col("d.stock_id").alias("ticker"), F.to_date("d.date").alias("date")).agg(F.coalesce(F.sum("d.buy"), F.lit(0)).alias("inst_buy"), F.coalesce(F.sum("d.sell"), F.lit(0)).alias("inst_sell"))


def positional(spark: SparkSession, path: str, code_field: str, wanted: dict[str, str], tickers: DataFrame | None = None) -> DataFrame:
    """Tables whose columns are found by field name, whatever the layout's width.

    ``wanted``: output name -> field name; four-digit codes only, of ``tickers`` if given; the
    date is the eight-digit part of the file name.
    """
    raw = _json(spark, path, POSITIONAL).withColumn("date", F.to_date(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{8})", 1), "yyyyMMdd"))
    rows = raw.select("date", F.size("fields").alias("n_fields"), F.explode("data").alias("row"), "fields")
    m = F.map_from_arrays(F.transform("fields", lambda f: F.trim(f)), F.col("row"))
    cells = rows.withColumn("m", m).withColumn("ticker", F.trim(F.element_at("m", code_field)))
    cells = cells.where(F.col("ticker").rlike(r"^\d{4}$"))
    cells = cells if tickers is None else cells.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    return cells.select("date", "ticker", "n_fields", *[X.shares(F.try_element_at("m", F.lit(f))).alias(n) for n, f in wanted.items()])


def layouts(rows: DataFrame) -> DataFrame:
    """How many days and rows came in each width, and from when to when."""
    return rows.groupBy("n_fields").agg(F.countDistinct("date").alias("n_days"), F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def vendor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Third-party daily CSVs, one or a folder (header, maybe a BOM): the first row of a file's date stays.

    ``ticker`` is the file's name without its ending.
    """
    raw = spark.read.csv(path, header=True, enforceSchema=False)
    clean = [F.col(f"`{c}`").alias(c.lstrip("﻿").strip().lower().replace(" ", "_")) for c in raw.columns]
    # A file may be read in pieces: rows are ordered by the piece's place in it, then within the piece.
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)(?:\.[A-Za-z]+)?$", 1)
    rows = raw.select(*clean, name.alias("ticker"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at")).withColumn("date", F.to_date("date"))
    w = Window.partitionBy("ticker", "date").orderBy("__block", "__at")
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__block", "__at")


def vendor_prices(spark: SparkSession, path: str, events: DataFrame | None = None) -> DataFrame:
    """Vendor CSVs as numbers (what is no number is missing), adjusted by ``events`` if given."""
    from ..operators import market

    raw = vendor_csv(spark, path)
    out = raw.select("ticker", "date", *[F.col(c).try_cast("double").alias(c) for c in raw.columns if c not in ("ticker", "date")])
    return out if events is None else market.adjust(out, market.factors(events))


#: Numbers may come as text; they are coerced, and what is no number is missing.
BENCHMARK = "data array<struct<date:string,stock_id:string,Trading_Volume:string,Trading_money:string,open:string,max:string,min:string,close:string>>"


def benchmark_prices(spark: SparkSession, path: str, events: DataFrame | None = None) -> DataFrame:
    """One series of daily prices from a JSON document, adjusted by ``events`` (ticker, date, factor); zero prices are missing.

    Factors outside (0.3, 1.05] are errors of the source and are left out.  No row is an error.
    """
    from ..operators import market

    d = _json(spark, path, BENCHMARK).select(F.explode("data").alias("d"))
    number = lambda c: F.col(f"d.{c}").try_cast("double")
    price = lambda c, name: F.nullif(number(c), F.lit(0.0)).alias(name)
    rows = d.select(F.col("d.stock_id").alias("ticker"), F.to_date("d.date").alias("date"), price("open", "open"), price("max", "high"), price("min", "low"), price("close", "close"), number("Trading_Volume").alias("volume"), number("Trading_money").alias("value"))
    if rows.isEmpty():
        raise FileNotFoundError(f"no benchmark prices in {path}")
    if events is None:
        return rows.withColumns({"adj_factor": F.lit(1.0), "adj_open": F.col("open"), "adj_close": F.col("close")})
    own = events.where("factor > 0.3 AND factor <= 1.05").select("ticker", "date", F.lit("exright").alias("kind"), F.lit(1.0).alias("before_price"), F.col("factor").alias("after_price"))
    return market.adjust(rows, market.factors(own))


def month_revenue(spark: SparkSession, path: str) -> DataFrame:
    d = _json(spark, path, REVENUE).select(F.explode("data").alias("d"))
    month = F.make_date("d.revenue_year", "d.revenue_month", F.lit(1))
    return d.select(F.col("d.stock_id").alias("ticker"), month.alias("month"), F.to_date("d.date").alias("announce_date"), F.col("d.revenue").alias("revenue"), F.col("d.revenue_yoy").alias("revenue_yoy"), F.col("d.revenue_mom").alias("revenue_mom"))


def completed_folders(spark: SparkSession, path: str, marker: str = "_complete.json") -> list[str]:
    """Folders under ``path`` that hold the marker (Spark itself does not list hidden files)."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    files, out = at.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(at, True), []
    while files.hasNext():
        p = files.next().getPath()
        if p.getName() == marker:
            out.append(p.getParent().toString())
    return sorted(out)


def news(spark: SparkSession, path: str) -> DataFrame:
    """Items of completed windows (folders with ``_complete.json``); one row per id."""
    done = completed_folders(spark, path)
    if not done:
        return spark.createDataFrame([], "news_id long, publish_at timestamp_ntz, title string, content string")
    items = spark.read.schema(NEWS).json(done, multiLine=True, mode="FAILFAST").select(F.explode("items.data").alias("d"))
    rows = items.where("d.publishAt IS NOT NULL").select(F.col("d.newsId").alias("news_id"), F.timestamp_seconds("d.publishAt").cast("timestamp_ntz").alias("publish_at"), F.col("d.title").alias("title"), X.strip_html(F.col("d.content")).alias("content"))
    w = Window.partitionBy("news_id").orderBy("publish_at", "title")
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def event_rows(raw: DataFrame, date: Column, before: Column, after: Column, kind: str) -> DataFrame:
    """Corporate actions: Minguo dates, cleaned prices, factor after / before."""
    out = raw.select("ticker", T.roc_date(date).alias("date"), X.number(before, True).alias("before_price"), X.number(after, True).alias("after_price"), F.lit(kind).alias("kind"))
    return out.withColumn("factor", F.try_divide("after_price", "before_price"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def batch_digest(files: DataFrame, batch: Column) -> DataFrame:
    """Per batch: SHA-256 over the raw digests in path order."""
    d = files.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"), F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("d"))
    return d.select("batch", "n_files", "bytes", F.sha2(F.unhex(F.array_join(F.col("d.sha256"), "")), 256).alias("sha256"))


def archive_digest(batches: DataFrame) -> DataFrame:
    """One row over all batches: SHA-256 over their raw digests in order of their names."""
    d = batches.agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n_files").alias("n_files"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(F.struct("batch", "sha256"))).alias("d"))  # a row a batch
    return d.select("n_batches", "n_files", "bytes", F.sha2(F.unhex(F.array_join(F.col("d.sha256"), "")), 256).alias("sha256"))
