"""Scans: shipment files by suffix, dated and cleaned scans, cluster files, and the shipments view of the star schema."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.sources.schema import CLUSTER_SCHEMA, RAW_SCHEMA, check_columns

# The year to date of the clean scan.
YTD = (dt.date(2024, 10, 1), dt.date(2025, 10, 31))


def read_csv(spark: SparkSession, path: str, schema=None, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """CSV, gzip-compressed or plain, with a header. Without a schema all columns are strings; nothing is inferred. Plain files are read in splits unless multi_line says that quoted values hold line ends."""
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_numeric_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """CSV whose rows with a value in `numbers` that isn't a number are skipped."""
    df = read_csv(spark, path)
    return df.select(*(F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if c in numbers else F.col(f"`{c}`") for c in df.columns)).dropna(subset=numbers)


def read_xlsx(spark: SparkSession, path: str, header_row: int = 5, cache: str | None = None, sheet: str | int = 0) -> DataFrame:
    """A customs workbook of 33 columns. Spark has no workbook source, so the driver parses one file; with cache, a Parquet copy there is read instead once it exists."""
    if cache is not None and _exists(spark, cache):
        return spark.read.parquet(cache)
    import pandas as pd

    table = pd.read_excel(path, header=header_row, sheet_name=sheet)
    check_columns(list(table.columns), exact=True)
    df = spark.createDataFrame(table.astype(object).where(table.notna(), None), RAW_SCHEMA)
    if cache is None:
        return df
    df.write.parquet(cache)
    return spark.read.parquet(cache)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_shipments(spark: SparkSession, path: str) -> DataFrame:
    """Shipments by suffix: .csv, .csv.gz, .parquet, .xlsx, or a table's name without a suffix."""
    if path.endswith((".csv", ".csv.gz")):
        return read_csv(spark, path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".xlsx"):
        return read_xlsx(spark, path)
    if "/" in path or "." in path.rsplit(".", 1)[-1]:
        raise ValueError(f"no reader for {path}")
    return spark.table(path)


def with_known_names(df: DataFrame) -> DataFrame:
    """df with exporter and importer by their canonical names where it has those columns and they are set, else as they are, else "Unknown Exporter" or "Unknown Importer": the source of flows."""
    for column in ("exporter", "importer"):
        own = [F.col(c) for c in (f"canonical_{column}", column) if c in df.columns]
        df = df.withColumn(column, F.coalesce(*own, F.lit(f"Unknown {column.title()}")))
    return df


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Cluster file: a JSON array of {canonical_name, aliases, count}."""
    return spark.read.schema(CLUSTER_SCHEMA).option("multiLine", True).json(path)


def run_sql(spark: SparkSession, statement: str, params: dict | None = None, **frames: DataFrame) -> DataFrame:
    """A parameterised statement over DataFrames given by name."""
    return spark.sql(statement, args=params or {}, **frames)


def between_dates(df: DataFrame, first: dt.date | None, last: dt.date | None, column: str = "date") -> DataFrame:
    """Rows dated in the closed range; an open end is None. Dates compare as dates."""
    if first is not None:
        df = df.where(F.col(column) >= F.lit(first))
    return df if last is None else df.where(F.col(column) <= F.lit(last))


def load_ytd(df: DataFrame, ytd: tuple[dt.date, dt.date] = YTD) -> DataFrame:
    return between_dates(df, *ytd)


#: Estimated bytes up to which a table is sent to all tasks, whatever the session's own threshold: some 700,000 suppliers.
SENT_BYTES = 16 << 20


def is_small(df: DataFrame) -> bool:
    """Whether Spark's estimate from df's files is small enough for a broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SENT_BYTES


def sent_if_small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small."""
    return F.broadcast(df) if is_small(df) else df


def with_price(df: DataFrame) -> DataFrame:
    """Columns of the shipments view with usd_per_mt as the view has it: its value by its tons."""
    return df.withColumn("usd_per_mt", F.col("fob_usd") / F.col("net_weight_mt"))


def shipments(spark: SparkSession, sf_dir: str, first: str = "product") -> DataFrame:
    """The shipment fact over the star schema: one row a line item, with its product, exporter, importer, destination and order. Orders meet their buyers before their lines do, so that lines are shuffled by product and order only, and long texts come last.

    Suppliers are sent to the lines while they are few. first ("product", "order" or "exporter") is what lines meet
    first: a query that keeps few of these then moves its own lines only.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    buyers = read("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", F.to_date("l_shipdate").alias("date"))
    sides = {
        "product": (read("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey")),
        "order": (orders, F.col("l_orderkey") == F.col("o_orderkey")),
        "exporter": (sent_if_small(read("supplier").select("s_suppkey", "s_name")), F.col("l_suppkey") == F.col("s_suppkey")),
    }
    for name in sorted(sides, key=lambda n: n != first):
        lines = lines.join(*sides[name])
    return lines.select(
        F.col("l_orderkey").alias("declaration"), F.col("s_name").alias("exporter"), F.col("c_name").alias("importer"), F.col("p_type").alias("fruit_name"), F.col("p_brand").alias("format_type"), F.col("p_size").cast("string").alias("size_mm"),
        F.when(F.col("l_returnflag") == "R", "organic").when(F.col("l_returnflag") == "A", "conventional").otherwise("unknown").alias("certification"),
        F.col("n_name").alias("country"), F.when(F.col("r_name") == "EUROPE", "Europe").otherwise("Rest of World").alias("region"), "date",
        F.col("l_quantity").cast("double").alias("net_weight_mt"), F.col("l_extendedprice").alias("fob_usd"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("usd_per_mt"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "AIR").otherwise("SEA").alias("via"), F.col("p_name").alias("description"),
    )
