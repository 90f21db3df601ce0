"""What the corpus operators share: durable intermediate tables, row keys, joins of whole rows and hot keys, Arrow limits, word and space patterns."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and its complement, as Java and Python regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters for trim().
SPACES = " \t\n\x0b\x0c\r"

#: An Arrow batch holds at most so many rows and bytes, so that long texts don't pile up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 2048, 16 << 20


def bound_arrow(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to ours; smaller limits stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a cluster is refused, as its machines share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cargolens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_root(spark)}/cargolens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    for paths in getattr(_recorders, "open", ()):
        paths.append(path)
    return path


_recorders = threading.local()


@contextmanager
def recording() -> Iterator[list[str]]:
    """A list that gets the shared paths which this thread makes inside the block."""
    if not hasattr(_recorders, "open"):
        _recorders.open = []
    paths: list[str] = []
    _recorders.open.append(paths)
    try:
        yield paths
    finally:
        _recorders.open.pop()


def delete_tables(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete shared paths; whoever calls this knows that nothing reads them any more."""
    for p in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cut lineage that outlives executors, with true sizes for the planner."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, carry: Sequence[str] | None = None, **named: str) -> DataFrame:
    """A struct `row` of the columns in `carry` (None: all), so that no column added later can clash with them, and beside it the columns in `named` under the names given there."""
    kept = docs.columns if carry is None else list(carry)
    row = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.struct(F.lit(None).cast("string").alias("none"))
    return docs.select(row.alias("row"), *(F.col(f"`{c}`").alias(name) for name, c in named.items()))


#: Keys or rows of a small table that are sent to every executor, at most; more are shuffled.
SENT_ROWS = 1 << 18
#: A filter of more keys has this many bits and lets more of the others pass.
FILTER_BITS = 1 << 27
#: Fewer rows than this don't make a key hot.
HOT_ROWS = 256


def plain_scan(docs: DataFrame) -> bool:
    """Whether docs is a table read from files, each file once, under deterministic filters and projections alone: then a file's row is one row of docs at most, and the same one each time."""
    node = docs._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias", "View"):
        expressions = node.expressions()
        if not all(expressions.apply(i).deterministic() for i in range(expressions.size())):
            return False
        node = node.children().head()
    if node.getClass().getSimpleName() != "LogicalRelation" or node.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    roots = sorted(f"{x}/" for x in node.relation().location().rootPaths().mkString("\n").split("\n"))
    return not any(b.startswith(a) for a, b in zip(roots, roots[1:], strict=False))


def located(docs: DataFrame, **named: str) -> DataFrame:
    """A struct `row` of docs' columns, the columns in `named` under the names given there, and `at`: where the row lies (hash of the file's path, and number in the file), the same whenever the table is read.

    So narrow results find their rows again in a second scan, and no stage
    writes whole rows between. What isn't a table under filters and projections alone, as rows that were joined,
    exploded, sampled or united, is written to a table first, so that each row has a place of its own.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    at = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("number")).alias("at")
    base = None
    if "_metadata" not in map(str.lower, docs.columns) and plain_scan(docs):
        try:
            base = docs.select(row, at)
        except AnalysisException:  # a projection hides the files' metadata
            pass
    if base is None:
        base = durable(docs.select(row), "rows").select("row", at)
    return base.select("row", *(F.col("row")[c].alias(name) for name, c in named.items()), "at")


def maybe_in(rows: DataFrame, keys: DataFrame, key: str, n: int) -> DataFrame:
    """rows with `_maybe`: true for all that have one of the n keys and, by chance, for some others. A bitmap of at most FILTER_BITS bits by the key's hash, made by an aggregate, is sent as a table of words and joined."""
    bits = min(FILTER_BITS, 1 << max(10, (20 * n).bit_length()))
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    word = F.shiftright(place, 6)
    words = keys.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int"))).alias("_bits"))
    told = rows.withColumn("_place", place).join(F.broadcast(words), F.shiftright("_place", 6) == F.col("_word"), "left")
    hit = F.call_function("shiftright", F.col("_bits"), F.col("_place").bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    return told.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_place", "_word", "_bits")


def rows_with(rows: DataFrame, keys: DataFrame, key: str, *, many: str | None = None, sent_rows: int | None = None) -> DataFrame:
    """Rows joined to keys, a narrow written table with one row for each key. A table of at most sent_rows rows is sent to all executors; else rows that surely have no partner are filtered out before the others are shuffled (as join_by_count does, if the column `many` counts the rows of each key)."""
    n = keys.count()
    if n <= (SENT_ROWS if sent_rows is None else sent_rows):
        return rows.join(F.broadcast(keys), key)
    left = maybe_in(rows, keys, key, n).where("_maybe").drop("_maybe")
    return left.join(keys, key) if many is None else join_by_count(left, keys, key, many)


def rows_without(rows: DataFrame, keys: DataFrame, key: str, *, sent_rows: int | None = None) -> DataFrame:
    """Whole rows whose key isn't in keys (a narrow written table of distinct keys). A table of at most sent_rows rows is sent to all executors; else rows that the filter clears stay where they are, and only the others are shuffled."""
    n = keys.count()
    if n <= (SENT_ROWS if sent_rows is None else sent_rows):
        return rows.join(F.broadcast(keys), key, "left_anti")
    told = maybe_in(rows, keys, key, n)
    return told.where("not _maybe").drop("_maybe").unionByName(told.where("_maybe").drop("_maybe").join(keys, key, "left_anti"))


def join_by_count(rows: DataFrame, table: DataFrame, key: str, many: str, how: str = "inner") -> DataFrame:
    """rows joined to table, which has one row for each key and in column `many` the number of rows that hold it (inner or left; both written tables, as they are read twice).

    Keys with over a part in four times the shuffle partitions of all counted
    rows are at most as many, and are sent to all executors: a hot key's rows stay
    where they are. The other keys are shuffled.
    """
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = table.agg(F.sum(many).alias("all"), F.max(many).alias("most")).first()
    limit = max(HOT_ROWS, (held["all"] or 0) // parts)
    if (held["most"] or 0) <= limit:
        return rows.join(table, key, how)
    hot, others = table.where(F.col(many) > limit), table.where(F.col(many) <= limit)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(others, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def whole_text(name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters that aren't ASCII white space, as a bigint; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hex_shard(digest: Column, shards: int) -> Column:
    """Which of `shards` equal ranges of digest's first 32 bits holds it; digests sort as their shards do."""
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") * F.lit(shards).cast("bigint"), 32).cast("int")


def shard_number(spark: SparkSession) -> int:
    """Shards for a split group: a few times the shuffle partitions, so that one shard stays a small part of a task."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
