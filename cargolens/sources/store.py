"""A partitioned table that is changed in place: only the partitions that a change touches are written, and checks taken in that same pass decide whether they are published."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cargolens.sources.readers import is_small, sent_if_small
from cargolens.sources.written import written

#: name: (aggregate over the rows that are written, test of its value)
Checks = Mapping[str, tuple[Column, Callable]]


class CheckFailed(ValueError):
    """A check of the written rows failed; the table is as it was."""


def summed(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """The sums by keys; nulls are keys.

    Where keys hardly repeat, as with a price among them, grouping would shuffle whole rows to leave them as
    they are. So hashes of the keys are counted first: rows whose hash comes once are kept, and only the others are grouped. If too
    many hashes repeat to be sent to the rows, all are grouped. df is read up to three times, so it should be cheap to read, as once() makes it.
    """
    grouped = lambda rows: rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
    hashed = df.select(*keys, *sums, F.xxhash64(*keys).alias("_hash"))
    repeated = written(hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash"), "repeated")
    if not is_small(repeated):
        return grouped(df)
    some = grouped(hashed.join(F.broadcast(repeated), "_hash", "left_semi"))
    alone = hashed.join(F.broadcast(repeated), "_hash", "left_anti")
    return alone.select(*keys, *(F.col(c).cast(some.schema[c].dataType) for c in sums)).unionByName(some)


class Files:
    """The Hadoop file system of a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.system = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)

    def names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.system.listStatus(self.path(folder))) if self.exists(folder) else []

    def rename(self, old: str, new: str) -> None:
        if not self.system.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} couldn't be renamed to {new}")

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write aside, then rename, so that a reader sees the whole text or none."""
        aside = f"{name}.{uuid.uuid4().hex}"
        stream = self.system.create(self.path(aside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.delete(name)
        self.rename(aside, name)


class Store:
    """A Parquet table with a folder for each value of one column.

    A change writes the new files of the partitions that it touches beside the
    table, with the counts that its checks ask for taken by observe() as the rows go by. If the checks
    hold, a journal is written and the folders are put in place one after another;
    a change that is cut off there is completed when the table is opened again. One that is cut off
    before, or whose checks fail, leaves the table as it was. There is one writer at a time; readers that began before a change must read again.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        head = json.loads(self.files.read(f"{self.path}/_store"))
        self.partition, self.schema = head["partition"], StructType.fromJson(head["schema"])
        self._finish()

    @classmethod
    def create(cls, df: DataFrame, path: str, partition: str, checks: Checks | None = None) -> Store:
        """A new table of df's rows; partition is one of its columns, and may be null. The path must not hold a table."""
        files = Files(df.sparkSession, path)
        if files.exists(f"{path}/_store"):
            raise ValueError(f"{path} holds a table already")
        if partition not in df.columns:
            raise ValueError(f"there is no column {partition}")
        ordered = df.select(*(c for c in df.columns if c != partition), partition)
        files.write(f"{path.rstrip('/')}/_store", json.dumps({"partition": partition, "schema": json.loads(ordered.schema.json())}))
        store = cls(df.sparkSession, path)
        store.replace(df, checks)
        return store

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def marks(self) -> list[str]:
        """Names of the changes that were published under a name."""
        return self.files.names(f"{self.path}/_marks")

    def replace(self, rows: DataFrame, checks: Checks | None = None, mark: str | None = None) -> dict:
        """Give each partition that rows has exactly these rows; the counts of the pass: rows, and the checks' values."""
        checks, staged = checks or {}, f"{self.path}/_staged/{uuid.uuid4().hex}"
        seen = Observation()
        counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(agg.alias(name) for name, (agg, _) in checks.items()))
        counted.select(*(n for n in rows.columns if n in self.schema.names)).write.partitionBy(self.partition).parquet(staged, compression="zstd")
        found = {"rows": 0, **seen.get}
        failed = [name for name, (_, test) in checks.items() if name in found and not test(found[name])]
        if failed:
            self.files.delete(staged)
            raise CheckFailed(", ".join(f"{name} is {found[name]}" for name in failed))
        moves = [n for n in self.files.names(staged) if "=" in n]
        self.files.write(f"{self.path}/_journal", json.dumps({"staged": staged, "moves": moves, "mark": mark}))
        self._finish()
        return found

    def _finish(self) -> None:
        """Put the journal's folders in place; those that are there already aren't staged any more."""
        if not self.files.exists(f"{self.path}/_journal"):
            return
        journal = json.loads(self.files.read(f"{self.path}/_journal"))
        for name in journal["moves"]:
            if self.files.exists(f"{journal['staged']}/{name}"):
                self.files.delete(f"{self.path}/{name}")
                self.files.rename(f"{journal['staged']}/{name}", f"{self.path}/{name}")
        if journal["mark"] is not None:
            self.files.write(f"{self.path}/_marks/{journal['mark']}", "")
        self.files.delete(f"{self.path}/_journal")
        self.files.delete(journal["staged"])

    def touched(self, rows: DataFrame) -> DataFrame:
        """The table's rows in the partitions that rows has. Values of the partition column are few and go through the driver."""
        values = [r[0] for r in rows.select(self.partition).distinct().collect()]
        p = F.col(self.partition)
        test = p.isin(*(v for v in values if v is not None)) if any(v is not None for v in values) else F.lit(False)
        return self.read().where(test | p.isNull() if None in values else test)

    def _changed(self, touched: DataFrame, column: str, value: Column, checks: Checks | None) -> dict:
        """Set column to value in `touched`, the rows of the partitions that change; `changed` counts rows with another value than before."""
        other = ~value.eqNullSafe(F.col(column))
        out = touched.withColumn("_changed", other).withColumn(column, value.cast(self.schema[column].dataType))
        return self.replace(out, {"changed": (F.count_if("_changed"), lambda n: True), **(checks or {})})

    def update_where(self, column: str, where: Column, value: Column, checks: Checks | None = None) -> dict:
        """Set column to value where the condition is true (null isn't): rows written and rows changed. Partitions without a changed row keep their files."""
        self._not_partition(column)
        new = F.when(F.coalesce(where, F.lit(False)), value).otherwise(F.col(column))
        rows = self.read()
        own = self.touched(rows.where(~new.eqNullSafe(F.col(column))))
        return self._changed(own, column, new, checks)

    def update_by_key(self, mapping: DataFrame, key: str, column: str, found: str, checks: Checks | None = None) -> dict:
        """Set column from mapping (key, found) where the key is mapped to something; others stay. Null keys map nothing; a key that comes twice is an error. A small mapping is sent to the rows."""
        self._not_partition(column)
        known = sent_if_small(mapping.where(F.col(key).isNotNull() & F.col(found).isNotNull()).select(F.col(key).alias("_key"), F.col(found).alias("_found")))
        twice = known.groupBy("_key").count().where("count > 1").select("_key").first()
        if twice is not None:
            raise ValueError(f"{key} {twice[0]} is mapped twice")
        rows = self.read()
        other = rows.join(known, F.col(key) == F.col("_key")).where(~F.col("_found").eqNullSafe(F.col(column)))
        own = self.touched(other).join(known, F.col(key) == F.col("_key"), "left")
        return self._changed(own, column, F.coalesce("_found", column), checks)

    def upper(self, column: str) -> dict:
        """Set a text column to upper case, and publish only if no row is left in lower case."""
        left = F.count_if(F.col(column) != F.upper(column))
        return self.update_where(column, F.col(column) != F.upper(column), F.upper(column), {"left": (left, lambda n: n == 0)})

    def merge(self, rows: DataFrame, keys: Sequence[str], sums: Sequence[str], mark: str | None = None) -> dict | None:
        """Add rows' sums to those of the rows with the same keys (nulls are keys), in the partitions that rows has. With a mark, a second merge under the same one does nothing: None."""
        if mark is not None and mark in self.marks():
            return None
        both = self.touched(rows).select(*keys, *sums).unionByName(rows.select(*keys, *sums))
        return self.replace(summed(both, keys, sums), mark=mark)

    def _not_partition(self, column: str) -> None:
        if column == self.partition:
            raise ValueError("rows don't change their partition")


def write_split(df: DataFrame, folder: str, key: str, rows_per_file: int = 1_000_000, suffix: str = ".csv") -> DataFrame:
    """One named CSV file for each value of key: (value, file, rows) of what is written. A value of more rows has numbered parts.

    Names are the value in lower case, other characters than letters and digits as `_`; null is `unknown`. Values
    whose names agree share a file. Files are written aside and renamed, so a second run puts the same names in place; files of values that are gone stay.
    """
    spark = df.sparkSession
    folder, files = folder.rstrip("/"), Files(spark, folder)
    name = F.coalesce(F.nullif(F.regexp_replace(F.lower(F.col(key).cast("string")), r"[^\p{L}\p{N}]+", "_"), F.lit("")), F.lit("unknown"))
    named = df.withColumn("_name", name)
    sizes = {r["_name"]: r["count"] for r in named.groupBy("_name").count().collect()}  # a row for each file
    parts = F.coalesce(*(F.when(F.col("_name") == n, -(-c // rows_per_file)) for n, c in sizes.items() if c > rows_per_file), F.lit(1))
    part = F.pmod(F.xxhash64(*df.columns), parts).cast("int")
    staged = f"{folder}/_staged-{uuid.uuid4().hex}"
    gzip = suffix.endswith(".gz")
    dealt = named.withColumn("_part", part).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_name", "_part")
    dealt.write.partitionBy("_name", "_part").option("header", True).option("compression", "gzip" if gzip else "none").csv(staged)
    done = []
    for top in (n for n in files.names(staged) if n.startswith("_name=")):
        value = files.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(top.removeprefix("_name="))
        numbered = sizes[value] > rows_per_file
        for sub in files.names(f"{staged}/{top}"):
            own = [f for f in files.names(f"{staged}/{top}/{sub}") if f.startswith("part-")]
            for k, f in enumerate(own):
                number = f"-{int(sub.removeprefix('_part=')) + 1}" * numbered + f"-{k + 1}" * (len(own) > 1)
                target = f"{folder}/{value}{number}{suffix}"
                files.delete(target)
                files.rename(f"{staged}/{top}/{sub}/{f}", target)
                done.append((value, target))
    files.delete(staged)
    return spark.createDataFrame([(v, t, sizes[v]) for v, t in done], "value string, file string, value_rows bigint")
