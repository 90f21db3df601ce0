"""Document quality with host-level rules, in DataFrame functions only.

Each document is measured and tested by itself. Its failures are added up by
host, and a host's failure rate is shrunk towards the rate of all documents by a
beta prior fitted to how far hosts differ beyond chance, so that a host with few
documents isn't judged by them alone. Hosts whose shrunk rate is too high lose
all documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import SPACE, SPACES, durable, join_by_count, packed, rows_without, whole_text

SYMBOLS = "[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """Maximal runs of characters that aren't ASCII white space."""
    bare = F.trim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def window_hashes(words: Column, width: int) -> Column:
    """64-bit hash of each run of `width` words; words must be a plain column, as it's read once for each element."""
    each = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, width))))
    return F.slice(each, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))


def repeated_words(windows: Column, width: int) -> Column:
    """Words inside windows whose hash is there twice or more: sort (hash, place), keep places with an equal neighbour, add up the covered words."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    n = F.size(windows)
    pairs = F.zip_with(F.slice(placed, F.lit(1), n - 1), F.slice(placed, F.lit(2), n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    covered = F.aggregate(places, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-width).alias("last")), lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])
    return F.coalesce(F.when(F.size(F.array_distinct(windows)) == n, F.lit(0).cast("bigint")).otherwise(covered), F.lit(0)).cast("bigint")


def barrier(df: DataFrame, kept: Sequence[str], **made: Column) -> DataFrame:
    """kept columns and made ones, computed once: expressions that read a made column many times don't repeat its expression."""
    one = F.explode(F.array(F.struct(*(c.alias(k) for k, c in made.items())))).alias("made")
    return df.select(*kept, one).select(*kept, *(F.col("made")[k].alias(k) for k in made))


def measured(df: DataFrame, *, width: int = 5) -> DataFrame:
    """df with its string column `text` (null: empty) replaced by MEASURES as bigint columns."""
    rest = [c for c in df.columns if c != "text"]
    text = whole_text()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))
    first = barrier(
        df, rest, words=words_of(text), n_symbols=(F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint"), n_dup_lines=F.aggregate(F.array(lines), F.lit(0), lambda a, x: a + F.size(x) - F.size(F.array_distinct(x))).cast("bigint")
    )
    second = barrier(first, [*rest, "n_symbols", "n_dup_lines"], n_words=F.size("words").cast("bigint"), word_chars=F.length(F.array_join("words", "")).cast("bigint"), windows=window_hashes(F.col("words"), width))
    return second.select(*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("windows"), width).alias("n_repeat_words"))


def host_rates(failures: DataFrame) -> DataFrame:
    """Rows (host, n, failed, all bigint but host) with `rate`, each host's failure rate shrunk by a beta prior: (failed + a) / (n + a + b).

    The prior's mean m is the share of all documents that fail. How far hosts
    differ comes from their rates' spread about m, weighted by n, less what
    binomial sampling alone gives hosts of these sizes: with correlation
    rho = 1 / (a + b + 1), the sum of n * (failed / n - m)**2 is expected to be
    m * (1 - m) * (hosts - 1 + rho * sum((1 - n / all) * (n - 1))). rho is kept within
    0 (hosts don't differ: all have rate m) and 1 (each has its own), and
    is 0 where the hosts can't tell: a single host, or none with two documents.
    """
    n, failed = F.col("n").cast("double"), F.col("failed").cast("double")
    sums = failures.agg(F.sum(n).alias("all"), F.sum(failed).alias("f"), F.count(F.lit(1)).alias("hosts"), F.sum(failed * failed / n).alias("squares"), F.sum(n * n).alias("nn"))
    mean = F.col("f") / F.col("all")
    spread = F.col("squares") - F.col("f") * mean
    weight = F.col("all") - F.col("hosts") - F.col("nn") / F.col("all") + 1
    rho = (spread / (mean * (1 - mean)) - (F.col("hosts") - 1)) / weight
    rho = F.when((mean > 0) & (mean < 1) & (weight > 1e-9), F.greatest(F.lit(0.0), F.least(F.lit(1.0), rho))).otherwise(0.0)
    prior = sums.select(mean.alias("m"), rho.alias("rho")).first()  # one row
    m, r = (prior["m"] or 0.0), (prior["rho"] or 0.0)
    return failures.withColumn("rate", (failed * r + m * (1 - r)) / (n * r + (1 - r)))


def judged_rows(docs: DataFrame, carry: Sequence[str] | None, text_col: str, host_col: str, min_words: int, max_repeat_percent: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: rows (row, host, MEASURES, base_failed), and for each host (host, n, host_rate). host is a struct, so that null is a name."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    host = F.struct(F.col("host").isNull().alias("none"), F.coalesce(F.col("host").cast("string"), F.lit("")).alias("name"))
    rows = measured(packed(docs, carry, host=host_col, text=text_col).withColumn("host", host))
    rows = durable(rows.withColumn("base_failed", failed), "measured")
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed"))
    return rows, durable(host_rates(durable(hosts, "hosts")).select("host", "n", F.col("rate").alias("host_rate")), "verdicts")


def host_quality(
    docs: DataFrame, *, text_col: str = "text", host_col: str = "source", carry: Sequence[str] | None = None, min_words: int = 10, max_repeat_percent: int = 20, max_host_rate: float = 0.5
) -> DataFrame:
    """Columns row, MEASURES, base_failed, host_rate and kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of
    100 words lie in 5-word windows that the text has twice or more. A host
    (null is a host of its own) whose shrunk failure rate is over max_host_rate
    loses its documents; else those that haven't failed stay. Null text is
    empty. Repeated rows count each. An empty table gives an empty one.
    """
    rows, verdicts = judged_rows(docs, carry, text_col, host_col, min_words, max_repeat_percent)
    found = join_by_count(rows, verdicts, "host", "n")
    return found.select("row", *MEASURES, "base_failed", "host_rate", (~F.col("base_failed") & (F.col("host_rate") <= max_host_rate)).alias("kept"))


def drop_low_quality(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", min_words: int = 10, max_repeat_percent: int = 20, max_host_rate: float = 0.5) -> DataFrame:
    """docs without those that host_quality rejects, by its rules: null or empty text fails, a null host is a host of its own, repeated rows count each, and an empty table gives an empty one. Only the hosts that are rejected meet the rows."""
    rows, verdicts = judged_rows(docs, None, text_col, host_col, min_words, max_repeat_percent)
    rejected = durable(verdicts.where(F.col("host_rate") > max_host_rate).select("host"), "rejected")
    return rows_without(rows.where("not base_failed"), rejected, "host").select("row.*")
