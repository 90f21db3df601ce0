"""Packing into length buckets chosen by dynamic programming.

Documents longer than the context are cut into full pieces and a rest. The
histogram of piece lengths, at most `max_len` rows whatever the corpus, is all that
the dynamic programme needs to choose the bucket lengths that waste the
fewest padding tokens. In a bucket every batch holds as many pieces as the
token budget allows, in a seeded order, one reading (epoch) of the corpus after another, so
that copies of a document never share a batch; pieces are numbered through
shards of the order, so that no bucket is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.common import SENT_ROWS, bound_arrow, durable, hex_shard, shard_number, word_count


def bucket_lengths(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """At most `buckets` of the lengths, the largest among them, such that rounding each length up to the next one adds the fewest tokens.

    Cost obeys the quadrangle inequality, so the best cuts move one way and
    each layer is found by divide and conquer. Ties take the shorter prefix.
    """
    order = np.argsort(lengths)
    length, count = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(length)
    if not n:
        return []
    held, tokens = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(count * length)))
    best = length * held[1:] - tokens[1:]  # one bucket for the first j+1 lengths
    cuts: list[np.ndarray] = []
    for _ in range(1, min(buckets, n)):
        new, cut = best.copy(), np.full(n, -1, np.int64)
        todo = [(1, n - 1, 1, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j) + 1)  # the last bucket is lengths i..j
            cost = best[i - 1] + length[j] * (held[j + 1] - held[i]) - (tokens[j + 1] - tokens[i])
            at = int(np.argmin(cost))
            if cost[at] < new[j]:
                new[j], cut[j] = cost[at], i[at]
            todo += [(lo, j - 1, first, int(i[at])), (j + 1, hi, int(i[at]), last)]
        cuts.append(cut)
        best = new
    out, j = [], n - 1
    for cut in reversed(cuts):
        out.append(int(length[j]))
        if cut[j] < 0:  # no further bucket helps up to here
            continue
        j = int(cut[j]) - 1
    return sorted({*out, int(length[j])})


def readings(docs: DataFrame, most: int = 4096) -> DataFrame:
    """Rows (row, id, total, print) with `epoch`: rows that are equal in all four are readings 0, 1, ... of one document. They are counted, not gathered; a document of more than `most` readings is spread over tasks."""
    counted = durable(docs.groupBy("row", "id", "total", "print").agg(F.count(F.lit(1)).alias("n")), "readings")
    numbers = lambda first, last: F.explode(F.sequence(first, last)).alias("epoch")
    few = counted.where(F.col("n") <= most).select("row", "id", "total", numbers(F.lit(0).cast("bigint"), F.col("n") - 1))
    starts = counted.where(F.col("n") > most).select("row", "id", "total", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(most).cast("bigint"))).alias("at"))
    many = starts.repartition(shard_number(docs.sparkSession)).select("row", "id", "total", numbers(F.col("at"), F.least(F.col("at") + most, F.col("n")) - 1))
    return few.unionByName(many)


def pack_into_buckets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_tokens: Column | None = None,
    epoch: Column | None = None,
    carry: Sequence[str] = (),
    max_len: int = 2048,
    buckets: int = 8,
    token_budget: int = 16384,
    seed: int = 0,
) -> DataFrame:
    """Columns row, id, epoch, piece_no, start_token, n_tokens, bucket_len, batch_no, slot and padding.

    n_tokens (an expression of docs' columns; words of the text by default) is a document's
    length. A document of over max_len tokens becomes pieces of max_len and a
    rest. A piece goes to the shortest bucket that holds it; a bucket's batch
    holds token_budget // bucket_len pieces (one at least). A document without tokens, or of null
    length or text, has one row with piece_no 0 and nulls for bucket, batch, slot and padding.

    Rows that are equal in id, text, length and carried columns (which must be fit for
    grouping) are readings of one document: their epochs are 0, 1, ... in any
    order; or epoch gives it. A batch holds pieces of one epoch, so copies never
    share one; each bucket has at most one partly filled batch an epoch. Rows with one id
    and different texts are different documents. Order within a bucket: epoch, then MD5 of seed, id
    and piece number; rows that tie there come in any order. An empty table gives an empty one.
    """
    if not 1 <= max_len <= token_budget:
        raise ValueError("a piece must fit the token budget")
    spark = docs.sparkSession
    bound_arrow(spark)
    row = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.struct(F.lit(None).cast("string").alias("none"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")) if text_col in docs.columns else F.lit("")
    total = word_count(text) if n_tokens is None else F.greatest(F.lit(0), F.coalesce(n_tokens.cast("bigint"), F.lit(0)))
    made = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), total.alias("total"), F.xxhash64(text).alias("print"), *(() if epoch is None else (F.coalesce(epoch.cast("bigint"), F.lit(0)).alias("epoch"),)))
    made = readings(made) if epoch is None else made
    last = F.greatest(F.ceil(F.col("total") / max_len), F.lit(1)).cast("bigint") - 1
    pieces = made.select("row", "id", "epoch", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece_no"))
    pieces = pieces.select(
        "row", "id", "epoch", "piece_no", (F.col("piece_no") * max_len).alias("start_token"), F.least(F.lit(max_len), F.col("total") - F.col("piece_no") * max_len).cast("bigint").alias("n_tokens")
    )
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("piece_no").cast("string")))
    pieces = durable(pieces.withColumn("key", key), "pieces")

    histogram = pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect()  # at most max_len rows
    chosen = bucket_lengths([r["n_tokens"] for r in histogram], [r["count"] for r in histogram], buckets) or [max_len]
    bucket = F.lit(chosen[-1])
    for b in reversed(chosen[:-1]):
        bucket = F.when(F.col("n_tokens") <= b, b).otherwise(bucket)
    shards = shard_number(spark)
    capacity = F.expr(f"{token_budget} div bucket_len")
    placed = pieces.where("n_tokens > 0").withColumn("bucket_len", bucket.cast("bigint")).withColumn("shard", hex_shard(F.col("key"), shards))
    sizes = durable(placed.groupBy("bucket_len", "epoch", "shard").agg(F.count(F.lit(1)).alias("n")), "sizes")
    before = Window.partitionBy("bucket_len", "epoch").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket_len", "epoch", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # a row for each bucket and epoch: the batches of the epochs before it
    batches = sizes.groupBy("bucket_len", "epoch").agg(F.sum("n").alias("n")).withColumn("batches", F.ceil(F.col("n") / capacity).cast("bigint"))
    earlier = Window.partitionBy("bucket_len").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    firsts = batches.select("bucket_len", "epoch", F.coalesce(F.sum("batches").over(earlier), F.lit(0)).alias("first_batch"))
    offsets = durable(offsets.join(firsts, ["bucket_len", "epoch"]), "offsets")
    inside = Window.partitionBy("bucket_len", "epoch", "shard").orderBy("key", "id", "piece_no", "n_tokens")
    # buckets x epochs x shards rows: sent to all where that is few, and a document of very many copies makes many
    small = F.broadcast(offsets) if offsets.count() <= SENT_ROWS else offsets
    numbered = placed.withColumn("place", F.row_number().over(inside)).join(small, ["bucket_len", "epoch", "shard"]).withColumn("at", F.col("offset") + F.col("place") - 1)
    columns = ("row", "id", "epoch", "piece_no", "start_token", "n_tokens")
    batch = (F.col("first_batch") + F.floor(F.col("at") / capacity)).cast("bigint")
    full = numbered.select(*columns, "bucket_len", batch.alias("batch_no"), (F.col("at") % capacity).cast("bigint").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
    none = F.lit(None).cast("bigint")
    bare = pieces.where("n_tokens = 0").select(*columns, *(none.alias(c) for c in ("bucket_len", "batch_no", "slot", "padding")))
    return full.unionByName(bare)
