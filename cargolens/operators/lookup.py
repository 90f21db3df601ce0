"""Look-up of names by terms through a table of grams: a name is scored only if it shares as many grams with a term as a match must."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.names import similarity_udf
from cargolens.operators.similar import numbered
from cargolens.sources.written import written

#: sizes of grams in a kept index
SIZES = (1, 2, 3)


def size_for(threshold: float) -> int:
    """The largest grams of which matches at this ratio are sure to share one for each 20 characters: of all characters, the threshold's share matches, and each other one can part a run."""
    return max((q for q in SIZES if threshold / 2 - (q - 1) * (1 - threshold) >= 0.05), default=1)


def name_grams(name: Column, size: int) -> Column:
    """The grams of `size` characters of a name in lower case, repeated ones told apart by their number."""
    low = F.lower(name)
    count = F.length(low) - size + 1
    grams = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(low, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.transform(grams, lambda g, i: F.concat(g, F.lit("\0"), F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda x: x == g)).cast("string")))


def gram_index(names: DataFrame, column: str, sizes: Sequence[int] = SIZES) -> DataFrame:
    """A written table (size, gram, name, length) of the distinct names in a column; null isn't a name. It serves any number of look-ups."""
    own = names.select(F.col(column).alias("name")).where("name is not null").distinct()
    sized = lambda q: F.transform(name_grams(F.col("name"), q), lambda g: F.struct(F.lit(q).alias("size"), g.alias("gram")))
    each = F.flatten(F.array(*map(sized, sizes)))
    # a name without grams, as it is short or empty, stands under the size 0
    each = F.concat(each, F.array(F.struct(F.lit(0).alias("size"), F.lit("").alias("gram"))))
    return written(own.select("name", F.length("name").alias("length"), F.explode(each).alias("g")).select("g.size", "g.gram", "name", "length"), "grams")


def candidates(index: DataFrame, terms: Sequence[str], threshold: float) -> DataFrame:
    """(k, name): names that may match term number k with this ratio or more, or hold it. Terms are a user's, so their grams are sent to all tasks.

    Of la + lb characters at least threshold / 2 match in each name, in one run more than there are others at
    most; a run loses size - 1 grams. A name that holds the term has all its grams.
    """
    spark, q = index.sparkSession, size_for(threshold)
    rows, all_grams = [], {}
    for k, term in enumerate(terms):
        low = term.lower()
        own = numbered([low[i : i + q] for i in range(len(low) - q + 1)])
        rows += [(k, g, len(low), len(own)) for g in own]
        all_grams[k] = (len(low), len(own))
    asked = spark.createDataFrame(rows, "k int, gram string, term_length int, term_grams int")
    shared = index.where(F.col("size") == q).join(F.broadcast(asked), "gram").groupBy("k", "name", "length", "term_length", "term_grams").agg(F.count(F.lit(1)).alias("shared"))
    both = F.col("length") + F.col("term_length")
    least = both * threshold / 2 - (q - 1) * (both * (1 - threshold) + 1) - 1e-9
    alike = F.least("length", "term_length") * (2 - threshold) >= F.greatest("length", "term_length") * threshold - 1e-9
    found = shared.where((F.col("shared") >= least) & alike | (F.col("shared") >= F.col("term_grams"))).select("k", "name")
    # where a term is so short that a match needn't share a gram, names of such lengths are all scored
    for k, (length, n) in all_grams.items():
        longest = 2 * length / threshold if threshold > 0 else math.inf
        bound = lambda other: (length + other) * threshold / 2 - (q - 1) * ((length + other) * (1 - threshold) + 1)
        if n == 0 or threshold <= 0 or min(bound(0), bound(longest)) <= 0:
            low = F.col("length") * threshold / 2 + length * threshold / 2 - (q - 1) * ((F.col("length") + length) * (1 - threshold) + 1)
            every = index.where("size = 0")
            few = every if n == 0 or threshold <= 0 else every.where(low <= 0)
            found = found.unionByName(few.select(F.lit(k).alias("k"), "name")).distinct()
    return found


def matches(index: DataFrame, terms: Sequence[str], threshold: float) -> DataFrame:
    """(k, name, score) of the names that match: 2 if equal in any case, 1 if they hold the term, else the ratio of matched characters, at least threshold."""
    found = candidates(index, terms, threshold)
    score = F.coalesce(*(F.when(F.col("k") == k, similarity_udf(t)("name")) for k, t in enumerate(terms)))
    return found.withColumn("score", score).where(F.col("score") >= threshold)
