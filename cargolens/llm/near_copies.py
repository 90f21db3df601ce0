"""Near copies by SimHash fingerprints and by exact Jaccard similarity of word shingles.

Fingerprints of the shingles are linked by ball hashing as in op10; of these links, those whose sets of shingles are alike to the limit stay.
Four of 64 bits find few of the pairs near the limit, so MinHash bands add what fingerprints miss among texts that are still apart. They name the candidates: texts whose sets of shingles are alike to at
least 0.8 share one of 32 bands of six minima with probability above
1 - 7 / 10**5. A sketch of two bits of each of the 192 minima goes with a text into its buckets; candidates are
verified by their whole sets if at least 146 minima agree in it (of a pair at 0.8 some 163 do, and fewer than 146 three times in 10**4).
First each bucket's members are compared with a centre: the one with most
companions in all its buckets, which is the text that a family of copies was made from, then another. Then
members of a bucket that still are in different components are compared by
sketches and then by their 256 least hashes (all of a short text's), bucket by bucket where they meet, a large bucket in pairs of parts; only pairs that may be alike by both leave the task.
So large groups of copies cost a few comparisons a member, and none of a bucket's
pairs is given up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import bound_arrow, durable, join_by_count, located, rows_with, rows_without, whole_text
from cargolens.llm.simhash import components, majority, near_links, shingle_hashes

#: bands of a text, minima in a band
BANDS, MINIMA = 32, 6
#: shingles that meet all permutations at once
STEP = 512
#: rounds of centres; equal minima in the sketches of a pair that is verified, at least
ROUNDS, AGREE = 2, 146
#: members of a bucket's part; rows of one part that meet the other at once
PART, STRIPE = 1024, 32
#: least hashes of a text's shingles that go with it into open buckets; how many hundredths below the limit a pair may be by them, if they are all hashes of both and if not
LEAST, EXACT_SLACK, SLACK = 256, 1, 9
#: differing bits of linked fingerprints
RADIUS = 4
#: 64-bit words of a sketch, and the lower bit of each pair of bits
WORDS, LOWER = BANDS * MINIMA // 32, np.uint64(0x5555555555555555)
_random = np.random.default_rng(20)
FLIP, ODD = (_random.integers(0, 1 << 64, BANDS * MINIMA, np.uint64) for _ in range(2))
ODD |= np.uint64(1)
MIX, START = (_random.integers(0, 1 << 64, k, np.uint64) | np.uint64(1) for k in (MINIMA, BANDS))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a set of shingle hashes; sets without shingles have the largest."""
    least = np.full(BANDS * MINIMA, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), STEP):
        np.minimum(least, ((FLIP[:, None] ^ hashes[at : at + STEP]) * ODD[:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of minima."""
    keys = START.copy()
    for k in range(MINIMA):
        keys = (keys ^ least[k::MINIMA]) * MIX[k]
        keys ^= keys >> np.uint64(31)
    return keys


def sketch(least: np.ndarray) -> bytes:
    """Two bits of each of the minima."""
    two = ((least >> np.uint64(13)) & np.uint64(3)).reshape(WORDS, 32)
    return np.bitwise_or.reduce(two << (2 * np.arange(32, dtype=np.uint64)), axis=1).astype("<u8").tobytes()


def agreements(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many minima sketches agree, for arrays (..., WORDS) that broadcast against each other."""
    other = x ^ y
    return BANDS * MINIMA - np.bitwise_count((other | (other >> np.uint64(1))) & LOWER).sum(axis=-1, dtype=np.int64)


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, WORDS)


def bands_udf(width: int, seed: int):
    """UDF from text to its fingerprint, its number of different shingles, its band keys, and its sketch."""
    kind = pa.struct([("fp", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for t in texts.cast(pa.binary()).to_pylist():
                every = shingle_hashes(t or b"", width, seed)
                found = np.unique(every)
                least = minima(found)
                rows.append({"fp": int(np.uint64(majority(every)).view(np.int64)), "n": len(found), "keys": band_keys(least).view(np.int64), "sketch": sketch(least)})
            yield pa.array(rows, kind)

    return F.arrow_udf(of, "fp bigint, n bigint, keys array<bigint>, sketch binary")


def agreeing_udf():
    """UDF from two sketches to the number of minima in which they agree."""

    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array(agreements(unpacked(left), unpacked(right)))

    return F.arrow_udf(of, "bigint")


def least_udf(width: int, seed: int):
    """UDF from text to the LEAST smallest of its different shingle hashes, in order, as bytes."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([np.unique(shingle_hashes(t or b"", width, seed))[:LEAST].astype("<u8").tobytes() for t in texts.cast(pa.binary()).to_pylist()], pa.binary())

    return F.arrow_udf(of, "binary")


def alike_by_least(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets may be alike by their LEAST smallest hashes: of the smallest of the union, so many are in both. Sets that are given whole are judged exactly, but for EXACT_SLACK."""
    whole = max(len(x), len(y)) < LEAST
    both = np.concatenate((x, y))
    both.sort()
    twice = both[1:] == both[:-1]
    if not whole:  # the LEAST smallest different hashes of both
        new = np.flatnonzero(np.concatenate(([True], ~twice)))
        if len(new) > LEAST:
            twice = twice[: new[LEAST] - 1]
            return 100 * int(twice.sum()) >= (percent - SLACK) * LEAST
    common = int(twice.sum())
    return 100 * common >= (percent - (EXACT_SLACK if whole else SLACK)) * (len(x) + len(y) - common)


def set_udf(width: int, seed: int):
    """UDF from text to its different shingle hashes in order."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([np.unique(shingle_hashes(t or b"", width, seed)).view(np.int64) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))

    return F.arrow_udf(of, "array<bigint>")


def common_udf():
    """UDF from two sets to the number of their common members."""

    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            sets = ((x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)) for x, y in zip(left, right, strict=True))
            yield pa.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets], pa.int64())

    return F.arrow_udf(of, "bigint")


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b; a written table) whose sets have a Jaccard similarity of at least percent / 100; two empty sets are alike. Sets of texts that very many pairs have in b are sent to all tasks."""
    often = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("many"))
    ends = durable(sets.join(often, sets.uid == often.b).select("b", "many", F.col("found").alias("of_b")), "ends")
    one = sets.select(F.col("uid").alias("a"), F.col("found").alias("of_a"))
    both = join_by_count(pairs, ends, "b", "many").join(one, "a").withColumn("common", common_udf()("of_a", "of_b"))
    return both.where(100 * F.col("common") >= percent * (F.size("of_a") + F.size("of_b") - F.col("common"))).select("a", "b")


def open_pairs(percent: int):
    """mapInArrow function: rows (key, i, j, first, uid, n, root, sketch, least) ordered by (key, i, j) to pairs (a, b) of one bucket's parts i and j that are in different components and may be alike. first says whether a row is of part i."""

    def compare(first: np.ndarray, uid: np.ndarray, n: np.ndarray, root: np.ndarray, words: np.ndarray, least: list[bytes], same: bool) -> Iterator[pa.RecordBatch]:
        left, right = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
        for at in range(0, len(left), STRIPE):
            own = left[at : at + STRIPE]
            may = (root[own, None] != root[right]) & (100 * np.minimum(n[own, None], n[right]) >= percent * np.maximum(n[own, None], n[right]))
            if same:
                may &= own[:, None] < right
            x, y = np.nonzero(may)
            if len(x):
                keep = agreements(words[own[x]], words[right[y]]) >= AGREE
                x, y = own[x[keep]], right[y[keep]]
                keep = np.fromiter((alike_by_least(np.frombuffer(least[a], "<u8"), np.frombuffer(least[b], "<u8"), percent) for a, b in zip(x, y, strict=True)), bool, len(x))
                yield pa.RecordBatch.from_arrays([pa.array(uid[x[keep]]), pa.array(uid[y[keep]])], ["a", "b"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                columns = (t.column(c).to_numpy() for c in ("first", "uid", "n", "root"))
                yield from compare(*columns, unpacked(t.column("sketch")), t.column("least").to_pylist(), now[1] == now[2])

        for batch in batches:
            names = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if now is not None and tuple(names[lo]) != now:
                        yield from done()
                        held = []
                    now = tuple(names[lo])
                    held.append(batch.slice(lo, hi - lo))
        yield from done()

    return of


def print_pairs(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) among the uids of rows (uid, fp; a written table) by op10's method: of each fingerprint one row stands for it, the others are paired with that, and fingerprints are linked by ball hashing."""
    prints = durable(rows.groupBy("fp").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("many")), "prints")
    copies = join_by_count(rows.select("fp", F.col("uid").alias("a")), prints.where("many > 1").select("fp", F.col("uid").alias("b"), "many"), "fp", "many").where("a <> b")
    links = durable(near_links(prints.select("fp"), radius=radius), "near").select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    end = lambda c: prints.select(F.col("fp").alias(f"_{c}"), F.col("uid").alias(c))
    return copies.select("a", "b").unionByName(links.join(end("a"), "_a").join(end("b"), "_b").select("a", "b"))


def similar_links(rows: DataFrame, texts: DataFrame, *, width: int = 5, seed: int = 42, percent: int = 80, part: int = PART, prints: DataFrame | None = None) -> DataFrame:
    """Links (a, b) among the uids of rows (uid, at, n, keys and sketch; a written table), whose texts are those of `texts` (at, text); components are those of all verified candidate pairs. With prints (uid, fp) of the rows, pairs by fingerprints come first."""
    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent  # noqa: E731  else the sizes alone rule it out
    keyed = rows.select("uid", F.explode("keys").alias("key"))
    shared = durable(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "buckets")
    own = durable(rows_with(keyed, shared, "key", many="many").select("uid", "key", "many"), "own")
    degree = own.groupBy("uid").agg(F.sum("many").alias("degree"))
    wanted = durable(rows.select("uid", "at", "n", "sketch").join(degree, "uid"), "wanted")
    members = durable(own.select("uid", "key").join(wanted.select("uid", "n", "degree", "sketch"), "uid"), "members")

    def verified(pairs: DataFrame, known: DataFrame = wanted) -> DataFrame:
        """Links among pairs (a, b) of known rows; whole sets are made for their texts only."""
        pairs = durable(pairs.distinct(), "pairs")
        ends = durable(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct().join(known.select("uid", "at"), "uid"), "ends")
        sets = durable(rows_with(texts, ends, "at").select("uid", set_udf(width, seed)("text").alias("found")), "sets")
        return durable(alike(pairs, sets, percent), "links")

    def rooted(links: DataFrame) -> DataFrame:
        roots = durable(components(links), "roots")
        return durable(members.join(roots, members.uid == roots.node, "left").select("key", "uid", "n", "degree", "sketch", F.coalesce("root", "uid").alias("root")), "named")

    links, named = None, members.withColumn("root", F.col("uid"))
    if prints is not None:
        links = verified(print_pairs(prints), rows)
        named = rooted(links)
    for k in range(ROUNDS):
        order = F.struct(-F.col("degree"), "uid") if k == 0 else F.struct(F.xxhash64("uid", "key", F.lit(k)), "uid")
        centre = F.min_by(F.struct("uid", "n", "root", "sketch"), order).alias("c")
        open_ = durable(named.groupBy("key").agg(centre, F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("many")).where("low < high").select("key", "c", "many"), "open")
        apart = join_by_count(named, open_, "key", "many").where((F.col("root") != F.col("c.root")) & near(F.col("n"), F.col("c.n")))
        more = verified(apart.where(agreeing_udf()("sketch", "c.sketch") >= AGREE).select(F.col("uid").alias("a"), F.col("c.uid").alias("b")))
        links = more if links is None else durable(links.unionByName(more), "links")
        named = rooted(links)
    open_ = durable(named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("many")).where("low < high").select("key", "many"), "open")
    # a bucket of g parts goes to a task for each pair of parts
    g = F.ceil(F.col("many") / part).cast("int")
    left = durable(join_by_count(named, open_, "key", "many"), "left")
    known = left.select("uid").distinct().join(wanted.select("uid", "at"), "uid")
    least = durable(rows_with(texts, durable(known, "known"), "at").select("uid", least_udf(width, seed)("text").alias("least")), "least")
    placed = left.join(least, "uid").withColumn("g", g).withColumn("p", F.pmod(F.xxhash64("uid"), F.col("g")).cast("int"))
    met = placed.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") <= F.col("q")).alias("first"), "uid", "n", "root", "sketch", "least")
    dealt = met.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return links.unionByName(verified(dealt.mapInArrow(open_pairs(percent), "a bigint, b bigint")))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, seed: int = 42, percent: int = 80) -> DataFrame:
    """docs without all but one row of each group of near copies: the one with the smallest id stays (of rows with that id, one; null ids come last).

    Near copies are linked by a Jaccard similarity of at least percent / 100 of
    their sets of `width`-word shingles, A-Z lower-cased; groups are the
    components of links. Null text is empty; texts without words are alike. Very
    long texts are read whole. An empty table gives an empty one. docs is read more than once and
    must give the same rows each time.
    """
    bound_arrow(docs.sparkSession)
    base = located(docs, id=id_col, text=text_col)
    made = base.withColumn("of", bands_udf(width, seed)(whole_text()))
    rows = durable(made.select("at", "id", F.monotonically_increasing_id().alias("uid"), "of.fp", "of.n", "of.keys", "of.sketch"), "bands")
    texts = base.select("at", whole_text().alias("text"))
    roots = durable(components(similar_links(rows, texts, width=width, seed=seed, percent=percent, prints=rows.select("uid", "fp"))), "roots")
    grouped = durable(rows.select("at", "id", "uid").join(roots, F.col("uid") == F.col("node")).select("at", "id", "uid", "root"), "grouped")
    first = durable(grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid"))["uid"].alias("kept"), F.count(F.lit(1)).alias("held")), "first")
    gone = durable(join_by_count(grouped, first, "root", "held").where("uid <> kept").select("at"), "gone")
    return rows_without(base.select("row", "at"), gone, "at").select("row.*")
