"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 2r bits exactly when some 64-bit
value lies within r bits of both. Every distinct fingerprint therefore emits all
values within r = radius / 2 bits of itself, and fingerprints that emit
the same value are linked. Instead of shuffling one row per value, the values are shuffled in
blocks that share their leading bits: a fingerprint goes once to each block
that its ball reaches, and the block's task makes the values, sorts them and
links those that collide. Members of one collision are linked to its smallest
member only, never to each other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import bound_arrow, durable, join_by_count, located, packed, rows_without, whole_text

BITS = 64
#: bytes that separate words
SPACE_BYTES = bytes(range(9, 14))
TO_SPACE = bytes.maketrans(SPACE_BYTES, b" " * len(SPACE_BYTES))
#: a block with more fingerprints or values is split by further bits before its values are made
BLOCK, VALUES = 1 << 15, 6_000_000


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of `width` words (of the whole sequence if shorter), A-Z lower-cased, words joined by one space."""
    words = text.lower().translate(TO_SPACE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1))
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit value whose bit is 1 where over half of the hashes have it."""
    n = len(hashes)
    if not n:
        return 0
    total = np.zeros(BITS, np.int64)
    step = 255 * 4096  # partial sums of 255 rows fit a byte
    for at in range(0, n, step):
        bits = np.unpackbits(hashes[at : at + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        short = -len(bits) % 255
        if short and len(bits) > 255:
            bits = np.concatenate((bits, np.zeros((short, BITS), np.uint8)))
        blocks = bits.reshape(-1, 255, BITS) if len(bits) % 255 == 0 else bits[None]
        total += np.add.reduce(blocks, axis=1, dtype=np.uint8).astype(np.int64).sum(axis=0)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprint_udf(width: int, seed: int):
    """UDF from text to its fingerprint as a signed bigint with the same bits."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            prints = np.array([majority(shingle_hashes(t or b"", width, seed)) for t in texts.cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.array(prints.view(np.int64), pa.int64())

    return F.arrow_udf(of, "bigint")


@lru_cache(256)
def masks(bits: int, most: int) -> np.ndarray:
    """All values of `bits` bits with at most `most` ones, fewest first."""
    return np.array([sum(1 << b for b in chosen) for k in range(min(most, bits) + 1) for chosen in combinations(range(bits), k)], np.uint64)


def collisions(prints: np.ndarray, spare: np.ndarray, free: int) -> Iterator[np.ndarray]:
    """Pairs (print, smallest print) of each value that two or more of `prints` reach by flipping at most `spare` of their low `free` bits; their other bits count as equal."""
    if len(prints) < 2:
        return
    if free == 0:
        yield np.stack((prints, np.full_like(prints, prints.min())), 1)
        return
    if len(prints) > BLOCK or sum(len(masks(free, int(s))) * int(n) for s, n in zip(*np.unique(spare, return_counts=True), strict=True)) > VALUES:  # split by the next bit: whoever has the other bit pays a flip
        bit = (prints >> np.uint64(free - 1)) & np.uint64(1)
        for want in (0, 1):
            same = bit == want
            reach = same | (spare > 0)
            yield from collisions(prints[reach], spare[reach] - ~same[reach], free - 1)
        return
    order = np.argsort(prints)
    prints, spare = prints[order], spare[order]
    low = prints & np.uint64((1 << free) - 1)
    values, owners = [], []
    for s in np.unique(spare):
        own = np.flatnonzero(spare == s)
        flips = masks(free, int(s))
        values.append((low[own, None] ^ flips).ravel())
        owners.append(np.repeat(own, len(flips)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    need = int(len(prints) - 1).bit_length()
    if free + need <= BITS:  # value and owner in one word: one plain sort
        packed = (value << np.uint64(need)) | owner.astype(np.uint64)
        packed.sort()
        value, owner = packed >> np.uint64(need), (packed & np.uint64((1 << need) - 1)).astype(np.int64)
    else:
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
    again = np.flatnonzero(value[1:] == value[:-1]) + 1
    if not len(again):
        return
    first = np.concatenate(([True], value[1:] != value[:-1]))
    root = np.maximum.accumulate(np.where(first, np.arange(len(value)), 0))
    yield np.unique(np.stack((prints[owner[again]], prints[owner[root[again]]]), 1), axis=0)


def link_blocks(free: int, half: int):
    """mapInArrow function: rows (block, print) ordered by block, to links (a, b)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(block: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            prints = np.concatenate(parts)
            spare = half - np.bitwise_count((prints >> np.uint64(free)) ^ np.uint64(block)).astype(np.int64)
            for pairs in collisions(prints, spare, free):
                pairs = pairs[pairs[:, 0] != pairs[:, 1]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        open_block, parts = None, []
        for batch in batches:
            block = batch.column(0).to_numpy()
            prints = batch.column(1).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.diff(block)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if hi > lo:
                    if open_block is not None and block[lo] != open_block:
                        yield from links(int(open_block), parts)
                        parts = []
                    open_block = block[lo]
                    parts.append(prints[lo:hi])
        if parts:
            yield from links(int(open_block), parts)

    return of


def block_bits(n: int, half: int) -> int:
    """Leading bits that name a block: the fewest that leave a block half as many fingerprints, on average, as those bits can number (so that a value and its owner fit one word)."""
    for bits in range(6, 31):
        sends = sum(comb(bits, k) for k in range(half + 1))
        if n * sends / 2**bits <= min(2**bits, BLOCK) / 2:
            return bits
    return 30


def near_links(prints: DataFrame, *, radius: int = 4) -> DataFrame:
    """Links (a, b), a > b as unsigned, among distinct bigint fingerprints in column `fp`.

    Every fingerprint with a partner within `radius` bits is linked, and linked
    fingerprints always have at most `radius` differing bits; components are
    those of all such pairs. radius must be even and at most 8.
    """
    if radius % 2 or not 0 <= radius <= 8:
        raise ValueError("radius must be even and at most 8")
    half, spark = radius // 2, prints.sparkSession
    bits = block_bits(prints.count(), half)
    free = BITS - bits
    signed = lambda v: v - (1 << BITS) if v >> (BITS - 1) else v
    flips = F.array(*(F.lit(signed(int(m) << free)).cast("bigint") for m in masks(bits, half)))
    sent = prints.select("fp", F.explode(flips).alias("m")).select(F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("m")), free).cast("int").alias("block"), "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = sent.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(link_blocks(free, half), "a bigint, b bigint")
    return found.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(links: DataFrame) -> DataFrame:
    """Each node of links (a, b) with the smallest node of its component: (node, root).

    Alternates large-star and small-star contraction until nothing changes: every round only takes
    minima and counts per node and joins them back, hubs apart from the other nodes, so that no
    neighbourhood is gathered. Each round is a written table; rounds grow with
    the logarithm of the longest path. Smallest is by signed bigint order.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("many")), "least")
        large = durable(join_by_count(both, least, "u", "many").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # u > v in every edge: a node and its other smaller neighbours go under the smallest of them
        down = durable(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("many")), "down")
        small = join_by_count(large, down, "u", "many").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = durable(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None, width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """Columns row (a struct of docs' columns, or of those in carry), id, fp, root (a fingerprint that names the component) and component: the smallest id reachable over links of at most `radius` bits.

    Null text counts as empty; texts without words have fingerprint zero and
    link like any other. Rows that repeat an id each keep their own
    fingerprint; null ids are never smallest (a component of null ids has
    null). Links join fingerprints, so copies cost nothing. An empty table
    gives an empty one.
    """
    bound_arrow(docs.sparkSession)
    rows = packed(docs, carry, id=id_col, text=text_col).withColumn("fp", fingerprint_udf(width, seed)(whole_text()))
    rows = durable(rows.select("row", "id", "fp"), "fingerprints")
    return join_by_count(rows, fingerprints_named(rows, radius), "fp", "many").drop("many")


def fingerprints_named(rows: DataFrame, radius: int) -> DataFrame:
    """Written table (fp, root, component, many) of rows (id, fp): many rows have the fingerprint."""
    prints = durable(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("many")), "prints")
    roots = durable(components(near_links(prints.select("fp"), radius=radius)), "roots")
    joined = durable(prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", "many", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = durable(joined.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("held")), "smallest")
    return durable(join_by_count(joined, smallest, "root", "held").select("fp", "root", "component", "many"), "components")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """docs without all but one row of each component: a row with the smallest id stays; of null ids one stays. Null text is empty; an empty table gives an empty one. Only the rows that go are named to the second scan."""
    bound_arrow(docs.sparkSession)
    base = located(docs, id=id_col, text=text_col)
    rows = durable(base.withColumn("fp", fingerprint_udf(width, seed)(whole_text())).select("at", "id", "fp"), "fingerprints")
    found = durable(join_by_count(rows, fingerprints_named(rows, radius), "fp", "many").select("at", "id", "root"), "named")
    first = durable(found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at"))["at"].alias("stays"), F.count(F.lit(1)).alias("held")), "first")
    gone = durable(join_by_count(found, first, "root", "held").where("at <> stays").select("at"), "gone")
    return rows_without(base.select("row", "at"), gone, "at").select("row.*")


def fingerprint_hex(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
