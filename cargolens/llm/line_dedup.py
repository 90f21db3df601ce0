"""Lines that many documents share, found by probing sharded minimal perfect hashes.

A line's key is hashed to 128 bits, and distinct hashes are counted by the
number of documents that hold them. The index comes in shards by hash. A shard
is a minimal perfect hash, levels of bit arrays in which every key owns one bit,
and two dense arrays at the key's rank: a 64-bit fingerprint, independent of the bits that placed it, and the
document count. Keys that agree in their placing bits stand in a list of their own.
Documents probe the arrays for their lines. If the keys that enough documents hold
are few, the index is made of them and sent to every executor, and documents probe it while they
are read; else it is made of all distinct keys, and each document sends a hash for each
of its distinct keys to the shards.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import bound_arrow, durable, packed, rows_with, rows_without, whole_text

STRIP = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 16
BITS_PER_KEY = 2.0
#: bytes that a key takes in a shard's arrays, about
KEY_BYTES = 13
#: probes of a shard that one group takes, about
PROBES = 200_000
#: counts above this are stored as this
MOST = (1 << 32) - 1
#: levels after which keys that still share their bits go to the list
LEVELS = 64


def line_hashes(lines: list[bytes]) -> np.ndarray:
    """128-bit hash of each line's key as two words (n, 2): placing bits and fingerprint; zeros for an empty key."""
    h = xxhash.xxh3_128_digest
    keys = [x.strip(STRIP).lower() for x in lines]
    return np.frombuffer(b"".join([h(k) if k else b"\0" * 16 for k in keys]), "<u8").reshape(-1, 2)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The different hashes of non-empty keys."""
    own = hashes[hashes.any(axis=1)]
    return np.unique(np.ascontiguousarray(own).view("V16")).view("<u8").reshape(-1, 2) if len(own) > 1 else own


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalising mix, one for each level."""
    x = values ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Ranks 0..n-1 for n distinct 64-bit values; any rank, or -1, for others. Levels are words of 64 bits, with the bits set before each word beside them."""

    def __init__(self, sizes: Sequence[int], levels: list[np.ndarray]) -> None:
        self.sizes, self.levels = sizes, levels
        counts = [np.bitwise_count(x).astype(np.int64) for x in levels]
        self.starts = np.cumsum([0, *(int(c.sum()) for c in counts)])
        self.before = [(np.cumsum(c) - c).astype(np.int32) for c in counts]

    @classmethod
    def build(cls, values: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash, and a mask of the values that it places."""
        sizes, levels, left = [], [], np.arange(len(values))
        placed = np.zeros(len(values), bool)
        while len(left) and len(levels) < LEVELS:
            size = max(64, int(len(left) * BITS_PER_KEY))
            at = (mixed(values[left], len(levels) + 1) % np.uint64(size)).astype(np.int64)
            owned = np.bincount(at, minlength=-(-size // 64) * 64) == 1
            sizes.append(size)
            levels.append(np.packbits(owned, bitorder="little").view("<u8"))
            placed[left[owned[at]]] = True
            left = left[~owned[at]]
        return cls(sizes, levels), placed

    def rank(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), -1, np.int64)
        left = np.arange(len(values))
        for k, (size, words) in enumerate(zip(self.sizes, self.levels, strict=True)):
            at = mixed(values[left], k + 1) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.starts[k] + self.before[k][word] + below)[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


class Shard:
    """Perfect hash with the fingerprint and count arrays, and (hash, hash, count) rows of the keys that it couldn't place."""

    def __init__(self, places: PerfectHash, prints: np.ndarray, counts: np.ndarray, others: np.ndarray) -> None:
        self.places, self.prints, self.counts, self.others = places, prints, counts, others

    @classmethod
    def build(cls, hashes: np.ndarray, counts: np.ndarray) -> Shard:
        """Distinct hashes (n, 2) and their counts."""
        counts = np.minimum(counts, MOST).astype(np.uint32)
        places, placed = PerfectHash.build(hashes[:, 0])
        rank = places.rank(hashes[placed, 0])
        prints, held = np.empty(len(rank), np.uint64), np.empty(len(rank), np.uint32)
        prints[rank], held[rank] = hashes[placed, 1], counts[placed]
        return cls(places, prints, held, np.column_stack((hashes[~placed], counts[~placed].astype(np.uint64))))

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """Documents that hold each key; 0 for keys that aren't indexed, but for one of 2**64 of those."""
        rank = self.places.rank(hashes[:, 0])
        out = np.zeros(len(hashes), np.int64)
        known = rank >= 0
        known[known] = self.prints[rank[known]] == hashes[known, 1]
        out[known] = self.counts[rank[known]]
        for a, b, n in self.others:
            out[(hashes[:, 0] == a) & (hashes[:, 1] == b)] = n
        return out

    def dump(self) -> bytes:
        """About 12 bytes and 4 bits a key."""
        sizes, words = self.places.sizes, [x.astype("<u8").tobytes() for x in self.places.levels]
        head = struct.pack(f"<III{len(sizes)}I", len(sizes), len(self.prints), len(self.others), *sizes)
        return head + b"".join(words) + self.prints.astype("<u8").tobytes() + self.counts.astype("<u4").tobytes() + self.others.astype("<u8").tobytes()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        """The dumped arrays themselves; only the counts of set bits, 4 bytes for 64 bits, are made anew."""
        k, n, more = struct.unpack_from("<III", data)
        sizes = struct.unpack_from(f"<{k}I", data, 12)
        at, levels = 12 + 4 * k, []
        for size in sizes:
            levels.append(np.frombuffer(data, "<u8", -(-size // 64), at))
            at += 8 * len(levels[-1])
        return cls(PerfectHash(sizes, levels), np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<u4", n, at + 8 * n), np.frombuffer(data, "<u8", 3 * more, at + 12 * n).reshape(-1, 3))


def shard_of(first: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(first, 0) % np.uint64(shards)).astype(np.int64)


class LineIndex:
    """All shards, for probing where the documents are."""

    def __init__(self, blobs: dict[int, bytes], shards: int) -> None:
        self.shards, self.held = shards, {k: Shard.load(b) for k, b in blobs.items()}

    def count(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        of = shard_of(hashes[:, 0], self.shards)
        for k in np.unique(of).tolist():
            if k in self.held:
                own = np.flatnonzero(of == k)
                out[own] = self.held[k].count(hashes[own])
        return out


def document_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, n): hash of a key and the number of this batch's documents that hold it."""
    for batch in batches:
        found = [distinct(line_hashes(t.split(b"\n"))) for t in batch.column(0).cast(pa.binary()).to_pylist()]
        if not sum(map(len, found)):
            continue
        keys, counts = np.unique(np.ascontiguousarray(np.concatenate(found)).view("V16"), return_counts=True)
        keys = keys.view("<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(counts.astype(np.int64))], ["a", "b", "n"])


def shard_arrays(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The keys (a, b, n) of one shard to its dumped arrays and the number of (document, key) pairs that it holds."""
    hashes, n = np.stack((table.column("a").to_numpy(), table.column("b").to_numpy()), 1).view(np.uint64), table.column("n").to_numpy()
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "arrays": pa.array([Shard.build(hashes, n).dump()], pa.binary()), "held": pa.array([int(n.sum())], pa.int64())})


def counted_lines(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """A written table (a, b, n): every distinct line key, by its hash, with the number of documents that hold it."""
    bound_arrow(docs.sparkSession)
    keys = packed(docs, [], text=text_col).select(whole_text().alias("text")).mapInArrow(document_keys, "a bigint, b bigint, n bigint")
    return durable(keys.groupBy("a", "b").agg(F.sum("n").alias("n")), "lines")


def line_index(counted: DataFrame, n_keys: int, *, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(written table of shards, number of shards) over the n_keys keys of counted_lines, or some of them: `arrays`, and `held`, the number of (document, key) pairs of the shard's keys. No keys have no shards."""
    shards = max(1, -(-n_keys // shard_keys))

    def placed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for first in batches:
            yield pa.array(shard_of(first.to_numpy(zero_copy_only=False).view(np.uint64), shards).astype(np.int32), pa.int32())

    sharded = counted.withColumn("shard", F.arrow_udf(placed, "int")("a"))
    return durable(sharded.groupBy("shard").applyInArrow(shard_arrays, "shard int, arrays binary, held bigint"), "shards"), shards


RESULT = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
KIND = "n_lines bigint, n_dropped bigint, kept_sha256 string, kept_text string"


def kept_lines(text: bytes, drop: np.ndarray, with_text: bool) -> dict:
    lines = text.split(b"\n")
    kept = b"\n".join([x for x, d in zip(lines, drop.tolist(), strict=True) if not d]) if drop.any() else text
    return {"n_lines": len(lines), "n_dropped": int(drop.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept_text": kept.decode() if with_text else None}


def drop_shared_lines(docs: DataFrame, *, text_col: str = "text", min_docs: int = 10, carry: Sequence[str] | None = None, with_text: bool = True, sent_bytes: int = 64 << 20, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Columns row, n_lines, n_dropped, kept_sha256 and kept_text (null without with_text).

    Lines are split at line feeds; null or empty text is one empty line. A key
    is the line without ASCII white space at its ends, A-Z lower-cased; empty
    keys are never dropped. A key held by min_docs rows or more loses all its
    lines, also repeats within a document. Rows that repeat a document count as
    documents of their own. Texts are read whole, whatever their length. An empty table gives an empty one.

    Where the arrays of the keys with min_docs documents have at most sent_bytes, the
    index is made of these and sent to every executor; else it is made of all distinct keys and stays a
    table of shards, to which documents send their probes: the same result. Keys of one 128-bit hash
    count as one; a key that isn't in a sent index is taken for one of its keys once in 2**64.
    """
    counted = counted_lines(docs, text_col=text_col)
    made = packed(docs, carry, text=text_col).select("row", whole_text().alias("text"))
    sizes = counted.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("n") >= min_docs).alias("often")).first()
    if sizes["often"] * KEY_BYTES <= sent_bytes:
        index, shards = line_index(counted.where(F.col("n") >= min_docs), sizes["often"], shard_keys=shard_keys)
        return sent_index(made, index.select("shard", "arrays"), shards, min_docs, with_text)
    index, shards = line_index(counted, sizes["all"], shard_keys=shard_keys)
    return routed_probes(made, index, shards, min_docs, with_text)


def sent_index(made: DataFrame, index: DataFrame, shards: int, min_docs: int, with_text: bool) -> DataFrame:
    sent = made.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["arrays"]) for r in index.collect()})  # at most sent_bytes

    def probe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        arrays = LineIndex(sent.value, shards)
        for texts in batches:
            held = texts.cast(pa.binary()).to_pylist()
            lines = [t.split(b"\n") for t in held]
            hashes = line_hashes([x for own in lines for x in own])
            drop = (arrays.count(hashes) >= min_docs) & hashes.any(axis=1)
            ends = np.cumsum([len(own) for own in lines])
            yield pa.array([kept_lines(t, d, with_text) for t, d in zip(held, np.split(drop, ends[:-1]), strict=True)], RESULT)

    return made.select("row", F.arrow_udf(probe, KIND)("text").alias("of")).select("row", "of.*")


def routed_probes(made: DataFrame, index: DataFrame, shards: int, min_docs: int, with_text: bool) -> DataFrame:
    # Every (document, key) pair is one probe, so a shard's `held` is the number it gets; a shard of many is split over salts
    # and its arrays go to each of them. The driver holds a number a shard: 4 bytes for some 65,000 distinct lines.
    salt_of = np.ones(shards, np.int32)
    for r in index.where(F.col("held") > PROBES).select("shard", "held").toLocalIterator():
        salt_of[r["shard"]] = -(-r["held"] // PROBES)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distinct(line_hashes(t.split(b"\n"))) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            uid = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
            own = np.concatenate(found)
            of = shard_of(own[:, 0], shards)
            salt = (mixed(uid.view(np.uint64), 3) % salt_of[of].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of, salt, uid, own[:, 0].view(np.int64), own[:, 1].view(np.int64))], ["shard", "salt", "uid", "a", "b"])

    def look(probed: pa.Table, held: pa.Table) -> pa.Table:
        hashes = np.stack((probed.column("a").to_numpy(), probed.column("b").to_numpy()), 1).view(np.uint64)
        count = Shard.load(held.column("arrays")[0].as_py()).count(hashes) if len(held) else np.zeros(len(hashes), np.int64)
        return probed.select(["uid", "a", "b"]).filter(pa.array(count >= min_docs))

    rows = durable(made.withColumn("uid", F.monotonically_increasing_id()), "texts")
    sent = rows.select("uid", "text").mapInArrow(probes, "shard bigint, salt bigint, uid bigint, a bigint, b bigint")
    salts = F.greatest(F.lit(1), F.ceil(F.col("held") / PROBES)).cast("bigint")
    spread = index.select(F.col("shard").cast("bigint").alias("shard"), F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"), "arrays")
    hits = sent.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInArrow(look, "uid bigint, a bigint, b bigint")
    keys = durable(hits.groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("keys")), "hits")

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, shared in batches:
            out = []
            for t, own in zip(texts.cast(pa.binary()).to_pylist(), shared, strict=True):
                hashes = line_hashes(t.split(b"\n"))
                drop = np.zeros(len(hashes), bool)
                if own.is_valid and len(own.values):
                    known = np.stack([own.values.field(k).to_numpy() for k in (0, 1)], 1).view("V16").ravel()
                    drop = np.isin(np.ascontiguousarray(hashes).view("V16").ravel(), known)
                out.append(kept_lines(t, drop, with_text))
            yield pa.array(out, RESULT)

    # only documents that lose a line meet their keys; the others stay where they are
    none = F.lit(None).cast(keys.schema["keys"].dataType).alias("keys")
    both = rows_with(rows, keys, "uid").select("row", "text", "keys").unionByName(rows_without(rows, keys.select("uid"), "uid").select("row", "text", none))
    return both.select("row", F.arrow_udf(cut, KIND)("text", "keys").alias("of")).select("row", "of.*")
