"""Exact duplicates by composable polynomial fingerprints.

A chunk of bytes b0..bn-1 hashes to sum(bi * R**(n-1-i)) modulo a prime, so
that hash(A + B) = hash(A) * R**len(B) + hash(B). Every text is cut into chunk
rows; a chunk's hash, shifted by the bytes after it, is its term of the text's
hash, and the terms are summed by an aggregate. Two primes and the byte
length make a fingerprint. Texts that share one are then compared chunk by
chunk: per fingerprint and chunk number the smallest and the largest chunk must
be the same bytes, which partial aggregation decides without bringing a group
together. Groups that fail this are grouped by their whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import bound_arrow, durable, join_by_count, located, rows_with, rows_without, whole_text

CHUNK = 4096
#: primes below 2**31 with a base for each
FIELDS = ((2147483647, 1103515245), (2147483629, 1566083941))
#: bytes of a chunk row: texts are hashed and compared in such pieces
PIECE = 1 << 15


def powers(prime: int, base: int, n: int) -> np.ndarray:
    """base**(n-1) ... base**0 modulo prime."""
    out = np.empty(n, np.int64)
    x = 1
    for i in range(n - 1, -1, -1):
        out[i] = x
        x = x * base % prime
    return out


POWERS = [powers(p, r, CHUNK) for p, r in FIELDS]


def chunk_hashes(data: bytes, which: int) -> list[int]:
    """Hash of each CHUNK bytes of data, the last chunk as long as it is."""
    prime = FIELDS[which][0]
    values = np.frombuffer(data, np.uint8)
    whole = len(values) // CHUNK
    out = [int(x) for x in (values[: whole * CHUNK].reshape(whole, CHUNK).astype(np.int64) @ POWERS[which]) % prime] if whole else []
    rest = values[whole * CHUNK :]
    if len(rest):
        out.append(int(rest.astype(np.int64) @ POWERS[which][CHUNK - len(rest) :]) % prime)
    return out


def combine(parts: Iterator[tuple[int, int]], which: int) -> tuple[int, int]:
    """(hash, length) of the concatenation of parts, each (hash, length)."""
    prime, base = FIELDS[which]
    total, length = 0, 0
    for h, n in parts:
        total = (total * pow(base, n, prime) + h) % prime
        length += n
    return total, length


def fingerprint(data: bytes, which: int) -> int:
    lengths = [CHUNK] * (len(data) // CHUNK) + [len(data) % CHUNK] * (len(data) % CHUNK > 0)
    return combine(zip(chunk_hashes(data, which), lengths, strict=True), which)[0]


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; texts without such runs aren't rewritten."""
    return F.when(text.rlike(r"[\x20\x09-\x0D]{2}|[\x09-\x0D]"), F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")).otherwise(text)


def pieces_of(size: int, *kept: str) -> Callable[[DataFrame], DataFrame]:
    """Rows with a string column `text` to its byte chunks of `size` (one empty chunk for an empty text): kept columns, chunk_no, n_bytes of the text, and chunk. Chunks are cut one after another as they are asked for."""

    def of(rows: DataFrame) -> DataFrame:
        data = rows.select(*kept, F.col("text").cast("binary").alias("data")).withColumn("n_bytes", F.octet_length("data").cast("bigint"))
        numbers = F.sequence(F.lit(0).cast("bigint"), F.expr(f"greatest(n_bytes - 1, 0L) div {size}"))
        cut = data.select("*", F.explode(numbers).alias("chunk_no"))
        return cut.select(*kept, "chunk_no", "n_bytes", F.substring("data", (F.col("chunk_no") * size + 1).cast("int"), F.lit(size)).alias("chunk"))

    return of


def shifted_hashes() -> Callable[[str, Column], Column]:
    """UDF from a chunk and the number of bytes after it in its text to the chunk's terms of the text's two hashes."""
    kind = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])

    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for chunks, after in batches:
            rows = []
            for b, n in zip(chunks.to_pylist(), after.to_pylist(), strict=True):
                rows.append({h: fingerprint(b, k) * pow(base, n, prime) % prime for k, (h, (prime, base)) in enumerate(zip(("h1", "h2"), FIELDS, strict=True))})
            yield pa.array(rows, kind)

    return F.arrow_udf(of, "h1 bigint, h2 bigint")


def combine_chunks(chunks: DataFrame, *, key: Sequence[str], size: int, number: str = "chunk_no", data: str = "chunk", total: str = "n_bytes") -> DataFrame:
    """Fingerprints of documents that come as chunk rows of `size` bytes (the last shorter), each hashed where it lies: key columns and fp.

    A chunk's hash times R**(bytes after it) is its term of the document's
    hash, so partial sums add up in any order, and chunks of a huge document
    meet only as two numbers. A document without bytes has the hash 0.
    """
    after = F.greatest(F.col(total) - (F.col(number) + 1) * size, F.lit(0))
    each = chunks.select(*key, F.col(total).alias("n_bytes"), shifted_hashes()(F.col(data), after).alias("h"))
    sums = each.groupBy(*key, "n_bytes").agg(F.sum("h.h1").alias("h1"), F.sum("h.h2").alias("h2"))
    return sums.select(*key, F.struct((F.col("h1") % FIELDS[0][0]).alias("h1"), (F.col("h2") % FIELDS[1][0]).alias("h2"), "n_bytes").alias("fp"))


def exact_members(base: DataFrame, chunk: int, prints: Column | None) -> tuple[DataFrame, DataFrame]:
    """Written tables for located rows (at, id, text): each row's (at, id, text_sha256), and for rows of groups of several (at, keep_at, keep_id, group_size)."""
    bound_arrow(base.sparkSession)
    raw = base.select("at", "id", whole_text().alias("text"))
    texts = raw.withColumn("text", normalised(F.col("text")))
    if prints is None:
        hashed = combine_chunks(pieces_of(chunk, "at", "id", "text_sha256")(texts.withColumn("text_sha256", F.sha2("text", 256))), key=["at", "id", "text_sha256"], size=chunk)
    else:
        hashed = texts.select("at", "id", F.sha2("text", 256).alias("text_sha256"), prints.alias("fp"))
    hashed = durable(hashed, "fingerprints")

    order = F.struct(F.col("id").isNull().alias("none"), "id", "at")
    sizes = hashed.groupBy("fp").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("first"))
    several = durable(sizes.where("group_size > 1"), "several")
    members = durable(join_by_count(hashed.select("at", "id", "fp"), several, "fp", "group_size"), "members")
    # Chunkwise comparison: in a group of equal texts each chunk number has one value, as often as the group has rows
    held = rows_with(raw.select("at", "text"), members.select("at", "fp"), "at").withColumn("text", normalised(F.col("text")))
    compared = pieces_of(chunk, "fp")(held).groupBy("fp", "chunk_no").agg((F.min("chunk") == F.max("chunk")).alias("same"), F.count(F.lit(1)).alias("n"))
    unlike = durable(compared.join(several.select("fp", "group_size"), "fp").where("not same or n <> group_size").select("fp").distinct(), "unlike")
    if not unlike.isEmpty():  # fingerprints that different texts share: their groups go by the whole texts
        apart = durable(members.join(unlike, "fp", "left_semi").select("at", "id"), "apart")
        whole = durable(rows_with(raw.select("at", "text"), apart, "at").withColumn("text", normalised(F.col("text"))), "whole")
        groups = durable(whole.groupBy("text").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("first")).where("group_size > 1"), "groups")
        again = join_by_count(whole, groups, "text", "group_size").select("at", "id", "group_size", "first")
        members = durable(members.join(unlike, "fp", "left_anti").select("at", "id", "group_size", "first").unionByName(again), "members")
    return hashed, members.select("at", F.col("first")["at"].alias("keep_at"), F.col("first")["id"].alias("keep_id"), "group_size")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None, chunk: int = PIECE, prints: Column | None = None) -> DataFrame:
    """Columns row (a struct of docs' columns, or of those in carry), id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after each run of ASCII white space became
    one space; null counts as empty. Of equal texts the row with the smallest
    id stays; null ids come last, and of rows that repeat the smallest id one
    stays. Texts of any length are hashed and compared in chunks of `chunk` bytes. An
    empty table gives an empty one. docs is read more than once and must give
    the same rows each time. prints replaces the fingerprint by another
    expression of the normalised column `text` that equal texts share, for
    tests of colliding ones.
    """
    base = located(docs, id=id_col, text=text_col)
    hashed, members = exact_members(base, chunk, prints)
    found = hashed.select("at", "id", "text_sha256").join(members, "at", "left")
    told = found.select("at", "id", F.coalesce("keep_id", F.when(F.col("group_size").isNull(), F.col("id"))).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), (F.col("keep_at").isNull() | (F.col("keep_at") == F.col("at"))).alias("kept"), "text_sha256")
    row = F.col("row") if carry is None else F.struct(*(F.col("row")[c].alias(c) for c in carry))
    return base.select(row.alias("row"), "at").join(told, "at").select("row", "id", "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = PIECE) -> DataFrame:
    """docs with one row of each group of equal texts, by the rules of exact_groups: null text is empty, null ids come last, one of repeated rows stays, and an empty table gives an empty one. Only the rows that go are named to the second scan."""
    base = located(docs, id=id_col, text=text_col)
    _, members = exact_members(base, chunk, None)
    gone = durable(members.where("keep_at <> at").select("at"), "gone")
    return rows_without(base.select("row", "at"), gone, "at").select("row.*")
