"""Frequent phrases that are tighter than chance, from merged count-min sketches.

First, every task counts the hashes of its phrases in a count-min
sketch, whose cells stop at the threshold, and hands on its blocks; equal blocks
are added up and only say which cells reach the threshold. As a sketch never
counts too little, a phrase with a cell below it is rare. There are two sketches: one of words
and pairs, then one of the longer phrases whose pairs all survive, as
rare phrases would fill its cells. Then the phrases that survive are counted exactly by their words.
Candidates are then scored by their weakest cut, those that occur only inside a
longer one are dropped, and the best of each language are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.common import bound_arrow, durable, join_by_count, packed, rows_with, shard_number, whole_text
from cargolens.llm.word_arrays import Words, byte_classes, chunks, mixed

SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
CLASSES = byte_classes(SPACES, BREAKS)
LONGEST = 5
#: sizes of phrases that each sketch counts, one after another
LEVELS = (range(1, 3), range(3, LONGEST + 1))
#: rows of a sketch, cells of a row, cells of a block that tasks hand on
ROWS, CELLS, BLOCK = 2, 1 << 24, 1 << 16
#: splits of the table that a task reads: sketches, and counts of frequent phrases, come once from each task
SPLITS = 4
#: different phrases that a task holds before it hands on their counts
HELD = 300_000
STEP = np.uint64(0x9E3779B97F4A7C15)
SALTS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5CB3A5F1C9D7B21))


class Phrases:
    """Hashes of the phrases of 1 to LONGEST words that begin at each word of some texts' parts, by language."""

    def __init__(self, parts: list[bytes], counted: np.ndarray, langs: list[str]) -> None:
        self.words = Words([p.lower() for p in parts], CLASSES)
        w = self.words
        seed = np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], np.uint64)[w.text]
        self.first, self.second = mixed(w.hashes(0) ^ seed), w.hashes(1)
        self.begins = w.starts - w.text_starts[w.text] < counted[w.text]

    def together(self, size: int) -> np.ndarray:
        """Words at which a phrase of `size` words begins that lies in one piece."""
        m = len(self.words) - size + 1
        return np.flatnonzero(self.words.piece[size - 1 :] == self.words.piece[:m]) if m > 0 else np.empty(0, np.int64)

    def hashes(self, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
        """Hash of the phrase of `size` words at each place."""
        own = (self.first, self.second)[which]
        out = own[at]
        for k in range(1, size):
            out = out * STEP + own[at + k]
        return mixed(out + np.uint64(size))

    def living(self, reach: dict[int, np.ndarray], cells: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places, hashes) of the phrases of up to `longest` words whose cells, and whose parts' cells, reach the threshold, where that is known for their size."""
        live = np.ones(len(self.words) + 1, bool)
        for size in range(1, longest + 1):
            at = self.together(size)
            at = at[live[at] & live[at + 1]] if size > 1 else at
            hashes = self.hashes(at, size)
            known = reach.get(level_of(size))
            if known is not None:
                ok = known[0, cells_of(hashes, 0, cells)]
                for row in range(1, ROWS):
                    ok[ok] = known[row, cells_of(hashes[ok], row, cells)]
                at, hashes = at[ok], hashes[ok]
            live[:] = False
            live[at] = True
            yield size, at, hashes


def level_of(size: int) -> int:
    """Number of the sketch that counts phrases of this size."""
    return next(k for k, sizes in enumerate(LEVELS) if size in sizes)


def cells_of(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mixed(hashes ^ SALTS[row]) & np.uint64(cells - 1)).astype(np.int64)


def sketch_blocks(least: int, cells: int, sizes: range, sent: dict):
    """mapInArrow function: rows (lang, text) to the task's sketch of the phrases of these sizes that the bitmaps in `sent` let live, in blocks (row, block, cells), and rows (-1, 0, lang, n) with its numbers of words."""
    kind = np.uint8 if least < 256 else np.uint32

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, reach = np.zeros((ROWS, cells), np.uint32), reaching(sent, cells)
        totals: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for owners, parts, counted in chunks(batch.column(1).cast(pa.binary()).to_pylist(), BREAKS, LONGEST - 1):
                own = [langs[i] for i in owners]
                found = Phrases(parts, counted, own)
                for i, n in enumerate(np.bincount(found.words.text[found.begins], minlength=len(parts)).tolist()):
                    totals[own[i]] = totals.get(own[i], 0) + n
                for size, at, hashes in found.living(reach, cells, sizes[-1]):
                    if size in sizes:
                        for row in range(ROWS):
                            np.add.at(sketch[row], cells_of(hashes[found.begins[at]], row, cells), np.uint32(1))
        names = ["row", "block", "lang", "n", "cells"]
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary())
        if totals:
            values = ([-1] * len(totals), [0] * len(totals), list(totals), list(totals.values()), [None] * len(totals))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)
        small = zstandard.ZstdCompressor(level=1)
        for row in range(ROWS if totals else 0):
            for b, block in enumerate(sketch[row].reshape(-1, min(BLOCK, cells))):
                if block.any():
                    data = small.compress(np.minimum(block, least).astype(kind).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((row, b, None, 0, data), kinds, strict=True)], names)

    return of


def reaching(sent: dict, cells: int) -> dict[int, np.ndarray]:
    """By level, which cells of each row reach the threshold, from broadcast bitmaps."""
    out, width = {}, min(BLOCK, cells)
    for level, blocks in sent.items():
        out[level] = np.zeros((ROWS, cells), bool)
        for (row, block), bits in blocks.value.items():
            out[level][row, block * width : (block + 1) * width] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little", count=width)
    return out


def added_blocks(least: int, cells: int):
    """mapInArrow function: blocks ordered by (row, block) to one bitmap (row, block, bits) of the cells that reach the threshold together."""
    kind = np.uint8 if least < 256 else np.uint32

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, total = zstandard.ZstdDecompressor(), np.zeros(min(BLOCK, cells), np.uint32)
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                bits = np.packbits(total >= least, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([bits], pa.binary())], ["row", "block", "bits"])

        for batch in batches:
            for row, block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row, block) != now:
                    yield from done()
                    now = (row, block)
                    total[:] = 0
                np.minimum(total + np.frombuffer(whole.decompress(data), kind), least, out=total)
        yield from done()

    return of


def exact_counts(sent: dict, cells: int):
    """mapInArrow function: rows (lang, text) to (lang, phrase, size, n) of the phrases whose cells, and whose parts' cells, reach the threshold."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = reaching(sent, cells)
        held: dict[tuple[int, int], list] = {}

        def flush() -> pa.RecordBatch:
            rows = list(zip(*held.values(), strict=True)) or [(), (), (), ()]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["lang", "phrase", "size", "n"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for owners, parts, counted in chunks(batch.column(1).cast(pa.binary()).to_pylist(), BREAKS, LONGEST - 1):
                own = [langs[i] for i in owners]
                found = Phrases(parts, counted, own)
                for size, at, hashes in found.living(reach, cells, LONGEST):
                    tell = found.begins[at]
                    tally(held, found, own, at[tell], hashes[tell], size)
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        yield flush()

    return of


def tally(held: dict, found: Phrases, langs: list[str], at: np.ndarray, hashes: np.ndarray, size: int) -> None:
    """Count phrases by both hashes; runs of equal ones are found by sorting the first."""
    order = np.argsort(hashes, kind="stable")
    at, hashes = at[order], hashes[order]
    check = found.hashes(at, size, 1)
    new = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (check[1:] != check[:-1])))) if len(at) else at
    counts = np.diff(np.append(new, len(at)))
    for key, other, n, i in zip(hashes[new].tolist(), check[new].tolist(), counts.tolist(), at[new].tolist(), strict=True):
        row = held.get((key, other))
        if row is None:
            held[key, other] = [langs[found.words.text[i]], found.words.phrase(i, size), size, n]
        else:
            row[3] += n


def frequent_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 100, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """Written tables (lang, phrase, size, f) of all phrases of 1 to 5 words with f >= least occurrences, and (lang, n) of the words of each language.

    cells, a power of two, bounds what tasks hold (8 bytes each), hand on and are sent (a bit each, for two
    rows). The more phrases share a cell (pairs of words over cells, on average), the more of those below the threshold by
    less than that are counted for nothing; none is lost.
    """
    if cells & (cells - 1):
        raise ValueError("cells must be a power of two")
    bound_arrow(docs.sparkSession)
    spark = docs.sparkSession
    rows = packed(docs, [], lang=lang_col, text=text_col).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().alias("text"))
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-rows.rdd.getNumPartitions() // SPLITS))
    rows = rows.coalesce(tasks)
    shuffles, sent, totals = int(spark.conf.get("spark.sql.shuffle.partitions")), {}, None
    for level, sizes in enumerate(LEVELS):
        parts = durable(rows.mapInArrow(sketch_blocks(least, cells, sizes, dict(sent)), "row int, block int, lang string, n bigint, cells binary"), "sketches")
        totals = totals or durable(parts.where("row < 0").groupBy("lang").agg(F.sum("n").alias("words")), "totals")
        dealt = parts.where("row >= 0").select("row", "block", "cells").repartition(shuffles, "row", "block").sortWithinPartitions("row", "block")
        bits = dealt.mapInArrow(added_blocks(least, cells), "row int, block int, bits binary")
        sent[level] = spark.sparkContext.broadcast({(r["row"], r["block"]): bytes(r["bits"]) for r in bits.collect()})  # 2 bits a cell at most
    counted = rows.mapInArrow(exact_counts(sent, cells), "lang string, phrase string, size int, n bigint")
    frequent = counted.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return durable(frequent, "frequent"), totals


def cut_scores(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, k, l, r, n, score) of the phrases of two words or more: the cut with the least floor(1000 * a * n / (l * r)), ties to the earliest."""
    cuts = frequent.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    first = F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("k"))
    rest = F.substring("phrase", F.length(first) + 2, F.length("phrase"))
    sides = F.array(*(F.struct(F.lit(i).alias("side"), F.struct("lang", part.alias("phrase")).alias("part")) for i, part in enumerate((first, rest))))
    asked = durable(cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.*"), "cuts")
    uses = asked.groupBy("part").agg(F.count(F.lit(1)).alias("many"))
    known = durable(frequent.select(F.struct("lang", "phrase").alias("part"), "f").join(uses, "part"), "parts")
    told = join_by_count(asked, known, "part", "many").groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    whole = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"cast({whole('1000 * a')} * {whole('words')} div ({whole('l')} * {whole('r')}) as bigint)")
    scored = rows_with(told, totals, "lang").select("lang", "phrase", "a", F.col("words").alias("n"), F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    return scored.groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "n", "cut.*")


def inner_phrases(phrase: Column, size: Column) -> Column:
    """All runs of two words or more of a phrase, shorter than it."""
    words = F.split(phrase, " ")
    runs = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.flatten(F.transform(F.sequence(F.lit(2), size - 1), runs))


def collocations(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 100, percent: int = 100, top: int = 2000, cells: int = CELLS
) -> DataFrame:
    """Columns lang, rank, phrase, a, l, r, n and score: the `top` phrases of each language by score, then a, then phrase.

    Texts in lower case (A-Z alone) are cut at . , ; : ! ? and line ends into pieces
    of words between spaces and tabs. Phrases have 2 to 5 words of a piece and a >= least
    occurrences; n counts the language's words, l and r the cut's parts. A phrase
    inside a longer one that has at least percent of its occurrences is dropped.
    Null text is empty, a null language `und`; repeated rows count each; long
    texts are taken whole, in overlapping parts; an empty table gives an empty one.
    """
    frequent, totals = frequent_phrases(docs, text_col=text_col, lang_col=lang_col, least=least, cells=cells)
    inner = frequent.where("size > 2").select("lang", "f", F.explode(inner_phrases(F.col("phrase"), F.col("size"))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    scored = cut_scores(frequent, totals).join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    # first the best of each part of a language, so that none of them is sorted in one task
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(shard_number(docs.sparkSession)))
    some = scored.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
