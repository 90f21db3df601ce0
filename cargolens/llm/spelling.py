"""Spelling variants of words: Aho-Corasick shards over the halves of every word.

One inserted, deleted or replaced character leaves one of a word's two halves
intact: the first at the start of the other word, the second at its end. Shards
hold the halves of all words in an automaton each. Every word is scanned by the
shards that can hold a half of a word of its length, one more or one less; a hit
counts if the half's offset and the words' lengths agree, and the distance is
then verified. Halves that many words share are looked up by what remains
of the word with one character deleted, and dealt to shards by it, so that such
a half is neither one task's group nor compared word by word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import SENT_ROWS, bound_arrow, durable, packed, whole_text

#: Latin-1 bytes of letters in lower case (A-Z alone are changed), all others as spaces
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: different words that a task holds before it hands on their counts
HELD = 400_000
#: halves that a shard holds, about
SHARD_HALVES = 20_000
#: words that share a half: more are looked up by the rest, and more than HOT are dealt by it too
LISTED, HOT = 32, 2048


def counted_words(every: int, least_length: int):
    """mapInArrow function: rows (id, text) to (word, n), words of at least least_length code points."""

    def flush(total: Counter) -> pa.RecordBatch:
        held = [(w.decode("latin-1"), n) for w, n in total.items() if n and len(w) >= least_length]
        words, counts = zip(*held, strict=True) if held else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                runs = text.encode("latin-1", "replace").translate(LETTERS).split()
                total.update(runs)
                start = zlib.crc32(f"{name}:".encode())
                hit = [r for r in set(runs) if zlib.crc32(as_utf8(r), start) % every == 0]
                if hit:
                    own = Counter(runs)
                    for r in hit:
                        at = zlib.crc32(as_utf8(r), start) % len(r)
                        total[r] -= own[r]
                        total[r[:at] + r[at + 1 :]] += own[r]
            if len(total) > HELD:
                yield flush(total)
                total = Counter()
        yield flush(total)

    return of


def as_utf8(run: bytes) -> bytes:
    return run if run.isascii() else run.decode("latin-1").encode()


def word_counts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least_length: int = 6, least_n: int = 5
) -> DataFrame:
    """(word, n) of the words of all texts, A-Z lower-cased, with least_length code points and least_n occurrences.

    A run of letters whose crc32 with its document's id is a multiple of `every`
    loses one code point. Null text has no words; a null id counts as the empty
    string; an empty table has no words.
    """
    bound_arrow(docs.sparkSession)
    rows = packed(docs, [], id=id_col, text=text_col)
    rows = rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")), whole_text())
    found = rows.mapInArrow(counted_words(every, least_length), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def one_apart(a: str, b: str) -> int:
    """Where a and b differ if they do so by exactly one inserted, deleted or replaced character, else -1."""
    short = min(len(a), len(b))
    at = next((i for i in range(short) if a[i] != b[i]), short)
    if len(a) == len(b):
        return at if at < short and a[at + 1 :] == b[at + 1 :] else -1
    longer, other = (a, b) if len(a) > len(b) else (b, a)
    return at if len(longer) == short + 1 and longer[at + 1 :] == other[at:] else -1


def without_one(text: str) -> set[str]:
    """The text, and the text without each of its characters."""
    return {text, *(text[:i] + text[i + 1 :] for i in range(len(text)))}


def shared_rest(a: str, b: str, at: int) -> str:
    """The one string through which two rests that differ at `at` are counted: the shorter, or what both are without that character."""
    return a[:at] + a[at + 1 :] if len(a) == len(b) else min(a, b, key=len)


def rest_of(word: str, size: int, side: int) -> str:
    """What remains of a word without its first (side 0) or last `size` characters."""
    return word[size:] if side == 0 else word[: len(word) - size]


class Halves:
    """Words of one shard by side and half; `rests` has them by their rest with at most one character deleted."""

    def __init__(self) -> None:
        self.listed: tuple[list, list] = ([], [])
        self.rests: tuple[dict, dict] = ({}, {})

    def settle(self, size: int) -> None:
        for side in (0, 1):
            if len(self.listed[side]) > LISTED:
                for word, n in self.listed[side]:
                    for rest in without_one(rest_of(word, size, side)):
                        self.rests[side].setdefault(rest, []).append((word, n))
                self.listed[side].clear()

    def near(self, word: str, size: int, side: int) -> Iterator[tuple[str, int]]:
        """Words of this half and side that are one character apart from `word`, each in one shard and for one half only."""
        for other, n in self.listed[side]:
            if abs(len(other) - len(word)) <= 1 and not counted_first(word, other, side) and one_apart(word, other) >= 0:
                yield other, n
        if self.rests[side]:
            mine = rest_of(word, size, side)
            for rest in without_one(mine):
                for other, n in self.rests[side].get(rest, ()):
                    theirs = rest_of(other, size, side)
                    at = one_apart(mine, theirs)
                    if at >= 0 and shared_rest(mine, theirs, at) == rest and not counted_first(word, other, side):
                        yield other, n


def counted_first(word: str, other: str, side: int) -> bool:
    """Whether a pair met through its second half also meets through its first."""
    return side == 1 and word.startswith(other[: len(other) // 2])


def scan_shard(entries: pa.Table, visitors: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best) of the visiting words that have near words among the shard's entries (side, half, rest, held, held_n)."""
    import ahocorasick

    halves: dict[str, Halves] = {}
    for side, half, rest, word, n in zip(*(entries.column(c).to_pylist() for c in ("side", "half", "rest", "held", "held_n")), strict=True):
        held = halves.setdefault(half, Halves())
        if rest is None:
            held.listed[side].append((word, n))
        else:
            held.rests[side].setdefault(rest, []).append((word, n))
    found = []
    if halves:
        automaton = ahocorasick.Automaton()
        for half, held in halves.items():
            held.settle(len(half))
            automaton.add_word(half, (len(half), held))
        automaton.make_automaton()
        for word in visitors.column("visitor").to_pylist():
            count, best = 0, None
            for end, (size, held) in automaton.iter(word):
                for side in (0, 1):
                    if end + 1 == (size if side == 0 else len(word)):
                        for other, n in held.near(word, size, side):
                            count += 1
                            best = min(best or (-n, other), (-n, other))
            if count:
                found.append((word, count, -best[0], best[1]))
    columns = list(zip(*found, strict=True)) or [(), (), (), ()]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, *, shard_halves: int = SHARD_HALVES, hot: int = HOT) -> DataFrame:
    """(word, n_near, best_n, best) of words (word, n; a written table of distinct words): how many other words are one character apart, and which of them has the largest n (ties: the first in order). Words without any are left out."""
    size = lambda length: F.floor(length / 2).cast("int")
    m = F.length("word")

    def part(side: int, length: Column, word_length: Column) -> Column:
        """(side, half, rest of the word) for the half that a word of `length` characters has on this side."""
        of_half = size(length) if side == 0 else length - size(length)
        half = F.substring("word", F.lit(1), of_half) if side == 0 else F.substring("word", word_length - of_half + 1, of_half)
        rest = F.substring("word", of_half + 1, word_length) if side == 0 else F.substring("word", F.lit(1), word_length - of_half)
        return F.struct(F.lit(side).alias("side"), half.alias("half"), rest.alias("over"))

    own = F.array(part(0, m, m), part(1, m, m))
    met = F.array_distinct(F.array(*(part(s, m + k, m) for s in (0, 1) for k in (-1, 0, 1))))
    entries = words.select("word", "n", F.explode(own).alias("p")).select("word", "n", "p.*")
    visits = words.select("word", F.explode(met).alias("p")).select("word", "p.*").where("half <> ''")
    often = durable(entries.groupBy("side", "half").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > hot).select("side", "half"), "often")
    n_often = often.count()
    told = F.broadcast(often) if n_often <= SENT_ROWS else often
    over, at = F.col("over"), F.col("i")

    def dealt(rows: DataFrame) -> DataFrame:
        """rows with `rest`: null, or for a half of many words a row for each rest with at most one character deleted."""
        none = F.lit(None).cast("string")
        if not n_often:
            return rows.withColumn("rest", none)
        cut = F.transform(F.sequence(F.lit(1), F.length(over)), lambda i: F.concat(F.substring(over, F.lit(1), i - 1), F.substring(over, i + 1, F.length(over))))
        rests = F.when(F.length(over) > 0, F.array_distinct(F.concat(F.array(over), cut))).otherwise(F.array(over))
        few = rows.join(told, ["side", "half"], "left_anti").withColumn("rest", none)
        return few.unionByName(rows.join(told, ["side", "half"]).withColumn("rest", F.explode(rests)))

    shards = max(1, -(-2 * words.count() // shard_halves))
    shard = F.pmod(F.xxhash64("side", "half", "rest"), F.lit(shards)).alias("shard")
    held = dealt(entries).select(shard, "side", "half", "rest", F.col("word").alias("held"), F.col("n").alias("held_n"))
    visitors = dealt(visits).select(shard, F.col("word").alias("visitor")).distinct()
    found = held.groupBy("shard").cogroup(visitors.groupBy("shard")).applyInArrow(scan_shard, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form; a written table): the last word that following forms leads to. Paths are halved each round; forms never lead back, as n grows along them."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        on = now.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        now = durable(now.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least_length: int = 6, least_n: int = 5, ratio: int = 5,
    shard_halves: int = SHARD_HALVES, hot: int = HOT,
) -> DataFrame:
    """Columns word, form, root, n, n_near and form_n over the words of word_counts.

    A word's form is the word one character apart with the largest n (ties: the
    first in code-point order) if that n is at least ratio times the word's, else
    null; root is the end of the chain of forms, the word itself without one.
    Null and empty texts have no words; repeated rows count each; very long
    texts and words are taken whole; an empty table gives an empty one. ratio
    is over 1 and least_length at least 4.
    """
    if ratio <= 1 or least_length < 4:
        raise ValueError("ratio must be over 1, least_length at least 4")
    words = durable(word_counts(docs, id_col=id_col, text_col=text_col, every=every, least_length=least_length, least_n=least_n), "words")
    near = near_words(words, shard_halves=shard_halves, hot=hot)
    formed = F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False))
    told = durable(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")
        ),
        "forms",
    )
    ends = roots(told.where("form is not null").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
