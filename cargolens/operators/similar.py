"""Pairs of similar names from a join of rare parts, and greedy choices over them in rounds.

The similarity of two names counts matched characters. Of names that are alike
enough, all but a few characters match. Where few enough are left over, the
characters that both have in common are made by deleting the others: names of two
lengths meet at what is left of them (a word that most names have stays whole among those). Where that are too many, the matches lie
in few runs, so such names share many of
their grams (runs of 2 or 3 characters within a word), and whoever takes
only the rarest grams of each name finds each pair by one of them. Names that are
alike because one's words are among the other's are found by their rarest words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import combinations, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions import names as N
from cargolens.sources.written import written

#: sizes of grams: the smaller ones are for names that need not share a larger one with all names alike. Of two
#: names either one is sure to share a gram of some size, which both have as keys, or both have the next size too.
SIZES = (4, 3, 2)
ASKS = -1.0
#: ways to delete from a name, at most, for names of its length and another's to meet at what is left
WAYS = 2000


def numbered(grams: list[str]) -> list[str]:
    """Repeated grams told apart by their number."""
    seen: Counter = Counter()
    out = []
    for g in grams:
        seen[g] += 1
        out.append(f"{g}\0{seen[g]}")
    return out


def grams(words: list[str], size: int) -> list[str]:
    """A gram for each character: it and those before it in its word."""
    return numbered([("^" * (size - 1) + w)[i : i + size] for w in words for i in range(len(w))])


def least_shared(length: float, partner: float, share: float, size: int, words: int) -> int:
    """How many grams of `size` two names share at least, if they have so many characters in all, of which the share matches.

    What doesn't match parts the matches into runs, one more than there are such
    characters at most; the first size - 1 characters of a run may have other grams, and spaces have none.
    """
    both = length + partner
    return math.ceil(both * share / 2 - (size - 1) * (both * (1 - share) + 1) - (words - 1) - 1e-9)


def deletions(length: int, partner: int, share: float) -> tuple[int, int] | None:
    """How many characters of two names of such lengths are deleted for the least number of matches to be left; None if they can't be alike."""
    left = math.ceil((length + partner) * share / 2 - 1e-9)
    return (length - left, partner - left) if left <= min(length, partner) else None


def by_deletion(length: int, partner: int, share: float, whole: int = 0) -> bool:
    """Whether names of two lengths meet at what is left of them, if so many characters stay whole."""
    n = deletions(length, partner, share)
    return n is not None and math.comb(max(length - whole, n[0]), n[0]) <= WAYS and math.comb(max(partner - whole, n[1]), n[1]) <= WAYS


def by_grams(length: int, lengths: Iterable[int], share: float, whole: int = 0) -> bool:
    """Whether a name must meet names of one of these lengths by grams."""
    return any(deletions(length, n, share) and not by_deletion(length, n, share, whole) for n in lengths)


@lru_cache(256)
def without(word: str, n: int) -> frozenset[str]:
    """word without n of its characters, in all ways."""
    return frozenset(map("".join, combinations(word, len(word) - n))) if n <= len(word) else frozenset()


def remnants(words: tuple[str, ...], n: int, joins: Iterable[int] | None = None) -> set[str]:
    """What n deletions leave of sorted words, in all ways: of a character, or of the space between a word and any later one, as words that both names have may stand elsewhere. Words are put in order again. `joins` says how many are spaces, any number if None."""
    if len(words) == 1:
        return set(without(words[0], n)) if joins is None or 0 in joins else set()
    out, merged = set(), {words}
    for k in range(n + 1):
        for own in merged if joins is None or k in joins else ():
            # the places of n - k deletions among the words, as bars between stars
            for bars in combinations(range(n - k + len(own) - 1), len(own) - 1):
                ends = (-1, *bars, n - k + len(own) - 1)
                each = [without(w, hi - lo - 1) for w, lo, hi in zip(own, ends, ends[1:], strict=False)]
                out.update(" ".join(sorted(filter(None, some))) for some in product(*each))
        merged = {(*own[:i], own[i] + own[j], *own[i + 1 : j], *own[j + 1 :]) for own in merged for i, j in combinations(range(len(own)), 2)}
    return out


def forms(name: str) -> tuple[str, tuple[str, ...], int]:
    """A name without spaces, its different words in order, and the length of these with spaces between them."""
    words = tuple(sorted(set(name.split())))
    return name.replace(" ", ""), words, sum(map(len, words)) + len(words) - 1


class Lengths:
    """The lengths of the names that are compared: without spaces (solid), and of their different words with the number of these: of names that have `word` (those) and of others (rest). No name has the word ""."""

    def __init__(self, solid: Iterable[int], rest: Iterable[tuple[int, int]], word: str = "", those: Iterable[tuple[int, int]] = ()):
        self.solid, self.rest, self.word, self.those = set(solid), set(rest), word, set(those)

    def groups(self, words: tuple[str, ...]) -> list[tuple[str, tuple[str, ...], Iterable[tuple[int, int]], int]]:
        """(kind, words, partners, characters that stay whole) of a name by whether partners have `word` as it has. Two names begin with the words that both have when they are compared, so nothing is deleted of these if either has others; if not, names meet by the words."""
        if not words:
            return []
        if self.word not in words:
            return [("words", words, self.rest | self.those, 0)]
        others = tuple(w for w in words if w != self.word)
        return [("words", words, self.rest, 0), *([("those", others, self.those, len(self.word) + 1)] if others else [])]


def lengths_of(names: DataFrame) -> Lengths:
    """Lengths of distinct names; the word is the most frequent one, if half of the names have it."""
    words = names.select(F.explode(F.array_distinct(F.split("name", r"\s+"))).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("many"))
    most = words.orderBy(F.col("many").desc(), "word").limit(1).withColumn("names", F.lit(names.count())).first()
    word = most["word"] if most and 2 * most["many"] >= most["names"] else ""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {(len(solid), length, len(words), word in words) for batch in batches for solid, words, length in map(forms, batch.column(0).to_pylist())}
        yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, f, strict=True)) for f in found], kinds)

    kinds = pa.schema([("solid", pa.int32()), ("length", pa.int32()), ("words", pa.int32()), ("has", pa.bool_())])
    sizes = dealt(names.select("name")).mapInArrow(of, "solid int, length int, words int, has boolean").distinct().collect()
    return Lengths((r["solid"] for r in sizes), ((r["length"], r["words"]) for r in sizes if not r["has"]), word, ((r["length"], r["words"]) for r in sizes if r["has"]))


def remnant_keys(name: str, across: int, spacing: int, lengths: Lengths) -> list[tuple[str, int]]:
    """(key, role) of a name: what is left of it where it meets names of these lengths by deletion, and whether it is one of the shorter ones (1) or longer ones (2) there, or all have one length (0)."""
    solid, words, length = forms(name)
    close, far = (spacing - 0.5) / 100, (across - 0.5) / 100
    made: dict[tuple, set[str]] = {}
    out = {}
    for kind, of, partners, whole, own, share in (*((*g, length, far) for g in lengths.groups(words)), ("solid", (solid,), ((n, 1) for n in lengths.solid), 0, len(solid), close)):
        count = len(of) if kind == "solid" else len(words)
        for n, theirs in partners:
            if by_deletion(own, n, share, whole):
                k, other = deletions(own, n, share)
                # as many spaces more are deleted of one name as it has words more
                joins = range(max(0, count - theirs), min(k, other + count - theirs) + 1)
                if (kind, k, joins) not in made:
                    made[kind, k, joins] = remnants(of, k, joins)
                at, role = f"{kind} {min(own, n)} {max(own, n)} ", 0 if own == n else 1 if own < n else 2
                out.update((at + x, role) for x in made[kind, k, joins])
    return list(out.items())


def name_keys(name: str, across: int, spacing: int, lengths: Lengths) -> list[tuple[str, str, float, float]]:
    """(kind, key, weight, limit) of a name among names of these lengths: of a kind, the rarest keys are kept as long as the weights before a key don't pass the limit. Keys with the limit ASKS are never kept, but all of them ask for names that keep them."""
    out = []
    close, far = (spacing - 0.5) / 100, (across - 0.5) / 100
    solid, words, length = forms(name)
    out.append(("equal", solid, 1.0, 0.0))

    def add(kind: str, words: Iterable[str], length: int, share: float, size: int) -> bool:
        """Keys by grams; whether a partner of the least length is sure to share enough of them, a quarter, for the rarest to be rare."""
        own, shared = grams(words, size), least_shared(length, length * share / (2 - share), share, size, len(words))
        sure = shared >= (1 if size == SIZES[-1] else max(1, len(own) / 4))
        out.extend((f"{kind}{size}", g, 1.0, len(own) - shared if sure else ASKS) for g in own)
        return sure

    if by_grams(len(solid), lengths.solid, close):
        any(add("solid", [solid], len(solid), close, size) for size in SIZES)
    if words:
        out += [("word", w, len(w) + 1.0, length * (1 - far / (2 - far)) + 1e-9) for w in words]
        if any(by_grams(length, {n for n, _ in partners}, far, whole) for _, _, partners, whole in lengths.groups(words)):
            any(add("gram", words, length, far, size) for size in SIZES)
    return out


#: rows of a batch that a task makes
BATCH = 10_000


def dealt(df: DataFrame) -> DataFrame:
    """df dealt to as many tasks as shuffles have: what Python does with its rows costs far more than moving them, though they are few bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def rows_of(names: DataFrame, made: Callable[[str], Iterable[tuple]], fields: str, by: str = "name string") -> DataFrame:
    """A row (by, fields) for each tuple that is made of a name; `by` names the column that tells names apart."""
    schema = f"{by}, {fields}"
    kinds = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64()}
    columns = [(n, kinds[kind]) for n, kind in (f.split() for f in schema.split(", "))]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for own, name in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                rows.extend((own, *k) for k in made(name))
                if len(rows) >= BATCH:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), columns, strict=True)], [n for n, _ in columns])

    return dealt(names.select(F.col("name").alias("_name"), by.split()[0])).mapInArrow(of, schema)


def reaches(a: str, b: str, least: int) -> bool:
    """Whether ratio(a, b) is at least `least`."""
    return a == b or (round(200 * min(len(a), len(b)) / (len(a) + len(b))) >= least and N.ratio(a, b) >= least)


def alike_across(x: str, y: str, across: int, spacing: int, least_length_ratio: float) -> bool:
    """Names of similar length whose words (by token_set_ratio), or whose characters without spaces, nearly all match."""
    longest = max(len(x), len(y))
    if longest and min(len(x), len(y)) / longest < least_length_ratio:
        return False
    own, other = set(x.split()), set(y.split())
    if not own or not other:
        return across <= 0 or reaches(x.replace(" ", ""), y.replace(" ", ""), spacing)
    both = " ".join(sorted(own & other))
    left, right = (f"{both} {' '.join(sorted(rest))}".strip() for rest in (own - other, other - own))
    if both and round(200 * len(both) / (len(both) + min(len(left), len(right)))) >= across:  # both is how left and right begin
        return True
    return reaches(left, right, across) or reaches(x.replace(" ", ""), y.replace(" ", ""), spacing)


def pair_test(test: Callable[[str, str], bool]):
    """UDF from two names to whether they are alike."""

    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array([test(x, y) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.bool_())

    return F.arrow_udf(of, "boolean")


def similar_lengths(least_length_ratio: float) -> Column:
    """Whether the names a and b are."""
    x, y = F.length("a"), F.length("b")
    return F.least(x, y) >= least_length_ratio * F.greatest(x, y) - 1e-9


def shared_remnants(names: DataFrame, by: str, across: int, spacing: int, lengths: Lengths) -> DataFrame:
    """(by, key, role): the keys at which names meet by deletion, if any name meets another there."""
    made = rows_of(names, lambda n: remnant_keys(n, across, spacing, lengths), "key string, role int", by)
    each = made.withColumn("key", F.xxhash64("key"))
    own = Window.partitionBy("key")
    met = each.select("*", F.count(F.lit(1)).over(own).alias("many"), F.min("role").over(own).alias("least"), F.max("role").over(own).alias("most"))
    return met.where("if(most = 0, many > 1, least < most)").select(by.split()[0], "key", "role")


def pairs_by_parts(names: DataFrame, across: int, spacing: int, least_length_ratio: float, lengths: Lengths) -> DataFrame:
    """(a, b), a < b, of names that may be alike and don't meet by deletion.

    Every word and gram is counted; of each kind a name keeps its rarest ones. Pairs meet at
    a key that one of both has kept and the other has kept or asks for.
    """
    each = written(rows_of(names, lambda n: name_keys(n, across, spacing, lengths), "kind string, key string, weight double, limit double"), "keys", "zstd")
    often = each.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    shared = each.join(often, ["kind", "key"], "left")
    before = F.coalesce(F.sum("weight").over(Window.partitionBy("name", "kind").orderBy(F.coalesce("many", F.lit(1)), "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # a key that no other name has finds nothing, but takes its place among the rarest
    asks = (F.col("kind") == "word") | (F.col("limit") == ASKS)
    held = shared.withColumn("kept", before <= F.col("limit")).withColumn("asks", asks).where("many > 1 and (kept or asks)")
    held = written(held.select("kind", "key", "name", "kept", "asks"), "kept", "zstd")
    a, b = held.where("kept").select("kind", "key", F.col("name").alias("a")), held.select("kind", "key", F.col("name").alias("b"), "kept")
    met = a.join(b, ["kind", "key"]).where("a <> b").where(similar_lengths(least_length_ratio))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def candidate_pairs(names: DataFrame, across: int, spacing: int, least_length_ratio: float) -> DataFrame:
    """(a, b), a < b, of distinct names (a written table, column name) that may be alike: no alike pair is left out.

    The lengths that occur, a short list, say which names meet by what is left of
    them and which by parts. No group is
    brought together: pairs come from joins, whose large keys Spark can split.
    """
    lengths = lengths_of(names)
    left = written(shared_remnants(names, "name string", across, spacing, lengths), "shared", "zstd")
    low, high = left.where("role < 2").select("key", F.col("name").alias("a"), "role"), left.where("role <> 1").select("key", F.col("name").alias("b"), F.col("role").alias("_role"))
    met = low.join(high, "key").where("if(role = 0 and _role = 0, a < b, a <> b)").where(similar_lengths(least_length_ratio))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.unionByName(pairs_by_parts(names, across, spacing, least_length_ratio, lengths)).distinct()


def similar_names(names: DataFrame, across: int = 90, spacing: int = 95, least_length_ratio: float = 0.7) -> DataFrame:
    """(a, b), a < b, of distinct names that are alike; null isn't a name."""
    own = written(names.select("name").where("name is not null").distinct(), "names")
    alike = pair_test(lambda x, y: alike_across(x, y, across, spacing, least_length_ratio))
    return dealt(candidate_pairs(own, across, spacing, least_length_ratio)).where(alike("a", "b"))


#: pairs that one task settles in a round of greedy_heads, about
EDGES = 2_000_000
#: keys of names and pairs that one task reads in a round of greedy_names, about; keys of heads that it holds, at most
ROWS, HELD = 4_000_000, 1_000_000
#: keys of a round's heads that are sent to all tasks, at most (some 30 MB)
SENT = 500_000


def numbered_nodes(nodes: DataFrame) -> DataFrame:
    """(name, number), written: numbers from 0 in the order of place, by ranges of sampled rows."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(nodes.select("name", "place").repartitionByRange(parts, "place").withColumn("_s", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(F.lit(0)).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    offsets = dealt.groupBy("_s").agg(F.count(F.lit(1)).alias("_m")).select("_s", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_s").orderBy("place"))
    return written(dealt.withColumn("_i", inside).join(F.broadcast(offsets), "_s").select("name", (F.col("_before") + F.col("_i") - 1).alias("number")), "numbered")


def settled(alike: Callable[[str, str], bool] | None, held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: names in order, (number, name, own, ask, early), to (number, head): a name's head is the first of those before it that are alike and have none, else itself.

    `own` are a name's keys, `ask` those of names that may be alike, `early` earlier names that are. It is compared with heads only. Once heads have
    `held` keys, later names are left out.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[int, tuple[int, ...]] = {}
        heads: dict[int, str] = {}
        for batch in batches:
            out = []
            for number, name, own, ask, early in zip(batch.column("number").to_pylist(), batch.column("name").to_pylist(), *(lists(batch.column(c)) for c in ("own", "ask", "early")), strict=True):
                sure = {h for h in early if h in heads}
                found = set(sure)
                for k in ask:
                    if k in index:
                        found.update(index[k])
                head = next((h for h in sorted(found) if h in sure or alike(heads[h], name)), number)
                if head == number:
                    heads[number] = name
                    for k in own:
                        index[k] = (*index.get(k, ()), number)
                out.append((number, head))
                if len(index) >= held:
                    break
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], ["number", "head"])
            if len(index) >= held:
                return

    return of


def lists(column: pa.ListArray) -> Iterator[list[int]]:
    """Lists of numbers, through numpy, which is far quicker for them."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).tolist()
    return (values[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))


def in_order(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """(late, early, a, b) of pairs (a, b): their numbers, and their names with the earlier one as a."""
    number = lambda c: known.select(F.col("name").alias(c), F.col("number").alias(f"_{c}"))
    met = pairs.join(number("a"), "a").join(number("b"), "b")
    return met.select(F.greatest("_a", "_b").alias("late"), F.least("_a", "_b").alias("early"), F.when(F.col("_a") < F.col("_b"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("_a") < F.col("_b"), F.col("b")).otherwise(F.col("a")).alias("b"))


def heads_in_rounds(known: DataFrame, shared: DataFrame | None, pairs: DataFrame, alike: Callable[[str, str], bool] | None, rows: int, held: int = HELD) -> DataFrame:
    """(name, head) of known (name, number): names are taken by the first of those before them that are alike and not taken.

    Alike are pairs (late, early) of numbers, and names that meet at a shared key (number, key, role) and pass the test, the earlier one first: matched characters may depend on it. In
    each round one task settles the first names, with about so many keys and pairs in all or fewer, in order, and their heads take the
    later names, by joins. Names are compared with heads only, which are few where many are alike; a name with no
    pair and no shared key isn't looked at.
    """
    none = F.array().cast("array<bigint>")
    # the earlier one is looked at too, as paired with itself
    both = F.explode(F.array(F.struct(F.col("late").alias("number"), F.col("early").alias("key")), F.struct(F.col("early").alias("number"), F.col("early").alias("key"))))
    early = pairs.select(both.alias("of")).groupBy("of.number").agg(F.collect_set("of.key").alias("early"))
    open_ = known.join(early, "number", "left")
    if shared is None:
        open_ = open_.withColumn("own", none).withColumn("ask", none)
    else:  # of names of two lengths, the shorter ones ask for longer ones and these for shorter ones
        own, ask = (F.when(F.col("role") == 0, F.col("key")).otherwise(F.xxhash64("key", role)) for role in (F.col("role"), 3 - F.col("role")))
        keys = shared.select("number", own.alias("own"), ask.alias("ask")).groupBy("number").agg(F.collect_list("own").alias("own"), F.collect_list("ask").alias("ask"))
        open_ = open_.join(keys, "number", "left")
    open_ = open_.select("number", "name", *(F.coalesce(c, none).alias(c) for c in ("own", "ask", "early"))).where("size(own) + size(early) > 0")
    open_ = written(open_, "open", "zstd")
    taken = []
    while n := open_.agg(F.sum(F.size("own") + F.size("early"))).first()[0]:
        last = open_.agg(F.percentile_approx("number", rows / n, 10_000)).first()[0] if n > rows else None
        first = open_ if last is None else open_.where(F.col("number") <= last)
        chosen = written(first.repartition(1).sortWithinPartitions("number").mapInArrow(settled(alike, held), "number bigint, head bigint"), "taken")
        taken.append(chosen)
        done = chosen.agg(F.max("number")).first()[0]
        left = open_.where(F.col("number") > done)
        heads = open_.where(F.col("number") <= done).join(chosen.where("number = head").select("number"), "number").select(F.col("number").alias("head"), F.col("name").alias("a"), "own")
        met = left.select("number", F.explode("early").alias("head")).join(heads.select("head"), "head").select("number", "head")
        if shared is not None:
            theirs = written(heads.select("head", "a", F.explode("own").alias("key")), "theirs")
            theirs = F.broadcast(theirs) if theirs.count() <= SENT else theirs
            may = left.select("number", F.col("name").alias("b"), F.explode("ask").alias("key")).join(theirs, "key").select("number", "head", "a", "b").distinct()
            met = met.unionByName(dealt(may).where(pair_test(alike)("a", "b")).select("number", "head"))
        later = written(met.groupBy("number").agg(F.min("head").alias("head")), "taken")
        taken.append(later)
        open_ = written(left.join(later.select("number"), "number", "left_anti"), "open", "zstd")
    if not taken:
        return known.select("name", F.col("name").alias("head"))
    every = taken[0]
    for t in taken[1:]:
        every = every.unionByName(t)
    names = known.select(F.col("number").alias("head"), F.col("name").alias("_head"))
    led = known.join(every.where("number <> head").join(names, "head").select("number", "_head"), "number", "left")
    return led.select("name", F.coalesce("_head", "name").alias("head"))


def greedy_heads(nodes: DataFrame, pairs: DataFrame, edges: int = EDGES) -> DataFrame:
    """(name, head): each node, in order, is the head of all later nodes paired with it that have no earlier head.

    nodes are (name, place), places being comparable and distinct; pairs (a, b)
    join two nodes. Rounds are at most as many as `edges` goes into the pairs, however long the chains of nodes that wait for one another are.
    """
    known = numbered_nodes(nodes)
    return heads_in_rounds(known, None, in_order(known, pairs), None, edges)


def greedy_names(nodes: DataFrame, across: int = 90, spacing: int = 95, least_length_ratio: float = 0.7, rows: int = ROWS, held: int = HELD) -> DataFrame:
    """(name, head) of nodes (name, place): greedy_heads over all names that are alike, but names that meet by deletion are compared with heads only, not with each other: of names that differ in a number, each has hundreds of others alike."""
    known = numbered_nodes(nodes)
    names = known.select("name", "number")
    lengths = lengths_of(names)
    alike = lambda x, y: alike_across(x, y, across, spacing, least_length_ratio)
    pairs = dealt(in_order(known, pairs_by_parts(names, across, spacing, least_length_ratio, lengths))).where(pair_test(alike)("a", "b"))
    return heads_in_rounds(known, shared_remnants(names, "number bigint", across, spacing, lengths), pairs, alike, rows, held)


#: open names of a block that are looked at for heads in a round, at most; members of a block that one task compares with them
HEADS, MEMBERS = 256, 20_000


def block_heads(forms: DataFrame, alike: Callable[[str, str], bool], heads: int = HEADS, members: int = MEMBERS) -> DataFrame:
    """(block, form, head): within each block, in the order of `place`, each form takes all later forms that are alike and have no head yet.

    forms are (block, form, place), a form once in a block. In each round the
    first `heads` open forms of every block settle among themselves who is a
    head; the block's other open forms, dealt to as many tasks as they need, look
    for the first of those heads that is alike. So no task holds a block, and the
    forms are compared with heads only, as in the plain loop. Blocks of at most `heads` forms are rows of many to a batch.
    """
    many = F.count(F.lit(1)).over(Window.partitionBy("block"))
    told = written(forms.select("block", "form", "place").withColumn("many", many), "forms")
    kinds = f"block {dict(told.dtypes)['block']}, form string"

    def settle_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, own in zip(batch.column("block").to_pylist(), batch.column("of").to_pylist(), strict=True):
                found: list[str] = []
                for form in own:
                    head = next((h for h in found if alike(h, form)), None)
                    found += [form] if head is None else []
                    rows.append((block, form, form if head is None else head))
            fields = (batch.schema.field("block").type, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], fields[k]) for k in range(3)], ["block", "form", "head"])

    small = told.where(f"many between 2 and {heads}").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "form"))).alias("of")).select("block", F.col("of.form").alias("of"))
    parts = [told.where("many = 1").select("block", "form", F.col("form").alias("head")), written(dealt(small).mapInArrow(settle_small, f"{kinds}, head string"), "small")]
    open_ = told.where(f"many > {heads}").drop("many")

    def settle(rows: pa.Table) -> pa.Table:
        found: list[str] = []
        for form in rows.sort_by("rank").column("form").to_pylist():
            if not any(alike(h, form) for h in found):
                found.append(form)
        return pa.table({"block": rows.column("block").slice(0, 1).take([0] * len(found)), "form": pa.array(found, pa.string()), "at": pa.array(range(len(found)), pa.int32())})

    def look(rows: pa.Table, found: pa.Table) -> pa.Table:
        order = found.sort_by("at").column("head_form").to_pylist()
        own = [next((h for h in order if h == form or alike(h, form)), None) for form in rows.column("form").to_pylist()]
        return rows.select(["block", "form", "place"]).append_column("head", pa.array(own, pa.string()))

    while not open_.isEmpty():
        rank = F.row_number().over(Window.partitionBy("block").orderBy("place"))
        first = open_.withColumn("rank", rank).where(F.col("rank") <= heads).select("block", "form", "rank")
        chosen = written(first.groupBy("block").applyInArrow(settle, f"{kinds}, at int"), "chosen")
        sizes = open_.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / members).cast("int").alias("parts"))
        sent = chosen.select("block", F.col("form").alias("head_form"), "at").join(sizes, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        spread = open_.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("form"), F.col("parts")).cast("int"))
        looked = written(spread.select("block", "form", "place", "part").groupBy("block", "part").cogroup(sent.groupBy("block", "part")).applyInArrow(look, f"{kinds}, place {dict(told.dtypes)['place']}, head string"), "told")
        parts.append(looked.where("head is not null").select("block", "form", "head"))
        open_ = looked.where("head is null").select("block", "form", "place")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
