"""Exact token counts at every prefix of a text, by dynamic programming over BPE.

In a BPE encoding, whether two neighbouring tokens can stand side by side
depends on these two alone. So the encoding of a prefix is the encoding of some
shorter prefix and one more token that may follow its last one; exactly one
choice fits. One pass over a word gives the last token and the count at each of
its prefixes. A text's table holds the change in count from each code point to
the next: one signed byte each, whose running sum is the token count of every
prefix. Truncation and budgets are read from the table without encoding again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.normalizers import NFC, Lowercase, Sequence

from cargolens.llm.common import bound_arrow, packed, whole_text

#: The tokenizer's word pattern, with one space of any kind before a word taken along.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WHITE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The same for texts whose characters are all below U+0250, with the letters and numbers spelled out.
LATIN, NUMBER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_WORDS = rf"[{WHITE}]?(?:'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[{NUMBER}]|[^{WHITE}{LATIN}{NUMBER}]+)|[{WHITE}]"
SPACE_CHARS = frozenset(chr(c) for a, b in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)) for c in range(a, b + 1))
#: words, and prefixes of words, that a worker keeps; prefixes of longer words aren't kept
CACHE, SHARED = 200_000, 64


def word_pattern(white: str, letters: str, numbers: str) -> str:
    return rf"[{white}]?+(?:'s|'t|'re|'ve|'m|'ll|'d|[{letters}]++|[{numbers}]|[^{white}{letters}{numbers}]++)|[{white}]"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def char_classes(tokenizer: Tokenizer, block: int = 256) -> dict[str, list[tuple[int, int]]]:
    """Ranges (first, last) of the code points that the tokenizer's own word pattern takes as letters (L), numbers (N), white space (S) and others (O).

    The library's tables of Unicode aren't those of Python or the regex package, so
    it is asked: a letter goes on a word of letters, another character one of
    those, a number stands alone and white space isn't there. Blocks of one class take two questions.
    """
    ask = tokenizer.pre_tokenizer.pre_tokenize_str
    out: dict[str, list[tuple[int, int]]] = {kind: [] for kind in "LNSO"}

    def add(kind: str, first: int, last: int) -> None:
        if out[kind] and out[kind][-1][1] == first - 1:
            first = out[kind].pop()[0]
        out[kind].append((first, last))

    for first in range(0, 0x110000, block):
        codes = [c for c in range(first, first + block) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, codes))
        pure = [kind for kind, lead in (("L", "a"), ("O", "!")) if [span for _, span in ask(lead + text)] == [(0, len(text) + 1)]]
        if codes and pure:
            add(pure[0], codes[0], codes[-1])
            continue
        spans = {span for _, span in ask("".join(f"a{c} !{c} " for c in text))}
        for at, c in zip(range(0, 6 * len(codes), 6), codes, strict=True):
            add("L" if (at, at + 2) in spans else "O" if (at + 3, at + 5) in spans else "N" if (at + 1, at + 2) in spans else "S", c, c)
    return out


def char_set(ranges: list[tuple[int, int]]) -> str:
    """The inside of a character class."""
    return "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in ranges)


def word_finders(classes: dict[str, list[tuple[int, int]]]) -> tuple[Callable, Callable]:
    """findall of words by the classes, and a search for a character of which the regex package thinks otherwise."""
    every = "".join(chr(c) for ranges in classes.values() for a, b in ranges for c in range(a, b + 1))
    odd: set[int] = set()
    for kind, ours in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", f"[{WHITE}]")):
        odd |= {ord(c) for c in regex.findall(ours, every)} ^ {c for a, b in classes[kind] for c in range(a, b + 1)}
    known = word_pattern(*(char_set(classes[kind]) for kind in "SLN"))
    return regex.compile(known).findall, regex.compile(f"[{char_set([(c, c) for c in sorted(odd)])}]" if odd else "(?!)").search


class PrefixCounter(dict):
    """Maps a word, with or without a space before it, to the changes in count at each of its code points."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.vocab, self.end = frozenset(model["vocab"]), end
        self.longest = max(len(t.removesuffix(end)) for t in self.vocab)
        if self.longest > 120:
            raise ValueError("tokens of over 120 bytes need wider tables")
        self.letters = {chr(b): c for b, c in byte_letters().items()}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.hints = tuple({s[:2] for s in special})
        self.find, self.find_latin, self.beyond = regex.compile(word_pattern(WHITE, r"\p{L}", r"\p{N}")).findall, re.compile(LATIN_WORDS).findall, re.compile("[^\x00-\u024f]").search
        self.path, self.known = path, None
        self.normal = Sequence([NFC(), Lowercase()]).normalize_str  # the library's own tables
        self.pairs: dict[tuple[str, str], bool] = {}
        self.firsts: dict[str, list | None] = {}
        self.lasts: dict[str, list | None] = {}
        self.states: dict[str, list] = {}
        self.plain_tree, self.end_tree = {}, {}
        for token in self.vocab:
            node, body = (self.end_tree, token[: -len(end)]) if token.endswith(end) else (self.plain_tree, token)
            for c in reversed(body):
                node = node.setdefault(c, {})
            node[""] = token
        self.old: dict[str, bytes] = {}
        made: dict[str, int] = {}
        for (a, b), r in self.rank.items():
            if max(made.get(a, -1), made.get(b, -1)) >= r or a + b in made:
                raise ValueError("each merge must make a new token from older ones")
            made[a + b] = r

    def history(self, token: str, side: int) -> list[tuple[str, float, float]] | None:
        """The tokens that stand first (side 0) or last (side -1) while the token's own letters are merged, each with the ranks of the merges that make it and take it away. None if its letters don't merge to it."""
        body, end = (token[: -len(self.end)], self.end) if token.endswith(self.end) else (token, "")
        symbols = list(body)
        symbols[-1] += end
        out, born = [], -1
        while True:
            edge = symbols[side]
            pairs = [self.rank.get((a, b), -1) for a, b in zip(symbols, symbols[1:], strict=False)]
            best = min((r for r in pairs if r >= 0), default=-1)
            if best < 0:
                return [*out, (edge, born, float("inf"))] if symbols == [token] else None
            at = pairs.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            if symbols[side] != edge:
                out.append((edge, born, best))
                born = best

    def may_follow(self, a: str, b: str) -> bool:
        """Whether b can be the token after a (a empty: the first token): no merge across their border comes while both its sides stand there."""
        first = self.firsts.get(b, 0)
        if first == 0:
            first = self.firsts[b] = self.history(b, 0)
        if first is None or not a:
            return first is not None
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            last = self.lasts.get(a, 0)
            if last == 0:
                last = self.lasts[a] = self.history(a, -1)
            rank = self.rank
            known = last is not None and not any((m := rank.get((x, y), -1)) > born and born_y < m < gone and m <= gone_y for x, born, gone in last for y, born_y, gone_y in first)
            if len(self.pairs) > 2 * CACHE:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def choose(self, text: str, at: int, last: list[str], tree: dict) -> tuple[str, int]:
        """The token that ends at `at` in the encoding of text[:at], and where it starts: of the tokens in tree that end there, the one that may follow."""
        node, found, i = tree, [], at
        while i:
            i -= 1
            node = node.get(text[i])
            if node is None:
                break
            token = node.get("")
            if token is not None:
                found.append((token, i))
        pairs = self.pairs
        for token, i in reversed(found):
            known = pairs.get((last[i], token))
            if known or known is None and self.may_follow(last[i], token):
                return token, i
        raise ValueError("a byte is missing from the vocabulary")

    def word_counts(self, word: str) -> list[int]:
        """Token count of each prefix of the word, itself a word. States are kept by prefix, as words share many."""
        text = "".join(map(self.letters.__getitem__, word.encode().decode("latin-1")))
        last, count, ended = [""], [0], []
        states, choose = self.states, self.choose
        if len(states) > CACHE:
            states.clear()
        at, plain, shared = 0, word.isascii(), len(text) <= SHARED
        for c in word:
            stop = at + 1 if plain else at + len(c.encode())
            while at < stop:
                at += 1
                known = states.get(text[:at]) if shared else None
                if known is None:
                    token, i = choose(text, at, last, self.plain_tree)
                    known = [token, count[i] + 1, 0]
                    if shared:
                        states[text[:at]] = known
                last.append(known[0])
                count.append(known[1])
            if not known[2]:
                _, i = choose(text, at, last, self.end_tree)
                known[2] = count[i] + 1
            ended.append(known[2])
        return ended

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.made(key)
        if len(self) >= CACHE:  # the words since the last time stay at hand for one more
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out

    def made(self, key: str) -> bytes:
        lead = key[0] in SPACE_CHARS
        word = key[1:] if lead else key
        if word in CONTRACTIONS:  # cut short, a contraction is an apostrophe and letters
            counts = [1, *(1 + n for n in self.word_counts(word[1:])[:-1]), self.word_counts(word)[-1]]
        else:
            counts = self.word_counts(word)
        return bytes([*([0] * lead), *((b - a) & 255 for a, b in zip([0, *counts], counts, strict=False))])

    def plain(self, text: str) -> bytes:
        """Changes in count for text without special strings."""
        low = self.normal(text) if self.beyond(text) else text.lower()
        return b"".join(map(self.__getitem__, (self.find_beyond if self.beyond(low) else self.find_latin)(low)))

    def find_beyond(self, text: str) -> list[str]:
        """Words of a text with characters from U+0250 on; the tokenizer is asked for its classes when the first comes."""
        if self.known is None:
            self.known = word_finders(char_classes(Tokenizer.from_file(self.path)))
        find, odd = self.known
        return find(text) if odd(text) else self.find(text)

    def changes(self, text: str) -> bytes:
        """Change in token count at each code point of the text as the tokenizer sees it: in NFC and lower case. A special string is one token; cut short, it's ordinary text."""
        if not any(h in text for h in self.hints):
            return self.plain(text)
        parts, at, total = [], 0, 0
        for m in self.special.finditer(text):
            part = self.plain(text[at : m.end() - 1])
            own = np.frombuffer(part, np.int8)
            before = int(own[: len(own) - (m.end() - 1 - m.start())].sum(dtype=np.int64))
            jump = before + 1 - int(own.sum(dtype=np.int64))
            if not -128 <= jump <= 127:
                raise ValueError("a special string's parts have too many tokens for the table")
            parts += [part, np.int8(jump).tobytes()]
            total += before + 1
            at = m.end()
        return b"".join([*parts, self.plain(text[at:])])


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One per Python worker and vocabulary file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Code points in the longest prefix with at most budget tokens; counts holds one entry for each code point."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_table(docs: DataFrame, *, name: str = "word_bpe_49k.json", text_col: str = "text", carry=None) -> DataFrame:
    """Columns row, n_bytes, n_tokens and prefix_changes: the binary table of each whole text, one signed byte a code point.

    Null text counts as empty: an empty table. A text of any length has its
    whole table, of as many bytes as code points. Repeated rows count each. An
    empty table of docs gives an empty one.
    """
    bound_arrow(docs.sparkSession)

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            table = counter(vocabulary(name))
            yield pa.array([table.changes(t or "") for t in texts.to_pylist()], pa.binary())

    made = packed(docs, carry, text=text_col).select("row", whole_text().alias("text"))
    made = made.select("row", F.octet_length("text").cast("bigint").alias("n_bytes"), F.arrow_udf(of, "binary")("text").alias("prefix_changes"))
    return made.select("row", "n_bytes", tokens_at("prefix_changes").alias("n_tokens"), "prefix_changes")


def tokens_at(table: str | Column, n_chars: Column | None = None) -> Column:
    """Tokens of the first n_chars code points (null: all; below 0: none), from a prefix table; null for a null table."""

    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for tables, ends in batches:
            yield pa.array([None if t is None else int(np.frombuffer(t, np.int8)[: n if n is None else max(n, 0)].sum(dtype=np.int64)) for t, n in zip(tables.to_pylist(), ends.to_pylist(), strict=True)], pa.int64())

    return F.arrow_udf(of, "bigint")(F.col(table) if isinstance(table, str) else table, F.lit(None).cast("bigint") if n_chars is None else n_chars.cast("bigint"))


def chars_within(table: str | Column, budget: Column) -> Column:
    """Code points of the longest prefix with at most budget tokens, from a prefix table; null if either is null, 0 for an empty table or a budget that fits nothing."""

    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for tables, budgets in batches:
            yield pa.array([None if t is None or b is None else longest_within(np.cumsum(np.frombuffer(t, np.int8), dtype=np.int64), b) for t, b in zip(tables.to_pylist(), budgets.to_pylist(), strict=True)], pa.int64())

    return F.arrow_udf(of, "bigint")(F.col(table) if isinstance(table, str) else table, budget.cast("bigint"))


def count_tokens(text: Column, *, name: str = "word_bpe_49k.json") -> Column:
    """Tokens of each whole text, from its prefix table; null text has none."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            table = counter(vocabulary(name))
            yield pa.array([int(np.frombuffer(table.changes(t or ""), np.int8).sum(dtype=np.int64)) for t in texts.to_pylist()], pa.int64())

    return F.arrow_udf(of, "bigint")(text.cast("string"))


def token_counts(docs: DataFrame, *, name: str = "word_bpe_49k.json", limit: int = 2048, text_col: str = "text", carry=None) -> DataFrame:
    """Columns row, n_bytes, n_tokens, over_limit and limit_chars (code points of the longest prefix with at most `limit` tokens).

    As prefix_table, but each table is used where it is made and not kept.
    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows count each; an
    empty table gives an empty one; texts of any length are counted whole.
    """
    bound_arrow(docs.sparkSession)
    kind = pa.struct([("n_tokens", pa.int64()), ("limit_chars", pa.int64())])

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            table, rows = counter(vocabulary(name)), []
            for t in texts.to_pylist():
                change = np.frombuffer(table.changes(t or ""), np.int8)
                total = int(change.sum(dtype=np.int64))
                rows.append({"n_tokens": total, "limit_chars": longest_within(np.cumsum(change, dtype=np.int64), limit) if total > limit else len(change)})
            yield pa.array(rows, kind)

    made = packed(docs, carry, text=text_col).select("row", whole_text().alias("text"))
    made = made.select("row", F.octet_length("text").cast("bigint").alias("n_bytes"), F.arrow_udf(of, "n_tokens bigint, limit_chars bigint")("text").alias("t"))
    return made.select("row", "n_bytes", F.col("t.n_tokens").alias("n_tokens"), (F.col("t.n_tokens") > limit).alias("over_limit"), F.col("t.limit_chars").alias("limit_chars"))
