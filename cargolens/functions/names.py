"""Company names: cleaning, brand and core names, similarity."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that aren't part of a brand.
STOP_WORDS = (
    "SOCIEDAD", "SOC", "SOC.", "CORPORACION", "CORP", "CORP.", "GRUPO", "GROUP", "AGRICOLA", "AGRO", "AGROINDUSTRIAL", "EXPORTADORA", "EXPORT",
    "CONSORCIO", "IMPORTADORA", "COMERCIAL", "COMERCIALIZADORA", "COMPANIA", "CIA", "CIA.", "EMPRESA", "NEGOCIOS", "INVERSIONES", "THE", "ASOCIACION",
    "MEXICO", "MEXICAN", "MEXICANA", "USA", "US", "UNITED", "STATES", "UK", "KINGDOM", "CHILE", "CHILEAN", "CHILENA", "PERU", "PERUVIAN", "PERUANA",
    "ARGENTINA", "ARGENTINIAN", "BRAZIL", "BRAZILIAN", "BRASILEIRA", "COLOMBIA", "COLOMBIAN", "COLOMBIANA", "ECUADOR", "ECUADORIAN", "ECUATORIANA",
    "SPAIN", "SPANISH", "ESPANA", "ESPANOLA", "POLAND", "POLISH", "POLSKA", "GERMANY", "GERMAN", "DEUTSCHLAND", "FRANCE", "FRENCH", "FRANCAISE",
    "ITALY", "ITALIAN", "ITALIANA", "NETHERLANDS", "DUTCH", "NEDERLAND", "BELGIUM", "BELGIAN", "BELGIQUE", "KOREA", "KOREAN", "CHINA", "CHINESE",
    "JAPAN", "JAPANESE", "INDIA", "INDIAN", "AUSTRALIA", "AUSTRALIAN", "SWITZERLAND", "SWISS", "CH", "AUSTRIA", "AUSTRIAN", "CZECH", "CZECHIA",
    "SLOVAKIA", "SLOVAK", "DE", "CV", "SDE", "RL", "FLOOR", "BUILDING", "STREET", "AVENUE", "ROAD", "NORTH", "SOUTH", "EAST", "WEST", "AS", "CO",
    "COMPANY", "DBA", "JOINTLY", "SEVERALLY", "WITH", "SITE", "FACILITY", "BRANCH", "OFFICE", "PRIVATE", "PUBLIC", "INTERNATIONAL", "INTL", "Y", "O",
    "E", "CARE", "OF", "GOURIN", "ASHFORD", "ARDOOIE", "CHARING", "KENT", "BASEL", "SWITZERLAN",
)
INVALID = ("UNKNOWN", "VARIOUS", "TBD", "TBA", "PENDING", "NA", "N/A", "NONE")
CONJUNCTIONS = ("Y", "O", "E")
LEADING = ("IMPORTADORA", "EXPORTADORA", "COMERCIAL", "COMERCIALIZADORA", "SOCIEDAD", "EMPRESA", "AGRICOLA", "AGRO", "GRUPO", "GROUP")
# Legal forms, longest tried first.
LEGAL = (
    "S.A. DE C.V.", "SA DE CV", "S DE R.L. DE C.V.", "S DE RL DE CV", "SOCIEDAD ANONIMA CERRADA", "SOCIEDAD ANONIMA", "S.A.C.", "SAC", "S.A.", "SA", "E.I.R.L.", "EIRL", "S.R.L.", "SRL", "LTDA", "LIMITADA", "S.C.R.L.", "SCRL",
    "LIMITED", "LTD.", "LTD", "INCORPORATED", "INC.", "INC", "CORPORATION", "CORP.", "CORP", "L.L.C.", "LLC", "PLC.", "PLC", "GMBH & CO. KG", "GMBH & CO KG", "SPOLKA Z OGRANICZONA ODPOWIEDZIALNOSCIA", "GMBH", "AG", "KG",
    "B.V.", "BV", "N.V.", "NV", "S.P.A.", "SPA", "S.L.U.", "SLU", "S.L.", "SL", "AB", "OY", "A/S", "S.A.R.L.", "SARL", "SASU", "SAS", "SP. Z O.O.", "SPZOO", "S.R.O.", "SRO", "D.O.O.", "DOO",
)
LEGAL_PATTERN = r"\b(" + "|".join(x.replace(".", r"\.") for x in sorted(LEGAL, key=len, reverse=True)) + r")\b\.?"
# The order matters; each pattern with what takes its place.
REPAIRS = ((r"(\w)\?(\w)", "$1'$2"), (r"\?\?", ""), (r"Ã\?", ""))
SPACING = ((r"\.{2,}", " "), (r"\s+/\s+", " "), (r"['’]", ""))
LEGAL_FORMS = (
    (LEGAL_PATTERN, ""), (r"\bSP\s*\.?\s*Z\s*\.?\s*O\s*\.?\s*O?\.?\s*$", ""), (r"\bSP\s*\.?\s*Z\s*\.?\s*O\s*\.?\s*O?\.?\b", ""), (r"\bS\s*\.?\s*R\s*\.?\s*O\.?\s*\.?$", ""), (r"\bP[TV]Y\s*\.?\s*LTD?\.?\b", ""),
    (r"\bPVT\s*\.?\s*LTD?\.?\b", ""), (r"\bP[TV]Y\s*\.?\b", ""), (r"\bPVT\s*\.?\b", ""), (r"\bPRIVATE\s+LIMITED\b", ""), (r"\b(OSP|OOO)\s*\.?$", ""),
)
PUNCTUATION = ((r"[^\w\s]", " "), (r"\b([BNSAOLD])\s+([VARLPO])\b", "$1$2"))
SHORT_FORMS = ((r"\b(BV|NV|SA|SL|AB|OY|AG|KG|SPA|DOO|DO)\b", ""), (r"\s+[OAL]\s*$", ""))
ADDRESSES = (
    (r"\b(C|CO)\s+O\b", ""), (r"\b\w+(STRASSE|STRAAT|STREET|STR)\b", ""), (r"\b\d{4,6}\b", ""), (r"\b[A-Z]{1,2}\s*\d{2,6}\b", ""), (r"\b(SUITE|STE|UNIT|UL|FLOOR|FL)\s+\w+\b", ""), (r"\b\d+\s*(ST|ND|RD|TH)\s+FL(OOR)?\b", ""),
    (r"\bP\s*O\s*(BOX|BO)\s*\d*\b", ""), (r"\b(RUT|EORI|VAT|TAX|ID)\s*\d+\b", ""), (r"\b\d+\s*[NSEW](ORTH|OUTH|AST|EST)?\b", ""), (r"\s+\d+\s*$", ""),
)


def _accents() -> tuple[str, str]:
    """Letters that decompose to a base letter and marks, with the base letters."""
    pairs = []
    for code in range(0xC0, 0x1F00):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _accents()


def unaccent(text: Column) -> Column:
    """Without diacritics: letters up to U+1EFF by table, single marks by class."""
    return F.regexp_replace(F.translate(text, ACCENTED, BARE), r"\p{Mn}", "")


def full_unaccent(name: Column) -> Column:
    """Without diacritics for all of Unicode, as NFD without marks."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for names in batches:
            yield names.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))

    return F.pandas_udf(of, "string")(name)


def _apply(text: Column, rules) -> Column:
    for pattern, instead in rules:
        text = F.regexp_replace(text, "(?iU)" + pattern, instead)
    return text


def repair_encoding(text: Column) -> Column:
    return _apply(text, REPAIRS)


def clean_company(name: Column, strip_legal: bool = True, remove_addresses: bool = True) -> Column:
    """Upper-cased company name without accents, legal forms, punctuation and address parts; lone letters join the next word, except Y, O, E. Null is empty."""
    text = F.trim(F.upper(unaccent(repair_encoding(F.coalesce(name, F.lit(""))))))
    text = _apply(text, SPACING)
    if strip_legal:
        text = _apply(text, LEGAL_FORMS)
    text = _apply(text, PUNCTUATION)
    if strip_legal:
        text = _apply(text, SHORT_FORMS)
    if remove_addresses:
        text = _apply(text, ADDRESSES)
        text = F.regexp_replace(text, r"\s+(" + "|".join(w for w in STOP_WORDS if len(w) > 2 and w.isalpha()) + r")$", "")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("lone"))

    def step(acc: Column, w: Column) -> Column:
        joined = F.concat(acc["lone"], w)
        holds = (acc["lone"] == "") & (F.length(w) == 1) & ~w.isin(*CONJUNCTIONS)
        return F.struct(F.when(holds, acc["done"]).otherwise(F.concat(acc["done"], F.lit(" "), joined)).alias("done"), F.when(holds, w).otherwise("").alias("lone"))

    return F.aggregate(words, start, step, lambda acc: F.trim(F.concat(acc["done"], F.lit(" "), acc["lone"])))


def _strip(words: Column, test) -> Column:
    """words from the first one for which test is false; `words` is told once, as what stands in it would be computed again for each mention."""
    return F.aggregate(words, F.array().cast("array<string>"), lambda acc, w: F.when((F.size(acc) == 0) & test(w), acc).otherwise(F.concat(acc, F.array(w))))


def _strip_head(words: Column, drop: tuple[str, ...]) -> Column:
    """words from the first one that isn't in drop."""
    return _strip(words, lambda w: w.isin(*drop))


def _strip_tail(words: Column, test) -> Column:
    """words up to the last one for which test is false."""
    return F.reverse(_strip(F.reverse(words), test))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def brand_name(cleaned: Column) -> Column:
    """Display name: no stop words, then no lone letters at the end, no generic words at the start, no conjunctions at either end."""
    stops = [w for w in STOP_WORDS if w not in CONJUNCTIONS]
    words = _strip_tail(_words(cleaned), lambda w: w.isin(*stops))
    words = _strip_tail(words, lambda w: (F.length(w) == 1) & ~w.isin(*CONJUNCTIONS))
    words = _strip_head(_strip_head(words, LEADING), CONJUNCTIONS)
    return F.array_join(_strip_tail(words, lambda w: w.isin(*CONJUNCTIONS)), " ")


def core_name(cleaned: Column) -> Column:
    """Block key: first two words of over one letter between generic words and stop words; the first word if there are none."""
    words = _strip_tail(_strip_head(_words(cleaned), LEADING), lambda w: w.isin(*STOP_WORDS))
    longer = F.filter(words, lambda w: F.length(w) > 1)
    return F.when(F.size(longer) > 0, F.array_join(F.slice(longer, 1, 2), " ")).otherwise(F.coalesce(F.get(words, F.lit(0)), F.lit("")))


def without_spaces(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit(""))


def is_valid_name(name: Column) -> Column:
    return F.coalesce((F.trim(name) != "") & ~F.upper(F.trim(name)).isin(*INVALID), F.lit(False))


# Country and region suffixes of subsidiaries, with common typos, in the order in which they go; spellings put right.
COUNTRY_SUFFIXES = ("UK", "POLAND", "BELGIUM", "BELIUM", "FRANCE", "GERMANY", "SPAIN", "NETHERLANDS", "EUROPE", "IBERICA", "ITALIA", "SVERIGE", "DANMARK")
IMPORTER_FIXES = (("CROP S FRUITS", "CROPS FRUITS"), ("D ARTA", "DARTA"))
# Legal forms after which a long name is cut, and those that go from the end, in this order.
CUT_FORMS = ("NV", "BV", "SA", "SL", "GMBH", "LTD", "LLC", "INC", "CORP", "AB", "SAS", "SP Z OO", "SP ZOO")
END_FORMS = ("N V", "B V", "S A", "S L", "GMBH", "LTD", "LIMITED", "LLC", "INC", "CORP", "AB", "SAS", "SP Z OO", "SP ZOO", "NV", "BV")
def rule_clean_importer(name: Column) -> Column:
    """The simpler rules for European importers: no punctuation, long names cut after their legal form, no legal form and then no country at the end, two spellings put right."""
    text = F.regexp_replace(F.regexp_replace(F.trim(F.upper(name)), r"['\".,:;()\-/]+", ""), r"\s+", " ")
    legal = rf"^(.*?\b(?:{'|'.join(CUT_FORMS)})\b)"
    cut = F.when((F.length(text) > 30) & text.rlike(legal), F.trim(F.regexp_extract(text, legal, 1))).otherwise(text)
    for form in END_FORMS:
        cut = F.regexp_replace(cut, rf"\s+{form}\s*$", "")
    cut = F.trim(F.regexp_replace(cut, r"\s+", " "))
    for suffix in COUNTRY_SUFFIXES:
        cut = F.regexp_replace(cut, rf"\s+{suffix}\s*$", "")
    for wrong, right in IMPORTER_FIXES:
        cut = F.replace(cut, F.lit(wrong), F.lit(right))
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def equal_start(a: str, b: str) -> int:
    """How many characters at their start are the same."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def matched(a: str, b: str) -> int:
    """Characters in the matching blocks that SequenceMatcher finds without junk: the longest block, the first of a and then of b if several are, and those on either side of it."""
    if a == b:
        return len(a)
    # a block as long as the ends that both share is there, so only such and longer ones are looked for
    least = max(equal_start(a, b), equal_start(a[::-1], b[::-1]))
    total, parts = 0, [(a, b)]
    while parts:
        a, b = parts.pop()
        n, size, at = len(a), max(least - 1, 0), 0
        least = 0
        for i in range(n):
            if i + size >= n:
                break
            while i + size < n and a[i : i + size + 1] in b:
                size, at = size + 1, i
        if size:
            to = b.find(a[at : at + size])
            total += size
            if at and to:
                parts.append((a[:at], b[:to]))
            if at + size < n and to + size < len(b):
                parts.append((a[at + size :], b[to + size :]))
    return total


def ratio(a: str, b: str) -> int:
    """Matched characters in percent of both lengths, rounded."""
    return round(100 * (2.0 * matched(a, b) / (len(a) + len(b)))) if a or b else 100


def token_sort_ratio(a: str, b: str) -> int:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> int:
    """Best ratio among the common words and the common words with either side's rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0
    both = " ".join(sorted(x & y))
    left, right = (f"{both} {' '.join(sorted(rest))}".strip() for rest in (x - y, y - x))
    return max(ratio(both, left), ratio(both, right), ratio(left, right)) if both else ratio(left, right)


def similarity_udf(term: str):
    """UDF from a name to its match score with the search term: 2 if equal, 1 if it holds the term, else the ratio of matched characters; any case."""
    low = term.lower()

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for names in batches:
            yield names.map(lambda n: 0.0 if n is None else 2.0 if n.lower() == low else 1.0 if low in n.lower() else SequenceMatcher(None, low, n.lower()).ratio())

    return F.pandas_udf(of, "double")
