"""Product attributes from free-text descriptions, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Product patterns in the order they are tried (Spanish and English).
FRUITS = (
    ("mango", r"\bmango[s]?(?:\b|(?=[A-Z]))"), ("pineapple", r"\b(pineapple|piña|pina|ananas)\b"), ("strawberry", r"\b(strawberry|fresa[s]?)\b"), ("blueberry", r"\b(blueberry|arandano[s]?|arándano[s]?)\b"),
    ("papaya", r"\bpapaya[s]?\b"), ("avocado", r"\b(avocado[s]?|aguacate[s]?|palta[s]?)\b"), ("pomegranate", r"\b(pomegranate|granada[s]?)\b"), ("lucuma", r"\b(lucuma|lúcuma)\b"),
    ("passion_fruit", r"\b(passion fruit|maracuya|maracuyá)\b"), ("golden_berry", r"\b(golden berry|aguaymanto|physalis)\b"), ("camu_camu", r"\b(camu camu|camu-camu)\b"), ("soursop", r"\b(soursop|guanabana|guanábana)\b"),
    ("cherimoya", r"\b(cherimoya|chirimoya)\b"), ("pitaya", r"\b(pitaya|pitahaya|dragon fruit)\b"), ("acai", r"\b(acai|açai|acaí)\b"), ("banana", r"\b(banana[s]?|platano[s]?|plátano[s]?|banano)\b"),
    ("raspberry", r"\b(raspberry|frambuesa[s]?)\b"), ("cherry", r"\b(cherry|cherries|cereza[s]?)\b"), ("peach", r"\b(peach|peaches|durazno[s]?|melocoton|melocotón)\b"), ("grape", r"\b(grape[s]?|uva[s]?)\b"),
    ("orange", r"\b(orange[s]?|naranja[s]?)\b"), ("mix", r"\b(mix|mixtura|mezcla|berry mix|tropical mix)\b"),
)
VARIETIES = (r"(?:variedad|variety|var)[:\s]+([a-z]+)", r"\b(kent|edward|haden|keitt|tommy atkins|ataulfo)\b", r"\b(golden|md2|cayenne)\b")
FORMATS = (
    ("chunks", r"\b(chunk[s]?|trozo[s]?|pedazo[s]?|bits and pieces)\b"), ("cubes", r"\b(cube[s]?|cubo[s]?|cubos|dado[s]?|diced|picado[s]?|arilo[s]?)\b"), ("slices", r"\b(slice[s]?|sliced|rebanada[s]?|rodaja[s]?)\b"),
    ("halves", r"\b(halves|mitades)\b"), ("puree", r"\b(puree|pure|puré)\b"), ("pulp", r"\b(pulp|pulpa)\b"), ("whole", r"\b(whole|entero[s]?|entera[s]?)\b"), ("strips", r"\b(strip[s]?|tira[s]?)\b"),
    ("broken_pieces", r"\bb\s*&\s*p\b"), ("concentrate", r"\b(concentrate|concentrado)\b"), ("juice", r"\b(juice|jugo)\b"),
)
SIZES = (r"(\d+)\s*[xX×]\s*(\d+)\s*(?:mm)?", r"(\d+)\s*mm\s*[xX×]\s*(\d+)\s*mm")
ORGANIC, CONVENTIONAL, IQF, ASEPTIC = r"\b(organic|organico|org)\b", r"\b(conventional|convencional)\b", r"\biqf\b", r"\b(aseptic|aseptico|aséptico)\b"
#: ignore case, with Unicode word borders
FLAGS = "(?iU)"


#: letters that match others when case is ignored, though lower() doesn't make them those
ALIKE = ("\u0130\u0131\u017f\u212a", "iisk")


def folded(text: Column) -> Column:
    """text in lower case, so that it holds what a pattern matches in any case."""
    return F.lower(F.translate(text, *ALIKE))


def _stems(pattern: str) -> list[str]:
    """Texts of which a match of one of the patterns above holds one: how its alternatives begin."""
    plain = re.sub(r"\(\?=.*?\)", "", pattern).replace(r"\b", "").replace(r"b\s*&", "&")
    return sorted({m for x in re.sub(r"\(\?:|[()]", "|", plain).split("|") if (m := re.match(r"[^\W\d_&]*[^\[\\+?]*", x).group())})


def _may(pattern: str, low: Column | None) -> Column:
    """Whether low, a folded text, may match: a plain search, for patterns are slow. Without it, any text may."""
    held = F.lit(True) if low is None else F.lit(False)
    for stem in _stems(pattern) if low is not None else ():
        held = held | F.contains(low, F.lit(stem))
    return held


def _has(text: Column, pattern: str, low: Column | None = None) -> Column:
    found = text.rlike(FLAGS + pattern)
    return found if low is None else _may(pattern, low) & found


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, FLAGS + pattern, group), F.lit(""))


def _first_label(text: Column, patterns, low: Column | None = None) -> Column:
    return F.coalesce(*(F.when(_has(text, p, low), name) for name, p in patterns))


#: hash of a run of words
run_hash = F.xxhash64


def without_repeats(df: DataFrame, column: str, out: str = "clean_text", width: int = 5) -> DataFrame:
    """Add `out`: lower-cased words of column, joined by single spaces, each dropped if the run of up to `width` words from it came before.

    Where all runs' hashes differ, all runs do. Else hashes are sorted with their
    places, runs of one hash are compared word by word, and the first place of each stays, so long texts cost n log n.
    Only if two runs that differ have one hash, the runs themselves are sorted. What is read
    many times is made once by a generator, as the functions over arrays read it anew each time; sort_array compares natively, array_sort by an expression.
    """
    words = F.filter(F.split(F.lower(F.col(column)), r"\s+"), lambda w: w != "")
    made = df.withColumn("_w", F.explode_outer(F.array(words)))
    hashes = F.transform("_w", lambda w, i: run_hash(w, *(F.get(F.col("_w"), i + k) for k in range(1, width))))
    made = made.withColumn("_h", F.explode_outer(F.array(hashes)))
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    made = made.withColumn("_p", F.explode_outer(F.array(F.when(again, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))))
    earlier = lambda k: F.get(F.col("_p"), k - 1)
    run = lambda x: F.slice("_w", x["i"] + 1, width)
    clash = F.exists(F.transform("_p", lambda x, k: F.coalesce((x["h"] == earlier(k)["h"]) & (run(x) != run(earlier(k))), F.lit(False))), lambda c: c)
    places = F.sort_array(F.transform(F.filter("_p", lambda x, k: ~x["h"].eqNullSafe(earlier(k)["h"])), lambda x: x["i"]))
    runs = F.sort_array(F.transform("_w", lambda w, i: F.struct(F.concat_ws(" ", w, *(F.get(F.col("_w"), i + k) for k in range(1, width))).alias("run"), i.alias("i"), w.alias("w"))))
    made = made.withColumn("_r", F.explode_outer(F.array(F.when(clash, runs))))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform("_r", lambda r: r["run"]))
    firsts = F.zip_with(F.col("_r"), F.slice(before, F.lit(1), F.size("_r")), lambda r, b: F.when(~r["run"].eqNullSafe(b), F.struct(r["i"].alias("i"), r["w"].alias("w"))))
    kept = F.transform(F.sort_array(F.filter(firsts, lambda x: x.isNotNull())), lambda x: x["w"])
    text = F.array_join(F.when(F.col("_p").isNull(), F.col("_w")).when(F.col("_r").isNotNull(), kept).otherwise(F.transform(places, lambda i: F.get(F.col("_w"), i))), " ")
    return made.withColumn(out, F.coalesce(text, F.lit(""))).drop("_w", "_h", "_p", "_r")


def fruit(text: Column, low: Column | None = None) -> Column:
    return F.coalesce(_first_label(text, FRUITS, low), F.lit("unknown"))


def variety(text: Column, low: Column | None = None) -> Column:
    """Title-cased variety name, or null."""
    return F.initcap(F.coalesce(*(F.when(_may(p, low), _group(text, p, 1)) for p in VARIETIES)))


def size_mm(text: Column) -> Column:
    """AxB from the first size pattern that matches; package codes count too."""
    return F.coalesce(*(F.when(_has(text, p), F.concat_ws("x", _group(text, p, 1), _group(text, p, 2))) for p in SIZES))


def standard_size(text: Column) -> Column:
    """`10 X 20 mm` as `10x20`; other text unchanged."""
    return F.when(text.rlike(r"^\s*\d+\s*[xX]\s*\d+"), F.concat_ws("x", F.regexp_extract(text, r"(\d+)\s*[xX]\s*(\d+)", 1), F.regexp_extract(text, r"(\d+)\s*[xX]\s*(\d+)", 2))).otherwise(text)


def format_type(text: Column, low: Column | None = None) -> Column:
    """First matching format; else iqf if that word is there; else chunks if there is a size; else unknown."""
    return F.coalesce(_first_label(text, FORMATS, low), F.when(_has(text, IQF, low), "iqf"), F.when(size_mm(text).isNotNull(), "chunks"), F.lit("unknown"))


def certification(text: Column, low: Column | None = None) -> Column:
    return F.when(_has(text, ORGANIC, low), "organic").when(_has(text, CONVENTIONAL, low), "conventional").otherwise("unknown")


def product(text: Column, low: Column | None = None) -> Column:
    """The parsed product as a struct; with low, the folded text, patterns are tried only where they may match."""
    return F.struct(
        fruit(text, low).alias("fruit_name"), variety(text, low).alias("variety"), F.struct(format_type(text, low).alias("format_type"), size_mm(text).alias("size_mm")).alias("product_format"),
        F.struct(_has(text, ORGANIC, low).alias("is_organic"), _has(text, CONVENTIONAL, low).alias("is_conventional"), _has(text, IQF, low).alias("is_iqf"), _has(text, ASEPTIC, low).alias("is_aseptic"), certification(text, low).alias("certification")).alias("classification"),
    )


def parse_descriptions(df: DataFrame, column: str) -> DataFrame:
    """df with `product`; an empty or null description is an unknown product without a format."""
    text = F.col("_clean")
    none = F.struct(F.lit("unknown").alias("fruit_name"), F.lit(None).cast("string").alias("variety"), F.struct(F.lit(None).cast("string").alias("format_type"), F.lit(None).cast("string").alias("size_mm")).alias("product_format"), F.struct(*(F.lit(False).alias(k) for k in ("is_organic", "is_conventional", "is_iqf", "is_aseptic")), F.lit("unknown").alias("certification")).alias("classification"))
    empty = F.coalesce(F.col(column), F.lit("")) == ""
    made = without_repeats(df, column, "_clean").withColumn("_low", folded(text))
    return made.withColumn("product", F.when(empty, none).otherwise(product(text, F.col("_low")))).drop("_clean", "_low")


def unit_values(kg: Column, fob: Column) -> tuple[Column, Column]:
    """(metric tons to 3 places, USD per rounded ton to 2 places; missing inputs count as 0, no tons make price 0)."""
    mt = F.round(F.coalesce(kg, F.lit(0.0)) / 1000, 3)
    return mt, F.when(mt > 0, F.round(F.coalesce(fob, F.lit(0.0)) / mt, 2)).otherwise(0.0)


def model_unit_values(kg: Column, fob: Column) -> tuple[Column, Column]:
    """As unit_values, but what is missing stays missing: no tons without a weight, no price without a value or without tons."""
    mt = F.round(kg / 1000, 3)
    return mt, F.when(mt > 0, F.round(fob / mt, 2))


def enrich(df: DataFrame) -> DataFrame:
    """Raw shipments with the parsed product flattened, unit values, English country and region; given is_iqf and is_aseptic values stay."""
    from cargolens.functions.places import english_country, region

    parsed = parse_descriptions(df, "Commercial Description")
    mt, price = unit_values(F.col("Net kg"), F.col("U$ FOB Tot"))
    c, f = "product.classification", "product.product_format"
    own = lambda name: F.coalesce(F.col(name).cast("boolean"), F.col(f"{c}.{name}")) if name in df.columns else F.col(f"{c}.{name}")
    return parsed.withColumns(
        {
            "fruit_name": F.col("product.fruit_name"), "variety": F.col("product.variety"), "format_type": F.col(f"{f}.format_type"), "size_mm": F.col(f"{f}.size_mm"), "is_organic": F.col(f"{c}.is_organic"), "is_conventional": F.col(f"{c}.is_conventional"),
            "is_iqf": own("is_iqf"), "is_aseptic": own("is_aseptic"), "certification": F.col(f"{c}.certification"), "net_weight_mt": mt, "usd_per_mt": price, "country": english_country(F.col("Destination Country")),
        }
    ).withColumn("region", region(F.col("country"))).drop("product")


def combine_sources(frozen: DataFrame, aseptic: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Union by name with provenance flags, latest first, and the number of rows whose tariff code doesn't fit their source."""
    tagged = [df.withColumns({"is_iqf": F.lit(int(name == "frozen")), "is_aseptic": F.lit(int(name == "aseptic")), "data_source": F.lit(name)}) for name, df in (("frozen", frozen), ("aseptic", aseptic))]
    both = tagged[0].unionByName(tagged[1], allowMissingColumns=True).orderBy(F.col("Date").desc())
    digits = F.regexp_replace("HTS Code", r"[^0-9]", "").try_cast("bigint").cast("string")
    wrong = lambda df, head: df.where(~F.coalesce(F.startswith(digits, F.lit(head)), F.lit(False))).count()
    return both, {"frozen": wrong(frozen, "8119"), "aseptic": wrong(aseptic, "200")}
