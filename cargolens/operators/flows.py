"""Supply-chain flows between exporters, products, importers and countries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.operators.market import bucketed_names
from cargolens.sources.written import written

MANY = ("exporter", "fruit_name", "importer", "country")


LABELS = {"exporter": "Other Exporters", "importer": "Other Importers", "country": "Other Countries"}


def _edge_sums(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, source, target, mt): one pass, each row counts once for each pair."""
    edges = F.array(*(F.struct(F.lit(k).alias("pair"), F.col(a).alias("source"), F.col(b).alias("target")) for k, (a, b) in enumerate(pairs)))
    return df.select(F.explode(edges).alias("e"), "net_weight_mt").groupBy("e.pair", "e.source", "e.target").agg(F.sum("net_weight_mt").alias("mt"))


def flows(df: DataFrame, levels: Sequence[str] = MANY, least: float | None = None, top: int | None = None) -> DataFrame:
    """(level, source, target, value) edges between neighbouring levels, largest first."""
    sums = _edge_sums(df, list(zip(levels, levels[1:], strict=False)))
    return _finished(sums.select(F.col("pair").alias("level"), "source", "target", F.round("mt", 2).alias("value")), least, top)


def _finished(edges: DataFrame, least: float | None, top: int | None) -> DataFrame:
    edges = edges if least is None else edges.where(F.col("value") >= least)
    ordered = edges.orderBy(F.col("value").desc(), "level", "source", "target")
    return ordered if top is None else ordered.limit(top)


def supply_chain(df: DataFrame, bucket: bool = True, share: float = 0.2, least: float | None = None, top: int | None = None) -> DataFrame:
    """Flows over exporter, product, importer and country; the product level is left out if there is only one product.

    The rows are summed once, to edges between names. Small exporters, importers
    and countries are found from these sums and put under a label of their
    own, as is the number of products; rows aren't read again for either.
    """
    pairs = [*zip(MANY, MANY[1:], strict=False), ("exporter", "importer")]
    sums = written(_edge_sums(df, pairs), "edges")
    products = sums.where("pair = 0").agg(F.coalesce(F.min("target") < F.max("target"), F.lit(False)).alias("several"))
    level = F.when(F.col("several") & (F.col("pair") < 3), F.col("pair")).when(~F.col("several") & (F.col("pair") == 3), 0).when(~F.col("several") & (F.col("pair") == 2), 1)
    edges = sums.crossJoin(F.broadcast(products)).withColumn("level", level).where("level is not null")  # one row says whether there are several
    if bucket:
        names = bucket_names(sums, share)
        for end in ("source", "target"):
            dimension = F.element_at(F.array(*(F.lit(p[end == "target"]) for p in pairs)), F.col("pair") + 1)
            own = names.select(F.col("dimension").alias("_d"), F.col("name").alias("_n"), F.col("bucket").alias("_b"))
            edges = edges.withColumn("_at", dimension).join(own, (F.col("_at") == F.col("_d")) & F.col(end).eqNullSafe(F.col("_n")), "left")
            edges = edges.withColumn(end, F.when(F.col("_d").isNull(), F.col(end)).otherwise(F.col("_b"))).drop("_at", "_d", "_n", "_b")
    return _finished(edges.groupBy("level", "source", "target").agg(F.round(F.sum("mt"), 2).alias("value")), least, top)


def bucket_names(sums: DataFrame, share: float) -> DataFrame:
    """(dimension, name, bucket) of the exporters, importers and countries of edge sums."""
    ends = F.array(
        *(F.when(F.col("pair") == pair, F.struct(F.lit(d).alias("dimension"), F.col(end).alias("name"))) for d, pair, end in (("exporter", 0, "source"), ("importer", 2, "source"), ("country", 2, "target")))
    )
    totals = sums.select(F.explode(F.array_compact(ends)).alias("e"), "mt").groupBy("e.dimension", "e.name").agg(F.round(F.sum("mt"), 2).alias("total"))
    label = F.element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), F.col("dimension"))
    return bucketed_names(totals, ["dimension"], share, label).select("dimension", "name", "bucket")


def country_flows(df: DataFrame, country: str, fruit: str | None = None) -> DataFrame:
    """Flows to one country, of all products or one, without bucketing."""
    own = df.where(F.col("country") == country)
    return supply_chain(own if fruit is None else own.where(F.col("fruit_name") == fruit), bucket=False)


def mermaid(edges: DataFrame, title: str = "", decimals: int = 0, most: int | None = None) -> str:
    """Sankey text of all edges given (limit them with flows' top; the text is made on the driver), or of the first `most`, which the text then says."""
    label = lambda c: F.translate(F.translate(F.col(c), "ÁÉÍÓÚÑáéíóúñ", "AEIOUNaeioun"), '",;', "   ")
    found = edges.select(label("source").alias("s"), label("target").alias("t"), "value")
    rows = found.collect() if most is None else found.limit(most + 1).collect()
    head = f"---\ntitle: {title}\n---\n" if title else ""
    cut = most is not None and len(rows) > most
    body = "".join(f"{r['s']},{r['t']},{r['value']:.{decimals}f}\n" for r in (rows[:most] if cut else rows))
    return head + "sankey-beta\n" + body + (f"%% the {most} largest flows\n" if cut else "")
