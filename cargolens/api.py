"""The tools' Python surface: summaries, drill-downs, searches, market questions and exports over one shipments DataFrame, answered as plain rows and kept for a while."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import DataFrame

from cargolens.cache import TtlCache
from cargolens.functions.dates import relative_date
from cargolens.operators import flows, market, pricing, quality
from cargolens.operators.lookup import gram_index
from cargolens.operators.rollup import Rollup
from cargolens.sources.readers import with_known_names
from cargolens.sources.sinks import headed, write_result

#: rows of an answer that is given without a limit
ANSWER_ROWS = 5000
#: Products of the price quote.
QUOTE_PRODUCTS = ("mango", "avocado", "strawberry", "blueberry", "pineapple", "passion_fruit")


class Shipments:
    """Questions about a shipments DataFrame with the columns of sources.readers.shipments. today fixes relative dates. Summaries and drill-downs are read from a kept rollup of the same shipments if one is given."""

    def __init__(self, df: DataFrame, *, today: dt.date | None = None, clean: bool = False, cache: TtlCache | None = None, rollup: Rollup | None = None) -> None:
        if clean and rollup is not None:
            raise ValueError("a rollup of all shipments doesn't answer for the clean ones")
        self.rollup = rollup
        self.df, self.today, self.cache = quality.clean_view(df) if clean else df, today or dt.date.today(), cache or TtlCache()
        self._index: DataFrame | None = None

    def rows(self, df: DataFrame, limit: int | None = None) -> list[dict[str, Any]]:
        """Rows as dicts. They go to the caller's memory, so answers without a limit of their own have at most ANSWER_ROWS, and raise if there are more."""
        if limit is not None:
            return [r.asDict() for r in df.limit(limit).collect()]
        found = df.limit(ANSWER_ROWS + 1).collect()
        if len(found) > ANSWER_ROWS:
            raise ValueError(f"over {ANSWER_ROWS} rows; give a limit, or use export()")
        return [r.asDict() for r in found]

    def date(self, text: str | None) -> dt.date | None:
        return None if text is None else relative_date(text, self.today)

    def _cached(self, name: str, make, **params: Any) -> list[dict[str, Any]]:
        return self.cache.get_or_compute(name, lambda **p: self.rows(make(**p)), **params)

    def _quartiles(self, dimension: str, region: str | None, where: dict[str, str] | None = None) -> DataFrame:
        if self.rollup is not None:
            return self.rollup.quartiles(dimension, region, where)
        return pricing.quartile_summary(self.df, dimension, region) if where is None else pricing.drill_down(self.df, *next(iter(where.items())), dimension, region)

    def summary(self, dimension: str, region: str | None = None, limit: int = 20) -> list[dict[str, Any]]:
        return self._cached("summary", lambda dimension, region, limit: self._quartiles(dimension, region).limit(limit), dimension=dimension, region=region, limit=limit)

    def drill(self, dimension: str, value: str, by: str, region: str | None = None, limit: int = 20) -> list[dict[str, Any]]:
        return self._cached("drill", lambda dimension, value, by, region, limit: self._quartiles(by, region, {dimension: value}).limit(limit), dimension=dimension, value=value, by=by, region=region, limit=limit)

    def search(self, term: str, limit: int = 50) -> list[dict[str, Any]]:
        return self.rows(market.search_names(self.df, term, limit=limit))

    def fuzzy(self, term: str, threshold: float = 0.6) -> list[str]:
        """Names like the term, best first."""
        if self._index is None:
            self._index = gram_index(self.df, "exporter")
        return [r["name"] for r in market.fuzzy_search(self.df, term, threshold, index=self._index).collect()]

    def values(self, dimension: str) -> list[dict[str, Any]]:
        return self._cached("values", lambda dimension: pricing.available_values(self.df, dimension), dimension=dimension)

    def detail(self, limit: int = 100, sort: str = "date", exporter_like: str | None = None, country: str | None = None, first: str | None = None, last: str | None = None, **given: Any) -> dict[str, Any]:
        """Detail rows and the totals over them. exporter_like is matched as in fuzzy(); no match is an error. Country and dates as users write them."""
        if exporter_like is not None:
            given["exporters"] = self.fuzzy(exporter_like, 0.4)
            if not given["exporters"]:
                return {"error": f"no exporter is like {exporter_like}"}
        if country is not None:
            given["destination"] = country
        given |= {"first": self.date(first), "last": self.date(last)}
        rows = self.rows(market.detail(self.df, limit, sort, **given))
        return {"rows": rows, "shipments": len(rows), "total_mt": round(sum(r["net_weight_mt"] for r in rows), 2), "total_fob": round(sum(r["fob_usd"] for r in rows), 2)}

    def top(self, dimension: str, metric: str = "volume", n: int = 10, **given: Any) -> list[dict[str, Any]]:
        return self.rows(market.top_n(market.predicates(self.df, **given), dimension, metric, n))

    def series(self, metric: str = "volume", grain: str = "monthly", **given: Any) -> list[dict[str, Any]]:
        return self.rows(market.time_series(market.predicates(self.df, **given), metric, grain).orderBy("period"))

    def dashboard(self, first: str, last: str) -> dict[str, Any]:
        """Key figures with growth, and the five largest products and destinations."""

        def make(first: str, last: str) -> dict[str, Any]:
            a, b = self.date(first), self.date(last)
            own = market.predicates(self.df, first=a, last=b)
            return self.rows(market.dashboard(self.df, a, b))[0] | {"top_products": self.rows(market.top_n(own, "fruit", "volume", 5)), "top_destinations": self.rows(market.top_n(own, "country", "volume", 5))}

        return self.cache.get_or_compute("dashboard", make, first=first, last=last)

    def price_quote(self, products: tuple[str, ...] = QUOTE_PRODUCTS) -> list[dict[str, Any]]:
        """Quartile prices of each product that is there, from one pass."""
        return self.rows(pricing.quartile_summary(self.df.where(self.df["fruit_name"].isin(*products)), "fruit"))

    def sankey(self, share: float = 0.2, top: int | None = None, least: float | None = None, title: str = "", fruit: str | None = None, region: str | None = None) -> str:
        """Flows of one product or all, to one region or all, as Sankey text; the 2,000 largest if top doesn't say otherwise, and the text says so where there are more."""
        own = pricing.region_filter(market.predicates(with_known_names(self.df), fruit=fruit), region)
        return flows.mermaid(flows.supply_chain(own, share=share, top=top, least=least), title, most=None if top else 2000)

    def export(self, dimension: str, path: str, region: str | None = None, include_records: bool = False) -> None:
        write_result(headed(pricing.quartile_summary(self.df, dimension, region), dimension), path, include_records)
