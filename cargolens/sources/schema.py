"""The shipment record: raw columns, required columns and the parsed product."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D = T.StringType(), T.DoubleType()
# The 33 columns of a customs export, in order, and those that must be there.
RAW_COLUMNS = (
    ("HTS Code", _S), ("HTS Code Description", _S), ("Customs", _S), ("DUA / DAM", _S), ("Date", T.DateType()), ("Tax ID", T.LongType()), ("Exporter", _S), ("Importer", _S), ("Gross kg", _D), ("Net kg", _D),
    ("Qty 1", _D), ("Unit 1", _S), ("Qty 2", _D), ("Unit 2", _S), ("U$ FOB Tot", _D), ("U$ FOB Unit 1", _D), ("U$ FOB Unit 2", _D), ("Destination Country", _S), ("Destination Port", _S), ("Last Port", _S),
    ("Via", _S), ("Port Agent", _S), ("Customs Agent", _S), ("Shipping Line", _S), ("Forwarding Agent(Origin)", _S), ("Forwarding Agent(Destination)", _S), ("Channel", _S), ("Commercial Description", _S),
    ("Description1", _S), ("Description2", _S), ("Description3", _S), ("Description4", _S), ("Description5", _S),
)
REQUIRED = ("Date", "Exporter", "Net kg", "U$ FOB Tot", "Commercial Description", "HTS Code")
RAW_SCHEMA = T.StructType([T.StructField(n, t) for n, t in RAW_COLUMNS])
CLUSTER_SCHEMA = "canonical_name string, aliases array<string>, count bigint"


def check_columns(columns: list[str], *, exact: bool = False) -> None:
    """Raise unless the required columns are there; with exact, unless there are exactly 33."""
    if exact and len(columns) != len(RAW_COLUMNS):
        raise ValueError(f"{len(RAW_COLUMNS)} columns are expected, {len(columns)} are there")
    missing = [c for c in REQUIRED if c not in columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
