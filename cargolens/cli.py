"""Command line: summary, drill, export and sankey over a folder of tables or a shipments file."""

from __future__ import annotations

import argparse
import sys

from cargolens.api import Shipments
from cargolens.operators.pricing import DIMENSIONS
from cargolens.session import build_session
from cargolens.sources.readers import read_shipments, shipments


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cargolens", description=__doc__)
    out.add_argument("--data", required=True, help="a folder with the star-schema tables; or, with --shipments, a shipments file or table")
    out.add_argument("--shipments", action="store_true", help="--data is a file or table of shipments (implied by .csv, .csv.gz, .parquet and .xlsx)")
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("summary", "drill", "export", "sankey"):
        one = sub.add_parser(name)
        one.add_argument("--region", choices=["Europe", "RoW"])
        one.add_argument("--limit", type=int, default=20)
        one.add_argument("--output")
        if name == "sankey":
            one.add_argument("--product")
            one.add_argument("--min-value", type=float)
            one.add_argument("--others-share", type=float, default=0.2)
        if name in ("summary", "export"):
            one.add_argument("dimension", choices=sorted(DIMENSIONS))
        if name == "export":
            one.add_argument("path")
        if name == "drill":
            one.add_argument("value")
            one.add_argument("--by", choices=sorted(DIMENSIONS), required=True)
            one.add_argument("--filter-dimension", choices=sorted(DIMENSIONS), default="fruit")
    return out


def table(rows: list[dict]) -> str:
    if not rows:
        return "no rows"
    heads = list(rows[0])
    cells = [heads, *([str(r[h]) for h in heads] for r in rows)]
    width = [max(len(c[k]) for c in cells) for k in range(len(heads))]
    return "\n".join("  ".join(c[k].ljust(width[k]) for k in range(len(heads))) for c in cells)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session()
    single = args.shipments or args.data.endswith((".csv", ".csv.gz", ".parquet", ".xlsx"))
    found = Shipments(read_shipments(spark, args.data) if single else shipments(spark, args.data))
    if args.command == "export":
        found.export(args.dimension, args.path, args.region)
        return 0
    if args.command == "sankey":
        text = found.sankey(share=args.others_share, top=args.limit, least=args.min_value, fruit=args.product, region=args.region)
    elif args.command == "drill":
        text = table(found.drill(args.filter_dimension, args.value, args.by, args.region, args.limit))
    else:
        text = table(found.summary(args.dimension, args.region, args.limit))
    if args.output:
        with open(args.output, "w", encoding="utf-8") as out:
            out.write(text + "\n")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
