"""Secrets, told from copied examples by how many owners share them.

Documents are scanned for candidates. Every candidate value is hashed, and over the
whole corpus each hash is counted by distinct owners and repositories: a
value that many owners have is an example that was copied around, one that stays
with an owner looks live. The three base kinds are always reported; tokens of the
looser kind `opaque` are added where ownership says that they look live.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import bound_arrow, durable, join_by_count, packed, whole_text

KINDS = ("assign", "access", "hex", "opaque")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""((?ia:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: a run with lower case, upper case and digits: too mixed for prose
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}")
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("value_hash", pa.string())])


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of the base kinds, in code points, leftmost non-overlapping for each kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]


def opaque_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Mixed runs of 24 characters or more that touch no base span."""
    out = []
    for m in OPAQUE.finditer(text):
        value = m[0]
        if re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value) and not any(a < m.end() and m.start() < b for a, b, _, _ in base):
            out.append((m.start(), m.end(), 3, value))
    return out


def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = []
        for t in texts.to_pylist():
            base = base_spans(t)
            spans = sorted([*base, *opaque_spans(t, base)], key=lambda x: (x[0], x[2]))
            rows.append([{"start": a, "end": b, "kind": k, "value_hash": hashlib.sha256(v.encode()).hexdigest()} for a, b, k, v in spans])
        yield pa.array(rows, pa.list_(SPAN))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in their order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def value_owners(candidates: DataFrame) -> DataFrame:
    """candidates (value_hash, owner, repo) to (value_hash, n_owners, n_repos, n_spans). Copies shrink to a row for each task, owner and repository before they travel."""
    repos = candidates.groupBy("value_hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = repos.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_spans"))


def secret_spans(docs: DataFrame, *, text_col: str = "text", owner: Column | None = None, repo: Column | None = None, carry: Sequence[str] | None = None, most_owners: int = 1, most_repos: int = 3) -> DataFrame:
    """Columns row, n_assign, n_access, n_hex, base_spans, spans, n_live and n_example.

    spans is an array of (start, end, kind, value_hash, n_owners, n_repos, live),
    by start and then kind. live: at most most_owners owners hold the value,
    and if they are several, in at most most_repos repositories; a value of one
    owner is live in however many of its repositories it is. Base spans (base_spans has them alone) are
    always there, opaque ones only if live. owner is `source` by default, repo
    owner and `lang`; null is an owner of its own. Null text is empty. Repeated rows are spans
    of the same repository. Texts of any length are scanned whole; of spans that begin at one place
    the base kinds come first. An empty table gives an empty one.
    """
    bound_arrow(docs.sparkSession)
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    kept = docs.columns if carry is None else carry
    row = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.struct(F.lit(None).cast("string").alias("none"))
    made = docs.select(row.alias("row"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), F.col(f"`{text_col}`").alias("text"))
    kind = "array<struct<start:bigint,end:bigint,kind:int,value_hash:string>>"
    found = durable(made.select("row", "owner", "repo", F.monotonically_increasing_id().alias("uid"), F.arrow_udf(scan, kind)(whole_text()).alias("found")), "candidates")
    each = found.where(F.size("found") > 0).select("uid", "owner", "repo", F.explode("found").alias("s"))
    owners = durable(value_owners(each.select(F.col("s.value_hash").alias("value_hash"), "owner", "repo")), "owners")
    told = join_by_count(each.select("uid", "s", F.col("s.value_hash").alias("value_hash")), owners, "value_hash", "n_spans")
    live = (F.col("n_owners") <= most_owners) & ((F.col("n_owners") == 1) | (F.col("n_repos") <= most_repos))
    span = F.struct("s.start", "s.end", "s.kind", "s.value_hash", "n_owners", "n_repos", live.alias("live"))
    judged = told.select("uid", span.alias("s")).where("s.kind < 3 or s.live").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), "s"))).alias("all"))
    judged = judged.select(F.col("uid").alias("of"), F.transform("all", lambda x: x["s"]).alias("spans"))
    none = F.array().cast(judged.schema["spans"].dataType)
    out = found.join(judged, found.uid == judged.of, "left").select("row", "found", F.coalesce("spans", none).alias("spans"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint")
    return out.select(
        "row", *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.filter("found", lambda s: s["kind"] < 3).alias("base_spans"), "spans",
        F.size(F.filter("spans", lambda s: s["live"])).cast("bigint").alias("n_live"), F.size(F.filter("spans", lambda s: ~s["live"])).cast("bigint").alias("n_example"),
    )
