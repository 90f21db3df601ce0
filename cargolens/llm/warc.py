"""WARC archives written from and read to a table of payload chunks.

A record's payload travels as rows (record, chunk number, bytes) of bounded
size, so that neither writer nor reader holds a whole record: the writer gets
chunk rows one after another and streams them into a gzip member, the reader inflates a
member piece by piece into chunk rows, each with the digest of the payload so
far. Of records with equal payloads one is a response; the others revisit it
and carry its digest and length only.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm.common import bound_arrow, durable, join_by_count, located, rows_without, shared_path

#: bytes of a chunk row, at most; bytes of an archive that are read at once
CHUNK, READ = 1 << 14, 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
CRLF = b"\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def page_urn(page_id: int | None) -> str:
    return f"urn:x-page:{'null' if page_id is None else page_id}"


def page_of(urn: str) -> int | None:
    name = urn.strip("<> ").rsplit(":", 1)[-1]
    return None if name == "null" else int(name)


def clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:x-unknown"


def record_head(page_id: int | None, url: str | None, n_bytes: int, digest: str, response_id: int | None) -> tuple[bytes, bytes]:
    """WARC header and HTTP header of a page's record."""
    revisit = response_id is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{page_urn(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean_url(url)}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(http) + (0 if revisit else n_bytes)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{page_urn(response_id)}>"]
    return "\r\n".join([*lines, "", ""]).encode(), http


def write_archive(root: str):
    """mapInArrow function: rows (page_id, url, n_bytes, sha1, response_id, chunk_no, chunk), a record's chunks one after another, to an archive of each task, and its row in the manifest. A task that runs again writes another file; only the committed one is in the manifest."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, gz, left, want = None, f"{root}/{uuid.uuid4().hex}.warc.gz", 0, None, 0, 0
        for batch in batches:
            for page_id, url, n_bytes, sha1, response_id, chunk_no, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store, where = pafs.FileSystem.from_uri(path)
                    store.create_dir(where.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(where, compression=None)
                if gz is None:
                    gz, left, want = zlib.compressobj(6, zlib.DEFLATED, 31), 0 if response_id is not None else n_bytes, 0
                    head, http = record_head(page_id, url, n_bytes, base32(bytes.fromhex(sha1)), response_id)
                    out.write(gz.compress(head + http))
                if chunk_no != want:
                    raise ValueError("a record's chunks don't come in order")
                out.write(gz.compress(chunk or b""))
                left, want = left - len(chunk or b""), want + 1
                if not left:
                    out.write(gz.compress(CRLF + CRLF) + gz.flush())
                    gz, n = None, n + 1
        if gz is not None:
            raise ValueError("a record lacks chunks")
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

    return of


def payload_chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """rows with a binary column `html` to rows for each `size` bytes of it, one after another (one for an empty payload): the other columns, chunk_no and chunk."""
    kept = [c for c in rows.columns if c != "html"]
    numbered = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"greatest(length(html) - 1, 0) div {size}"))))
    return numbered.select(*kept, "chunk_no", F.substring("html", (F.col("chunk_no") * size + 1).cast("int"), F.lit(size)).alias("chunk"))


def write_warc(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record per row into archives in the shared folder; the manifest (path, n_records).

    The payload is the column's UTF-8 (null: empty), of any length. Of rows with equal
    payloads of at least min_bytes, those with the largest id are responses and the
    others revisits; smaller payloads are all responses. Rows that repeat the largest id with the same
    payload are each a response; a null id is never largest, and if all are
    null all are responses. Record identifiers are made of page ids, so rows that repeat an
    id share one; the reader tells records apart by archive and number. An empty table writes
    nothing. pages is read twice; payloads of revisits aren't read again.
    """
    spark = pages.sparkSession
    bound_arrow(spark)
    base = located(pages, page_id=id_col, url=url_col, html=payload_col)
    base = base.select("at", F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = base.withColumn("n_bytes", F.length("html").cast("bigint")).withColumn("sha1", F.sha1("html"))
    # Equal payloads agree in both digests and the length
    narrow = durable(rows.select("at", "page_id", "url", "n_bytes", "sha1", F.struct(F.sha2("html", 256).alias("sha256"), "sha1", "n_bytes").alias("payload")).where(F.col("n_bytes") >= min_bytes), "digests")
    groups = narrow.groupBy("payload").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("many"))
    several = durable(groups.where("many > 1 and first is not null"), "payloads")
    revisits = join_by_count(narrow, several, "payload", "many").where(~F.col("first").eqNullSafe(F.col("page_id")))
    revisits = durable(revisits.select("at", "page_id", "url", "n_bytes", "sha1", F.col("first").alias("response_id")), "revisits")
    responses = rows_without(rows, revisits.select("at"), "at").select("page_id", "url", "n_bytes", "sha1", F.lit(None).cast("bigint").alias("response_id"), "html")
    bare = revisits.select("page_id", "url", "n_bytes", "sha1", "response_id", F.lit(0).cast("bigint").alias("chunk_no"), F.lit(None).cast("binary").alias("chunk"))
    return durable(payload_chunks(responses).unionByName(bare).mapInArrow(write_archive(shared_path(spark, "warc")), "path string, n_records bigint"), "manifest")


class Member:
    """Inflates the gzip members of a stream one after another; reads lines and bounded pieces."""

    def __init__(self, raw, size: int = CHUNK, read: int = READ) -> None:
        self.raw, self.size, self.read, self.left, self.held, self.z = raw, size, read, b"", b"", None

    def next(self) -> bool:
        """Go to the next member; False at the end of the file."""
        while self.z is not None and not self.z.eof:
            if not self.more():
                break
        self.held = b""
        if self.z is not None:
            self.left = self.z.unused_data
        if not self.left:
            self.left = self.raw.read(self.read)
        self.z = zlib.decompressobj(31)
        return bool(self.left)

    def more(self) -> bool:
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail or self.left or self.raw.read(self.read)
        self.left = b""
        if not data:
            raise ValueError("the archive ends inside a record")
        self.held += self.z.decompress(data, self.size)
        return True

    def head(self) -> list[str]:
        """Lines up to an empty one."""
        while b"\r\n\r\n" not in self.held:
            if not self.more():
                raise ValueError("a header doesn't end")
        head, _, self.held = self.held.partition(b"\r\n\r\n")
        return head.decode().split("\r\n")

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces of at most `size`."""
        while n:
            if not self.held and not self.more():
                raise ValueError("a record is shorter than it says")
            part, self.held = self.held[: min(n, self.size)], self.held[min(n, self.size) :]
            n -= len(part)
            if part:
                yield part


def fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


CHUNKS = "archive string, record_no bigint, page_id bigint, record_type string, url string, refers_to bigint, payload_bytes bigint, declared_digest string, chunk_no bigint, chunk_offset bigint, chunk binary, running_digest string"
KINDS = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def read_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: rows (path) to the archives' chunk rows, in batches of some chunks."""
    schema = pa.schema([(name, KINDS[kind]) for name, kind in (x.split() for x in CHUNKS.split(", "))])

    def table(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, where = pafs.FileSystem.from_uri(path)
            rows, held, record_no = [], 0, 0
            with store.open_input_stream(where, compression=None) as raw:
                member = Member(raw)
                while member.next():
                    head = fields(member.head())
                    lines = member.head()
                    left = int(head["content-length"]) - len("\r\n".join(lines).encode()) - 4
                    size, sha, at = int(fields(lines)["content-length"]), hashlib.sha1(), 0
                    refers = page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None
                    same = [path, record_no, page_of(head["warc-record-id"]), head["warc-type"], head["warc-target-uri"], refers, size, head["warc-payload-digest"].partition(":")[2]]
                    for k, part in enumerate(member.pieces(left) if left else [b""]):  # a revisit, or an empty payload: one row without bytes
                        sha.update(part)
                        rows.append([*same, k, at, part, base32(sha.digest())])
                        at, held = at + len(part), held + len(part) + 300
                        if held > 1 << 21:
                            yield table(rows)
                            rows, held = [], 0
                    record_no += 1
            if rows:
                yield table(rows)


def read_warc_chunks(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Chunk rows of the manifest's archives; (archive, record_no) identifies a record. running_digest is the base32 SHA-1 of the payload up to and with the chunk; payload_bytes and declared_digest are of the full payload. A revisit has one row without bytes."""
    paths = manifest.select("path").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return paths.mapInArrow(read_archives, CHUNKS)


def warc_round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write pages to archives, read them back as chunk rows and put each record's rows together: page_id, payload_bytes, payload_digest, record_type, refers_to, n_chunks and intact (all chunks are there, and a response's bytes have the declared length and digest). Rows as write_warc says; an empty table gives an empty one."""
    chunks = read_warc_chunks(pages.sparkSession, write_warc(pages, **how))
    record = ["archive", "record_no", "page_id", "payload_bytes", "declared_digest", "record_type", "refers_to"]
    last = F.max(F.struct("chunk_no", "running_digest"))
    found = chunks.groupBy(*record).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.octet_length("chunk")).alias("read_bytes"), last.alias("last"))
    revisit, digest = F.col("record_type") == "revisit", F.col("last.running_digest")
    whole = (F.col("n_chunks") == F.col("last.chunk_no") + 1) & (revisit | ((F.col("read_bytes") == F.col("payload_bytes")) & (digest == F.col("declared_digest"))))
    return found.select("page_id", "payload_bytes", F.when(revisit, F.col("declared_digest")).otherwise(digest).alias("payload_digest"), "record_type", "refers_to", "n_chunks", whole.alias("intact"))
