"""Operator 5, WARC archives: write request, response or revisit, and metadata records, and assemble them again.

Each page becomes three records that name the page's response (or revisit) record
in WARC-Concurrent-To. Reading joins the records of one transaction through those
identifiers and emits one nested row per capture.

The archives are WARC 1.1 files, gzipped. Spark's own text writer and reader move them,
so they may lie in any store that Spark reaches: a record ends in two line breaks, which
are the line separator of both. The reader puts the lines of a file together
again and goes by Content-Length alone, so payloads may hold anything, separators
included. A file is read as a stream, by one task, since it is gzipped; a task holds one
record at a time, however long its file is.

Of records with equal payloads of at least ``least`` bytes, that with the largest
id is the response and the others revisit it. Defined cases: a null payload is
empty; rows that tie at the largest id with equal payloads are each a response;
rows with a null id are responses, and are never revisited; rows that are equal in id,
url and payload are captures of their own, told apart by a number; names of records are the
same in every run; extra columns are neither read nor returned; an empty table makes
an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialize

EOL = "\r\n"
DATE = "2024-01-01T00:00:00Z"
SEPARATOR = EOL + EOL
#: Records of one archive file at most, so that there are files enough to read side by side.
FILE_RECORDS = 30_000


def digests(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, url, bytes, digest, payload): digest is the payload's base32 SHA-1."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        sums = [base64.b32encode(hashlib.sha1((h or "").encode("utf-8", "surrogatepass")).digest()).decode() for h in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.string())], ["id", "url", "payload", "digest"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    return map_arrow(src, each, "id long, url string, payload string, digest string").withColumn("bytes", F.octet_length("payload").cast("long"))


def record(kind: str, headers: list[tuple[str, Column]], block: Column, content_type: str) -> Column:
    """The text of a record without its closing line breaks; a null header is left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in headers]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(EOL, *lines), F.lit(EOL + EOL), block)


def urn(*parts: Column) -> Column:
    """A record identifier, the same in every run: a UUID of the hash of its parts."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def numbered(pages: DataFrame, per: DataFrame) -> DataFrame:
    """pages with ``number``: 0, or a number among rows that are equal in id, url and digest. per has their counts, as n.

    Equal rows are brought together as one row and a count, however many they are.
    """
    again = materialize(per.where("n > 1").select(F.col("digest").alias("__digest"), F.col("id").alias("__id"), F.col("url").alias("__url")), "again")
    if again.isEmpty():
        return pages.withColumn("number", F.lit(0))
    same = (F.col("digest") == F.col("__digest")) & F.col("id").eqNullSafe(F.col("__id")) & F.col("url").eqNullSafe(F.col("__url"))
    many = pages.join(again, same, "left_semi").groupBy("id", "url", "digest").agg(F.first("payload").alias("payload"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    many = many.withColumn("number", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    return pages.join(again, same, "left_anti").withColumn("number", F.lit(0)).unionByName(many)


def write_archives(df: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write three records per row into WARC files under path.

    The responses are chosen on ids, digests and sizes alone; only then are the
    payloads joined with the choice, by digest. A digest that many rows share is
    one row on the other side, so adaptive execution may split it.
    """
    pages = digests(df, id_col, url_col, payload_col)
    per = materialize(pages.groupBy("digest", "id", "url").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")), "captures")
    keep = per.where(F.col("bytes") >= least).groupBy("digest", "id").agg(F.sum("n").alias("n"))
    keep = keep.groupBy("digest").agg(F.sum("n").alias("all"), F.max(F.struct("id", "n")).alias("top")).where("all > 1 AND top.id IS NOT NULL")
    keep = materialize(keep.select("digest", F.col("top.id").alias("last"), (F.col("top.n") == 1).alias("sole")), "digests")
    pages = numbered(pages, per).join(keep, "digest", "left")
    again = F.coalesce((F.col("id") < F.col("last")) & (F.col("bytes") >= least), F.lit(False))
    # a response that is alone at the largest id has a name that its revisits can refer to
    sole = (F.col("id") == F.col("last")) & F.col("sole")
    own = F.when(sole, urn(F.lit("response"), F.col("id"), F.col("digest"))).otherwise(urn(F.lit("capture"), F.col("id"), F.col("url"), F.col("digest"), F.col("number")))
    c = F.col
    pages = pages.withColumn("again", again).withColumn("name", own).withColumn("uri", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", ""))
    uri = F.when(c("uri") != "", c("uri"))
    path_part = F.coalesce(F.nullif(F.regexp_extract("uri", r"^[a-z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract("uri", r"^[a-z]+://([^/?#]*)", 1)
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), c("bytes").cast("string"), F.lit(EOL + EOL))
    digest = F.concat(F.lit("sha1:"), c("digest"))
    request = record("request", [("WARC-Record-ID", urn(F.lit("request"), c("name"))), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", c("name"))],
                     F.concat(F.lit("GET "), path_part, F.lit(f" HTTP/1.1{EOL}Host: "), host, F.lit(EOL + EOL)), "application/http; msgtype=request")
    response = record("response", [("WARC-Record-ID", c("name")), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest)], F.concat(head, c("payload")), "application/http; msgtype=response")
    revisit = record("revisit", [("WARC-Record-ID", c("name")), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                                 ("WARC-Refers-To", F.when(c("sole"), urn(F.lit("response"), c("last"), c("digest")))), ("WARC-Refers-To-Page", c("last").cast("string"))], head, "application/http; msgtype=response")
    fields = F.concat_ws(EOL, F.concat(F.lit("page-id: "), c("id").cast("string")), F.concat(F.lit("payload-length: "), c("bytes").cast("string")), F.lit(""))
    metadata = record("metadata", [("WARC-Record-ID", urn(F.lit("metadata"), c("name"))), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", c("name"))], fields, "application/warc-fields")
    out = pages.select(F.explode(F.array(request, F.when(c("again"), revisit).otherwise(response), metadata)).alias("value"))
    out.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def parse(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of archives that come in chunks."""
    have = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        got = next(chunks, None)
        have.extend(got or b"")
        return got is not None

    at = 0  # what stands before it in have is done with
    while True:
        # line breaks that end a record; the last line of a file comes with one separator too many
        while at == len(have) or have[at] in b"\r\n":
            if at < len(have):
                at += 1
            else:
                have.clear()
                at = 0
                if not more():
                    return
        while (end := have.find(SEPARATOR.encode(), at)) < 0:
            if not more():
                raise ValueError("an archive ends within a header")
        lines = have[at:end].decode().split(EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {lines[0][:40]!r}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        n = int(head["content-length"])
        while len(have) < start + n + 4:
            if not more():
                raise ValueError("an archive ends within a record")
        if have[start + n : start + n + 4] != SEPARATOR.encode():
            raise ValueError(f"the record {head.get('warc-record-id')} is longer or shorter than it says")
        yield head, bytes(have[start : start + n])
        at = start + n + 4
        if at > 1 << 20:
            del have[:at]
            at = 0


RECORDS = "kind string, record_id string, transaction string, uri string, digest string, refers_page long, http string, fields string, payload binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under path."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "record_id", "transaction", "uri", "digest", "refers_page", "http", "fields", "payload"]
        types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
        sep = SEPARATOR.encode()
        lines = (line.encode() + sep for b in batches for line in b.column(0).to_pylist())
        rows: list[tuple] = []
        size = 0
        for h, block in parse(lines):
            kind = h["warc-type"]
            http, body = (block.split(sep, 1) + [b""])[:2] if kind != "metadata" else (b"", b"")
            last = h.get("warc-refers-to-page")
            rows.append((kind, h["warc-record-id"], h.get("warc-concurrent-to", h["warc-record-id"]), h.get("warc-target-uri"), h.get("warc-payload-digest"), int(last) if last else None,
                         http.decode("utf-8", "replace"), block.decode() if kind == "metadata" else None, body if kind == "response" else None))
            size += len(block) + 500
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spark.read.option("lineSep", SEPARATOR).text(path).mapInArrow(each, RECORDS)


def verified(records: DataFrame) -> DataFrame:
    """records with each response's payload checked against its digest: columns payload_bytes and intact instead of payload."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        size, good = [], []
        for d, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            size.append(None if p is None else len(p))
            good.append(None if p is None else d == "sha1:" + base64.b32encode(hashlib.sha1(p).digest()).decode())
        return pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(size, pa.int64()), pa.array(good, pa.bool_())], [*rest, "payload_bytes", "intact"])

    rest = [c for c in records.columns if c not in ("digest", "payload")] + ["d"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.withColumn("d", F.col("digest")).select(rest).schema)
    return map_arrow(records.select("digest", "payload", *[c for c in rest if c != "d"], F.col("digest").alias("d")), each, f"{kinds}, payload_bytes long, intact boolean")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its request, its response or revisit, and its metadata, joined by transaction."""
    of = lambda *kinds: records.where(F.col("kind").isin(*kinds))
    rest = [c for c in records.columns if c != "transaction"]
    main = of("response", "revisit").select("transaction", F.struct(*rest).alias("response"))
    asked = of("request").select("transaction", F.struct("record_id", "uri", "http").alias("request"))
    about = of("metadata").select(
        "transaction",
        F.struct(
            "record_id",
            F.regexp_extract("fields", r"page-id: (-?\d+)", 1).try_cast("long").alias("page_id"),
            F.regexp_extract("fields", r"payload-length: (\d+)", 1).try_cast("long").alias("payload_length"),
        ).alias("metadata"),
    )
    return main.join(asked, "transaction", "left").join(about, "transaction", "left")
