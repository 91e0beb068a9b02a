"""WARC archives: writing with revisits and segments, reading with segment reassembly.

Writing: each page is an HTTP response in chunked transfer framing. Of the pages with equal payloads of
at least ``REVISIT`` bytes the one with the largest page_id is the response and the others are revisits
that refer to it; a block of more than ``segment`` bytes is split into a first record and continuations.
Records are written as gzipped text files whose line separator is the two empty lines between records,
through Spark's own writer, so they land in the shared folder whatever its file system is.

Reading: files are parsed by content length, not by separators. Records without a segment number are
whole; segments are grouped by origin identifier, ordered by segment number, and joined if the numbers
run from 1 without a gap and the length is the stated total; then the chunked framing is decoded and the
payload's digest is checked. An incomplete or damaged record gets payload null and says why in ``error``.

Every row is a record of its own, with its own url. A record's identifier holds the page_id and the payload's digest;
where a page has the same payload more than once, the record of the smallest url bears it, and the others add a digest
of their url and a number. All of them are responses if the page is the response, and revisits refer to the first. Rows
that are equal as a whole travel as one with their number and are written ``COPIES`` a task.

Two different segments of one number are an error (``conflicting segments``), equal ones are one.

Nulls: a null payload is empty, a null url an empty string, a null page_id a page of its own that revisits any
page with an id. Extra columns play no part. An empty table gives an empty archive. Spark's text writer makes one
gzip member a file, so files are read whole; a page's segments meet in one row, which holds less than 2 GB.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobath.llm.shared import materialise, shared_dir, table

REVISIT = 1000
SEGMENT = 32 << 10
HTTP_CHUNK = 8 << 10
RECORDS_A_FILE = 2000
COPIES = 1000
SEP = b"\r\n\r\n"


def identified(pages: DataFrame) -> DataFrame:
    """id, page_id, url, payload (binary), n, sha1 of each row; equal payloads of one page_id have one id."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    return rows.withColumn("id", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("sha1")))


def decisions(pages: DataFrame, least: int = REVISIT) -> DataFrame:
    """id, copies and first_url (of its rows), record_type, refers_to (an id). Only payloads that repeat meet a join."""
    each = identified(pages).groupBy("id", "page_id", "sha1", "n").agg(F.count("*").alias("copies"), F.min("url").alias("first_url"))
    # of pages without an id none is the largest, unless all are
    latest = F.max_by("id", F.struct(F.col("page_id").isNotNull(), "page_id")).alias("latest")
    often = each.filter(F.col("n") >= least).groupBy("sha1", "n").agg(latest, F.count("*").alias("times")).filter("times > 1")
    refers = F.when(F.col("latest") != F.col("id"), F.col("latest"))
    return each.join(often, ["sha1", "n"], "left").select("id", "copies", "first_url", F.when(refers.isNull(), "response").otherwise("revisit").alias("record_type"), refers.alias("refers_to"))


def frame(payload: bytes, size: int = HTTP_CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unframe(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk without end")
        out.append(body[at : at + n])
        at += n + 2


def _record(kind: str, id_: str, block: bytes, **headers) -> bytes:
    lines = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <{id_}>".encode(), b"WARC-Date: 2024-01-01T00:00:00Z"]
    lines += [f"{k.replace('_', '-')}: {v}".encode() for k, v in headers.items() if v is not None]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block)]) + SEP + block


def page_urn(page_id: int | None, payload: bytes) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}:{hashlib.sha1(payload).hexdigest()}"


def records(id_: str, url: str, payload: bytes, refers_to: str | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one row, without the separators after them."""
    digest = f"sha1:{hashlib.sha1(payload).hexdigest()}"
    uri = "".join(c if c > " " else "%20" for c in url)
    headers = {"WARC_Target_URI": uri, "WARC_Payload_Digest": digest, "Content_Type": "application/http; msgtype=response", "X_Payload_Length": len(payload)}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + SEP
    if refers_to is not None:
        return [_record("revisit", id_, head, WARC_Refers_To=f"<{refers_to}>", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", **headers)]
    block = head + frame(payload)
    if len(block) <= segment:
        return [_record("response", id_, block, **headers)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [_record("response", id_, parts[0], WARC_Segment_Number=1, **headers)]
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        out.append(_record("continuation", f"{id_}:{k}", part, WARC_Segment_Origin_ID=f"<{id_}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=total, WARC_Target_URI=uri))
    return out


def write_archives(pages: DataFrame, path: str, least: int = REVISIT, segment: int = SEGMENT) -> None:
    """Write pages (page_id, url, html) as WARC files into the folder path.

    Payloads meet the decisions by id. Rows of an id that repeats meet once more, equal ones pre-aggregated, and part again
    before they are written.
    """
    decided = materialise(decisions(pages, least), "warc")
    one = F.lit(1).cast("long")
    columns = ["id", "url", "first_url", "payload", "refers_to"]
    rows = identified(pages).select("id", "url", "payload").join(decided, "id")
    single = rows.filter("copies = 1").select(*columns, one.alias("start"), one.alias("end"))
    equal = rows.filter("copies > 1").groupBy("id", "url", "first_url", "refers_to").agg(F.first("payload").alias("payload"), F.count("*").alias("times"))
    parts = equal.withColumn("start", F.explode(F.sequence(one, F.col("times"), F.lit(COPIES).cast("long"))))
    many = parts.select(*columns, "start", F.least(F.col("start") + COPIES - 1, F.col("times")).alias("end")).repartition("id", "url", "start")

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for id_, url, first_url, payload, refers_to, start, end in zip(*(batch.column(c).to_pylist() for c in (*columns, "start", "end")), strict=True):
                for number in range(start, end + 1):
                    own = id_ if url == first_url and number == 1 else f"{id_}:{hashlib.sha1(url.encode()).hexdigest()}-{number}"
                    for r in records(own, url, payload, refers_to, segment):
                        out.append(r)
                        size += len(r)
                    if size > 4 << 20:
                        yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])
                        out, size = [], 0
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    made = single.unionByName(many).mapInArrow(run, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", SEP.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def parse(data: bytes):
    """(headers, block) of each record of an uncompressed archive."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(SEP, at)
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            headers[k.strip().lower().decode()] = v.strip().decode()
        at = end + len(SEP)
        n = int(headers["content-length"])
        yield headers, data[at : at + n]
        at += n


def _bare(id_: str | None) -> str | None:
    return id_.strip("<>") if id_ else None


_FIELDS = pa.schema([("id", pa.string()), ("kind", pa.string()), ("uri", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("stated", pa.int64()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary())])
_DDL = "id string, kind string, uri string, refers string, digest string, stated long, segment long, total long, block binary"
_BATCH = 256


def _record_batches(rows, schema: pa.Schema):
    """Rows as record batches of up to _BATCH rows."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == _BATCH:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record; id is the origin's identifier for continuations."""

    def rows(data: bytes):
        for h, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
            stated, number, total = (int(h[k]) if k in h else None for k in ("x-payload-length", "warc-segment-number", "warc-segment-total-length"))
            id_ = h.get("warc-segment-origin-id", h["warc-record-id"])
            yield _bare(id_), h["warc-type"], h.get("warc-target-uri"), _bare(h.get("warc-refers-to")), h.get("warc-payload-digest"), stated, number, total, block

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                yield from _record_batches(rows(content.as_py()), _FIELDS)

    # an archive of RECORDS_A_FILE records is one value; the scan packs few of them into a task
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, _DDL)


def reassemble(found: DataFrame) -> DataFrame:
    """One row per record: blocks in order, with error where they do not fit together. Segments are grouped by origin."""
    whole = found.filter(F.col("segment").isNull()).withColumn("blocks", F.array("block")).drop("segment", "total", "block").withColumn("error", F.lit(None).cast("string"))
    parts = F.sort_array(F.array_distinct(F.collect_list(F.struct("segment", "block"))))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    length = F.aggregate("blocks", F.lit(0).cast("long"), lambda acc, b: acc + F.octet_length(b))
    joined = (
        found.filter(F.col("segment").isNotNull())
        .groupBy("id")
        .agg(*[first(c) for c in ("kind", "uri", "refers", "digest", "stated")], F.max("total").alias("total"), parts.alias("parts"))
        .withColumn("blocks", F.transform("parts", lambda p: p["block"]))
        .withColumn("twice", F.size(F.array_distinct(F.transform("parts", lambda p: p["segment"]))) < F.size("parts"))
        .withColumn("gap", F.exists(F.transform("parts", lambda p, i: p["segment"] != i + 1), lambda g: g))
        .withColumn("error", F.when(F.col("twice"), "conflicting segments").when(F.col("gap") | F.col("total").isNull(), "missing segment").when(length != F.col("total"), "wrong total length"))
    )
    return whole.unionByName(joined.select(*whole.columns))


_PAYLOADS = pa.schema([("id", pa.string()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])


def _payload(r: dict) -> tuple:
    payload, error = None, r["error"]
    stated = (r["digest"] or "").removeprefix("sha1:")
    if error is None and r["kind"] == "response":
        try:
            head, _, body = b"".join(r["blocks"]).partition(SEP)
            payload = unframe(body) if b"transfer-encoding: chunked" in head.lower() else body
            if stated and hashlib.sha1(payload).hexdigest() != stated:
                payload, error = None, "wrong digest"
        except ValueError as broken:
            error = f"broken framing: {broken}"
    # stated values stand in for a revisit's only: what is not read back is not reported
    trusted = r["kind"] == "revisit" and error is None
    n = len(payload) if payload is not None else r["stated"] if trusted else None
    digest = hashlib.sha1(payload).hexdigest() if payload is not None else (stated or None) if trusted else None
    return r["id"], r["uri"], r["kind"], r["refers"], n, digest, payload, error


def payloads(found: DataFrame) -> DataFrame:
    """id, uri, record_type, refers_to (identifier), payload_bytes, payload_digest, payload, error; a revisit has no payload of its own."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, _BATCH):
                yield from _record_batches(map(_payload, batch.slice(a, _BATCH).to_pylist()), _PAYLOADS)

    ddl = "id string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"
    return found.select("id", "kind", "uri", "refers", "digest", "stated", "blocks", "error").mapInArrow(run, ddl)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return payloads(reassemble(read_records(spark, path)))


def op6_warc(spark, sf_dir):
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    back = materialise(read_archives(spark, path).filter(F.col("record_type").isin("response", "revisit")).drop("payload", "uri", "error"), "records")
    # a revisit's payload is its response's: length and digest are read from the response
    origin = back.filter("record_type = 'response'").select(F.col("id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))
    revisits = back.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(origin, "refers_to", "left").withColumnsRenamed({"n": "payload_bytes", "d": "payload_digest"})
    columns = ["id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    both = back.filter("record_type = 'response'").select(*columns).unionByName(revisits.select(*columns))
    number = lambda c: F.expr(f"try_cast(split({c}, ':')[2] AS long)")
    return both.select(number("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, sha1(html) AS d, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {REVISIT} AND last IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISIT} AND last IS DISTINCT FROM page_id THEN last END AS refers_to
FROM s
"""
