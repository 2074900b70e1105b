"""WARC archives: writing captures, reading records, and assembling transactions.

Writing: each page becomes a request, a response (or a revisit) and a metadata record, joined by
WARC-Concurrent-To identifiers. Of equal payloads of at least `least` bytes the page with the
largest id is stored and the others revisit it. Spark's text writer makes the files; the two
line ends that close a record are its separator, so the files are plain WARC 1.1.

Reading: whole files, at most `file_records` records each where this module wrote them, are
split by Content-Length, never by a separator that a payload may hold. Compressed files (one member or one per
record) are read too.

Assembly: records are joined through their concurrent-to identifiers in either direction, over
at most one record in between, and each response or revisit gives one nested row.

Defined results: a null html is an empty payload, a null url leaves out the target; a null page
id is written as none and read back as null (it never stands for others and sorts below any id). Fully
repeated rows (page id, url and html) are captures of their own: of equal payloads one row is stored, whatever ids
repeat, and equal rows get numbered identifiers. A record
whose length runs past its file's end is marked `truncated`; bytes between records are skipped.
Responses without request or metadata have nulls there; records joined to no response are
returned by `orphans`. An empty table writes an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.common import cut
from farebox.session import shared_dir

LEAST, FILE_RECORDS = 1000, 3000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("concurrent_to", T.ArrayType(T.StringType())), T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("payload_digest", T.StringType()),  # bare hexadecimal, of the full payload
    T.StructField("payload_bytes", T.LongType()), T.StructField("http_head", T.StringType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),  # of metadata records
    T.StructField("payload", T.BinaryType()), T.StructField("truncated", T.BooleanType()),
    T.StructField("file", T.StringType()), T.StructField("offset", T.LongType())])


# ---- writing ---------------------------------------------------------------------------

def _lines(*named: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)), F.lit("")) for k, v in named])


def _identifier(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}|"), key))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
                    F.lit(">"))


def _record(kind: Column | str, rid: Column, uri: Column, content: str, block: Column, *more: tuple[str, Column]) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = _lines(("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri),
                  *more, ("Content-Type", F.lit(content)), ("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(F.lit("WARC/1.1" + CRLF), head, F.lit(CRLF), block)


def _numbered(known: DataFrame) -> DataFrame:
    """`known` with `again`: 0, 1, ... over rows that are equal in all columns.

    Equal rows need no order: they are counted, and one of them is written out as often. The others pass by.
    """
    own = ["page_id", "url", "sha", "bytes"]
    repeated = cut(known.groupBy(*own).agg(F.count("*").alias("times")).where("times > 1"), "repeated")
    same = [known[c].eqNullSafe(repeated[c]) for c in own]
    single = known.join(repeated, same, "left_anti").withColumn("again", F.lit(0).cast("long"))
    many = (known.join(repeated, same, "left_semi").groupBy(*own).agg(F.any_value("html").alias("html"), F.count("*").alias("times"))
            .select("page_id", "url", "html", "sha", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("again")))
    return single.unionByName(many)


def capture_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """One row `value` per record of `pages` (page_id, url, html), without the closing line ends."""
    digest = F.sha1(F.coalesce("html", F.lit("")))
    known = _numbered(pages.select(F.col("page_id"), F.col("url"), F.col("html"), digest.alias("sha"),
                                   F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("bytes")))
    leaders = (known.where(F.col("bytes") >= least).groupBy(F.col("sha").alias("of"), F.col("bytes").alias("size"))
               .agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n")).where("n > 1")
               .select("of", "size", F.col("top.page_id").alias("leader"), F.col("top.url").alias("leader_url")))
    rows = known.join(leaders, (known["sha"] == leaders["of"]) & (known["bytes"] == leaders["size"]), "left")

    def key(page: Column, url: Column) -> Column:
        return F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), "sha", "bytes")

    first = F.col("page_id").eqNullSafe(F.col("leader")) & F.col("url").eqNullSafe(F.col("leader_url")) & (F.col("again") == 0)
    revisit = F.col("leader").isNotNull() & ~first
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    # a row that stands again gets an identifier of its own
    own = F.concat(key(F.col("page_id"), F.col("url")), F.when(F.col("again") > 0, F.concat(F.lit("|#"), F.col("again").cast("string"))).otherwise(""))
    path = F.coalesce(F.regexp_extract(uri, r"^[a-zA-Z]+://[^/]*(/.*)$", 1), F.lit("/"))
    path = F.when(path == "", F.lit("/")).otherwise(path)
    host = F.regexp_extract(F.coalesce(uri, F.lit("")), r"^[a-zA-Z]+://([^/]*)", 1)
    response, request, metadata = (_identifier(k, own) for k in ("response", "request", "metadata"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    sha32 = F.concat(F.lit("sha1:"), F.col("sha"))
    one = _record(
        F.when(revisit, "revisit").otherwise("response"), response, uri, "application/http;msgtype=response",
        F.concat(head, F.when(revisit, "").otherwise(F.coalesce("html", F.lit("")))),
        ("WARC-Payload-Digest", sha32), ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit, _identifier("response", key(F.col("leader"), F.col("leader_url"))))))
    asked = _record("request", request, uri, "application/http;msgtype=request",
                    F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)),
                    ("WARC-Concurrent-To", response))
    about = _record("metadata", metadata, uri, "application/warc-fields",
                    _lines(("page-id", F.col("page_id").cast("string")),
                           ("refers-to-page-id", F.when(revisit, F.col("leader").cast("string")))),
                    ("WARC-Concurrent-To", request))  # over the request to its response
    return rows.select(F.explode(F.array(asked, one, about)).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST, file_records: int = FILE_RECORDS,
                   compression: str = "gzip") -> None:
    """Write the captures of `pages` under `path`, a folder that all executors share."""
    (capture_records(pages, least).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", file_records)
     .option("compression", compression).text(path))


# ---- reading ---------------------------------------------------------------------------

def _plain(data: bytes) -> bytes:
    """The data, each compressed member expanded."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


_HEX = re.compile(r"[0-9a-fA-F]{40}")


def _digest(value: str | None) -> str | None:
    """sha1 in base 16 or 32 as bare lower-case hexadecimal."""
    text = (value or "").partition(":")[2] or value
    if not text or _HEX.fullmatch(text):
        return text.lower() if text else None
    try:
        return base64.b32decode(text).hex()
    except ValueError:
        return None


def split_records(data: bytes, file: str, payloads: bool = True) -> Iterator[dict]:
    """The records of one archive."""
    data = _plain(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head: dict[str, str] = {}
        concurrent = []
        for line in data[at:end].decode("utf-8", "replace").split(CRLF)[1:]:
            name, colon, value = line.partition(":")
            if colon:
                name, value = name.strip().lower(), value.strip()
                head.setdefault(name, value)
                if name == "warc-concurrent-to":
                    concurrent.append(value)
        length = head.get("content-length", "")
        if "warc-type" not in head or not length.isdigit():
            at += 5
            continue
        block = data[end + 4:end + 4 + int(length)]
        kind, content = head["warc-type"].lower(), head.get("content-type", "").lower()
        http, payload, fields = None, block, None
        if content.startswith("application/http"):
            first, gap, payload = block.partition(b"\r\n\r\n")
            http = (first + gap).decode("utf-8", "replace")
        if content.startswith("application/warc-fields"):
            fields = {k.strip(): v.strip() for k, c, v in
                      (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF)) if c}
        said = re.search(r"(?im)^content-length:\s*(\d+)\s*$", http or "")
        stored = kind != "revisit"
        yield {"record_id": head.get("warc-record-id"), "record_type": kind, "concurrent_to": concurrent,
               "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"),
               "date": head.get("warc-date"),
               "payload_digest": hashlib.sha1(payload).hexdigest() if stored else _digest(head.get("warc-payload-digest")),
               "payload_bytes": len(payload) if stored else int(said[1]) if said else None, "http_head": http,
               "fields": fields, "payload": payload if payloads and stored else None,
               "truncated": len(block) < int(length), "file": file, "offset": at}
        at = end + 4 + int(length)


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under `path`; `payloads=False` leaves the bytes behind."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, data in zip(b["path"], b["content"]):
                some: list[dict] = []
                for r in split_records(data, file, payloads):
                    some.append(r)
                    if len(some) >= 512:
                        yield pd.DataFrame(some, columns=RECORD.names)
                        some = []
                if some:
                    yield pd.DataFrame(some, columns=RECORD.names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, RECORD)


# ---- assembly --------------------------------------------------------------------------

def _anchors(records: DataFrame) -> DataFrame:
    """(id, anchor): the response that each record belongs to, itself for responses."""
    ids = records.select(F.col("record_id").alias("id"), F.col("record_type").isin("response", "revisit").alias("stored"),
                         "concurrent_to").where("id is not null")
    edge = ids.select("id", F.explode("concurrent_to").alias("other"))
    both = edge.select("id", "other").union(edge.select(F.col("other").alias("id"), F.col("id").alias("other")))
    own = ids.where("stored").select("id", F.col("id").alias("anchor"))
    rest = ids.where("not stored").select("id")

    def step(known: DataFrame) -> DataFrame:
        near = both.join(known.withColumnRenamed("id", "other"), "other")
        return near.groupBy("id").agg(F.min("anchor").alias("anchor"))

    direct = rest.join(step(own), "id", "left").distinct()
    lost = direct.where("anchor is null").select("id")
    further = lost.join(step(direct.where("anchor is not null")), "id", "left")
    return own.distinct().union(direct.where("anchor is not null")).union(further)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id and the structs response, request and metadata.

    Of several records of a role, the one first by file and offset stands.
    """
    anchored = records.join(_anchors(records), records["record_id"] == F.col("id"))
    role = F.when(F.col("record_type").isin("response", "revisit"), "response").otherwise(F.col("record_type"))
    whole = F.struct(*RECORD.names)
    place = F.struct("file", "offset")

    def first(kind: str) -> Column:
        return F.min_by(F.when(role == kind, whole), F.when(role == kind, place)).alias(kind)

    return (anchored.where("anchor is not null").groupBy(F.col("anchor").alias("capture_id"))
            .agg(first("response"), first("request"), first("metadata")).where("response is not null"))


def orphans(records: DataFrame) -> DataFrame:
    """Records that no concurrent-to identifier joins to a response."""
    left = _anchors(records).where("anchor is null").select("id")
    return records.join(left, records["record_id"] == left["id"], "left_semi")


def round_trip(pages: DataFrame, least: int = LEAST, file_records: int = FILE_RECORDS) -> DataFrame:
    """Captures of `pages` written to the shared folder and read back without payloads."""
    spark = pages.sparkSession
    shared = shared_dir(spark)
    if shared is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{shared}/llm/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex[:12]}"
    write_archives(pages, path, least, file_records)
    return transactions(cut(read_records(spark, path, payloads=False), "records"))


def summary(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each capture."""
    about = F.col("metadata.fields")
    return captures.select(
        about["page-id"].cast("long").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"),
        about["refers-to-page-id"].cast("long").alias("refers_to"))
