"""WARC archives: writing captures, reading records, assembling transactions."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm.common import materialize, shared_dir, small_batches

#: Payloads of fewer bytes are stored each time.
REVISIT_BYTES = 1000
#: Bytes of records, before packing, that one archive file may hold (a larger page has a file of its own).
FILE_BYTES = 64 << 20
#: Pages are written by classes of size, the largest of each so many times its least.
CLASS = 16
DATE = "2024-01-01T00:00:00Z"
END = "\r\n"
#: Bytes of payload in one Arrow batch of records that are read.
OUT_BYTES = 8 << 20


def _lines(*fields: tuple[str, Column | str]) -> Column:
    """Header lines; a field whose value is null is left out."""
    lines = [F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v), F.lit(END)) for k, v in fields]
    return F.concat(*(F.coalesce(x, F.lit("")) for x in lines))


def _record(kind: str, ident: Column, content_type: str, block: Column, uri: Column, *fields: tuple[str, Column | str]) -> Column:
    head = _lines(("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", DATE), ("WARC-Target-URI", uri), *fields, ("Content-Type", content_type), ("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(F.lit("WARC/1.1" + END), head, F.lit(END), block)


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """pages: page_id, url, html (other columns are ignored). Writes, for each row, a request, a response or revisit,
    and a metadata record, which name the response or revisit as concurrent; gzip files under path.

    Of rows with equal html of revisit_bytes or more the one of the largest page_id (then url) is a response and the
    others revisit it; rows that repeat its page_id and url are responses too. Null html: empty. Null url: no target.
    White space and control characters of a url are dropped from headers. No rows: no records. Files hold FILE_BYTES
    of pages at most, so that a reader can take one whole.
    """
    html = F.coalesce("html", F.lit(""))
    size, digest = F.octet_length(html), F.sha1(F.encode(html, "UTF-8"))
    keyed = pages.select("page_id", "url", html.alias("html"), size.cast("long").alias("size"), digest.alias("digest"))
    kept = keyed.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("keep"), F.count(F.lit(1)).alias("n"))
    # Only payloads that repeat; written first, so that a small table is broadcast and the html isn't shuffled.
    kept = materialize(kept.where(F.col("n") > 1).select("digest", "keep"), "repeats")
    rows = keyed.join(kept, "digest", "left")
    ids = [F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")).alias(k) for k in ("answer_id", "ask_id", "meta_id")]
    rows = rows.select("*", *ids)
    uri = F.nullif(F.regexp_replace("url", r"[\s\p{Cntrl}]", ""), F.lit(""))
    again = F.col("keep").isNotNull() & ~F.struct("page_id", "url").eqNullSafe(F.col("keep"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END + END))
    stated = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    answer = F.when(again, _record("revisit", F.col("answer_id"), "application/http;msgtype=response", http, uri, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", F.regexp_replace("keep.url", r"[\s\p{Cntrl}]", "")), stated)).otherwise(
        _record("response", F.col("answer_id"), "application/http;msgtype=response", F.concat(http, F.col("html")), uri, stated)
    )
    target = F.regexp_extract(uri, r"^[^:]*://[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.coalesce(F.nullif(target, F.lit("")), F.lit("/")), F.lit(f" HTTP/1.1{END}Host: "), F.coalesce(F.regexp_extract(uri, r"^[^:]*://([^/?#]*)", 1), F.lit("")), F.lit(END + END))
    concurrent = ("WARC-Concurrent-To", F.col("answer_id"))
    records = F.array(_record("request", F.col("ask_id"), "application/http;msgtype=request", ask, uri, concurrent), answer, _record("metadata", F.col("meta_id"), "application/warc-fields", _lines(("page_id", F.col("page_id").cast("string"))), uri, concurrent))
    # A file holds whole pages, so many that even the largest of their class fit: three records a page.
    floor_ = FILE_BYTES // CLASS**3
    place = F.greatest(F.ceil(F.log(float(CLASS), (F.col("size") + 1) / F.lit(floor_))), F.lit(0)).cast("int")
    for k in sorted(r[0] for r in keyed.select(place.alias("class")).distinct().collect()) or [0]:
        pages_a_file = max(1, FILE_BYTES // (floor_ * CLASS**k))
        packed = rows.where(place == k).select(F.explode(records).alias("value"))
        packed.write.mode("append").option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", 3 * pages_a_file).text(path)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower-cased names) and block of each record. A record cut short raises."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(n := int(fields["content-length"]))
        if len(block) < n:
            raise ValueError("a record is cut short")
        yield fields, block


RECORD = "record_id string, type string, concurrent_to string, target_uri string, stated_digest string, head string, payload_bytes long, payload_digest string, payload binary"


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in RECORD.split(", ")])
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for content in batch.column("content"):
                raw = io.BytesIO(content.as_buffer())
                packed = raw.getvalue()[:2] == b"\x1f\x8b"
                for f, block in parse_records(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if packed else raw):
                    head, payload = b"", block
                    if "application/http" in f.get("content-type", ""):
                        head, _, payload = block.partition(b"\r\n\r\n")
                    elif f.get("content-type") == "application/warc-fields":
                        head, payload = block, b""
                    rows.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-concurrent-to"), f.get("warc-target-uri"), f.get("warc-payload-digest"), head.decode("utf-8", "replace"), len(payload), hashlib.sha1(payload).hexdigest(), payload if with_payload else None))
                    size += 500 + len(payload) * with_payload
                    if size > OUT_BYTES:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives under path (plain or gzip), with the length and SHA-1 of its payload."""
    small_batches(spark)
    # A file of no bytes holds no record; an empty result leaves no other.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > 0)
    return files.select("content").mapInArrow(_read(with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata (each the whole record or null).

    The response or revisit names the capture. Requests and metadata belong to the record that they are concurrent
    to, directly, through the request, or as the response states it the other way round; those that reach none stand
    for themselves. A capture of several requests or metadata records gives a row for each pair of them.
    """
    whole = F.struct(*records.columns)
    kind = F.col("type")
    answers = records.where(kind.isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), "concurrent_to", whole.alias("response"))
    asks = records.where(kind == "request").select("record_id", "concurrent_to", whole.alias("request"))
    notes = records.where(kind == "metadata").select("record_id", "concurrent_to", whole.alias("metadata"))
    reverse = answers.where(F.col("concurrent_to").isNotNull()).select(F.col("concurrent_to").alias("record_id"), F.col("capture_id").alias("by"))
    asks = asks.join(reverse, "record_id", "left").select(F.coalesce("concurrent_to", "by", "record_id").alias("capture_id"), "record_id", "request")
    through = asks.select(F.col("record_id").alias("concurrent_to"), F.col("capture_id").alias("by"))
    notes = notes.join(through, "concurrent_to", "left").select(F.coalesce("by", "concurrent_to", "record_id").alias("capture_id"), "metadata")
    joined = answers.select("capture_id", "response").join(asks.select("capture_id", "request"), "capture_id", "full").join(notes, "capture_id", "full")
    return joined.select("capture_id", "response", "request", "metadata")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives pages in the shared folder, reads them back and returns per page: page_id, payload_bytes,
    payload_digest, record_type, refers_to (the page_id of the response that a revisit stands for), target_uri,
    request_line. A revisit's length and digest are those of the response that its stated digest names."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/factmill/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    records = materialize(read_warc(spark, path, with_payload=False), "records")
    seen = materialize(assemble(records), "captures")
    page = F.nullif(F.regexp_extract("metadata.head", r"(?m)^page_id: (-?\d+)", 1), F.lit("")).cast("long")
    line = F.regexp_extract("request.head", r"^[^\r\n]*", 0)
    flat = seen.select(page.alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.payload_bytes").alias("n"), F.col("response.payload_digest").alias("own"), F.substring_index("response.stated_digest", ":", -1).alias("stated"), F.col("response.target_uri").alias("target_uri"), line.alias("request_line"))
    again = flat.where(F.col("record_type") == "revisit")
    stored = flat.where((F.col("record_type") == "response") & (F.col("n") >= REVISIT_BYTES))
    # Only payloads that some revisit names.
    stored = stored.join(again.select(F.col("stated").alias("own")).distinct(), "own").groupBy("own").agg(F.max("page_id").alias("refers_to"), F.max("n").alias("full"))
    stored = materialize(stored.select(F.col("own").alias("stated"), "refers_to", "full"), "stored")
    out = again.join(stored, "stated", "left").select("page_id", F.col("full").alias("payload_bytes"), F.col("stated").alias("payload_digest"), "record_type", "refers_to", "target_uri", "request_line")
    first = flat.where(F.col("record_type") == "response").select("page_id", F.col("n").alias("payload_bytes"), F.col("own").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "target_uri", "request_line")
    return first.union(out)
