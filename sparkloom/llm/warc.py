"""WARC archives with revisit resolution: headers are shuffled by payload digest, payloads are not."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, saved, scratch

CRLF, END = "\r\n", "\r\n\r\n"
#: Revisit ids are broadcast up to so many rows; beyond, responses are found by a shuffled anti join.
MAX_BROADCAST_ROWS = 1_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, from the hex digest by 5 hex digits (20 bits) at a time."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _key(*parts: Column) -> Column:
    """An MD5 of some values, nulls apart from all others."""
    return F.md5(F.concat(*[F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]).cast("binary"))


def _urn(key: Column, copy: Column) -> Column:
    """A record id from the row's key and the number of its copy."""
    h = F.md5(F.concat(key, F.lit("/"), copy.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none if the value is null. Line ends in values are percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def _record(kind: str, date: str, block: Column, first: list[Column]) -> Column:
    head = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {date}{CRLF}Content-Type: application/http; msgtype=response{CRLF}"), *first]
    return F.concat(*head, _line("Content-Length", F.octet_length(block)), F.lit(CRLF), block)


def _http(size: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), _line("Content-Length", size), F.lit(CRLF))


def resolve(heads: DataFrame, min_payload: int = 0) -> DataFrame:
    """``(key, page_id, url, digest, size, copies, first_key, first_page, first_url)``: different rows of ``heads`` (page_id, url, digest, size).

    Of equal digests and sizes of at least ``min_payload`` bytes the smallest page_id (null is the largest, ties go by
    url) is the original, ``first_key`` is its key; smaller payloads have none.  Rows that agree in all are
    folded into one with their number, so a digest with a large share of all rows is, too, before the shuffle where rows repeat;
    other such digests are resolved by a broadcast of them (see ``lookup``).
    """
    rows = heads.groupBy("page_id", "url", "digest", "size").agg(F.count("*").alias("copies")).withColumn("key", _key(F.col("page_id"), F.col("url"), F.col("digest"), F.col("size")))
    rows = saved(rows.withColumn("of", F.when(F.col("size") >= min_payload, F.concat_ws("/", "digest", "size"))), "rows")
    order = F.struct(F.col("page_id").isNull().alias("x"), "page_id", F.col("url").isNull().alias("y"), "url", "key")
    groups = saved(rows.where("of is not null").groupBy("of").agg(F.min(order).alias("first"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    named = groups.select("of", "n", F.col("first.key").alias("first_key"), F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url"))
    return saved(lookup(rows, named, "of", "n", "key", total).drop("of"), "resolved")


def _members(software: str, date: str):
    """Records as gzip members of their own, less their last byte, a zero, which the row separator gives back."""

    def member(record: bytes) -> bytes:
        out = gzip.compress(record, mtime=0)
        return out[:-1] if out[-1] == 0 else out + gzip.compress(b"", mtime=0)[:-1]  # of over 16 MB: an empty member follows

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body = f"software: {software}{CRLF}format: WARC File Format 1.1{CRLF}"
        info = f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Date: {date}{CRLF}WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>{CRLF}Content-Type: application/warc-fields{CRLF}Content-Length: {len(body)}{END}{body}{END}"
        first = [member(info.encode())]
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                texts = whole.column(0).slice(start, 256).to_pylist()
                yield pa.RecordBatch.from_pydict({"member": pa.array(first + [member(t.encode("utf-8", "surrogatepass") + END.encode()) for t in texts], pa.binary())})
                first = []

    return apply


def _write(spark: SparkSession, records: DataFrame, path: str, date: str) -> None:
    """Spark's own committer writes the members' bytes as text rows; the files are then named as archives."""
    records.mapInArrow(_members("sparkloom", date), "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in files.listStatus(folder):
        name = f.getPath().getName()
        if name.startswith("part-") and not files.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.gz")):
            raise OSError(f"could not rename {name}")


def _common(key: Column, copy: Column) -> list[Column]:
    return [_line("WARC-Record-ID", _urn(key, copy)), _line("WARC-Page-ID", F.col("page_id")), _line("WARC-Target-URI", F.col("url")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]


def _responses(rows: DataFrame, date: str) -> DataFrame:
    """Records of (key, copy, page_id, url, digest, payload)."""
    block = F.concat(_http(F.octet_length("payload")), F.col("payload"))
    return rows.select(_record("response", date, block, _common(F.col("key"), F.col("copy"))).alias("value"))


def _revisits(resolved: DataFrame, date: str) -> DataFrame:
    """Records of all copies that are no response, as headers."""
    first = F.when(F.col("key") == F.col("first_key"), 2).otherwise(1)
    each = resolved.where(F.col("first_key").isNotNull() & (first <= F.col("copies"))).withColumn("copy", F.explode(F.sequence(first.cast("long"), F.col("copies"))))
    refers = [_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _urn(F.col("first_key"), F.lit(1))), _line("WARC-Refers-To-Page-ID", F.col("first_page")), _line("WARC-Refers-To-Target-URI", F.col("first_url")), _line("WARC-Refers-To-Date", F.lit(date))]
    return each.select(_record("revisit", date, _http(F.col("size")), _common(F.col("key"), F.col("copy")) + refers).alias("value"))


def write_archives(pages: DataFrame, path: str, min_payload: int = 0, date: str = "1970-01-01T00:00:00Z", payload_col: str = "html") -> None:
    """Write a WARC record for each row of (page_id, url, payload): responses once, revisits as headers.

    ``path`` becomes a folder of .warc.gz archives, each of a warcinfo record and others, every record a gzip member of its
    own, so that readers can seek.  They are written by Spark's own committer, so a lost task is simply run again, on any file
    system that Spark reaches.  Only headers are shuffled.  A null payload counts as empty; of rows that repeat, also
    those of the smallest page_id, one is the response and the others revisit it; a null page_id comes after all others.
    Record ids tell all records apart. Extra columns are ignored. An empty table gives archives without such records.
    """
    with scratch():
        rows = pages.select("page_id", "url", F.coalesce(F.col(payload_col), F.lit("")).alias("payload")).withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
        heads = saved(rows.select("page_id", "url", "digest", "size"), "heads")
        resolved = resolve(heads, min_payload)
        rows = rows.withColumn("key", _key(F.col("page_id"), F.col("url"), F.col("digest"), F.col("size"))).withColumn("copy", F.lit(1))
        other = saved(resolved.where("first_key <> key or copies > 1").select("key"), "other")  # not to be written as they are
        single = rows.join(F.broadcast(other) if other.count() <= MAX_BROADCAST_ROWS else other, "key", "left_anti")
        records = _responses(single, date).union(_revisits(resolved, date))
        twice = saved(resolved.where("copies > 1 and (first_key is null or first_key = key)").select("key", F.when(F.col("first_key").isNull(), F.col("copies")).otherwise(1).alias("times")), "twice")
        if not twice.isEmpty():  # rows that repeat: one of them is a response, or all of them if they are small
            one = rows.join(twice, "key").groupBy("key", "page_id", "url", "digest", "times").agg(F.max("payload").alias("payload"))
            records = records.union(_responses(one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))), date))
        _write(pages.sparkSession, records, path, date)


def _parsed(raw: bytes) -> dict | None:
    """A record's fields, None for other kinds of records; for responses digest and size are those of the payload itself."""
    head, _, block = raw.partition(END.encode())
    named = {}
    for line in head.decode("utf-8", "replace").split(CRLF)[1:]:
        name, _, value = line.partition(": ")
        named[name.lower()] = value
    inner, _, payload = block.partition(END.encode())
    kind = named.get("warc-type")
    if kind == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    elif kind == "revisit":
        sizes = [x.partition(b": ")[2] for x in inner.split(CRLF.encode()) if x.lower().startswith(b"content-length: ")]
        size, digest = int(sizes[0]) if sizes else None, named.get("warc-payload-digest", "").removeprefix("sha1:")
    else:
        return None
    number = lambda k: int(named[k]) if k in named else None
    return {"record_id": named.get("warc-record-id"), "page_id": number("warc-page-id"), "url": named.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to-page-id"), "payload": payload if kind == "response" else None}


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """Whole records from rows (file, bytes up to a blank line); a payload may hold blank lines itself."""
    end, file, buffer, need = END.encode(), None, bytearray(), None
    for batch in batches:
        for name, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != file:
                if bytes(buffer).strip():
                    raise ValueError(f"{file} ends inside a record")
                file, buffer, need = name, bytearray(), None
            buffer += chunk + end
            while True:
                if need is None:
                    at = buffer.find(end)
                    if at < 0:
                        break
                    head = bytes(buffer[:at])
                    if not head.strip():  # a last row without a separator was given one
                        break
                    if not head.startswith(b"WARC/"):
                        raise ValueError(f"{file}: no record where one must begin")
                    sizes = [x.partition(b":")[2] for x in head.split(CRLF.encode()) if x.lower().startswith(b"content-length:")]
                    need = at + len(end) + int(sizes[0])
                if len(buffer) < need + len(end):
                    break
                yield bytes(buffer[:need])
                del buffer[: need + len(end)]
                need = None
    if bytes(buffer).strip():
        raise ValueError(f"{file} ends inside a record")


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each response and revisit of a folder of archives; with ``payloads`` also the payload of responses.

    Archives are streamed: what is held at once is one record, not one file.  Records without a page id have a null one;
    an archive that ends inside a record is an error; a folder without records gives no rows.
    """
    chunks = spark.read.option("lineSep", END).text(path).select("_metadata.file_path", F.col("value").cast("binary").alias("value"))
    schema = RECORD + (", payload binary" if payloads else "")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"record_id": pa.string(), "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})
        rows: list[dict] = []
        held = 0
        for raw in _records(batches):
            if (found := _parsed(raw)) is None:
                continue
            rows.append(found)
            held += len(raw)
            if len(rows) >= 2000 or held > 16 << 20:
                yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})
                rows, held = [], 0
        yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})

    return chunks.mapInArrow(parse, schema)


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_payload: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Resolve the records of existing archives anew and write them with fresh headers.

    Heads of all records are shuffled by digest.  Of each digest one payload, that of the smallest record id among
    its responses, goes to the new original (to each record if payloads are small); none is copied to a revisit.  Records
    of a digest without any response, whose payload is elsewhere, go out as revisits as they came.
    """
    with scratch():
        records = read_archives(spark, source, payloads=True).withColumnRenamed("payload_digest", "digest").withColumnRenamed("payload_bytes", "size")
        heads = saved(records.drop("payload"), "heads")
        held = saved(heads.where("record_type = 'response'").groupBy("digest", "size").agg(F.min("record_id").alias("record_id")), "held")
        known = heads.join(held.select("digest", "size"), ["digest", "size"], "left_semi")
        resolved = resolve(known.select("page_id", "url", "digest", "size"), min_payload)
        news = resolved.where("first_key is null or first_key = key").withColumn("times", F.when(F.col("first_key").isNull(), F.col("copies")).otherwise(1))
        news = saved(news.join(held, ["digest", "size"]).select("record_id", "key", "page_id", "url", "digest", "times"), "news")
        payloads = records.where("record_type = 'response'").select("record_id", F.col("payload").cast("string").alias("payload"))
        written = payloads.join(F.broadcast(news) if news.count() <= MAX_BROADCAST_ROWS else news, "record_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        lost = heads.join(held.select("digest", "size"), ["digest", "size"], "left_anti").withColumnRenamed("refers_to", "first_page")
        lost = lost.select(F.col("record_id").alias("key"), "page_id", "url", "digest", "size", F.lit(1).cast("long").alias("copies"), F.concat(F.lit("page:"), F.coalesce(F.col("first_page").cast("string"), F.lit("-"))).alias("first_key"), "first_page", F.lit(None).cast("string").alias("first_url"))
        _write(spark, _responses(written, date).union(_revisits(resolved, date)).union(_revisits(lost, date)), target, date)
