"""WARC archives: written with segments, and reassembled.

Each page's payload is framed in chunks inside an HTTP response, and a response longer than a segment continues in
further records: DataFrame work. Each record is a gzip member of its own, and Spark's text writer puts members one after
another, so no worker opens a file (its separator can't be empty; it is a gzip member without content, which readers
pass over). A file has so many records that it can't hold more than FILE_BYTES of them, whatever the pages. Readers
inflate a file piece by piece and hold one record at a time. Of records with equal payloads of at least `least_bytes` bytes, the
one of the smallest page is a response and the others are revisits of it.

Reading groups continuation records by the identifier of the record they continue, orders them by segment number,
verifies numbers and total length, takes off the chunked framing and checks the payload's digest. A group with a
missing segment, a wrong length, broken framing or another digest comes back with ok = false and a null payload.

A null payload is an empty one; a null url leaves its header out; control characters in a url are escaped. A row that
is repeated m times is written m times and comes back m times. A null page id can't be referred to: such rows are
revisits of the smallest id with their payload, or responses if there is none. Equal payloads that share the smallest
id are all responses. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEGMENT = 64 * 1024
CHUNK = 8 * 1024
#: Bytes of segments in one file, at most.
FILE_BYTES = 128 << 20
_END = "\r\n\r\n"
#: A gzip member without content: header, an empty block, checksum and length of nothing.
_EMPTY = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: each five hex digits are four digits to the base 32."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(data), i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _identifier(page: Column, url: Column, digest: Column) -> Column:
    """A record's name, the same each time that the record is written."""
    h = F.md5(F.to_json(F.struct(page.alias("p"), url.alias("u"), digest.alias("d"))))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """One row for each WARC record, its text in `record` without the empty line that ends it."""
    base = pages.select(
        F.col(key).cast("long").alias("page"), F.regexp_replace(F.col(url), r"[\x00-\x20\x7F]", "%20").alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload")
    ).withColumns({"digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload")})
    firsts = (
        base.where(F.col("page").isNotNull() & (F.col("bytes") >= least_bytes))
        .groupBy("digest")
        .agg(F.min(F.struct("page", F.coalesce("url", F.lit("")).alias("order"), "url")).alias("first"), F.count("*").alias("n"))
    )
    if base.where(F.col("page").isNull()).isEmpty():
        firsts = firsts.where("n > 1")  # a payload of one row has nothing to revisit
    both = base.join(firsts.drop("n"), "digest", "left")
    response = F.col("first").isNull() | (F.col("bytes") < least_bytes) | F.coalesce(F.col("first.page") == F.col("page"), F.lit(False))
    shared = F.concat(
        F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page").cast("string"), F.lit("\r\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.col("url"), F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nContent-Type: application/http;msgtype=response\r\n"),
    )
    framed = F.expr(f"""concat(array_join(transform(if(bytes = 0, cast(array() as array<int>), sequence(0, cast((bytes - 1) div {chunk} as int))),
        i -> concat(lower(hex(least({chunk}, bytes - i * {chunk}))), '\r\n', cast(substring(payload, i * {chunk} + 1, {chunk}) as string), '\r\n')), ''), '0\r\n\r\n')""")
    whole = both.select(
        "page", response.alias("response"), _identifier(F.col("page"), F.col("url"), F.col("digest")).alias("id"), shared.alias("shared"),
        F.when(~response, _identifier(F.col("first.page"), F.col("first.url"), F.col("digest"))).alias("refers"),
        F.when(response, F.concat(F.lit(_HTTP), framed)).otherwise(F.lit(_HTTP)).cast("binary").alias("block"),
    )
    length = F.octet_length("block")
    parts = F.ceil(length / segment).cast("int")
    cut = whole.withColumns({"total": length, "parts": parts}).withColumn("number", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    part = F.expr(f"substring(block, (number - 1) * {segment} + 1, {segment})")
    head = F.when(
        F.col("number") == 1,
        F.concat(
            F.lit("WARC-Type: "), F.when(F.col("response"), "response").otherwise("revisit"), F.lit("\r\nWARC-Record-ID: "), F.col("id"), F.lit("\r\n"), F.col("shared"),
            F.coalesce(F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), F.col("refers"), F.lit("\r\n")), F.lit("")),
            F.when(F.col("parts") > 1, F.lit("WARC-Segment-Number: 1\r\n")).otherwise(F.lit("")),
        ),
    ).otherwise(
        F.concat(
            F.lit("WARC-Type: continuation\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Record-ID: "), _identifier(F.col("number"), F.col("id"), F.lit("")), F.lit("\r\nWARC-Segment-Origin-ID: "), F.col("id"),
            F.lit("\r\nWARC-Segment-Number: "), F.col("number").cast("string"), F.lit("\r\n"),
            F.when(F.col("number") == F.col("parts"), F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("total").cast("string"), F.lit("\r\n"))).otherwise(F.lit("")),
        )
    )
    return cut.select(F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("Content-Length: "), F.octet_length(part).cast("string"), F.lit("\r\n\r\n"), part.cast("string")).alias("record"))


def write(pages: DataFrame, path: str, **options) -> str:
    """Writes archives into a folder."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.settle(batches):
            packed = [gzip.compress(v.as_py(), mtime=0) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, type=pa.binary())], names=["member"])

    most = max(1, FILE_BYTES // options.get("segment", SEGMENT))
    common.text_batches(pages.sparkSession)
    packed = records(pages, **options).select(F.concat("record", F.lit(_END)).cast("binary").alias("record")).mapInArrow(members, "member binary")
    separator = _EMPTY.decode("latin-1")
    packed.select(F.col("member").cast("string")).write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", most).text(path)
    return path


def inflate(data: bytes, piece: int = 1 << 16) -> Iterator[bytes]:
    """The content of a gzip file piece by piece, one member after another."""
    whole, at, d = memoryview(data), 0, zlib.decompressobj(31)
    while at < len(whole):
        some = whole[at : at + piece]
        out = d.decompress(some)
        at += len(some) - len(d.unused_data)
        if out:
            yield out
        if d.eof:
            d = zlib.decompressobj(31)
        elif at == len(whole):
            raise ValueError("a gzip member is cut short")


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive that comes in pieces: headers by lower-case name, and the block."""
    source, held = iter(pieces), bytearray()

    def reach(n: int) -> bool:
        while len(held) < n and (more := next(source, None)) is not None:
            held.extend(more)
        return len(held) >= n

    while reach(1):
        seen = 0
        while (stop := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not reach(seen + 1):
                raise ValueError("a record is cut short")
        first, *lines = held[:stop].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no record where one should begin")
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        end = stop + 4 + int(headers["content-length"])
        if not reach(end):
            raise ValueError("a record is cut short")
        yield headers, bytes(held[stop + 4 : end])
        reach(end + 4)
        del held[: end + 4]


def dechunk(body: bytes) -> bytes | None:
    """The bytes inside chunked framing; None if it is broken."""
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        try:
            size = int(body[at:stop].split(b";")[0], 16) if stop >= 0 else -1
        except ValueError:
            return None
        if size < 0 or len(body) < stop + 2 + size:
            return None
        if not size:
            return b"".join(out)
        out.append(body[stop + 2 : stop + 2 + size])
        if body[stop + 2 + size : stop + 4 + size] != b"\r\n":
            return None
        at = stop + 4 + size


def payload_of(block: bytes, digest: str) -> bytes | None:
    """The payload of an HTTP response; None if its framing is broken or its digest is another."""
    stop = block.find(b"\r\n\r\n")
    if stop < 0:
        return None
    chunked = b"transfer-encoding: chunked" in block[:stop].lower()
    payload = dechunk(block[stop + 4 :]) if chunked else block[stop + 4 :]
    good = payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
    return payload if good else None


_FIELDS = [("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("ok", pa.bool_()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
_WHOLE = "record_id string, record_type string, page_id long, url string, payload_digest string, refers_to_id string, ok boolean, payload_bytes long, payload binary"
_SEGMENT = [("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())]


def _row(h: dict[str, str], block: bytes | None, payloads: bool) -> dict:
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
    out = {"record_id": h["warc-record-id"], "record_type": h["warc-type"], "page_id": int(h["x-page-id"]) if "x-page-id" in h else None, "url": h.get("warc-target-uri"), "payload_digest": digest, "refers_to_id": h.get("warc-refers-to"), "ok": True, "payload_bytes": None, "payload": None}
    if h["warc-type"] != "revisit":
        payload = payload_of(block, digest) if block is not None else None
        out |= {"ok": payload is not None, "payload_bytes": None if payload is None else len(payload), "payload": payload if payloads else None}
    return out


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each response and revisit of the archives in a folder, with its segments put together."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema(_FIELDS + _SEGMENT)
        for batch in batches:
            for value in batch.column(0):
                found, held = [], 0
                for h, block in parse(inflate(value.as_py())):
                    if "warc-segment-number" in h:
                        number = int(h["warc-segment-number"])
                        row = {"origin": h.get("warc-segment-origin-id", h["warc-record-id"]), "number": number, "total": int(h.get("warc-segment-total-length", 0)) or None, "block": block}
                        found.append((_row(h, None, False) if number == 1 else dict.fromkeys((k for k, _ in _FIELDS))) | row)
                    else:
                        found.append(_row(h, block, payloads) | dict.fromkeys(k for k, _ in _SEGMENT))
                    held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(found, schema=fields)
                        found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=fields)

    def together(group: pa.Table) -> pa.Table:
        """The segments of one record: its length bounds the group."""
        seen: dict[int, list] = {}
        for row in group.to_pylist():
            seen.setdefault(row["number"], []).append(row)
        last = max(seen)
        first = seen.get(1, [None])[0]
        copies = len(seen.get(1, [0]))
        blocks = [seen[i][0]["block"] for i in range(1, last + 1) if i in seen]
        whole = b"".join(blocks)
        if first is None:
            row = dict.fromkeys(k for k, _ in _FIELDS) | {"record_id": group["origin"][0].as_py(), "ok": False}
        else:
            good = len(blocks) == last and seen[last][0]["total"] == len(whole)
            payload = payload_of(whole, first["payload_digest"]) if good else None
            row = {k: first[k] for k, _ in _FIELDS} | {"ok": payload is not None, "payload_bytes": None if payload is None else len(payload), "payload": payload if payloads else None}
        return pa.Table.from_pylist([row] * copies, schema=pa.schema(_FIELDS))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,txt}").load(path).select("content")
    parsed = common.materialize(files.mapInArrow(rows, f"{_WHOLE}, origin string, number int, total long, block binary"), "warc")
    names = [k for k, _ in _FIELDS]
    whole = parsed.where(F.col("origin").isNull()).select(names)
    segments = parsed.where(F.col("origin").isNotNull())
    return whole.unionByName(segments.groupBy("origin").applyInArrow(together, _WHOLE))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes pages, reads the archives back, and tells of each record what it holds."""
    spark = pages.sparkSession
    path = write(pages, common.own_folder(spark, "archives"), **options)
    back = read(spark, path, payloads=False)
    # A response's name is unique but for rows that are equal, so this join keeps one row for each record.
    targets = back.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("__bytes"))
    return back.join(targets, "refers_to_id", "left").select(
        "page_id", F.coalesce("payload_bytes", "__bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url", "ok", "record_id"
    )
