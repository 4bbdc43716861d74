"""Legacy archive converter: ARC files to WARC, and readers and writers of both.

Files are written and read by Spark's text source, so they may lie in any store Spark reaches: a
record is one row, the row separator closes it, and gzip keeps a file in one task; plain files, which
Spark may split, are put together again by a shuffle. Readers put the rows of a file together and go
by declared lengths, so payloads may hold any bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import forget, join_hot, materialise, small, small_batches

# The fields of a url record by the version of its file.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "result", "checksum", "location", "offset", "filename", "length"),
}
NAMES = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ORDER = "X-Record-Order"
RECORD = "locator string, kind string, url string, ip string, date string, mime string, order long, payload_bytes long, payload_digest string, content binary"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(date: str) -> str:
    """A 14 or 12 digit ARC date in WARC's form; digits that lack count as the least."""
    d = re.sub(r"\D", "", date)[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """Head, with the blank line that ends it, and payload of an HTTP message."""
    ends = [i + len(m) for m in (b"\r\n\r\n", b"\n\n") if (i := content.find(m)) >= 0]
    at = min(ends, default=len(content))
    return content[:at], content[at:]


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb"[ \t]*:[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def as_long(digits: str) -> int | None:
    """A number written in digits, if a long can hold it."""
    n = int(digits) if re.fullmatch(r"-?[0-9]{1,19}", digits) else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def arc_records(rows: Iterator[tuple[str, bytes]]) -> Iterator[dict]:
    """Records of ARC files given as (file, line): the version block says which fields a header line
    has; a header's last field is the length of what follows. Lines that are no header between
    records are passed over; a record cut short by the file's end is dropped."""
    file, version, n, head, body, size = None, 1, 0, None, [], 0
    for name, line in rows:
        if name != file:
            file, version, n, head = name, 1, 0, None
        if head is None:
            parts = line.rstrip(b"\r").decode("utf-8", "replace").split(" ")
            fields = FIELDS[version]
            if parts[0].startswith("filedesc:"):
                fields = FIELDS[2] if len(parts) >= len(FIELDS[2]) else FIELDS[1]
            if len(parts) < len(fields) or not parts[-1].isdigit():
                continue
            # blanks inside a url: the fields after it are counted from the right
            extra = len(parts) - len(fields)
            head = dict(zip(fields, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]], strict=True))
            body, size = [], -1
            continue
        body.append(line)
        size += len(line) + 1
        if size >= int(head["length"]):
            data = b"\n".join(body)[: int(head["length"])]
            if head["url"].startswith("filedesc:") and not data.startswith(b"HTTP/"):
                version = 2 if data[:1] == b"2" else 1
            yield head | {"locator": f"{file}#{n:09d}", "content": data}
            n, head = n + 1, None


def as_warc(record: dict) -> dict:
    """What the WARC record of an ARC record has: kind, date, order and payload digest."""
    url, content = record["url"], record["content"]
    if content.startswith(b"HTTP/"):  # whatever its url
        kind = "response"
        head, payload = http_parts(content)
    elif url.startswith("filedesc:"):
        kind, payload, head = "warcinfo", content, b""
    else:
        kind, payload, head = "resource", content, b""
    order = http_field(head, ORDER) or ""
    return {
        "locator": record["locator"], "kind": kind, "url": url, "ip": record["ip"], "date": iso_date(record["date"]), "mime": record["mime"],
        "order": as_long(order), "payload_bytes": len(payload), "payload_digest": digest(payload), "content": content,
    }


def warc_bytes(r: dict) -> bytes:
    """A WARC record but for its last line end. Identifiers are name-based, so a second run of a
    lost task writes the same bytes."""
    first = r.get("first_url") is not None
    block = http_parts(r["content"])[0] if first else r["content"]
    named = lambda url, date, locator: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}|{date}|{locator.rpartition("/")[2]}')}>"
    kinds = {"response": "application/http; msgtype=response", "warcinfo": "application/warc-fields"}
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if first else r['kind']}", f"WARC-Record-ID: {named(r['url'], r['date'], r['locator'])}", f"WARC-Date: {r['date']}",
        *([f"WARC-Filename: {r['url'].removeprefix('filedesc://')}"] if r["kind"] == "warcinfo" else [f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha1:{r['payload_digest']}"]),
    ]
    if first:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {named(r['first_url'], r['first_date'], r['first_locator'])}", f"WARC-Refers-To-Target-URI: {r['first_url']}", f"WARC-Refers-To-Date: {r['first_date']}"]
        if r["first_order"] is not None:
            lines.append(f"X-Refers-To-Order: {r['first_order']}")
    lines += [f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Type: {kinds.get(r['kind'], r['mime'])}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n"


def warc_records(rows: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-case name, and block of the records of files given as (file, row)."""
    file, head, body, size = None, None, [], 0
    fields: dict[str, str] = {}
    for name, line in rows:
        if name != file:
            file, head, fields = name, None, {}
        if head == "block":
            body.append(line)
            size += len(line) + 2
            need = int(fields.get("content-length", "0"))
            if size >= need:
                yield fields, b"\r\n".join(body)[:need]
                head, fields = None, {}
        elif head is None:
            head = "fields" if line.startswith(b"WARC/") else None
        elif not line:
            head, body, size = "block", [], -2
        else:
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()


#: Ends of the names of compressed files, which Spark reads in one task each.
WHOLE = (".gz", ".deflate", ".lz4", ".snappy", ".zst")


def _read(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """The rows of files, each file's in order and in one task. Plain files, which Spark may split, are
    put together again by a shuffle, sorted (and spilled) by place."""
    small_batches(spark)
    rows = spark.read.option("lineSep", separator).text(path)
    cols = [F.input_file_name().alias("file"), F.col("value").cast("binary").alias("value")]
    if all(f.endswith(WHOLE) for f in rows.inputFiles()):
        return rows.select(*cols)
    rows = rows.select(*cols, F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("n"))
    return rows.repartition("file").sortWithinPartitions("file", "start", "n").select("file", "value")


def _write(df: DataFrame, path: str, separator: str) -> None:
    out = df.select(F.col("record").cast("string").alias("value")).write.option("lineSep", separator)
    out.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _batched(rows: Iterator[dict], names: list[str], types: list[pa.DataType], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some megabytes of content, so long records do not pile up."""
    part: list[dict] = []
    size = 0
    for r in rows:
        part.append(r)
        size += len(r.get("content") or r.get("record") or b"") + 200
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in part], t) for n, t in zip(names, types, strict=True)], names)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in part], t) for n, t in zip(names, types, strict=True)], names)


def write_arc(pages: DataFrame, path: str, version: int, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "19960101000000") -> None:
    """Legacy files of a crawl: a version block, then a url record a page with its HTTP response.
    A null url becomes a urn of the id; blanks and control characters in urls are escaped; null
    html is an empty payload. Rows that repeat give a record each; an empty table gives files with a
    version block at most; other columns play no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[dict]:
            told = f"{version} 0 textloom\n{NAMES[version]}\n".encode()
            yield {"record": line("filedesc://pages.arc", "text/plain", told)}
            for b in batches:
                for i, url, html in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                    body = html or b""
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + (f"{ORDER}: {i}\r\n".encode() if i is not None else b"") + f"Content-Length: {len(body)}\r\n\r\n".encode()
                    name = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url if url else f"urn:page:{i}")
                    yield {"record": line(name, "text/html", head + body)}

        def line(url: str, mime: str, content: bytes) -> bytes:
            middle = f"200 - - 0 pages.arc {len(content)}" if version == 2 else f"{len(content)}"
            return f"{url} 0.0.0.0 {date} {mime} {middle}\n".encode() + content

        yield from _batched(records(), ["record"], [pa.binary()])

    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long"), url_col, F.encode(F.col(html_col), "UTF-8"))
    _write(rows.mapInArrow(run, "record binary"), path, "\n")


def read_arc(spark: SparkSession, path: str, with_content: bool = True) -> DataFrame:
    """Records of ARC files of either version, converted in meaning (see RECORD). With or without
    their content, which the digests cover in any case. A record without an order has a null one;
    empty contents are records; records that repeat are read as often as they come; lines between
    records, and a record that the file's end cuts short, are passed over; files without records
    give no rows."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]
    n = None if with_content else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(map(as_warc, arc_records(_rows(batches))), names[:n], types[:n])

    return _read(spark, path, "\n").mapInArrow(run, RECORD if with_content else RECORD.rpartition(",")[0])


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> None:
    """Write the records of ARC files as WARC. Of responses with equal payloads of at least
    ``least`` bytes, that of the smallest order (then place) stays a response; the others become
    revisits that refer to it. Records without an order come last, ties go by place. Digests are
    grouped and joined without contents, those of very many records apart; contents move only if
    the list of revisits is too large to be broadcast. Records of other kinds, empty payloads and
    repeated records are converted like any; archives without records give archives without any."""
    paths: list[str] = []
    meta = materialise(read_arc(spark, arc_path, with_content=False).where(F.col("kind") == "response").where(F.col("payload_bytes") >= least).select("locator", "url", "date", "order", "payload_digest"), paths)
    place = F.struct(F.col("order").isNull().alias("last"), F.col("order").alias("at"), "locator", "url", "date", "order")
    first = meta.groupBy("payload_digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialise(first, paths)
    told = F.octet_length("first.locator") + F.octet_length("first.url") + 200
    size, total = first.agg(F.sum(told), F.sum("n")).first()
    again = join_hot(meta, first, "payload_digest", "n", total or 0, size or 0).where("locator <> first.locator")
    again = again.select("locator", F.col("first.locator").alias("first_locator"), F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date"), F.col("first.order").alias("first_order"))
    again = materialise(again, paths)
    size = again.agg(F.sum(F.octet_length("locator") + F.octet_length("first_locator") + F.octet_length("first_url") + 100)).first()[0]
    joined = read_arc(spark, arc_path).join(small(again, size or 0), "locator", "left")
    names = joined.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(names, r, strict=True)) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _batched(({"record": warc_bytes(r)} for r in rows), ["record"], [pa.binary()])

    _write(joined.mapInArrow(run, "record binary"), warc_path, "\r\n")
    forget(spark, *paths)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, record_id, url, date, order, payload_bytes, payload_digest, refers_to, refers_to_order)``
    of every record. A response's length and digest are taken from its payload, a revisit's from
    its headers. Records that repeat are told each; what a record does not say is null; archives
    without records give no rows."""

    def told(fields: dict[str, str], block: bytes) -> dict:
        kind = fields.get("warc-type", "")
        head, payload = http_parts(block) if kind in ("response", "revisit") else (b"", block)
        order, refers = http_field(head, ORDER), fields.get("x-refers-to-order")
        size, name = len(payload), ""
        if kind == "revisit":
            size, name = int(http_field(head, "Content-Length") or 0), fields.get("warc-payload-digest", "").removeprefix("sha1:")
        return {
            "kind": kind, "record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "order": as_long(order or ""),
            "payload_bytes": size, "payload_digest": name or digest(payload), "refers_to": fields.get("warc-refers-to"), "refers_to_order": int(refers) if refers else None,
        }

    names = ["kind", "record_id", "url", "date", "order", "payload_bytes", "payload_digest", "refers_to", "refers_to_order"]
    types = [pa.string()] * 4 + [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((told(f, b) for f, b in warc_records(_rows(batches))), names, types)

    return _read(spark, path, "\r\n").mapInArrow(run, "kind string, record_id string, url string, date string, order long, payload_bytes long, payload_digest string, refers_to string, refers_to_order long")
