"""Legacy archives: ARC records parsed and converted to WARC records, WARC files written and read.

``parse_arc`` walks an ARC file by its header lines and declared lengths.  The file's
first record names the version and the fields of the lines to come (version 1: url, ip,
date, type, length; version 2 adds result code, checksum, location, offset and file
name), and lines are cut from their right end, so that a url may hold blanks.  A body is
taken by its declared length alone; where the next line does not follow it, the
record is marked and the walk goes on at the next line that parses.

``converted`` synthesises what WARC needs: a record id (a UUID of version 5 over the
header line and the body's digest, so that reruns agree), an ISO date, the type, and
SHA-1 digests in base32.  Of records with equal payloads of enough bytes one is kept as
response, and the others become revisits of it; the choice shuffles digests and keys,
never payloads, unless there are more revisits than ``BROADCAST_REVISITS``.

Files are written by Spark's text writer, whose line end is set to the blank lines that
close a WARC record, compressed, into the folder given; rows are dealt so that a file
holds about ``FILE_BYTES``.  ``read_warc`` reads whole files of that size and walks them by
``Content-Length``.

Defined results: a null payload is empty; a null url is ``-`` in the ARC line and left
out of the WARC record; blanks and line ends in a url are percent-encoded on writing; a
null key ranks last among equal payloads; rows that repeat both key and payload are all
of the same type; lines that are no header are skipped; a body that ends early, does not
end where its length says, or is not UTF-8 (it is written as text) has a ``problem``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkaudit.llm.common import fits

# Fixed values of the two formats.
V1_FIELDS = ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"]
V2_FIELDS = [
    "URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
    "Filename", "Archive-length",
]
CLOSE = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # that of urls, by RFC 4122

BROADCAST_REVISITS = 500_000
FILE_BYTES = 32 << 20
#: Bytes of ARC text made or read at once inside a task.
SEGMENT = 4 << 20
DATE = "20240101000000"

ARC_RECORD = re.compile(rb"^(\d{14})$")


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe_url(url: str | None) -> str:
    if not url:
        return "-"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def arc_head(version: int) -> bytes:
    """The version block that opens an ARC file."""
    fields = V1_FIELDS if version == 1 else V2_FIELDS
    body = f"{version} 0 sparkaudit\n{' '.join(fields)}\n".encode()
    line = ["filedesc://made.arc", "0.0.0.0", DATE, "text/plain"]
    line += [] if version == 1 else ["200", "-", "-", "0", "made.arc"]
    return " ".join([*line, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_record(url: str | None, block: bytes, version: int = 1, date: str = DATE, kind: str = "text/html") -> bytes:
    line = [safe_url(url), "0.0.0.0", date, kind]
    line += [] if version == 1 else ["200", "-", "-", "0", "made.arc"]
    return " ".join([*line, str(len(block))]).encode() + b"\n" + block + b"\n"


def http_block(payload: bytes, more: dict[str, str]) -> bytes:
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", *(f"{k}: {v}" for k, v in more.items())]
    return "\r\n".join([*head, f"Content-Length: {len(payload)}"]).encode() + b"\r\n\r\n" + payload


def header_line(line: bytes, n_fields: int) -> list[bytes] | None:
    """The fields of an ARC header line, cut from its right end; None if it is none."""
    fields = line.rsplit(b" ", n_fields - 1)
    good = len(fields) == n_fields and fields[-1].isdigit() and ARC_RECORD.match(fields[2])
    return fields if good else None


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one ARC file: line, url, date, kind, block and problem (None if sound)."""
    at, n_fields = 0, len(V1_FIELDS)
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end]
        counts = (n_fields, len(V1_FIELDS), len(V2_FIELDS))
        fields = next((f for n in counts if (f := header_line(line, n))), None)
        if fields is None:
            at = end + 1  # the line end after a body, or something that is no header
            continue
        length = int(fields[-1])
        block, problem = data[end + 1 : end + 1 + length], None
        if len(block) < length:
            problem = "cut short"
        elif data[end + 1 + length : end + 2 + length] not in (b"\n", b""):
            problem = "declared length does not end at a record's end"
        if fields[0].startswith(b"filedesc:"):
            names = block.split(b"\n")[1:2]
            n_fields = len(names[0].split()) if names and names[0].strip() else n_fields
        else:
            yield {
                "line": line, "url": fields[0].decode("utf-8", "replace"), "date": fields[2].decode(),
                "kind": fields[3].decode("utf-8", "replace"), "block": block, "problem": problem,
            }
        at = end + 1 + length


def iso_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def long_of(key: str | None) -> int | None:
    """A key's number, if it is one that a long holds."""
    if not key or not re.fullmatch(r"-?[0-9]{1,19}", key):
        return None
    number = int(key)
    return number if -(1 << 63) <= number < 1 << 63 else None


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its closing blank line) and payload of an HTTP response; without a head all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    for blank in (b"\r\n\r\n", b"\n\n"):
        head, sep, payload = block.partition(blank)
        if sep:
            return head + sep, payload
    return block, b""


def header_of(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


RECORD = "key long, record_id string, date string, url string, digest string, head string, payload string, problem string"
RECORD_KIND = pa.schema(
    [("key", pa.int64()), *((c, pa.string()) for c in ("record_id", "date", "url", "digest", "head", "payload", "problem"))]
)
KEY = "X-Archive-Key"


def arc_records(files: DataFrame, content: str = "content") -> DataFrame:
    """Records of ARC files (one binary column): what a WARC record of each needs, bodies as UTF-8 text.

    The key is the number in the ``X-Archive-Key`` header of the body, null where there is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                rows: list[dict] = []
                size = 0
                for r in parse_arc(file.as_py() or b""):
                    head, payload = http_parts(r["block"])
                    key = header_of(head, KEY)
                    name = r["line"].decode("utf-8", "replace") + " " + sha1(r["block"])
                    text = payload.decode("utf-8", "replace")
                    problem = r["problem"] or ("body is not UTF-8" if "\ufffd" in text and text.encode() != payload else None)
                    rows.append({
                        "key": long_of(key),
                        "record_id": f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>", "date": iso_date(r["date"]),
                        "url": None if r["url"] == "-" else r["url"], "digest": sha1(payload),
                        "head": head.decode("utf-8", "replace"), "payload": text, "problem": problem,
                    })
                    size += len(payload)
                    if size > SEGMENT:
                        yield pa.RecordBatch.from_pylist(rows, RECORD_KIND)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD_KIND)

    return files.select(content).mapInArrow(run, RECORD)


def arc_files(pages: DataFrame, key: str, url: str, payload: str, version: int = 1) -> DataFrame:
    """Rows as ARC files of about ``SEGMENT`` bytes, one binary column ``content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [arc_head(version)], 0
        for batch in batches:
            for k, u, p in zip(*(batch.column(i) for i in range(3))):
                body = (p.as_py() or "").encode()
                more = {} if k.as_py() is None else {KEY: str(k.as_py())}
                made.append(arc_record(u.as_py(), http_block(body, more), version))
                size += len(body)
                if size > SEGMENT:
                    yield pa.record_batch([pa.array([b"".join(made)], pa.binary())], ["content"])
                    made, size = [arc_head(version)], 0
        if len(made) > 1:
            yield pa.record_batch([pa.array([b"".join(made)], pa.binary())], ["content"])

    return pages.select(F.col(key).cast("long"), url, payload).mapInArrow(run, "content binary")


def with_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records with refers_to and refers_to_key: null for responses, the kept record of equal payload for revisits."""
    size = F.octet_length("payload")
    rank = F.struct(F.col("key").isNull().alias("none"), "key", "record_id")
    first = (
        records.filter(size >= least_bytes)
        .groupBy("digest")
        .agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select("digest", F.col("first.record_id").alias("_to"), F.col("first.key").alias("_to_key"))
    )
    if fits(first, BROADCAST_REVISITS):
        first = F.broadcast(first)
    other = (size >= least_bytes) & ~F.col("key").eqNullSafe(F.col("_to_key")) & F.col("_to").isNotNull()
    joined = records.join(first, "digest", "left")
    return joined.withColumn("refers_to", F.when(other, F.col("_to"))).drop("_to", "_to_key")


def warc_text() -> Column:
    """A record as WARC text without its closing blank lines; responses hold the payload, revisits only the head."""
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
        block,
    )


def write_warc(records: DataFrame, folder: str, bytes_in_all: int) -> None:
    """Write records as compressed WARC files of about ``FILE_BYTES``."""
    files = max(1, -(-bytes_in_all // FILE_BYTES))
    dealt = records.repartition(files, "record_id").select(warc_text().alias("value"))
    dealt.write.option("lineSep", CLOSE).option("compression", "gzip").text(folder)


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of one WARC file: headers (lower-case names) and block."""
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        if at < 0:
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        length = int(headers.get("content-length", "0"))
        yield {"headers": headers, "block": data[end + 4 : end + 4 + length]}
        at = end + 4 + length


READ = (
    "key long, record_id string, record_type string, url string, date string, payload_digest string, "
    "payload_bytes long, refers_to string, payload string"
)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the WARC files of a folder, digests checked against payloads that are there.

    ``payload_bytes`` is that of the full payload: counted in a response, from the kept
    HTTP head in a revisit.  A response whose payload does not give its digest has a
    null ``payload_digest``.
    """
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    kind = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in READ.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                raw = file.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                rows, size = [], 0
                for r in parse_warc(raw):
                    h = r["headers"]
                    head, payload = http_parts(r["block"])
                    response = h.get("warc-type") == "response"
                    digest = (h.get("warc-payload-digest") or "").removeprefix("sha1:")
                    if response and sha1(payload) != digest:
                        digest = None
                    key, length = header_of(head, KEY), header_of(head, "Content-Length")
                    values = [
                        long_of(key) if key else None, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"),
                        h.get("warc-date"), digest, len(payload) if response else int(length or 0),
                        h.get("warc-refers-to"), payload.decode("utf-8", "replace") if payloads and response else None,
                    ]
                    rows.append(dict(zip(names, values)))
                    size += len(payload)
                    if size > SEGMENT:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(run, READ)


def converted(pages: DataFrame, folder: str, key: str, url: str, payload: str, least_bytes: int = 0, version: int = 1) -> None:
    """Pages as ARC records, converted to WARC records with revisits, written to a folder."""
    narrow = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload"))
    records = with_revisits(arc_records(arc_files(narrow, "key", "url", "payload", version)), least_bytes)
    size = narrow.agg(F.sum(F.octet_length("payload") + 800)).first()[0] or 0
    write_warc(records, folder, size)
