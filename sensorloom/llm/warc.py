"""WARC archives: a writer of deduplicated records, and a reader that salvages what follows damage."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_VERSION_LINE = re.compile(rb"WARC/1\.\d\r\n")
#: An empty gzip member. Spark's text writer puts it between the rows, each of which is a whole member.
EMPTY_MEMBER = MAGIC + bytes(6) + b"\xff\x03" + bytes(9)
FILE_BYTES = 32 << 20
_FEED = 1 << 16
ID_PREFIX = "urn:record:"
RECORD_SCHEMA = (
    "path string, offset long, length long, reason string, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_bytes long, payload_digest string, payload binary, inner_offset long, inner_length long"
)


def digest_column(payload: Column) -> Column:
    """Upper-case base32 SHA-1: 160 bits are four times eight base32 digits, each eight from ten hex digits."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One uncompressed record.  A revisit has the HTTP header (with the full payload's length) but no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    head = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID_PREFIX}{record_id}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(uri, safe="".join(map(chr, range(33, 127)))))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 4) -> None:
    """Write one gzip member per row under ``path``, through Spark's own writer, so any file system Spark knows will do.

    A file holds about ``FILE_BYTES`` of members, or one larger member.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with the largest key are responses and the others revisits
    that refer to it; smaller payloads are all responses.  A null payload is empty, a null url is left out, a null key sorts lowest and is written as an empty id; repeated
    rows are all written.  Digests are grouped without payloads; the payload moves once, to meet its group, and a
    join whose hot group is one row on the other side can be split by Spark.
    """
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("_payload"))
    rows = rows.withColumn("_digest", digest_column(F.col("_payload")))
    groups = (
        rows.where(F.length("_payload") >= min_bytes).groupBy("_digest")
        .agg(F.max("_key").alias("_owner"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_digest").alias("_same"), "_owner")
    )
    met = rows.join(groups, (F.col("_digest") == F.col("_same")) & (F.length("_payload") >= min_bytes), "left").select(
        F.col("_key").cast("string").alias("_key"), "_url", "_payload", "_digest",
        F.when(F.col("_owner").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_owner")), F.col("_owner").cast("string")).alias("_refers"),
    )

    columns = met.columns

    def files(batches):
        held, size = [], 0
        for batch in batches:
            for name, uri, data, digest, refers in zip(*(batch[c].astype(object).where(batch[c].notna(), None) for c in columns), strict=True):
                made = gzip.compress(record_bytes("response" if refers is None else "revisit", name or "", uri, bytes(data), digest, refers, date), level, mtime=0)
                if held and size + len(made) > FILE_BYTES:
                    yield pd.DataFrame({"members": [b"".join(held)]})
                    held, size = [], 0
                held.append(made)
                size += len(made)
        if held:
            yield pd.DataFrame({"members": [b"".join(held)]})

    met.mapInPandas(files, "members binary").select(F.col("members").cast("string").alias("value")).write.option(
        "encoding", "ISO-8859-1"
    ).option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


class Damaged(ValueError):
    """A record or member fails a check."""


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], int, int, int]:
    """Checked header fields, start and end of the block, and end of the record at ``at``."""
    if not _VERSION_LINE.match(data, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("no end of header")
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Damaged("no length")
    start = end + 4
    stop = start + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("no end of record where the length says")
    block = fields.get("warc-block-digest", "")
    if block.startswith("sha1:") and base32_sha1(data[start:stop]) != block[5:]:
        raise Damaged("block digest")
    return fields, start, stop, stop + 4


def _row(data: bytes, fields: dict[str, str], start: int, stop: int, with_payload: bool) -> dict:
    kind, digest = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    http_end = data.find(b"\r\n\r\n", start, stop) if fields.get("content-type", "").startswith("application/http") else start - 4
    if http_end < 0:
        raise Damaged("no end of the HTTP header")
    payload = data[http_end + 4 : stop]
    size = len(payload)
    if kind == "revisit":
        told = re.search(rb"(?i)^content-length:[ \t]*(\d+)", data[start:http_end], re.M)
        size, payload = int(told[1]) if told else None, None
    else:
        found = base32_sha1(payload)
        if digest is not None and digest != found:
            raise Damaged("payload digest")
        digest = found
    plain = lambda name: v[1:-1].removeprefix(ID_PREFIX) if (v := fields.get(name)) else None
    return {
        "record_type": kind, "record_id": plain("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": plain("warc-refers-to"),
        "payload_bytes": size, "payload_digest": digest, "payload": payload if with_payload else None,
    }


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """Content and end of the gzip member at ``at``; if it is damaged, what it gave before the damage, and why it ended there.

    It is fed in small blocks, as what follows the member is copied.
    """
    tool, out, pos, why = zlib.decompressobj(31), [], at, None
    try:
        while not tool.eof and pos < len(data):
            out.append(tool.decompress(data[pos : pos + _FEED]))
            pos += _FEED
    except zlib.error:
        why = "gzip data"
        # the block in which the damage lies, in ever smaller steps
        tool, out, low, step = zlib.decompressobj(31), [], at, _FEED
        while step and low < len(data):
            before = tool.copy()
            try:
                out.append(tool.decompress(data[low : low + step]))
                low += step
            except zlib.error:
                tool, step = before, step // 2
    if why is None and not tool.eof:
        why = "gzip member is cut off"
    return b"".join(out), min(pos, len(data)) - len(tool.unused_data), why


def _verified(data: bytes, fields: dict[str, str], row: dict) -> bool:
    """Whether a digest stands for the record, as it must where nothing else does."""
    return fields.get("warc-block-digest", "").startswith("sha1:") or row["record_type"] != "revisit" and fields.get("warc-payload-digest", "").startswith("sha1:")


def _inside(data: bytes, with_payload: bool, whole: bool) -> Iterator[dict]:
    """Records of inflated bytes and the gaps between them, by the same search; of a damaged member only records with a digest."""
    at, gap, why = 0, None, None
    while at < len(data):
        try:
            fields, start, stop, end = parse_record(data, at)
            row = _row(data, fields, start, stop, with_payload)
            if not whole and not _verified(data, fields, row):
                raise Damaged("no digest in a damaged member")
        except Damaged as error:
            if gap is None:
                gap, why = at, str(error)
            found = data.find(VERSION, at + 1)
            at = found if found >= 0 else len(data)
            continue
        if gap is not None:
            yield {"inner_offset": gap, "inner_length": at - gap, "reason": why}
            gap = None
        yield {"inner_offset": at, "inner_length": end - at, **row}
        at = end
    if gap is not None:
        yield {"inner_offset": gap, "inner_length": len(data) - gap, "reason": why}


def salvage(data: bytes, with_payload: bool = True) -> Iterator[dict]:
    """Records of an archive in order, and a row with a ``reason`` for every run of bytes that belongs to none.

    Where a check fails, the search goes on at the next gzip magic or version line that starts a valid member or record.  The same search runs in
    the inflated bytes of a member: what lies around a bad record is kept, and ``inner_offset`` and ``inner_length`` say where in them a record or a gap is.  Of a member that
    does not inflate to its end, the records before the damage are kept if their digests agree; they have length 0, since the member's bytes are a gap.
    """
    at, gap, why = 0, None, None
    following = {MAGIC: -1, VERSION: -1}
    while at < len(data):
        rows, end, reason = [], at, None
        if data.startswith(MAGIC, at):
            inner, end, reason = _member(data, at)
            rows = list(_inside(inner, with_payload, reason is None))
            if inner and reason is None and all(r.get("reason") for r in rows):
                rows = [{"reason": rows[0]["reason"]}]  # a member without any record is one gap
        else:
            try:
                fields, start, stop, end = parse_record(data, at)
                rows = [_row(data, fields, start, stop, with_payload)]
            except Damaged as error:
                reason = str(error)
        if reason is not None:
            saved = [r for r in rows if not r.get("reason")]
            if saved and gap is not None and gap < at:
                yield {"offset": gap, "length": at - gap, "reason": why}
                gap = None
            for row in saved:
                yield {"offset": at, "length": 0, **row}
            if gap is None:
                gap, why = at, reason
            for mark in following:
                if following[mark] <= at:
                    following[mark] = p if (p := data.find(mark, at + 1)) >= 0 else len(data)
            at = min(following.values())
            continue
        if gap is not None:
            yield {"offset": gap, "length": at - gap, "reason": why}
            gap = None
        for row in rows:
            yield {"offset": at, "length": end - at, **row}
        at = end
    if gap is not None:
        yield {"offset": gap, "length": len(data) - gap, "reason": why}


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of ``RECORD_SCHEMA`` for all archives under ``path``, plain or gzip: records (``reason`` null) and quarantined gaps (with a reason).

    A file is one task's; Spark reads it whole, so archives should be of ordinary size (far below its 2 GB limit for a value; the writer keeps to ``FILE_BYTES``).
    """
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                held, size = [], 0
                for row in salvage(bytes(content), with_payload):
                    held.append({"path": name, **row})
                    size += len(row.get("payload") or b"") + 512
                    if size > 8 << 20:
                        yield _frame(held, names)
                        held, size = [], 0
                yield _frame(held, names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RECORD_SCHEMA)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame({n: [r.get(n) for r in rows] for n in names}, dtype=object)
    for n in ("offset", "length", "payload_bytes", "inner_offset", "inner_length"):
        frame[n] = frame[n].astype("Int64")
    return frame
