"""WARC archives of pages: written with revisit records, read back by a reader that salvages damaged files.

Equal payloads are found by their digests alone; page bodies move once, by page id, so a payload that a third
of all pages share is no group anywhere. An archive is one row of bounded size whose bytes are a
complete .warc.gz file (or plain .warc); the rows are written as a table in the shared folder. Files
from elsewhere come in through Spark's binaryFile source, which has the same columns.

The reader checks each record: the member's checksum, the version line, the type, the lengths, the digests of block,
payload and header, the page id against the record id. Records written here close their header with a digest of it
(`X-Header-Digest`); one that has a page id must have it, and so must one of ours in a member whose checksum fails. Archives
from elsewhere have none, so of their revisits `revisits_at_odds` tells those whose digest is not that of the response
they refer to. Where a check fails the reader looks for the next gzip member or version line that starts a valid record, goes on
there, and logs the bytes in between as a quarantined gap. Inside a member it looks in the plain bytes, and a damaged member of several
records gives those that inflate before its fault; `inner_start` and `inner_end` are places in a member's plain bytes.
Where a member was due and its gzip header doesn't read, what follows a header of the usual length is tried.

Every candidate start is looked at once and no step copies what is left of the file. A gzip header may hold a name and a
comment of up to MOST_NAME bytes; more is damage. A candidate inside bytes that a failed member was read to has to begin with a
version line, so no byte is inflated again and again for starts that are none. Beyond that only headers that claim a
block which is there, ends as one, and has another digest cost its length.

The query damages its archives on purpose: each begins with a spoiled copy of its first record, and further on
come stray bytes and torn copies, one of them to each SPOILED records. So its rows come out of the salvage reader,
whose gaps are logged in the table that is written with them.

Cases: null html is an empty payload; a null url leaves the target out; pages of equal id and payload are
records of one type; a null page id stays null and is never referred to; an empty table gives an
empty table; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pages, rows_of, settled

ARCHIVE_BYTES = 8_000_000  # an archive is closed when it is longer
SPOILED = 100  # records of an archive after which a damaged one comes, where damage is asked for
STEPS = (1 << 16, 1 << 10, 1 << 5, 1)  # bytes that are inflated at once; fewer where a fault is near
FIRST_STEP = 1 << 12  # most members are shorter
MOST_NAME = 4096  # bytes of a name or a comment in a gzip header
USUAL_HEADER = 10  # bytes of a gzip header without any
TYPES = frozenset("warcinfo response resource request metadata revisit conversion continuation".split())
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
LATER = re.compile(rb"\r\nWARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
#: What is known of a record, or of a gap in place of one.
NOTES = {
    "page_id": pa.int64(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "record_type": pa.string(),
    "refers_to": pa.int64(),
    "target": pa.string(),
    "archive": pa.string(),
    "start": pa.int64(),
    "end": pa.int64(),
    "inner_start": pa.int64(),
    "inner_end": pa.int64(),
    "gap": pa.string(),
}


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


OWN = 0x7061676500004000  # the upper half of the ids of records that are written here


def record_id(page_id: int) -> str:
    """A record id that holds the page id in its lower half."""
    return f"<{uuid.UUID(int=(OWN << 64) | (page_id & (2**64 - 1))).urn}>"


def page_of(record: str | None) -> int | None:
    """The page id in a record id, if it is one of ours."""
    number = uuid.UUID(record.strip("<>")).int if record else 0
    if number >> 64 != OWN:
        return None
    low = number & (2**64 - 1)
    return low - 2**64 if low >> 63 else low


def make_record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit of the keeper's; the HTTP header keeps the payload's length in both."""
    digest = base32_sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if keeper is None:
        block += payload
    named = record_id(page_id) if page_id is not None else f"<{uuid.uuid5(uuid.NAMESPACE_URL, digest).urn}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if keeper is None else 'revisit'}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Record-ID: {named}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~|^{}<>')}")
    if keeper is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(keeper)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", ""]
    above = "\r\n".join(head).encode()
    return above + f"X-Header-Digest: sha1:{base32_sha1(above)}".encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def zipped(record: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress(record) + packer.flush()


class Damaged(ValueError):
    """A check of a record failed."""


def header_holds(above: bytes, fields: dict[str, str], doubted: bool) -> bool:
    """Whether a header is as it was written, as far as it can tell: `above` is all of it before the line of its digest."""
    told = fields.get("x-header-digest")
    if told is not None:
        return told.removeprefix("sha1:") == base32_sha1(above)
    return "x-page-id" not in fields and not (doubted and page_of(fields.get("warc-record-id")) is not None)


def parse_record(data: bytes, at: int, doubted: bool = False) -> tuple[dict, int]:
    """The record that starts at a position of plain bytes, and where it ends; `doubted` where a checksum over it has failed."""
    if not VERSION.match(data, at):
        raise Damaged("no version line")
    following = LATER.search(data, at + 1)
    split = data.find(b"\r\n\r\n", at, following.start() + 2 if following else len(data))
    if split < 0:  # before the next version line, so that a header is looked through once
        raise Damaged("header without end")
    try:
        lines = data[at:split].decode().split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        length = int(fields["content-length"])
        page_id = int(fields["x-page-id"]) if "x-page-id" in fields else None
        if page_id is not None and (not -(2**63) <= page_id < 2**63 or page_of(fields.get("warc-record-id")) != page_id):
            raise ValueError("page id")
        refers_to = page_of(fields.get("warc-refers-to"))
        last = data.rfind(b"\r\n", at, split) + 2
        if not header_holds(data[at:last], fields, doubted):
            raise ValueError("header digest")
    except (ValueError, KeyError) as cause:
        raise Damaged("header") from cause
    kind = fields.get("warc-type", "")
    if kind not in TYPES:
        raise Damaged("type")
    end = split + 4 + length + 4
    if length < 0 or end > len(data) or data[end - 4 : end] != b"\r\n\r\n":
        raise Damaged("length")
    block = data[split + 4 : end - 4]
    wanted = fields.get("warc-block-digest")
    if wanted and wanted.removeprefix("sha1:") != base32_sha1(block) or doubted and not wanted:
        raise Damaged("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length:\s*(\d{1,18})\s*$", http)
    digest, size = fields.get("warc-payload-digest", "").removeprefix("sha1:"), int(told[1]) if told else 0
    if kind == "response":
        own = base32_sha1(payload)
        if told and size != len(payload) or digest not in ("", own):
            raise Damaged("payload digest")
        digest, size = own, len(payload)
    record = {"page_id": page_id, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers_to}
    return record | {"target": fields.get("warc-target-uri"), "payload": payload}, end


def header_reads(data: bytes, at: int) -> bool:
    """Whether a gzip header stands there whose name and comment end within MOST_NAME bytes."""
    if not data.startswith(MEMBER, at) or at + USUAL_HEADER >= len(data) or data[at + 3] & 0xE0:
        return False
    flags, at = data[at + 3], at + USUAL_HEADER
    if flags & 4:
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    for held in (8, 16):
        if flags & held:
            end = data.find(b"\0", at, at + MOST_NAME)
            if end < 0:
                return False
            at = end + 1
    return at < len(data)


def begins_with_version(data: bytes, at: int) -> bool:
    """Whether the first plain bytes of a gzip member are a version line."""
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 3 * MOST_NAME], 10).startswith(b"WARC/1.")
    except zlib.error:
        return False


def inflated(data: bytes, at: int, form: int = 31) -> tuple[bytes, int, str]:
    """All that a gzip member (form -15: what follows its header) gives up to its end or its first fault, where the reading stopped, and the fault."""
    view, opened, out = memoryview(data), zlib.decompressobj(form), []
    before, size = opened.copy(), FIRST_STEP
    for step in STEPS:
        size = min(size, step)
        try:
            while at < len(view) and not opened.eof:
                before = opened.copy()
                out.append(opened.decompress(view[at : at + size]))
                at, size = min(at + size, len(view)), min(4 * size, step)
        except zlib.error:
            opened = before
            continue
        return b"".join(out), at - len(opened.unused_data), "" if opened.eof else "member without end"
    rest = data[at : at + 1]
    try:
        while True:  # what the byte at the fault still gives
            out.append(opened.decompress(rest, 1))
            rest = opened.unconsumed_tail
            if not out[-1] and not rest:
                break
    except zlib.error:
        pass
    return b"".join(out), at, "gzip"


def read_to(data: bytes, at: int, size: int, form: int = 31) -> int:
    """How far a member is read when `size` bytes of it are inflated."""
    view, opened, left = memoryview(data), zlib.decompressobj(form), size - 1  # the last byte would let the reading go on to the checksum
    while left > 0 and at < len(view):
        step = min(STEPS[0], len(view) - at)
        left -= len(opened.decompress(view[at : at + step], left))
        at += step - len(opened.unconsumed_tail)
    return at


def read_plain(plain: bytes, doubted: bool = False) -> list[dict]:
    """Records and gaps of a member's plain bytes, in order."""
    at, bad_from, reason, found = 0, None, "", []
    while at < len(plain):
        try:
            record, end = parse_record(plain, at, doubted)
        except Damaged as cause:
            if bad_from is None:
                bad_from, reason = at, str(cause)
            following = VERSION.search(plain, at + 1)
            at = following.start() if following else len(plain)
            continue
        if bad_from is not None:
            found.append({"gap": reason, "inner_start": bad_from, "inner_end": at})
            bad_from = None
        found.append(record | {"gap": None, "inner_start": at, "inner_end": end})
        at = end
    if bad_from is not None:
        found.append({"gap": reason, "inner_start": bad_from, "inner_end": len(plain)})
    return found


def read_member(data: bytes, at: int, form: int = 31) -> tuple[list[dict], int, str]:
    """Records and gaps of a member, where it ends or where the search goes on, and its fault if it has one.

    Damaged if it gives no record; its second argument is where the reading stopped.
    """
    start = at if form == 31 else at + USUAL_HEADER
    plain, end, fault = inflated(data, start, form)
    fault = fault or ("" if form == 31 else "gzip header")
    found = read_plain(plain, bool(fault))
    if fault and form == 31 and len(found) == 1 and found[0]["inner_end"] == len(plain):
        raise Damaged(fault, end)  # the member is one record, so its checksum is the record's own check
    valid = [i for i, x in enumerate(found) if x["gap"] is None]
    if not valid and (fault or found):
        raise Damaged(fault or found[0]["gap"], end)
    if fault:  # what comes after the last valid record is searched as bytes of the file
        found = found[: valid[-1] + 1]
        end = read_to(data, start, found[-1]["inner_end"], form)
    return found, end, fault


def read_archive(data: bytes) -> Iterator[dict]:
    """Records (`gap` None) and quarantined gaps (`gap` the reason) of one file, in order, with their byte ranges."""
    at, bad_from, reason, explored = 0, None, "", 0
    while at < len(data):
        fault, on = "", at + 1  # where the search goes on after a failure
        try:
            if data.startswith(MEMBER, at):
                if not header_reads(data, at):
                    raise Damaged("gzip header", at)
                if at < explored and not begins_with_version(data, at):
                    raise Damaged("no version line", at)
                try:
                    found, end, fault = read_member(data, at)
                except Damaged as cause:
                    explored = max(explored, cause.args[1])
                    raise
            else:
                record, end = parse_record(data, at)
                found = [record | {"gap": None}]
        except Damaged as cause:
            try:  # where a member was due and its header has flags or doesn't read, it may be the header that is damaged
                plainly = header_reads(data, at) and not data[at + 3] or VERSION.match(data, at)
                if bad_from is not None or plainly or at + USUAL_HEADER >= len(data):
                    raise cause
                found, end, fault = read_member(data, at, -15)
            except Damaged:
                if bad_from is None:
                    bad_from, reason = at, str(cause.args[0])
                following = START.search(data, on)
                at = following.start() if following else len(data)
                continue
        if bad_from is not None:
            yield {"gap": reason, "start": bad_from, "end": at}
            bad_from = None
        yield from (x | {"start": at, "end": end} for x in found)
        at = end
        if fault:
            bad_from, reason = end, fault
            following = START.search(data, end)
            at = following.start() if following else len(data)
    if bad_from is not None:
        yield {"gap": reason, "start": bad_from, "end": len(data)}


def with_keepers(table: DataFrame) -> DataFrame:
    """page_id, url, html and the keeper: the largest page id of those with the same payload, null for that page itself."""
    digest = F.sha1(F.col("html").cast("binary"))
    rows = table.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", digest)
    keys = rows.select("page_id", "digest")
    shared = keys.where("page_id is not null").groupBy("digest").agg(
        F.max("page_id").alias("keeper"), F.count("*").alias("n")
    ).where("n > 1")
    others = keys.join(shared, "digest").where("page_id < keeper").groupBy("page_id", "digest").agg(F.max("keeper").alias("keeper"))
    return rows.join(others, ["page_id", "digest"], "left").select("page_id", "url", "html", "keeper")


def spoiled(record: bytes, turn: int) -> bytes:
    """What a reader has to get over: a record with a changed byte, stray bytes, or a torn record."""
    if turn % 3 == 0:
        middle = len(record) // 2
        return record[:middle] + bytes([record[middle] ^ 0x55]) + record[middle + 1 :]
    return b"stray bytes \x1f\x8b" if turn % 3 == 1 else record[: len(record) * 2 // 3]


def write_archives(table: DataFrame, damage: bool = False) -> DataFrame:
    """Archives as rows (path, content): a gzip member for each record. With `damage`, damaged records in between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            content = b"".join(held)
            held.clear()
            path = f"{hashlib.sha1(content).hexdigest()}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], names=["path", "content"])

        for batch in batches:
            for rows in rows_of(batch):
                for page_id, url, html, keeper in rows:
                    record = zipped(make_record(page_id, url, html.encode(), keeper))
                    if damage and len(held) % SPOILED == 0:
                        held.append(spoiled(record, len(held) // SPOILED))
                    held.append(record)
                    size += len(record)
                    if size >= ARCHIVE_BYTES:
                        yield close()
                        size = 0
        if held:
            yield close()

    return with_keepers(table).mapInArrow(run, "path string, content binary")


def read_archives(files: DataFrame) -> DataFrame:
    """Every record and every quarantined gap of archives (path, content), as spark.read.format("binaryFile") or write_archives give them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch, 1):
                for path, content in rows:
                    found = [x | {"archive": path} for x in read_archive(content)]
                    columns = [pa.array([x.get(name) for x in found], kind) for name, kind in NOTES.items()]
                    yield pa.RecordBatch.from_arrays(columns, names=list(NOTES))

    return files.select("path", "content").mapInArrow(
        run, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in NOTES.items())
    )


def salvage(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of archives, and the log of their quarantined gaps (archive, start, end, inner_start, inner_end, gap): one written table."""
    read = settled(read_archives(files), "salvaged")
    return read.where("gap is null").drop("gap"), read.where("gap is not null").select(
        "archive", "start", "end", "inner_start", "inner_end", "gap"
    )


def revisits_at_odds(records: DataFrame) -> DataFrame:
    """Revisits whose payload digest is not that of the response they refer to, as far as that one is among the records."""
    answers = records.where("record_type = 'response' and page_id is not null").select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("own")
    ).distinct()
    return records.where("record_type = 'revisit'").join(answers, "refers_to").where("payload_digest <> own").drop("own")


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        records, _ = salvage(scratch.settled(write_archives(pages(spark, sf_dir), damage=True), "archives"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a SHA-1 is 32 letters, each of five bits of the digest.
OP5_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
bits as (select distinct hex, list_aggregate(list_transform(range(1, 41), lambda i: format('{:04b}', instr('0123456789abcdef',
    hex[i]) - 1)), 'string_agg', '') as b from p),
named as (select hex, list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * b[5 * i +
    1]::int + 8 * b[5 * i + 2]::int + 4 * b[5 * i + 3]::int + 2 * b[5 * i + 4]::int + b[5 * i + 5]::int]), 'string_agg',
    '') as payload_digest from bits),
kept as (select hex, max(page_id) as keeper from p group by hex)
select p.page_id, p.payload_bytes, named.payload_digest,
  case when p.page_id = keeper then 'response' else 'revisit' end as record_type,
  case when p.page_id = keeper then null else keeper end as refers_to
from p join named using (hex) join kept using (hex)
"""
