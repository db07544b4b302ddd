"""WARC records in ZIP-packaged archives, written and read by range.

An archive is a ZIP file whose members are stored, not deflated: `archive/data.warc.gz`, one gzip member per record, and
`indexes/index.cdx`, one line `offset length` per record. `list_records` parses the end record, the ZIP64 end record, the
central directory and its ZIP64 fields, and turns the index into (archive, offset, length); `read_records` fetches just
those ranges. Nothing is extracted, and a record costs one read of its own bytes.

Of pages with equal payloads of at least `least` bytes that of the largest page_id is a response and the others are
revisits, which hold no payload but refer to it. Which ones they are comes from a minimum per digest (partial aggregates, so
copies that fill a third of the table do not meet in a task) and a join by digest that may be split.

Archives lie in the shared folder, opened through pyarrow's filesystems by URI. A task writes under a name of its own and
only names that its table holds are read, so a retried task does no harm.

Defined cases: a null html is an empty payload; a null url is `urn:none`; a null page_id is written as `urn:page:null` and
never refers nor is referred to; rows that repeat a page_id and a payload are all responses if that id is the largest;
an empty table writes nothing and reads no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.common import Scratch

#: Compressed bytes of records after which a task begins another archive, and bytes of records that a read may join.
ARCHIVE_BYTES, READ_BYTES = 32 << 20, 1 << 20
#: Bytes of an archive that are dealt to a task together.
DEALT_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_DATE = "2026-01-01T00:00:00Z"
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- ZIP -------------------------------------------------------------------------------------------------------------


def zip_stored(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP file of stored members, with ZIP64 sizes, offsets and end record."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), len(out)
        out += struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x800, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
        central += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x800, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 28, 0, 0, 0, 0, 0xFFFFFFFF) + raw + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
    at = len(out)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, len(members), len(members), len(central), at)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, at + len(central), 1)
    return bytes(out + central + end64 + locator + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


def zip_members(file: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """Each stored member's (offset of its data, size), from the directories alone. Members that are packed otherwise are left out."""
    total = file.size()

    def at(offset: int, n: int) -> bytes:
        file.seek(offset)
        return file.read(n)

    tail = at(max(0, total - 65557), min(total, 65557))
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no ZIP end record")
    n, size, offset = struct.unpack_from("<HII", tail, end + 10)
    if n == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        place = total - len(tail) + end - 20
        mark, _, where, _ = struct.unpack("<4sIQI", at(place, 20))
        if mark == b"PK\6\7":
            record = at(where, 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end record")
            n, size, offset = struct.unpack_from("<QQQ", record, 32)
    central, found, i = at(offset, size), {}, 0
    for _ in range(n):
        if central[i : i + 4] != b"PK\1\2":
            raise ValueError("broken ZIP directory")
        method = struct.unpack_from("<H", central, i + 10)[0]
        packed, plain, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", central, i + 20)
        local = struct.unpack_from("<I", central, i + 42)[0]
        name = central[i + 46 : i + 46 + name_n].decode("utf-8", "replace")
        extra = central[i + 46 + name_n : i + 46 + name_n + extra_n]
        j = 0
        while j + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, j)
            if kind == 1:  # only the fields that are full are there, in this order
                k = j + 4
                if plain == 0xFFFFFFFF:
                    plain, k = struct.unpack_from("<Q", extra, k)[0], k + 8
                if packed == 0xFFFFFFFF:
                    packed, k = struct.unpack_from("<Q", extra, k)[0], k + 8
                if local == 0xFFFFFFFF:
                    local = struct.unpack_from("<Q", extra, k)[0]
            j += 4 + length
        if method == 0:
            head = at(local, 30)
            if head[:4] != b"PK\3\4":
                raise ValueError(f"no local header for {name}")
            name_m, extra_m = struct.unpack_from("<HH", head, 26)
            found[name] = (local + 30 + name_m + extra_m, plain)
        i += 46 + name_n + extra_n + note_n
    return found


# --- records ---------------------------------------------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def warc_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response or revisit record. The HTTP head of a revisit keeps the length of the payload that it leaves out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else 'urn:none'}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_IDENTICAL}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """page_id, url, payload (None for a revisit), payload_bytes, payload_digest, record_type and refers_to of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    page = lambda urn: None if urn in (None, "<urn:page:null>") else int(urn.rpartition(":")[2].rstrip(">"))
    revisit = fields["warc-type"] == "revisit"
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (payload_digest(payload) != digest or len(payload) != int(told["content-length"])):
        raise ValueError(f"{fields['warc-record-id']}: the payload is not what its digest says")
    return {
        "page_id": page(fields["warc-record-id"]), "url": fields["warc-target-uri"], "payload": None if revisit else payload, "payload_bytes": int(told["content-length"]),
        "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": page(fields.get("warc-refers-to")) if revisit else None,
    }


# --- tables ----------------------------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """(archive, records) of the archives that hold a record per row of (page_id, url, html), as a written table."""
    folder = scratch.path("archives")
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    first = known.where((F.length("payload") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    refers = scratch.save(
        known.where((F.length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest").join(first, "digest").where("page_id <> first").select("page_id", "digest", "first").distinct(), "refers"
    )
    if refers.limit(1).count():
        known = known.join(refers, ["page_id", "digest"], "left")
    else:
        known = known.withColumn("first", F.lit(None).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        data, index = bytearray(), []

        def close() -> pa.RecordBatch:
            store.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(zip_stored([(DATA, bytes(data)), (INDEX, "\n".join(index).encode())]))
            found = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())], ["archive", "records"])
            data.clear()
            index.clear()
            return found

        for batch in batches:
            for page, url, payload, digest, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "first")), strict=True):
                raw = payload.as_py()
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                record = pack.compress(warc_record(page.as_py(), url.as_py(), raw, base64.b32encode(digest.as_py()).decode(), refers_to.as_py())) + pack.flush()
                index.append(f"{len(data)} {len(record)}")
                data += record
                if len(data) >= ARCHIVE_BYTES:
                    yield close()
        if index:
            yield close()

    return scratch.save(known.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, "archive string, records long"), "written")


def list_records(archives: DataFrame) -> DataFrame:
    """(archive, offset, length): the byte range of each record of the archives, from their directories and indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as file:
                    members = zip_members(file)
                    begin, size = members[INDEX]
                    file.seek(begin)
                    pairs = [tuple(map(int, x.split())) for x in file.read(size).decode().splitlines()]
                start = members[DATA][0]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(pairs)), pa.array([start + a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["archive", "offset", "length"])

    return archives.select("archive").mapInArrow(run, "archive string, offset long, length long")


def read_records(ranges: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at (archive, offset, length). Neighbouring ranges are fetched by one read of at most READ_BYTES or one record."""
    kind = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [x.split(" ")[0] for x in kind.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
            i = 0
            while i < len(rows):
                archive, begin, n = rows[i]
                j = i + 1
                while j < len(rows) and rows[j][0] == archive and rows[j][1] == begin + n and n + rows[j][2] <= READ_BYTES:
                    n += rows[j][2]
                    j += 1
                if archive != at:
                    if file:
                        file.close()
                    store, path = fs.FileSystem.from_uri(archive)
                    file, at = store.open_input_file(path), archive
                file.seek(begin)
                data = file.read(n)
                found = [parse_record(zlib.decompress(data[o - begin : o - begin + m], 31)) for _, o, m in rows[i:j]]
                if not with_payload:
                    for x in found:
                        x["payload"] = None
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in zip(names, kinds, strict=True)], names)
                i = j
        if file:
            file.close()

    return ranges.mapInArrow(run, kind)


def round_trip(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """Writes the pages and reads every record back."""
    archives = write_archives(pages, scratch, least)
    ranges = list_records(archives.repartition("archive"))
    dealt = ranges.repartition("archive", F.floor(F.col("offset") / DEALT_BYTES)).sortWithinPartitions("archive", "offset")
    return read_records(dealt, with_payload=False)
