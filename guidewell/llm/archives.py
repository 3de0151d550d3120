"""Web archives: WARC records in stored members of ZIP packages, written by tasks and read by ranges without extraction."""

from __future__ import annotations

import json
import struct
import zlib
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, file_system, make_dirs, new_path, table

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "part int, seq int, path string, records long, bytes long"
RECORD = "path string, offset long, length long, record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: Neighbouring records are read together, in ranges of about so many bytes.
RANGE_BYTES = 4 << 20


# ---- ZIP ----------------------------------------------------------------------------------------------------------


class ZipWriter:
    """Stored members written as a stream: sizes follow the data, all fields in ZIP64 form, no seeking back."""

    def __init__(self, out):
        self.out, self.at, self.members, self.open = out, 0, [], None

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.open = [raw, self.at, 0, 0]
        self._write(struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0x0808, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20) + raw + struct.pack("<2H2Q", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        self.open[2] = zlib.crc32(data, self.open[2])
        self.open[3] += len(data)
        self._write(data)

    def end(self) -> None:
        raw, at, crc, size = self.open
        self._write(struct.pack("<4sI2Q", b"PK\x07\x08", crc, size, size))
        self.members.append((raw, at, crc, size))

    def close(self) -> None:
        start = self.at
        for raw, at, crc, size in self.members:
            self._write(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0x0808, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 28, 0, 0, 0, 0, 0xFFFFFFFF) + raw + struct.pack("<2H3Q", 1, 24, size, size, at))
        end, n = self.at, len(self.members)
        self._write(struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, end - start, start))
        self._write(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        self._write(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


class Member(NamedTuple):
    name: str
    method: int
    size: int
    packed: int
    start: int  # of its data in the file


def zip_members(file, size: int) -> list[Member]:
    """Members of a ZIP file, with or without ZIP64, from its directory; ``file`` has read_at(n, offset)."""
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    k = tail.rfind(b"PK\x05\x06")
    while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
        k = tail.rfind(b"PK\x05\x06", 0, k)  # these bytes were part of the comment
    if k < 0:
        raise ValueError("no end of a ZIP directory")
    n, length, start = struct.unpack_from("<H2I", tail, k + 10)
    if (0xFFFF == n or 0xFFFFFFFF in (length, start)) and tail_at + k >= 20:
        magic, _, where = struct.unpack("<4sIQ", file.read_at(16, tail_at + k - 20))
        if magic == b"PK\x06\x07":
            record = file.read_at(56, where)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 directory where its locator points")
            n, length, start = struct.unpack_from("<3Q", record, 32)
    directory, at, out = file.read_at(length, start), 0, []
    for _ in range(n):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a broken ZIP directory")
        flags, method = struct.unpack_from("<2H", directory, at + 8)
        packed, whole, n_name, n_extra, n_note = struct.unpack_from("<2I3H", directory, at + 20)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, m = struct.unpack_from("<2H", extra, e)
            if kind == 1:  # the 64-bit forms of those fields that are full, in this order
                wide = list(struct.unpack_from(f"<{m // 8}Q", extra, e + 4))
                whole = wide.pop(0) if whole == 0xFFFFFFFF else whole
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            e += 4 + m
        local = file.read_at(30, header)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        out.append(Member(name, method, whole, packed, header + 30 + sum(struct.unpack_from("<2H", local, 26))))
        at += 46 + n_name + n_extra + n_note
    return out


# ---- WARC ---------------------------------------------------------------------------------------------------------


def _one_line(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def warc_record(kind: str, record_id: str, date: str, block: bytes, mime: str, **more: str | None) -> bytes:
    """One record, gzipped by itself."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    lines += [f"{k.replace('_', '-')}: {_one_line(v)}" for k, v in more.items() if v is not None]
    lines += [f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def http_block(payload: bytes, size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, rest


def parse_record(raw: bytes) -> tuple:
    """record_type, record_id, target_uri, payload_digest, refers_to, payload_bytes, payload of one record, gzipped or plain."""
    head, rest = _headers(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
    block = rest[: int(head.get("content-length", 0))]
    if head.get("content-type", "").startswith("application/http"):
        http, payload = _headers(block)
        size = int(http.get("content-length", len(payload)))
    else:
        payload, size = block, len(block)
    plain = lambda key: head[key].strip("<>") if key in head else None
    return head.get("warc-type"), plain("warc-record-id"), head.get("warc-target-uri"), head.get("warc-payload-digest"), plain("warc-refers-to"), size, payload


# ---- Spark --------------------------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", min_revisit: int = 100, archive_bytes: int = 64 << 20, urn: str = "urn:page:") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) into ZIP packages in the shared folder; returns the manifest.

    Of rows with equal payloads of at least ``min_revisit`` bytes, those with the least page_id are responses, the others
    revisits that name it. Which payloads repeat is found by aggregated digests; pages are joined with those alone. A
    package holds one stored member of separately gzipped records and one stored index of their offsets, of about
    ``archive_bytes`` together; it is written as a stream under a name of the task's attempt, and only packages in the
    manifest count, so a task that is run again does no harm.

    Null html: an empty payload. Null url: no target. Null page_id: its record id ends in "null"; it is a response only if
    no row with an id has that payload. Repeated rows: each has a record, all of the least id are responses. Memory is one
    Arrow batch of pages. An empty table gives an empty manifest; other columns are ignored.
    """
    import pandas as pd

    spark = pages.sparkSession
    base = new_path(spark, "archives")
    make_dirs(spark, base)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    firsts = rows.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = cut(firsts.select(F.col("digest").alias("d"), "first"), "repeated-payloads")
    near = F.broadcast(firsts) if firsts.count() <= 50_000 else firsts  # about 100 bytes each
    rows = rows.join(near, F.col("digest") == F.col("d"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    rows = rows.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest", F.when(revisit, F.col("first")).alias("refers_to"))

    def of_partition(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        part, seq, fs, zipped, index, count, path, at, out = task.partitionId(), 0, None, None, [], 0, "", 0, None

        def begin():
            nonlocal fs, zipped, index, count, path, at, out
            path = f"{base}/{part:06d}-{seq:05d}-{task.taskAttemptId()}.wacz"
            fs, where = file_system(path)
            out = fs.open_output_stream(where, compression=None)
            zipped, index, count = ZipWriter(out), [], 0
            zipped.begin(ARCHIVE)
            info = warc_record("warcinfo", f"urn:archive:{part}-{seq}", date, b"format: WARC File Format 1.1\r\n", "application/warc-fields")
            zipped.write(info)
            at = len(info)

        def finish():
            nonlocal zipped, seq
            zipped.end()
            zipped.begin(INDEX)
            zipped.write("".join(index).encode())
            zipped.end()
            zipped.close()
            out.close()
            row = (part, seq, path, count, zipped.at)
            zipped, seq = None, seq + 1
            return row

        done = []
        for pdf in batches:
            for page, url, payload, size, digest, refers in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["size"], pdf["digest"], pdf["refers_to"], strict=True):
                if zipped is None:
                    begin()
                name = f"{urn}{'null' if pd.isna(page) else int(page)}"
                kind = "response" if pd.isna(refers) else "revisit"
                to = None if pd.isna(refers) else f"<{urn}{int(refers)}>"
                data = warc_record(kind, name, date, http_block(payload or b"", size), "application/http; msgtype=response", WARC_Target_URI=url, WARC_Payload_Digest=f"sha256:{digest}", WARC_Refers_To=to, WARC_Profile=PROFILE if to else None)
                zipped.write(data)
                index.append(f"{name} {date} " + json.dumps({"offset": at, "length": len(data), "type": kind}) + "\n")
                at += len(data)
                count += 1
                if at >= archive_bytes:
                    done.append(finish())
        if zipped is not None:
            done.append(finish())
        yield pd.DataFrame(done, columns=["part", "seq", "path", "records", "bytes"])

    ids = rows.select(F.col("page_id").cast("decimal(20,0)").alias("page_id"), "url", "payload", "size", "digest", F.col("refers_to").cast("decimal(20,0)").alias("refers_to"))  # nulls stay exact in pandas
    return cut(ids.mapInPandas(of_partition, MANIFEST), "archive-manifest")


def archive_ranges(paths: DataFrame) -> DataFrame:
    """(path, offset, lengths): runs of neighbouring records in each ZIP package of ``paths``, from its index, or from the records themselves where it has none."""
    import pandas as pd

    def runs(path, member, entries):
        offset, lengths = None, []
        for at, n in entries:
            if lengths and (at != offset + sum(lengths) or sum(lengths) >= RANGE_BYTES):
                yield path, member.start + offset, lengths
                lengths = []
            if not lengths:
                offset = at
            lengths.append(n)
        if lengths:
            yield path, member.start + offset, lengths

    def gzipped(read, at, end):
        """Offsets and lengths of the gzip members from ``at`` to ``end``, read in pieces."""
        begun, packer, used = at, zlib.decompressobj(31), False
        while at < end or packer.unused_data:
            data = packer.unused_data
            if packer.eof:
                yield begun, at - len(data) - begun
                begun, packer, used = at - len(data), zlib.decompressobj(31), False
            if not data:
                data = read(min(RANGE_BYTES, end - at), at)
                at += len(data)
            if data:
                packer.decompress(data)
                used = True
        if used and packer.eof:
            yield begun, at - begun

    def plain(read, at, end):
        """Offsets and lengths of records that are not compressed: each says how long its block is."""
        while at < end:
            head, more = b"", 4096
            while b"\r\n\r\n" not in head and len(head) < end - at:
                head = read(min(more, end - at), at)
                more *= 4
            before = head.partition(b"\r\n\r\n")[0]
            if not before.startswith(b"WARC/"):
                raise ValueError("no WARC record where one should begin")
            length = len(before) + 4 + int(_headers(before + b"\r\n\r\n")[0].get("content-length", 0)) + 4
            yield at, min(length, end - at)
            at += length

    def scan(file, member, at, end):
        read = lambda n, k: file.read_at(n, member.start + k)
        return (gzipped if read(2, at) == b"\x1f\x8b" else plain)(read, at, end)

    def records(file, member, listed):
        """Records of a member by its index; what the index leaves out is looked for in the member itself."""
        at = 0
        for offset, length in [*listed, (member.size, 0)]:
            if at < offset:
                yield from scan(file, member, at, offset)
            if length and offset >= at:
                yield offset, length
            at = max(at, offset + length)

    def of_partition(batches):
        for pdf in batches:
            for path in pdf["path"]:
                fs, where = file_system(path)
                with fs.open_input_file(where) as file:
                    found = zip_members(file, file.size())
                    warcs = [m for m in found if m.name.startswith("archive/") and m.name.endswith((".warc.gz", ".warc"))]
                    if packed := [m.name for m in warcs if m.method]:
                        raise ValueError(f"{path}: {packed[0]} is compressed by the package, so its records cannot be read by ranges")
                    index = next((m for m in found if m.name == INDEX and m.method == 0), None)
                    for member in warcs:
                        listed = []
                        if index is not None and len(warcs) == 1:
                            fields = (json.loads(line[line.index("{") :]) for line in file.read_at(index.size, index.start).decode().splitlines() if "{" in line)
                            listed = sorted((int(f["offset"]), int(f["length"])) for f in fields if "offset" in f and "length" in f)
                        entries = records(file, member, listed)
                        made = list(runs(path, member, entries))
                        yield pd.DataFrame({"path": [m[0] for m in made], "offset": [m[1] for m in made], "lengths": [m[2] for m in made]})

    return paths.select("path").mapInPandas(of_partition, "path string, offset long, lengths array<long>")


def read_archives(paths: DataFrame) -> DataFrame:
    """RECORD rows of all records in the ZIP packages of ``paths`` (path): each range is read by itself, nothing is extracted.

    ``warcinfo`` and other records come with their own type. WARC members may be gzipped by record or plain; an index may
    give offsets as text or leave records out, which are then found in the member. A member that the package itself
    compresses raises an error that names it. A package without records gives no rows.
    """
    import pandas as pd

    n = max(1, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = cut(archive_ranges(paths.select("path").repartition(n)), "archive-ranges")

    def of_partition(batches):
        for pdf in batches:
            for path, offset, lengths in zip(pdf["path"], pdf["offset"], pdf["lengths"], strict=True):
                fs, where = file_system(path)
                with fs.open_input_file(where) as file:
                    data = file.read_at(int(sum(lengths)), int(offset))
                rows, at = [], 0
                for length in lengths:
                    rows.append((path, int(offset) + at, int(length), *parse_record(data[at : at + length])))
                    at += int(length)
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in RECORD.split(", ")])

    return ranges.repartition(max(1, min(ranges.count(), n * 4))).mapInPandas(of_partition, RECORD)


def op2_warc_zip(spark, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages"))).where("record_type in ('response', 'revisit')")
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    response = F.col("record_type") == "response"
    return records.select(
        page("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"))


OP2_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as payload_digest, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages),
f as (select payload_digest as d, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from p left join f on payload_digest = d
"""
