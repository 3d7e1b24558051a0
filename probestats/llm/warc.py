"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans one partition for every few files, parses a record's header first, and passes over records that the
pushed-down filters reject: their payload is neither inflated nor decoded if the member tells its own length (the
writer stores it in the gzip extra field ``sl``), and inflated without being decoded if it does not.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import Row

from probestats.llm.shared import BROADCAST_ROWS, small
from probestats.operators.ordered import hot_keys
from probestats.operators.stage import stage

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
)
# fixed values: the header fields of the format, by column
FIELDS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = 8192
_LIST = "_files-"
_END = b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(path: str):
    """(file system, path in it) of a local path or URI."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _one_line(value: str) -> str:
    """A header value without line ends, which would start another header."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict) -> bytes:
    """One record. A ``revisit`` has the response's HTTP head but no payload; the head tells the payload's length."""
    payload = bytes(row.get("payload") or b"")
    n = len(payload) if row.get("payload_length") is None else row["payload_length"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = head if row["record_type"] == "revisit" else head + payload
    lines = ["WARC/1.1"]
    lines += [f"{field}: {_one_line(str(row[c]))}" for c, field in FIELDS.items() if row.get(c) is not None]
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {IDENTICAL}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def gzip_member(data: bytes) -> bytes:
    """One gzip member whose extra field ``sl`` holds its compressed and uncompressed length (0: over 4 GB)."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    total = 10 + 2 + 12 + len(body) + 8
    lengths = struct.pack("<II", total, len(data)) if max(total, len(data)) < 2**32 else bytes(8)
    extra = b"sl" + struct.pack("<H", 8) + lengths
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) % 2**32)


def _skip_length(start: bytes) -> int:
    """The member's own length from its extra field; 0 if it tells none."""
    if not start[3] & 4:
        return 0
    end = 12 + struct.unpack_from("<H", start, 10)[0]
    at = 12
    while at + 4 <= min(end, len(start)):
        n = struct.unpack_from("<H", start, at + 2)[0]
        if start[at : at + 2] == b"sl" and n >= 8:
            return struct.unpack_from("<I", start, at + 4)[0]
        at += 4 + n
    return 0


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


class _Wanted:
    """Predicates that the header alone decides."""

    def __init__(self, equal: dict[str, list], there: set[str]):
        self.equal = {FIELDS[c].lower(): set(v) for c, v in equal.items()}
        self.there = {FIELDS[c].lower() for c in there}

    def __call__(self, headers: dict[str, str]) -> bool:
        return all(headers.get(k) in v for k, v in self.equal.items()) and all(k in headers for k in self.there)


def records(file, size: int, wanted: _Wanted, payloads: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of the wanted records of an open file; without ``payloads`` the block ends with its HTTP head."""
    at = 0
    while at < size:
        file.seek(at)
        start = file.read(min(_HEAD, size - at))
        if start[:2] == b"\x1f\x8b":
            at, found = _compressed(file, at, size, start, wanted, payloads)
        else:
            at, found = _plain(file, at, size, start, wanted)
        if found:
            yield found


def _compressed(file, at: int, size: int, start: bytes, wanted: _Wanted, payloads: bool):
    inflate, length = zlib.decompressobj(31), _skip_length(start)
    data, got = bytearray(inflate.decompress(start)), len(start)
    while (end := data.find(_END)) < 0 and not inflate.eof:
        more = file.read(_HEAD)
        if not more:
            raise ValueError(f"record at {at} ends in its header")
        got += len(more)
        data += inflate.decompress(more)
    headers = _headers(bytes(data[: max(end, 0)]))
    keep = wanted(headers)
    if length and (not keep or (not payloads and data.find(_END, end + 4) >= 0)):
        return at + length, (headers, bytes(data[end + 4 :])) if keep else None
    while not inflate.eof:
        more = file.read(length - got if length > got else 1 << 20)
        if not more:
            raise ValueError(f"record at {at} ends early")
        got += len(more)
        piece = inflate.decompress(more)
        if keep:
            data += piece
    following = at + got - len(inflate.unused_data)
    block = bytes(data[end + 4 : end + 4 + int(headers["content-length"])]) if keep else None
    return following, (headers, block) if keep else None


def _plain(file, at: int, size: int, start: bytes, wanted: _Wanted):
    data = bytearray(start)
    while (end := data.find(_END)) < 0:
        more = file.read(_HEAD)
        if not more:
            if data.strip(b"\r\n"):
                raise ValueError(f"record at {at} ends in its header")
            return size, None
        data += more
    headers = _headers(bytes(data[:end]))
    length = int(headers["content-length"])
    following = at + end + 4 + length + 4
    if not wanted(headers):
        return following, None
    file.seek(at + end + 4)
    return following, (headers, file.read(length))


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


def committed(system, root: str) -> dict[str, list]:
    """The lists of files that committed writes left, by name, without those that a later write replaced."""
    from pyarrow import fs

    names = [x.base_name for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.File]
    found = {}
    for name in names:
        if name.startswith(_LIST) and name.endswith(".json"):
            with system.open_input_stream(f"{root}/{name}") as f:
                found[name] = json.loads(f.read())
    gone = {name for x in found.values() for name in x["replaces"]}
    return {name: x["files"] for name, x in found.items() if name not in gone}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.verify = options["path"], options.get("verify", "false") == "true"
        self.payloads = options.get("payload", "true") == "true"
        self.split = int(options.get("splitbytes", 64 << 20))
        self.equal: dict[str, list] = {}
        self.there: set[str] = set()
        if "recordtype" in options:
            self.equal["record_type"] = options["recordtype"].split(",")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership on the header columns; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in FIELDS and isinstance(f, EqualTo | In):
                values = list(f.value) if isinstance(f, In) else [f.value]
                self.equal[column] = [v for v in self.equal.get(column, values) if v in values]
            elif column in FIELDS and isinstance(f, IsNotNull):
                self.there.add(column)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files of about ``splitBytes`` together; the lists of committed writes count, if there are some."""
        from pyarrow import fs

        system, root = file_system(self.path)
        lists = committed(system, root)
        if lists:
            files = sorted((f"{root}/{name}", size) for found in lists.values() for name, size in found)
        else:
            found = system.get_file_info(fs.FileSelector(root, recursive=True))
            files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz")))
        out: list[Files] = []
        held = self.split
        for path, size in files:
            if held + size > self.split and (not out or out[-1].files):
                out.append(Files([]))
                held = 0
            out[-1].files.append((path, size))
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = file_system(self.path)
        wanted = _Wanted(self.equal, self.there)
        for path, size in partition.files:
            with system.open_input_file(path) as file:
                for headers, block in records(file, size, wanted, self.payloads):
                    yield self._row(headers, block, path)

    def _row(self, headers: dict[str, str], block: bytes, path: str) -> tuple:
        values = [headers.get(f.lower()) for f in FIELDS.values()]
        payload, length = block, None
        if headers.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(_END)
            length = _headers(head).get("content-length")
        if headers.get("warc-type") == "revisit" or not self.payloads:
            payload = None
        elif self.verify and headers.get("warc-payload-digest") not in (None, f"sha1:{base32_sha1(payload)}"):
            raise ValueError(f"{path}: the payload of {headers.get('warc-record-id')} does not have its digest")
        return (*values, len(payload) if payload is not None else int(length) if length else None, payload)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceWriter):
    """Writes files under names of their own; only those of tasks that ended well get on the write's list of files.

    An append adds its list to those of earlier writes. An overwrite's list names those that it replaces, which are void as
    soon as it is there; then they and their files are deleted.
    """

    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path, self.most, self.overwrite = options["path"], int(options.get("maxfilebytes", 256 << 20)), overwrite

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        done, file, size = [], None, 0
        for row in rows:
            if file is None:
                name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                file = system.open_output_stream(f"{root}/{name}", compression=None)
            member = gzip_member(record_bytes(row.asDict()))
            file.write(member)
            size += len(member)
            if size >= self.most:
                file.close()
                done.append((name, size))
                file = None
        if file is not None:
            file.close()
            done.append((name, size))
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        old = committed(system, root) if self.overwrite else {}
        files = sorted(x for m in messages if m for x in m.files)
        with system.open_output_stream(f"{root}/{_LIST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps({"files": files, "replaces": sorted(old)}).encode())
        for name, replaced in old.items():
            for file, _ in replaced:
                system.delete_file(f"{root}/{file}")
            system.delete_file(f"{root}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = file_system(self.path)
        for name, _ in (x for m in messages if m for x in m.files):
            system.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """Options: path; reading: recordType (comma list), payload (false: headers only), verify, splitBytes; writing: maxFileBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame) -> DataFrame:
    """WARC records of pages (page_id, url, html): the smallest page_id of equal payloads is the response, others revisit it.

    NULL html is an empty payload. A NULL page_id never is the response of others: alone among equals it is a
    response without an id. Rows that repeat the smallest page_id with its payload are all responses. A NULL url
    gives no target. Other columns are ignored; an empty table gives no records.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    # only payloads that occur again are joined back, by digest and id; beyond a broadcast's size the frequent ones still are
    again = rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("of"), "first")
    again = stage(again, "again")
    on = F.col("sha") == F.col("of")
    hot = hot_keys(rows.select("sha"), ["sha"]) if again.count() > BROADCAST_ROWS else None
    if hot is None:
        joined = rows.join(small(again), on, "left")
    else:
        often = F.broadcast(again.join(F.broadcast(hot.select(F.col("sha").alias("of"))), "of"))
        joined = rows.join(often, on).unionByName(rows.join(often, on, "left_anti").join(again, on, "left"))
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return joined.select(
        urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"), F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), _base32("sha")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _base32(sha: str):
    """Base 32 of 20 bytes: the hexadecimal digits in four groups of 40 bits, each as eight digits of five bits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    digits = []
    for group in range(4):
        bits = F.conv(F.substring(F.hex(sha), 10 * group + 1, 10), 16, 10).cast("long")
        digits += [F.substr(alphabet, F.shiftright(bits, 35 - 5 * i).bitwiseAND(31).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*digits)


def page_id_of(urn: str):
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
