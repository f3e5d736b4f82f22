"""WARC records in ZIP packages: writing with revisit records, and a range reader.

A package is a ZIP archive of stored (uncompressed) members: gzipped WARC
records one after the other, an index line for each, and a manifest.  The
reader never extracts a member.  It finds the end-of-central-directory record,
follows the ZIP64 locator if sizes need it, walks the central directory, locates
a member's bytes behind its local header, and reads the ranges that the index
names, each one record.

Packages are files in the cluster's shared folder, written by the tasks under
names of their own attempt; a table of the committed tasks' files says which
count, so files of lost or repeated attempts are never read.  Readers open a
package where it lies and read ranges of it: first its directories and index,
then the records, of large packages in several tasks.  Paths are those of
Arrow's file systems (local and mounted ones, hdfs, s3, gs, abfs).

What is a response is decided from ids and digests before any record is built;
of a revisit no payload is compressed.

Cases: an empty table makes no package; a very long html is one record, larger
than a package's usual size; a null or empty html is an empty payload; payloads shorter than
``min_bytes`` are always responses; rows repeating the smallest page_id of a
payload are responses each; a null page_id is never referred to, and a payload
seen only with null ids is a response; other columns but the url are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracegraph.llm._common import SLICE, map_slices, materialize, shared_dir

DATE = "2024-01-01T00:00:00Z"
RECORDS, INDEX, MANIFEST = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Bytes of records at which a package is closed.
PACKAGE_BYTES = 8 << 20
#: Records, and bytes of an index, that are read together.
RECORDS_READ, INDEX_READ = 4_096, 1 << 20
#: Bytes of packages that a task reads, about.
READ_BYTES = 64 << 20

# Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: object, url: str, payload: bytes, digest: str, n_bytes: int, refers_to: object = None) -> bytes:
    """One gzipped WARC record; a revisit has the header block only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Target-URI": " ".join(url.split()), "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Bytes": n_bytes, "Content-Type": "application/http; msgtype=response",
    }
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head["Content-Length"] = len(block)
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw.encode() + block + b"\r\n\r\n") + z.flush()


def parse_record(raw: bytes) -> dict:
    """Header fields, and ``payload`` of a record (with or without gzip)."""
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompressobj(31).decompress(raw)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(out["Content-Length"])]
    out["payload"] = block.partition(b"\r\n\r\n")[2]
    return out


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP archive of stored members; ZIP64 structures where sizes need them, or always."""
    body, central, at = [], [], 0
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        big = zip64 or n >= FULL32 or at >= FULL32
        size32, at32 = (FULL32, FULL32) if big else (n, at)
        extra_l = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        extra_c = struct.pack("<HHQQQ", 1, 24, n, n, at) if big else b""
        need = 45 if big else 20
        body += [struct.pack("<4sHHHHHIIIHH", LOCAL, need, 0x800, 0, 0, 0x21, crc, size32, size32, len(raw), len(extra_l)), raw, extra_l, data]
        central.append(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, need, need, 0x800, 0, 0, 0x21, crc, size32, size32, len(raw), len(extra_c), 0, 0, 0, 0, at32) + raw + extra_c)
        at += 30 + len(raw) + len(extra_l) + n
    listing = b"".join(central)
    tail = b""
    big = zip64 or at >= FULL32 or len(listing) >= FULL32 or len(members) >= FULL16
    if big:
        tail = struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, len(members), len(members), len(listing), at) + struct.pack("<4sIQI", LOCATOR64, 0, at + len(listing), 1)
    n16, size32, at32 = (FULL16, FULL32, FULL32) if big else (len(members), len(listing), at)
    return b"".join([*body, listing, tail, struct.pack("<4sHHHHIIH", END, 0, 0, n16, n16, size32, at32, 0)])


class ZipPackage:
    """Stored members of a ZIP archive behind ``read(offset, n)``; only directories and asked ranges are read."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail_at = max(0, size - 65_557)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(END)
        if end < 0 or len(tail) - end < 22:
            raise ValueError("no end of a central directory")
        n, length, start = struct.unpack_from("<HII", tail, end + 10)
        if end + tail_at >= 20 and (locator := read(tail_at + end - 20, 20))[:4] == LOCATOR64:
            at64 = struct.unpack_from("<Q", locator, 8)[0]
            record64 = read(at64, 56)
            if record64[:4] != END64:
                raise ValueError("the ZIP64 locator points at no record")
            n, length, start = struct.unpack_from("<QQQ", record64, 32)
        self.members: dict[str, tuple[int, int, int]] = {}
        listing, at = read(start, length), 0
        for _ in range(n):
            if listing[at : at + 4] != CENTRAL:
                raise ValueError("a central directory entry is damaged")
            method = struct.unpack_from("<H", listing, at + 10)[0]
            packed, plain, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", listing, at + 20)
            local = struct.unpack_from("<I", listing, at + 42)[0]
            name = listing[at + 46 : at + 46 + name_n].decode()
            p, stop = at + 46 + name_n, at + 46 + name_n + extra_n
            while p + 4 <= stop:
                tag, width = struct.unpack_from("<HH", listing, p)
                if tag == 1:  # 64-bit values, present only for the fields that are full
                    q = p + 4
                    if plain == FULL32:
                        plain, q = struct.unpack_from("<Q", listing, q)[0], q + 8
                    if packed == FULL32:
                        packed, q = struct.unpack_from("<Q", listing, q)[0], q + 8
                    if local == FULL32:
                        local = struct.unpack_from("<Q", listing, q)[0]
                p += 4 + width
            self.members[name] = (method, packed, local)
            at = stop + note_n

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes."""
        method, length, local = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        head = self.read(local, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"{name} has no local header")
        name_n, extra_n = struct.unpack_from("<HH", head, 26)
        return local + 30 + name_n + extra_n, length

    def entries(self) -> Iterator[tuple[int, int]]:
        """Offset in the package and length of every indexed record; the index is read piece by piece."""
        base, length = self.locate(RECORDS)
        at, n = self.locate(INDEX)
        rest = b""
        for piece in range(0, n, INDEX_READ):
            *lines, rest = (rest + self.read(at + piece, min(INDEX_READ, n - piece))).split(b"\n")
            for line in lines:
                where = json.loads(line[line.index(b"{") :])
                if where["offset"] + where["length"] > length:
                    raise ValueError("an index line points beyond its member")
                yield base + where["offset"], where["length"]
        if rest:
            raise ValueError("the index ends within a line")

    def records(self) -> Iterator[dict]:
        """Every indexed record, each by one range read."""
        for at, n in self.entries():
            yield parse_record(self.read(at, n))


def package(records: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A package of (key, gzipped record)."""
    lines, at = [], 0
    for key, raw in records:
        lines.append(f"{key} {json.dumps({'offset': at, 'length': len(raw)})}\n")
        at += len(raw)
    manifest = json.dumps({"profile": "data-package", "resources": [{"path": RECORDS}, {"path": INDEX}]})
    return zip_bytes([(RECORDS, b"".join(r for _, r in records)), (INDEX, "".join(lines).encode()), (MANIFEST, manifest.encode())], zip64)


def decided(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, n_bytes, hex, refers_to, html``: ``html`` is null for a revisit.

    The list of payloads with several records comes from ids and digests alone; it has a row for each.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    facts = [F.sha1(payload.cast("binary")).alias("hex"), F.octet_length(payload).cast("long").alias("n_bytes")]
    page_id = F.col(id_col).cast("long").alias("page_id")
    first = pages.select(page_id, *facts).where(F.col("n_bytes") >= min_bytes)
    first = first.groupBy("hex").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    first = materialize(first.select(F.col("hex").alias("h"), "first_id"), "payloads")
    src = pages.select(page_id, F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("html"), *facts)
    out = src.join(first, F.col("hex") == F.col("h"), "left")
    again = F.col("first_id").isNotNull() & (F.col("n_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return out.select("page_id", "url", "n_bytes", "hex", F.when(again, F.col("first_id")).alias("refers_to"), F.when(~again, F.col("html")).alias("html"))


def opened(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "/", path)))


def packages(pages: DataFrame, min_bytes: int = 0, folder: str | None = None, **cols: str) -> DataFrame:
    """``path, length`` of packages of about PACKAGE_BYTES with all pages, in ``folder`` or a fresh one of the shared folder."""
    folder = folder or shared_dir(pages.sparkSession, "packages")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():05}-{task.attemptNumber()}-{uuid.uuid4().hex}"
        held: list[tuple[str, bytes]] = []
        total = count = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, total, count
            path, raw = f"{name}-{count:05}.wacz", package(held)
            store, inner = opened(path)
            store.create_dir(inner.rpartition("/")[0], recursive=True)
            with store.open_output_stream(inner) as f:
                f.write(raw)
            held, total, count = [], 0, count + 1
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(raw)], pa.int64())], names=["path", "length"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for r in batch.slice(at, SLICE).to_pylist():
                    digest = base64.b32encode(bytes.fromhex(r["hex"])).decode()
                    kind = "revisit" if r["html"] is None else "response"
                    raw = record(kind, r["page_id"], r["url"], (r["html"] or "").encode(), digest, r["n_bytes"], r["refers_to"])
                    held.append((f"page:{r['page_id']}", raw))
                    total += len(raw)
                    if total >= PACKAGE_BYTES:
                        yield flush()
        if held:
            yield flush()

    return materialize(decided(pages, min_bytes, **cols).mapInArrow(pack, "path string, length long"), "package-list")


def packages_at(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the packages that lie as files below ``path``; none is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def ranges(packs: DataFrame) -> DataFrame:
    """``path, at, n``: offsets and lengths of up to RECORDS_READ records of a package to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(path: str, part: list[tuple[int, int]]) -> pa.RecordBatch:
            numbers = [pa.array([[x[i] for x in part]], pa.list_(pa.int64())) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array([path]), *numbers], names=["path", "at", "n"])

        for batch in batches:
            for r in batch.to_pylist():
                store, inner = opened(r["path"])
                with store.open_input_file(inner) as f:
                    part: list[tuple[int, int]] = []
                    for entry in ZipPackage(lambda at, n: f.read_at(n, at), r["length"]).entries():
                        part.append(entry)
                        if len(part) == RECORDS_READ:
                            yield row(r["path"], part)
                            part = []
                    if part:
                        yield row(r["path"], part)

    return packs.select("path", "length").mapInArrow(run, "path string, at array<long>, n array<long>")


def read_packages(packs: DataFrame, keep_payload: bool = True) -> DataFrame:
    """A row per record of the packages ``path, length``: id, sizes and digest (of a response computed from the
    bytes read), type, reference and payload."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload
    names = [x.split()[0] for x in schema.split(", ")]
    out_schema = packs.sparkSession.createDataFrame([], schema).schema

    def fields(r: dict) -> tuple:
        page, refers, full = r["WARC-Record-ID"][10:-1], r.get("WARC-Refers-To", "")[10:-1], r["WARC-Type"] == "response"
        n, digest = (len(r["payload"]), digest_of(r["payload"])) if full else (int(r["X-Payload-Bytes"]), r["WARC-Payload-Digest"][5:])
        out = (None if page == "None" else int(page), r["WARC-Target-URI"], n, digest, r["WARC-Type"], int(refers) if refers else None)
        return (*out, r["payload"] if full else None) if keep_payload else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        for batch in batches:
            for r in batch.to_pylist():
                store, inner = opened(r["path"])
                with store.open_input_file(inner) as f:
                    for i in range(0, len(r["at"]), SLICE):
                        rows = [fields(parse_record(f.read_at(n, at))) for at, n in zip(r["at"][i : i + SLICE], r["n"][i : i + SLICE])]
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], arrow.field(k).type) for k in range(len(names))], schema=arrow)

    # Dealt anew by number, as rows this small would else be read by one task, whatever they point at.
    spark = packs.sparkSession
    total = packs.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(spark.sparkContext.defaultParallelism, total // READ_BYTES)
    return ranges(packs).repartition(n, "path", F.col("at")[0]).mapInArrow(run, out_schema)


def digests(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages, reads them back, and returns what each record says."""
    return read_packages(packages(pages, min_bytes), keep_payload=False).drop("url")
