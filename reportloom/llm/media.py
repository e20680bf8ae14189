"""Media columns: archives of media members, and a Spark data source that reads them by byte ranges.

Writing: each task puts its rows into one ZIP archive (members stored as they are) in a shared folder, under a name of its own, and
moves it into place at the end; only archives that the returned manifest names are read. A member is a greyscale PNG of
8-bit samples, 64 to a row: the payload's bytes, padded with zeros to a positive multiple of 64.

Reading: the planner needs to know where each archive's directory lies. The tasks that write archives tell it, in a manifest file that is
read at once; for a folder without one the planner reads each archive's end. It cuts the directory
into equal byte ranges, as many as the archive has PART_BYTES. A partition holds the archive's path and a byte range,
not members, so neither planning nor a plan's size follows the number of members. A task finds the first entry that
begins in its range, reads the entries up to the range's end, then each member by its own offset; a read that fails is tried again for that member alone, from a newly opened file. Batches
of members go to Spark through Arrow, bounded by rows and bytes.

Defined results: a null text is the empty text, whose payload is 64 zero bytes; repeated rows are members of their
own; an empty table gives an empty table; further columns are not read; a member that is damaged fails the task
after RETRIES tries, or with on_error = "null" gives a row with null content and the error's text, whose digests are null.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import bounded_batches, map_batches, table, temporary

#: Samples in a row of an image; a payload is a positive multiple of it.
ROW = 64
#: Bytes of members in a partition; tries of one member; rows and bytes of an Arrow batch.
PART_BYTES = 16 << 20
RETRIES = 3
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20
#: Fixed values of the PNG and ZIP formats.
PNG_START = b"\x89PNG\r\n\x1a\n"
ZIP_END = b"PK\x05\x06"
ZIP64_END = b"PK\x06\x06"
ENTRY = b"PK\x01\x02"
#: Bytes read beyond a range, for its last entry and those that prove where the first of the next begins.
BEYOND = 1 << 19
ZIP64_AT = b"PK\x06\x07"
SCHEMA = "name string, offset long, content binary, error string"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros appended up to a positive multiple of ROW; bytes without them."""
    data = (text or "").encode()
    return data + b"\0" * (-len(data) % ROW if data else ROW), len(data)


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # the filter of each line is 0, none
    lines[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return PNG_START + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """Samples of a PNG that to_png wrote, one row of the array for each line; damage raises ValueError."""
    if data[:8] != PNG_START:
        raise ValueError("not a PNG")
    at, size, packed = 8, None, []
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width, size, depth, colour = struct.unpack(">IIBB", body[:10])
            if (width, depth, colour) != (ROW, 8, 0):
                raise ValueError("not 8-bit greyscale of this width")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(size, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("a line filter that isn't supported")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and a 16-bin histogram of the samples, in thousandths."""
    flat = samples.ravel()
    bins = np.bincount(flat >> 4, minlength=16)
    shares = (bins * 1000 // len(flat)).tolist()
    total = np.bincount(flat, minlength=256)
    values = np.arange(256)
    n, s, q = len(flat), int((total * values).sum()), int((total * values * values).sum())
    return f"m{s * 1000 // n};v{(q * n - s * s) * 1000 // (n * n)};h" + ".".join(map(str, shares))


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write one archive a task into the folder; a row for each archive: path, members, bytes, and start and length of its directory. A member is named
    id-place.png, with the row's id (none: null) and its place in the task; the number of padding bytes goes into the member's comment."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        at = f"{base}/{uuid.uuid4().hex}"
        members = 0
        with fs.open_output_stream(f"{at}.part") as sink, zipfile.ZipFile(_Sink(sink), "w", zipfile.ZIP_STORED) as out:
            batch = first
            while batch is not None:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    payload, n = payload_of(text)
                    info = zipfile.ZipInfo(f"{'null' if key is None else key}-{members}.png")
                    info.comment = str(len(payload) - n).encode()
                    out.writestr(info, to_png(payload))
                    members += 1
                batch = next((b for b in batches if b.num_rows), None)
        fs.move(f"{at}.part", f"{at}.zip")
        size = fs.get_file_info(f"{at}.zip").size
        start, length, _ = directory(fs, f"{at}.zip")
        numbers = [pa.array([x], pa.int64()) for x in (members, size, start, length)]
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{at.rpartition('/')[2]}.zip"]), *numbers], ["path", "members", "bytes", "start", "length"])

    return docs.select(id_col, text_col).mapInArrow(run, "path string, members long, bytes long, start long, length long")


def write_manifest(archives: DataFrame, folder: str) -> str:
    """Run the writing (of write_archives) and put name, bytes, start and length of each archive into a file of the folder: a line for
    each task that counted, not for a member. Its path."""
    rows = archives.select("path", "bytes", "start", "length").collect()
    fs, base = opened(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest") as out:
        out.write("".join(f"{r['path'].rpartition('/')[2]} {r['bytes']} {r['start']} {r['length']}\n" for r in rows).encode())
    return f"{folder}/manifest"


class _Sink(io.RawIOBase):
    """A write-only file over an Arrow stream, for archives that are written from front to back."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at


class Range(InputPartition):
    """Bytes first to last of an archive's directory, which ends at end."""

    def __init__(self, path: str, first: int, last: int, end: int):
        self.path, self.first, self.last, self.end = path, first, last, end


def directory(fs: pafs.FileSystem, path: str) -> tuple[int, int, int]:
    """(start, size, entries) of an archive's directory, from its last bytes."""
    with fs.open_input_file(path) as f:
        size = f.size()
        tail = f.read_at(min(size, 65_557 + 76), max(0, size - 65_557 - 76))
        at = tail.rfind(ZIP_END)
        if at < 0:
            raise ValueError(f"{path}: no archive directory")
        entries, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if (mark := tail.rfind(ZIP64_AT, 0, at)) >= 0:
            big = struct.unpack("<Q", tail[mark + 8 : mark + 16])[0]
            head = f.read_at(56, big)
            if head[:4] == ZIP64_END:
                entries, length, start = struct.unpack("<QQQ", head[32:56])
    return start, length, entries


def _entry(data: bytes, at: int) -> int:
    """Where the entry at this place ends; -1 if there is none."""
    if data[at : at + 4] != ENTRY or at + 46 > len(data):
        return -1
    return at + 46 + sum(struct.unpack("<HHH", data[at + 28 : at + 34]))


def first_entry(data: bytes) -> int:
    """The first place where an entry begins: one that the next entries, or the data's end, follow."""
    at = data.find(ENTRY)
    while at >= 0:
        to, k = at, 0
        while k < 4 and 0 <= to < len(data):
            to, k = _entry(data, to), k + 1
        if to >= len(data) or to >= 0 and k == 4:
            return at
        at = data.find(ENTRY, at + 1)
    return len(data)


def entries(data: bytes, before: int) -> Iterator[tuple[str, int, int, int, str]]:
    """(name, offset, bytes, checksum, comment) of each entry of a piece of a directory that begins before this place."""
    at = first_entry(data)
    while at < before:
        crc, size, _, n, extra, note = struct.unpack("<IIIHHH", data[at + 16 : at + 34])
        offset = struct.unpack("<I", data[at + 42 : at + 46])[0]
        name, more = data[at + 46 : at + 46 + n].decode(), data[at + 46 + n : at + 46 + n + extra]
        while len(more) >= 4:  # large sizes and offsets stand in an extra field, in this order
            kind, length = struct.unpack("<HH", more[:4])
            if kind == 1:
                big = [x[0] for x in struct.iter_unpack("<Q", more[4 : 4 + length // 8 * 8])]
                size, offset = [big.pop(0) if x == 0xFFFFFFFF and big else x for x in (size, offset)]
            more = more[4 + length :]
        yield name, offset, size, crc, data[at + 46 + n + extra : at + 46 + n + extra + note].decode()
        at += 46 + n + extra + note


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").option("path", folder).load(): the members of all .zip archives of a folder.

    Options: path; manifest (archive names of the folder, joined by commas; by default all); manifest_file (of write_manifest, which tells all that the planner needs); part_bytes; retries; on_error ("fail" or "null")."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.only = set(options["manifest"].split(",")) if options.get("manifest") is not None else None
        self.manifest_file = options.get("manifest_file")
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.on_error = options.get("on_error", "fail")

    def partitions(self) -> list[Range]:
        found = []
        for name, size, start, length in self.archives():
            pieces = max(1, min(size // self.part_bytes, length // 4096))
            cuts = [start + length * k // pieces for k in range(pieces + 1)]
            found += [Range(f"{self.path}/{name}", a, b, start + length) for a, b in zip(cuts, cuts[1:])]
        return found or [Range("", 0, 0, 0)]

    def archives(self) -> Iterator[tuple[str, int, int, int]]:
        """Name and size of each archive, start and length of its directory."""
        if self.manifest_file:
            fs, path = opened(self.manifest_file)
            with fs.open_input_stream(path) as f:
                for line in f.read().decode().splitlines():
                    name, *numbers = line.split(" ")
                    yield (name, *map(int, numbers))
            return
        fs, base = opened(self.path)
        for info in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            name = info.path.rpartition("/")[2]
            if name.endswith(".zip") and (self.only is None or name in self.only):
                yield (name, info.size, *directory(fs, info.path)[:2])

    def member(self, fs: pafs.FileSystem, path: str, offset: int, size: int, crc: int, files: list) -> bytes:
        """One member's bytes by its offset, which must have the directory's checksum; a failed try opens the file anew and
        concerns this member alone. Members are stored, not compressed."""
        for k in range(self.retries):
            try:
                if not files:
                    files.append(fs.open_input_file(path))
                head = files[0].read_at(30, offset)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError(f"{path}: no member at {offset}")
                n, extra = struct.unpack("<HH", head[26:30])
                data = files[0].read_at(size, offset + 30 + n + extra)
                if len(data) != size:
                    raise ValueError(f"{path}: the member at {offset} is cut off")
                if zlib.crc32(data) != crc:
                    raise ValueError(f"{path}: the member at {offset} is damaged")
                return data
            except (OSError, ValueError, struct.error):
                files.clear()
                if k + 1 == self.retries:
                    raise
                time.sleep(0.1 * 2**k)
        raise ValueError("no tries")

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, path = opened(part.path)
        files: list = [fs.open_input_file(path)]
        listed = files[0].read_at(min(part.last + BEYOND, part.end) - part.first, part.first)
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            names, offsets, data, errors = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(offsets, pa.int64()), pa.array(data, pa.binary()), pa.array(errors, pa.string())], ["name", "offset", "content", "error"])

        for name, offset, size, crc, note in entries(listed, part.last - part.first):
            try:
                data, error = self.member(fs, path, offset, size, crc, files), None
            except (OSError, ValueError, struct.error) as e:
                if self.on_error != "null":
                    raise
                data, error = None, str(e)
            rows.append((f"{name}:{note}", offset, data, error))
            held += size
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(path=folder, **options).load()


def measured(media: DataFrame) -> DataFrame:
    """Digests and feature of each member that was read back."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(8)]
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                label, _, pad = name.rpartition(":")
                key = label.rpartition("-")[0]
                key = None if key == "null" else int(key)
                if data is None:
                    for to, x in zip(out, (key, *[None] * 7)):
                        to.append(x)
                    continue
                samples = from_png(data)
                payload = samples.tobytes()
                for to, x in zip(out, (key, len(payload) - int(pad), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples))):
                    to.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)

        return work

    return map_batches(media.select("name", "content"), make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = temporary(spark, "media")
    return measured(read_archives(spark, folder, manifest_file=write_manifest(write_archives(table(spark, sf_dir, "documents"), folder), folder)))
