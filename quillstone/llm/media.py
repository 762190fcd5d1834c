"""Media columns: payloads in image files inside archives, read by a data source of our own.

Writing: each task packs its rows, as 8-bit greyscale PNG images, into ZIP archives of bounded
size in a shared folder. An archive is written under a hidden name and moved to a name made of
its task and number, so a task that runs twice leaves one set of archives.

Reading: the source `media_archive` lists the archives and plans byte ranges over them, several to
a partition where there would be too many. A task reads the archive's directory, takes the members
that begin in its range, reads them in a few large pieces and streams their bytes through Arrow in
bounded batches. Every member is found by its own offset and checked by its CRC; one that fails is
read again on its own from a newly opened file.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import shared_dir, slices

#: Payloads are padded with this byte, which UTF-8 never holds, to rows of WIDTH samples.
PAD, WIDTH = 255, 576
#: An archive is closed beyond so many bytes or members.
ARCHIVE_BYTES, ARCHIVE_MEMBERS = 64 << 20, 20_000
#: Bytes that one read asks for, unless one member alone is larger; partitions of a read at most, about.
READ_BYTES, PARTITIONS = 8 << 20, 50_000
#: Bytes of payload in one Arrow batch, unless one member alone is larger.
BATCH_BYTES = 4 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def padded(data: bytes) -> bytes:
    """The bytes and then PAD up to a positive multiple of WIDTH."""
    return data + bytes([PAD]) * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(payload: bytes) -> bytes:
    """A greyscale PNG of WIDTH samples a row, unfiltered; equal payloads give equal files."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with its filter, 0
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 1)) + _chunk(b"IEND", b"")


def from_image(data: bytes) -> bytes:
    """The samples of an image that `to_image` made."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, shape = 8, b"", None
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(body), np.uint8)
    if shape is None or shape[2:] != (8, 0, 0, 0, 0) or raw.size != shape[1] * (shape[0] + 1):
        raise ValueError("not an unfiltered 8-bit greyscale image")
    raw = raw.reshape(shape[1], shape[0] + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean (thousandths), counts in eight bins, and a 64-bit average hash of an 8 x 8 grid; all in integers."""
    samples = np.frombuffer(payload, np.uint8)
    bins = np.bincount(samples >> 5, minlength=8)
    mean = int(samples.sum(dtype=np.int64)) * 1000 // samples.size
    cells = samples[: samples.size // 64 * 64].reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = "".join("1" if c * 64 >= cells.sum() else "0" for c in cells)
    return f"mean={mean};bins={','.join(map(str, bins))};hash={int(bits, 2):016x}"


def write_archives(rows: DataFrame, path: str) -> DataFrame:
    """Plan of a job that stores (doc_id long, payload text) rows as images in archives below `path`.

    Column 0 is the id, column 1 the text, whose UTF-8 bytes are padded; null counts as empty.
    Returns one row for each archive: archive, members, bytes. The files appear when it runs.
    """

    text_column = rows.columns[1]

    def run(batches):
        store, folder = pafs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        task, number, seen = TaskContext.get().partitionId(), 0, 0
        hidden = stream = archive = None
        members = size = 0

        def close():
            nonlocal number
            archive.close()
            stream.close()
            name = f"part-{task:06d}-{number:05d}.zip"
            store.move(hidden, f"{folder}/{name}")
            number += 1
            return pa.RecordBatch.from_pydict({"archive": [name], "members": [members], "bytes": [size]})

        for b in slices(batches, text_column):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if archive is None:
                    hidden, members, size = f"{folder}/_{uuid.uuid4().hex}", 0, 0
                    stream = store.open_output_stream(hidden)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                image = to_image(padded((text or "").encode()))
                archive.writestr(zipfile.ZipInfo(f"{seen:09d}.{'' if doc_id is None else doc_id}.png"), image)
                members, size, seen = members + 1, size + len(image), seen + 1
                if size >= ARCHIVE_BYTES or members >= ARCHIVE_MEMBERS:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    return rows.mapInArrow(run, "archive string, members long, bytes long")


def stored(piece: bytes, at: int, info: zipfile.ZipInfo) -> bytes:
    """The bytes of the member that begins at `at` in a piece of its archive, checked."""
    head = piece[at : at + 30]
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member begins here")
    skip = at + 30 + sum(struct.unpack("<HH", head[26:30]))
    data = piece[skip : skip + info.compress_size]
    if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise ValueError("damaged member")
    return data


class ByteRanges(InputPartition):
    """Byte ranges (archive, start, end): the members that begin at offsets from start up to, not including, end."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split: int, tries: int, keep_errors: bool):
        self.path, self.split, self.tries, self.keep_errors = path, split, tries, keep_errors

    def partitions(self) -> list[ByteRanges]:
        """Byte ranges of `split` bytes over all archives, hidden files left out.

        Beyond PARTITIONS of them, ranges that follow each other share a partition.
        """
        store, folder = pafs.FileSystem.from_uri(self.path)
        found = store.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
        ranges = [
            (f.path, at, at + self.split)
            for f in sorted(found, key=lambda f: f.path)
            if f.type == pafs.FileType.File and f.base_name.endswith(".zip") and f.base_name[0] not in "_."
            for at in range(0, max(1, f.size), self.split)
        ]
        together = max(1, -(-len(ranges) // PARTITIONS))
        return [ByteRanges(ranges[i : i + together]) for i in range(0, len(ranges), together)] or [ByteRanges([])]

    def members(self, store, archive: str, start: int, end: int) -> Iterator[tuple[zipfile.ZipInfo, bytes | None, str | None]]:
        """The members of a range: directory entry, bytes and error. One open, and a few large reads, unless something fails."""
        with store.open_input_file(archive) as f:
            with zipfile.ZipFile(f) as directory:
                infos = sorted(directory.infolist(), key=lambda i: i.header_offset)
                ends = [*(i.header_offset for i in infos[1:]), directory.start_dir]
            own = [(i, e) for i, e in zip(infos, ends, strict=True) if start <= i.header_offset < end]
            at = 0
            while at < len(own):
                first = own[at][0].header_offset
                last = at + 1
                while last < len(own) and own[last][1] - first <= READ_BYTES:
                    last += 1
                try:
                    piece = f.read_at(own[last - 1][1] - first, first)
                except OSError:
                    piece = b""
                for info, _ in own[at:last]:
                    try:
                        yield info, stored(piece, info.header_offset - first, info), None
                    except (struct.error, ValueError):
                        yield info, *self.member(store, archive, info)
                at = last

    def member(self, store, archive: str, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """Bytes of one stored member, found by its offset alone; each try opens the file anew."""
        error = None
        for attempt in range(self.tries):
            try:
                with store.open_input_file(archive) as f:
                    head = f.read_at(30, info.header_offset)
                    rest = sum(struct.unpack("<HH", head[26:30])) + info.compress_size
                    return stored(head + f.read_at(rest, info.header_offset + 30), 0, info), None
            except (OSError, ValueError, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(0.05 * attempt)
        return None, error

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {"archive": [], "member": [], "offset": [], "media": [], "error": []}
        held = 0

        def batch():
            made = pa.RecordBatch.from_arrays(
                [pa.array(rows["archive"], pa.string()), pa.array(rows["member"], pa.string()), pa.array(rows["offset"], pa.int64()), pa.array(rows["media"], pa.binary()), pa.array(rows["error"], pa.string())],
                names=list(rows),
            )
            for column in rows.values():
                column.clear()
            return made

        store, _ = pafs.FileSystem.from_uri(self.path)
        for archive, start, end in partition.ranges:
            for info, data, error in self.members(store, archive, start, end):
                if error and not self.keep_errors:
                    raise OSError(f"{archive}, member at {info.header_offset}: {error}")
                for name, value in zip(rows, (archive, info.filename, info.header_offset, data, error), strict=True):
                    rows[name].append(value)
                held += len(data or b"")
                if held >= BATCH_BYTES:
                    yield batch()
                    held = 0
        yield batch()


class ArchiveSource(DataSource):
    """`spark.read.format("media_archive")` with options path, split_bytes, tries and on_error.

    A member that stays unreadable after `tries` ends the task (on_error "raise", the default) or
    gives a row with null media and the reason in `error` (on_error "keep").
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        o = self.options
        return ArchiveReader(o["path"], int(o.get("split_bytes", 16 << 20)), int(o.get("tries", 4)), o.get("on_error", "raise") == "keep")


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """All members of the archives below `path`."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(path=path, **options).load()


def features(media: DataFrame) -> DataFrame:
    """Decode each image and describe its payload; columns as in FEATURES."""

    def run(batches):
        for b in slices(batches, "media"):
            out: list[list] = [[] for _ in range(8)]
            for member, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                payload, doc_id = from_image(data), member.split(".")[1]
                row = (
                    int(doc_id) if doc_id else None, len(payload.rstrip(bytes([PAD]))), len(payload), hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload),
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[f.split()[0] for f in FEATURES.split(", ")])

    return media.select("member", "media").mapInArrow(run, FEATURES)


def media_features(docs: DataFrame) -> DataFrame:
    """Store every text of `docs` as an image, read the images back and describe them.

    One row a document. A null or empty text is one row of padding (n_bytes 0); a null doc_id
    stays null; repeated rows are stored once each; an empty table gives no rows; other columns
    are not read. Equal texts give equal values. A text is held whole by the task that stores it.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    write_archives(docs.select("doc_id", "text"), path).write.parquet(f"{path}/_written")
    return features(read_archives(spark, path))
