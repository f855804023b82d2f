"""Image bytes out of tar archives and plain files, in place."""

from __future__ import annotations

import posixpath
import tarfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traincover.functions.paths import (
    ARCHIVE_SCHEME, MEMBER_MARK, plain_path, split_member_uri,
)
from traincover.sources.annotations import list_files

# Rows wait for their output batch until it holds this many bytes.
BATCH_BYTES = 32 << 20
OPEN_ARCHIVES = 8
# Columns that `locate` adds.
LOCATION = ("member_offset", "member_bytes")

# Leading bytes of the readable image formats.
IMAGE_SIGNATURES = (
    b"\xff\xd8\xff",        # JPEG
    b"\x89PNG\r\n\x1a\n",   # PNG
    b"BM",                  # BMP
    b"II*\x00",             # TIFF, little-endian
    b"MM\x00*",             # TIFF, big-endian
)


def looks_like_image(data: bytes | None) -> bool:
    """Signature test; it stands in for a full decode, which needs an imaging library."""
    if not data:
        return False
    return data.startswith(IMAGE_SIGNATURES) or (data[:4] == b"RIFF" and data[8:12] == b"WEBP")


def open_binary(path: str):
    """A seekable file: local path, or any URI of a file system Arrow knows."""
    if "://" not in path:
        return open(path.removeprefix("file:"), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def walk(tar: tarfile.TarFile) -> Iterator[tarfile.TarInfo]:
    """The entries of an archive, one at a time: nothing is kept of those passed."""
    while (info := tar.next()) is not None:
        tar.members = []
        yield info


class MemberReader:
    """Reads members of a few archives at a time. Use one per task: rows of an archive mostly come together.

    Of an archive only names and places are kept.
    """

    def __init__(self):
        self._open: dict[str, tuple[tarfile.TarFile, dict[str, tuple[int, int] | str]]] = {}
        self._raw: dict[str, object] = {}

    def _archive(self, path: str):
        if path not in self._open:
            if len(self._open) >= OPEN_ARCHIVES:
                self._open.pop(next(iter(self._open)))[0].close()
            tar = tarfile.open(fileobj=open_binary(path), mode="r")
            places: dict[str, tuple[int, int] | str] = {}
            for info in walk(tar):  # a repeated name: the last one counts
                if info.isreg():
                    places[info.name] = (info.offset_data, info.size)
                elif info.islnk():
                    places[info.name] = info.linkname
                elif info.issym():
                    places[info.name] = posixpath.normpath(posixpath.join(posixpath.dirname(info.name), info.linkname))
            self._open[path] = (tar, places)
        return self._open[path]

    def _span(self, path: str, offset: int, size: int) -> bytes:
        if path not in self._raw:
            if len(self._raw) >= OPEN_ARCHIVES:
                self._raw.pop(next(iter(self._raw))).close()
            self._raw[path] = open_binary(path)
        self._raw[path].seek(offset)
        return self._raw[path].read(size)

    def read(self, path: str | None, offset: int | None = None, size: int | None = None) -> bytes | None:
        """The bytes behind a path or a member address; None when they cannot be read.

        A known place in the archive spares the walk through its headers.
        """
        if path is None:
            return None
        try:
            if not path.startswith(ARCHIVE_SCHEME):
                with open_binary(path) as plain:
                    return plain.read()
            archive, member = path[len(ARCHIVE_SCHEME):].split(MEMBER_MARK, 1)
            if offset is not None:
                return self._span(archive, offset, size)
            tar, places = self._archive(archive)
            place, passed = places[member], {member}
            while isinstance(place, str):  # links, unless they lead in a circle
                if place in passed:
                    return None
                passed.add(place)
                place = places[place]
            tar.fileobj.seek(place[0])
            return tar.fileobj.read(place[1])
        except (OSError, KeyError, ValueError, tarfile.TarError):
            return None

    def read_batch(self, batch: pa.RecordBatch, path: str) -> Iterator[bytes | None]:
        """The bytes of each row, in order; uses the places added by `locate` where there are any."""
        addresses = batch.column(path).to_pylist()
        if LOCATION[0] not in batch.schema.names:
            yield from map(self.read, addresses)
            return
        places = (batch.column(name).to_pylist() for name in LOCATION)
        yield from map(self.read, addresses, *places)


def list_members(spark: SparkSession, pattern: str) -> DataFrame:
    """(archive, member, member_offset, member_bytes) of the files in all archives matching the path pattern.

    One pass over the headers of each archive. Links are not listed.
    """
    folder, _, name = pattern.rpartition("/")
    archives = list_files(spark, folder, name).select(plain_path(F.col("path")).alias("archive"))
    schema = pa.schema([
        ("archive", pa.string()), ("member", pa.string()), (LOCATION[0], pa.int64()), (LOCATION[1], pa.int64())
    ])

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with open_binary(archive) as source, tarfile.open(fileobj=source, mode="r:") as tar:
                    files = (i for i in walk(tar) if i.isreg())
                    while part := list(islice(files, 10_000)):
                        yield pa.RecordBatch.from_arrays([
                            pa.array([archive] * len(part)), pa.array([i.name for i in part]),
                            pa.array([i.offset_data for i in part]), pa.array([i.size for i in part]),
                        ], schema=schema)

    return archives.repartition("archive").mapInArrow(
        listing, f"archive string, member string, {LOCATION[0]} long, {LOCATION[1]} long"
    )


def locate(rows: DataFrame, members: DataFrame, path: str = "image_path") -> DataFrame:
    """Add each member's place in its archive, NULL for unknown ones.

    For archives so large that many tasks read from one: they then need no walk through its headers each. The join
    key is archive and member, so a hot archive does not make a hot key.
    """
    latest = members.groupBy("archive", "member").agg(
        F.max(F.struct(*LOCATION)).alias("place")  # a repeated name: the last one counts
    )
    address = split_member_uri(F.col(path))
    keyed = rows.withColumns({"_archive": address["archive"], "_member": address["member"]})
    return keyed.join(
        latest, (F.col("_archive") == F.col("archive")) & (F.col("_member") == F.col("member")), "left"
    ).select(*rows.columns, *[F.col(f"place.{name}").alias(name) for name in LOCATION])


def read_images(rows: DataFrame, path: str = "image_path", out: str = "content") -> DataFrame:
    """Add the bytes behind `path`; NULL when unreadable. Map-only, output batches bounded by bytes.

    Annotation rows arrive shard by shard, so each task opens its own shard's archive once and a large shard is
    already split over tasks by its annotation file. Use `gather_by_archive` first for rows in mixed order.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())])

    def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = MemberReader()
        for batch in batches:
            start, contents, held = 0, [], 0
            for i, data in enumerate(reader.read_batch(batch, path)):
                contents.append(data)
                held += len(data or b"")
                if held >= BATCH_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(start, len(contents))
                    columns = [*part.columns, pa.array(contents, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, out])
                    start, contents, held = i + 1, [], 0

    return rows.mapInArrow(reading, schema)


def gather_by_archive(rows: DataFrame, path: str = "image_path", splits: int = 16) -> DataFrame:
    """Bring rows of one archive together, in up to `splits` tasks each, so that a hot archive stays parallel."""
    archive = F.coalesce(split_member_uri(F.col(path))["archive"], F.col(path))
    salt = F.pmod(F.xxhash64(F.col(path)), F.lit(splits))
    return rows.repartition(archive, salt).sortWithinPartitions(archive)


def readable(rows: DataFrame, path: str = "image_path", out: str = "image_readable", decoder=None) -> DataFrame:
    """Add whether the image behind `path` can be read: present, and `decoder` (default: signature) accepts it."""
    accepts = decoder or looks_like_image
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BooleanType())])

    def checking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = MemberReader()
        for batch in batches:
            verdicts = [bool(accepts(data)) for data in reader.read_batch(batch, path)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(verdicts, pa.bool_())], names=[*batch.schema.names, out]
            )

    return rows.mapInArrow(checking, schema)


