"""File names, image suffixes and archive member addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ARCHIVE_SCHEME = "tar://"
MEMBER_MARK = "::"
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tiff", ".tif")


def member_uri(archive: Column, member: Column) -> Column:
    return F.concat(F.lit(ARCHIVE_SCHEME), archive, F.lit(MEMBER_MARK), member)


def is_member_uri(path: Column) -> Column:
    return path.startswith(ARCHIVE_SCHEME)


def split_member_uri(path: Column) -> Column:
    """STRUCT<archive, member>, cut at the first mark; both NULL for other paths."""
    body = F.when(is_member_uri(path), F.substr(path, F.lit(len(ARCHIVE_SCHEME) + 1)))
    parts = F.split(body, MEMBER_MARK, 2)
    return F.struct(
        F.when(F.size(parts) == 2, F.get(parts, 0)).alias("archive"),
        F.when(F.size(parts) == 2, F.get(parts, 1)).alias("member"),
    )


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The last dotted part of the file name; '' for none, or for a name that only starts with a dot."""
    return F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """File name without its suffix."""
    name = file_name(path)
    return F.left(name, F.length(name) - F.length(suffix(path)))


def is_image(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*IMAGE_SUFFIXES)


def plain_path(path: Column) -> Column:
    """A listed path as users write it: without the scheme of the local file system."""
    return F.regexp_replace(path, r"^file:/+", "/")


def decode_metadata_path(path: Column) -> Column:
    """`_metadata.file_path` percent-encodes some characters, but never '+'."""
    return plain_path(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def escape_glob(path: str) -> str:
    """A literal path for the readers, which would take these characters as patterns."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path)
