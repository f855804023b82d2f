"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that count as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space, the Unicode kinds too, from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for NULL, empty and white-space-only text. Looks no further than the first other character."""
    return F.coalesce(F.ltrim(text, F.lit(WHITESPACE)), F.lit("")) == ""


def first_filled(*texts: Column) -> Column:
    """The first text that is neither NULL nor empty; the last one whatever it is. White space counts as filled."""
    *head, last = texts
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in head], last)


def safe_file_stem(name: Column) -> Column:
    """A name usable in a file path: no slashes, at most 60 characters, never empty."""
    filled = F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))
    return F.substring(F.translate(filled, "/\\", "__"), 1, 60)


def bundle_file(sample: Column, name: Column, sequence: Column) -> Column:
    """Path of one exported image: <sample>/<name>_<three-digit sequence>.jpg."""
    return F.format_string("%s/%s_%03d.jpg", sample, safe_file_stem(name), sequence)
