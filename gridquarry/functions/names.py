"""Column functions for names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAT_SUFFIXES = (".png", ".jpg", ".jpeg")
PYRAMID_SUFFIXES = (".svs", ".tif", ".tiff")


def optional_path(c: Column) -> Column:
    """Blank, none and nan, in any case, stand for a missing path."""
    trimmed = F.trim(c)
    return F.when(F.lower(trimmed).isin("", "none", "nan"), None).otherwise(trimmed)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_flat_annotation(c: Column) -> Column:
    return c.isNull() | (c == "tissue")


def artifact_stem(sample: Column, annotation: Column) -> Column:
    """The annotation is a folder of its own unless it is the plain tissue result."""
    return F.when(is_flat_annotation(annotation), sample).otherwise(F.concat_ws("/", annotation, sample))


def valid_annotation(c: Column) -> Column:
    """A name that is safe as one folder: no separators, no dots alone, not blank, nothing to trim."""
    bad = c.isNull() | (F.trim(c) == "") | (F.trim(c) != c) | c.isin(".", "..") | c.contains("/") | c.contains("\\") | c.contains("\x00")
    return ~bad
