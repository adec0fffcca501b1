"""Relative paths, object keys and file records of image collections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INVALID_PATH = "__invalid_path__"
# Suffixes of image files that are taken off a name, longest first.
IMAGE_SUFFIXES = (".nii.gz", ".dicom", ".tiff", ".jpeg", ".nrrd", ".nii", ".dcm", ".png", ".jpg", ".tif", ".mha")
FILES = "array<struct<role:string,path:string,uri:string,file:string>>"


def safe_relative(c: Column) -> Column:
    """The path if it is relative and without control characters, backslash, drive, empty, . or .. component; else INVALID_PATH."""
    bad = c.isNull() | (c == "") | c.rlike(r"[\x00-\x1f\x7f\\]") | c.rlike("^/") | c.rlike("^[A-Za-z]:") | F.exists(F.split(c, "/"), lambda p: p.isin("", ".", ".."))
    return F.when(bad, F.lit(INVALID_PATH)).otherwise(c)


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


_SUFFIX = "(?i)(" + "|".join(s.replace(".", r"\.") for s in IMAGE_SUFFIXES) + ")$"


def without_suffix(c: Column) -> Column:
    """The path without its image suffix, whatever its case."""
    return F.regexp_replace(c, _SUFFIX, "")


def suffix_rank(c: Column) -> Column:
    """The place of the path's image suffix in the list of suffixes, from 0; null without one."""
    found = F.array_position(F.array(*[F.lit(s) for s in IMAGE_SUFFIXES]), F.lower(F.regexp_extract(c, _SUFFIX, 1)))
    return F.when(found > 0, found - 1)


def stem(c: Column) -> Column:
    """The name without its image suffix, whatever its case."""
    return without_suffix(base_name(c))


def bucket(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, "^s3://([^/]+)", 1), F.lit(""))


def object_key(uri: Column) -> Column:
    return F.when(uri.rlike("^s3://[^/]+/"), F.regexp_replace(uri, "^s3://[^/]+/", ""))


def below_prefix(uri: Column, prefix: str) -> Column:
    """The rest of a URI after a prefix, which ends with one slash; null if it does not begin with it."""
    root = prefix.rstrip("/") + "/"
    return F.when(uri.startswith(root), F.substring(uri, len(root) + 1, 1 << 30))


def primary_file(files_json: Column) -> Column:
    """Of a JSON list of files the first whose role is image or primary, else the first: its path, uri or file."""
    files = F.from_json(files_json, FILES)
    main = F.filter(files, lambda f: F.lower(f["role"]).isin("image", "primary"))
    one = F.when(F.size(main) > 0, F.try_element_at(main, F.lit(1))).otherwise(F.try_element_at(files, F.lit(1)))
    text = lambda k: F.nullif(one[k], F.lit(""))
    return F.coalesce(text("path"), text("uri"), text("file"))


def first_path(*candidates: Column) -> Column:
    """The first candidate that is a safe relative path; INVALID_PATH if none is."""
    return F.coalesce(*[F.nullif(safe_relative(c), F.lit(INVALID_PATH)) for c in candidates], F.lit(INVALID_PATH))
