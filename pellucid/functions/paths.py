"""Path and URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def has_scheme(path: Column) -> Column:
    return F.contains(path, F.lit("://"))


def normalize_lexical(path: Column, base: str = "/data") -> Column:
    """An absolute path without ``.`` and ``..``; null and blank give '', paths with a scheme stay as they are.

    Relative paths are below ``base``. Symbolic links are not looked up: that needs the machine that has them.
    """
    s = strip(path)
    whole = F.when(F.startswith(s, F.lit("/")), s).otherwise(F.concat(F.lit(base + "/"), s))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))

    def step(acc: Column, p: Column) -> Column:
        return F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(path.isNull() | (s == ""), "").when(has_scheme(s), path).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def resolve(path: Column, csv_dir: Column, image_root: str | None = None) -> Column:
    """A manifest path: URLs as they are, absolute paths normalized, others below image_root or else the CSV's folder."""
    s = strip(path)
    root = F.lit(image_root) if image_root else csv_dir
    below = F.concat(root, F.lit("/"), s)
    return F.when(has_scheme(s), s).otherwise(normalize_lexical(F.when(F.startswith(s, F.lit("/")), s).otherwise(below)))


def candidates(raw: Column, normalized: Column) -> Column:
    """Keys to look a path up by, in order."""
    return F.filter(F.array_distinct(F.array(raw, normalized)), lambda x: x.isNotNull() & (x != ""))


def result_id(path: Column) -> Column:
    """The result file of an image."""
    return F.concat(F.md5(path), F.lit(".json"))


def session_id(path: Column, b64: Column) -> Column:
    return F.sha2(F.coalesce(path, b64), 256)


def is_url(path: Column) -> Column:
    """Has both a scheme and a host."""
    return path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")


def base_url(url: Column, fallback: str = "https://api.openai.com/v1") -> Column:
    """A service's base address: https unless given, no query, path ending in /v1; null if it has no host."""
    s = F.trim(F.coalesce(F.nullif(url, F.lit("")), F.lit(fallback)))
    s = F.when(s.rlike("^https?://"), s).otherwise(F.concat(F.lit("https://"), s))
    scheme = F.regexp_extract(s, "^(https?)://", 1)
    host = F.regexp_extract(s, "^https?://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(s, "^https?://[^/?#]*([^?#]*)", 1), "/+$", "")
    full = F.when(F.endswith(path, F.lit("/v1")), path).otherwise(F.concat(path, F.lit("/v1")))
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, full))


def data_url(content: Column, fmt: Column) -> Column:
    """Of any length on one line: Spark's base64 has a line break after every 76 characters."""
    return F.concat(F.lit("data:image/"), F.lower(fmt), F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def decode_base64(s: Column) -> Column:
    """The bytes after the last comma of a data URL, or of plain base64."""
    return F.unbase64(F.element_at(F.split(s, ","), -1))


def format_of(path: Column) -> Column:
    """The upper-case suffix, or JPEG."""
    return F.upper(F.coalesce(F.nullif(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1), F.lit("")), F.lit("jpeg")))
