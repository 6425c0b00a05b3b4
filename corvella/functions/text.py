"""Column functions over text and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by modality.
IMAGES = ("bmp", "gif", "jpeg", "jpg", "png", "tiff", "webp")
SOUNDS = ("flac", "m4a", "mp3", "ogg", "wav", "webm")


def tokens(text: Column) -> Column:
    """Lower-cased runs of Unicode letters, digits and underscores; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.array().cast("array<string>"))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def extension(path: Column) -> Column:
    """Lower-case extension with its point, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./\\]+)$", 1))


def key_label(key: Column) -> Column:
    """How a key shows in logs: its first eight characters, stars if short, ``local-admin`` if none."""
    return F.when(key.isNull() | (key == ""), F.lit("local-admin")).when(F.length(key) <= 8, F.lit("***")).otherwise(F.concat(F.substring(key, 1, 8), F.lit("...")))


def preview(text: Column, size: int = 80) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def modality(path: Column, exists: Column) -> Column:
    """``image`` or ``audio`` by the extension of a file that exists, else ``text``."""
    ext = F.substring(extension(path), 2, 20)
    return F.when(exists & ext.isin(*IMAGES), "image").when(exists & ext.isin(*SOUNDS), "audio").otherwise("text")


def remote_key(prefix: str, name: Column) -> Column:
    clean = prefix.rstrip("/")
    return F.concat(F.lit(f"{clean}/" if clean else ""), name)


def snapshot_name(stem: str, at: Column, suffix: str = ".parquet") -> Column:
    return F.concat(F.lit(f"{stem}_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(suffix))


def seconds(created: Column) -> Column:
    """Unix seconds; values in milliseconds are scaled."""
    return F.when(created > 1e11, created / 1000).otherwise(created)
