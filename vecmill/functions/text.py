"""Column expressions over prompts, names and media parts."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MEDIA_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp",
    "mp4": "video/mp4", "mov": "video/quicktime", "avi": "video/x-msvideo", "mkv": "video/x-matroska", "webm": "video/webm",
    "mp3": "audio/mpeg", "wav": "audio/wav", "flac": "audio/flac", "pdf": "application/pdf", "html": "text/html", "txt": "text/plain",
}
BLANK = " \t\n\r\x0b\x0c"


def normalized_prompt(t: Column) -> Column:
    """Image marks become spaces, line ends \\n, ends of lines and of the whole lose their white space."""
    t = F.replace(F.replace(t, F.lit("<|image_1|>"), F.lit(" ")), F.lit("<image>"), F.lit(" "))
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, "[ \t]+(\n|$)", "$1")
    return F.btrim(t, F.lit(BLANK))


def joined_prompt(*parts: Column) -> Column:
    """The parts that aren't empty, normalised, a line each."""
    return F.btrim(F.concat_ws("\n", *[F.nullif(normalized_prompt(p), F.lit("")) for p in parts]), F.lit(BLANK))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def media_type(name: Column) -> Column:
    """By extension; null where that isn't known (``require_media_type`` fails there)."""
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.element_at(table, extension(name))


def require_media_type(name: Column) -> Column:
    return F.coalesce(media_type(name), F.raise_error(F.concat(F.lit("no media type is known for "), name)))


def slug(t: Column, default: str = "untitled") -> Column:
    """Lower case; runs of what isn't a letter, digit, dot, line or hyphen become _; none of these at the ends."""
    s = F.btrim(F.regexp_replace(t, "[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.when(s == "", default).otherwise(F.lower(s))


def cache_stem(t: Column, most: int = 80) -> Column:
    return F.left(F.btrim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "_"), F.lit("_")), F.lit(most))


def short_name(path: Column, default: str = ".png") -> Column:
    """The name's first 50 characters, eight digits of the whole path's MD5, and the extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    return F.concat(F.left(stem, F.lit(50)), F.lit("_"), F.left(F.md5(path), F.lit(8)), F.when(ext == "", default).otherwise(ext))


def sampled_evenly(items: Column, most: int) -> Column:
    """At most ``most`` items at even distances, the ends included; halves are rounded to even."""
    last = F.size(items) - 1
    if most <= 1:
        return F.slice(items, 1, max(most, 0))
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i.cast("double") * last / (most - 1)).cast("int")))
    return F.when(F.size(items) <= most, items).otherwise(F.transform(at, lambda i: F.get(items, i)))


def parts_with_values(parts: Column) -> Column:
    return F.filter(parts, lambda p: F.coalesce(p["value"], F.lit("")) != "")


def media_signature(parts: Column) -> Column:
    """SHA-256 of the parts' kinds, types and values in a fixed JSON form."""
    return F.sha2(F.to_json(F.transform(parts, lambda p: F.struct(p["kind"].alias("kind"), p["mime_type"].alias("mime_type"), p["value"].alias("value")))), 256)


def cache_key(model: str, dim: int, task_type: str, signature: Column) -> Column:
    return F.concat_ws(":", F.lit(model), F.lit(str(dim)), F.lit(task_type), signature)


def first_present(df, *names: str, default=None) -> Column:
    """The first of the columns that exist which isn't null."""
    have = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(default)) if have else F.lit(default)


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def evenly(items: list, most: int) -> list:
    """``sampled_evenly`` for a list."""
    if len(items) <= most:
        return list(items)
    if most <= 1:
        return items[:most]
    return [items[i] for i in sorted({round(k * (len(items) - 1) / (most - 1)) for k in range(most)})]


def n_batches(rows: int, size: int) -> int:
    return math.ceil(rows / size)
