"""Column functions over file names, paths and media attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions.
VIDEO_EXTENSIONS = (".mp4", ".webm", ".mov", ".mkv", ".m4v", ".avi")
MAYBE_ANIMATED_EXTENSIONS = (".png", ".webp")
#: The kinds of a picture.
MEME_TYPES = ("reaction", "image-macro", "comic", "screenshot", "text-post", "photo", "drawing", "chart", "template", "other")


def extension(name: Column) -> Column:
    """Lower-case extension with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]+$", "")


def classify_media_type(ext: Column, animated: Column, video_extensions: tuple[str, ...] = VIDEO_EXTENSIONS) -> Column:
    """video by extension, gif for .gif and for animated .png and .webp, else image."""
    low = F.lower(ext)
    moving = F.coalesce(animated, F.lit(False)) & low.isin(*MAYBE_ANIMATED_EXTENSIONS)
    return F.when(low.isin(*video_extensions), "video").when((low == ".gif") | moving, "gif").otherwise("image")


def category_from_path(rel_path: Column) -> Column:
    """Name of the first ancestor folder written like ``07-name`` or ``07 name``; null if there is none."""
    parts = F.split(rel_path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    numbered = F.get(F.filter(folders, lambda p: p.rlike(r"^\d{2}[\s-]+.+$")), F.lit(0))
    return F.replace(F.lower(F.trim(F.regexp_extract(numbered, r"^\d{2}[\s-]+(.+)$", 1))), F.lit(" "), F.lit("-"))


def category_folder(number: Column, slug: Column) -> Column:
    """Two digits, a hyphen and at most 30 characters of the slug."""
    return F.format_string("%02d-%s", number, F.substring(slug, 1, 30))
