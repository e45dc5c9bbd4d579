"""Path and URI rules over path strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import whole_number

# File suffixes that count as images, and the corpus naming rules.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "gif", "tiff")
PAGES_SEGMENT = "pages"
URI_PATH_PARAMETERS = ("file", "d")
IMAGE_FIELD = "image"


def is_image(path: Column) -> Column:
    """True for a known image suffix in either case."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The last segment without its final suffix; a leading dot is part of the name."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def page_subject_year(path: Column) -> Column:
    """``struct(subject, year)`` around the first ``pages`` segment, null when it has no room."""
    parts = F.split(path, "/")
    at = F.array_position(parts, PAGES_SEGMENT)
    fits = (at >= 3) & (at < F.size(parts))
    return F.when(
        fits,
        F.struct(
            F.try_element_at(parts, (at - 2).cast("int")).alias("subject"),
            F.try_element_at(parts, (at + 1).cast("int")).alias("year"),
        ),
    )


def sheet_year_number(sheet_stem: Column) -> Column:
    """``struct(year, sheet)`` of ``2016`` or ``2016_2``; a prefix match, sheet 1 when unnamed, null when no long holds its number."""
    year = whole_number(F.regexp_extract(sheet_stem, r"^(\d{4})", 1), "int")
    named = F.regexp_extract(sheet_stem, r"^\d{4}_(\d+)", 1)
    sheet = F.when(named == "", F.lit(1).cast("long")).otherwise(named.try_cast("long"))
    return F.when(year.isNotNull(), F.struct(year.alias("year"), sheet.alias("sheet")))


def question_digits(path: Column) -> Column:
    """The number an image file is named by, as text of any length without leading zeros; null for any other name."""
    # One pattern: a rule put together of several is worked out anew wherever a filter repeats it.
    return F.nullif(F.regexp_extract(path, rf"(?:^|/)0*(\d+)\.(?i:{'|'.join(IMAGE_SUFFIXES)})\z", 1), F.lit(""))


def question_number(path: Column) -> Column:
    """The number an image file is named by; null for any other name and where no long holds it (see :func:`question_digits`)."""
    return question_digits(path).try_cast("long")


def question_path(year_dir: Column, option: Column, part: Column, number: Column, fmt: Column) -> Column:
    name = F.concat(number.cast("string"), F.lit("."), fmt)
    return F.concat_ws("/", year_dir, option.cast("string"), part, name)


def object_key(root: str, path: Column) -> Column:
    """*path* below *root* with forward slashes, null when it lies elsewhere."""
    clean_root = root.replace("\\", "/").rstrip("/") + "/"
    clean = F.translate(path, "\\", "/")
    return F.when(clean.startswith(clean_root), F.substring(clean, len(clean_root) + 1, 2**31 - 1))


def local_root(root: str) -> str:
    """A folder as paths below it are compared: without the scheme of the local file system."""
    return re.sub(r"^file:/+", "/", root)


def page_name(number: Column, fmt: Column) -> Column:
    """Three-digit page name; longer numbers keep all their digits."""
    return F.format_string("%03d.%s", number, fmt)


def training_name(subject: Column, year: Column, page_stem: Column) -> Column:
    return F.concat(subject, F.lit("_"), year, F.lit("_"), page_stem, F.lit(".jpg"))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def local_file_path(uri: Column) -> Column:
    """The file a ``local-files`` URI names, null for a remote address.

    The value is decoded twice (once as a query, once as a path) and then written with single forward
    slashes and without ``.`` segments.
    """
    query = F.regexp_extract(uri, r"^[^?#]*\?([^#]*)", 1)
    raw = F.coalesce(
        *[F.nullif(F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1), F.lit("")) for name in URI_PATH_PARAMETERS]
    )
    once = _decode(raw)
    # A path has no plus-for-space rule, so pluses are kept through the second decoding.
    twice = F.coalesce(F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B"))), once)
    slashed = F.regexp_replace(F.translate(twice, "\\", "/"), "/+", "/")
    dotless = F.regexp_replace(F.regexp_replace(slashed, r"(?:/\.)+(?=/|$)", ""), r"^(?:\./)+", "")
    return F.when(F.length(dotless) > 1, F.regexp_replace(dotless, "/$", "")).otherwise(dotless)


def task_image_path(data: Column) -> Column:
    """First entry of a task's field map that names a local file, the ``image`` field ahead of the rest."""
    entries = F.map_entries(data)
    ordered = F.concat(
        F.filter(entries, lambda e: e["key"] == IMAGE_FIELD),
        F.filter(entries, lambda e: e["key"] != IMAGE_FIELD),
    )
    paths = F.filter(F.transform(ordered, lambda e: local_file_path(e["value"])), lambda p: p.isNotNull())
    return F.try_element_at(paths, F.lit(1))


def resolve_against(path: Column, root: str) -> Column:
    """An absolute path stays, a relative one is read below *root*."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
