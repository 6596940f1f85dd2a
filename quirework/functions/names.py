"""File names, extensions, media types and the names given to outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions.arrays import let


def file_ext(name: Column) -> Column:
    """Lower-case text after the last dot, '' when there is no dot."""
    return F.lower(F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise(""))


def stem(name: Column) -> Column:
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def _safe_ext(name: Column) -> Column:
    """Extension, but a single leading dot does not start one."""
    return F.when(F.regexp_replace(name, r"\.[^.]*$", "") == "", F.lit("")).otherwise(file_ext(name))


def sanitize_filename(name: Column, fallback: str = "download", limit: int = 200) -> Column:
    s = F.replace(F.coalesce(name, F.lit("")), F.lit(".."), F.lit(""))
    s = F.regexp_replace(s, r"[/\\]", "")
    s = F.regexp_replace(s, r"^\.+", "")
    s = F.regexp_replace(s, r"[\x00-\x1f\x7f]", "")
    s = F.regexp_replace(s, r'[<>:"|?*]', "")
    s = F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"^\.+|\.+$", "")

    def shorten(c: Column) -> Column:
        ext = _safe_ext(c)
        cut = F.substring(c, F.lit(1), F.lit(limit) - F.length(ext) - 1)
        return (
            F.when(c == "", F.lit(fallback))
            .when(F.length(c) <= limit, c)
            .when(ext != "", F.concat(cut, F.lit("."), ext))
            .otherwise(cut)
        )

    return let(s, shorten)


def ensure_extension(name: Column, ext: str) -> Column:

    def fix(s: Column) -> Column:
        have = _safe_ext(s)
        base = F.when(
            have != "", F.substring(s, F.lit(1), F.length(s) - F.length(have) - 1)
        ).otherwise(s)
        return F.when(have == ext.lower(), s).otherwise(F.concat(base, F.lit("." + ext)))

    return let(sanitize_filename(name), fix)


# Media type by extension, application/octet-stream otherwise.
MIME_BY_EXT = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "odt": "application/vnd.oasis.opendocument.text",
    "rtf": "application/rtf",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "ppt": "application/vnd.ms-powerpoint",
    "zip": "application/zip",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "webp": "image/webp",
    "svg": "image/svg+xml",
    "txt": "text/plain",
    "json": "application/json",
    "pdf": "application/pdf",
}


def mime_from_name(name: Column) -> Column:
    ext = file_ext(name)
    out = F.lit("application/octet-stream")
    for e, m in reversed(list(MIME_BY_EXT.items())):
        out = F.when(ext == e, F.lit(m)).otherwise(out)
    return out


def split_name(name: Column, start: Column, end: Column, part: Column, parts: Column) -> Column:
    """Name of one part of a split document."""
    base = stem(name)
    pages = F.when(start == end, F.concat(F.lit("page_"), start.cast("string"))).otherwise(
        F.concat(F.lit("pages_"), start.cast("string"), F.lit("-"), end.cast("string"))
    )
    mid = F.when(parts == 1, F.lit("_")).otherwise(
        F.concat(F.lit("_part"), part.cast("string"), F.lit("_"))
    )
    return F.concat(base, mid, pages, F.lit(".pdf"))


def extract_name(name: Column, n_pages: Column, first_pages: Column) -> Column:
    """Name of an extraction; up to three page numbers are listed in it."""
    base = stem(name)
    listed = F.array_join(F.transform(first_pages, lambda p: p.cast("string")), "-")
    return (
        F.when(n_pages == 1, F.concat(base, F.lit("_page_"), listed, F.lit(".pdf")))
        .when(n_pages <= 3, F.concat(base, F.lit("_pages_"), listed, F.lit(".pdf")))
        .otherwise(F.concat(base, F.lit("_"), n_pages.cast("string"), F.lit("_pages_extracted.pdf")))
    )


def merge_name(first: Column, second: Column, n_files: Column) -> Column:
    """Name of a merged document, after its first two sources."""
    return F.when(
        n_files == 2, F.concat(stem(first), F.lit("_"), stem(second), F.lit("_merged.pdf"))
    ).otherwise(
        F.concat(stem(first), F.lit("_and_"), (n_files - 1).cast("string"), F.lit("_more_merged.pdf"))
    )


def indexed_name(name: Column, index: Column) -> Column:
    """``a.pdf`` -> ``a_2.pdf`` for zero-based index 1; no dot -> ``a_2``."""
    k = (index + 1).cast("string")
    dotted = name.rlike(r"^.+\.[^.]+$")
    return F.when(
        dotted, F.concat(stem(name), F.lit("_"), k, F.lit("."), F.substring_index(name, ".", -1))
    ).otherwise(F.concat(name, F.lit("_"), k))


def node_output_names(n: Column, meta_names: Column, filename: Column, label: Column) -> Column:
    """Names for the ``n`` outputs of a step.

    Listed names win when their number fits, then a comma list of file names,
    then an index appended to the file name, then to the cleaned label.
    """
    clean = F.filter(F.transform(meta_names, lambda s: F.trim(s)), lambda s: s != "")
    listed = F.filter(F.transform(F.split(filename, ","), lambda s: F.trim(s)), lambda s: s != "")
    fallback = F.concat(safe_label(label), F.lit("_output.pdf"))
    idx = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    return (
        F.when(F.size(F.coalesce(clean, F.array().cast("array<string>"))) == n, clean)
        .when((filename != "") & (F.size(listed) == n), listed)
        .when(filename != "", F.transform(idx, lambda i: indexed_name(filename, i)))
        .otherwise(F.transform(idx, lambda i: indexed_name(fallback, i)))
    )


def safe_label(label: Column) -> Column:
    clean = F.regexp_replace(F.trim(label), r"\s+", "_")
    return F.when(clean == "", F.lit("workflow_node")).otherwise(clean)
