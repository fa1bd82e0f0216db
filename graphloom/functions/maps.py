"""Closed vocabularies: file extension to node type and MIME type, node type to bucket.

The tables are small constants; they are applied as map literals inside the projection.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Node types by file extension; anything else is a note.
NODE_TYPES = {
    "pdf": ["pdf"], "slides": ["pptx", "ppt"], "docx": ["docx", "doc"], "spreadsheet": ["xlsx", "xls", "csv"], "email": ["msg"],
    "image": ["png", "jpg", "jpeg", "gif", "webp", "bmp", "svg"],
    "code": [
        "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "rs", "go", "java", "cs", "cpp", "cc", "cxx", "c", "h", "hpp", "rb", "php", "kt", "swift", "scala", "lua",
        "sh", "bash", "zsh", "ps1", "psm1", "sql", "toml", "yaml", "yml", "ini", "cfg", "conf", "json", "xml", "html", "htm", "css", "scss", "sass",
    ],
}
#: Buckets of a project page by node type, in the order of the page.
BUCKETS = {"note": "paragraphs", "docx": "documents", "slides": "slides", "pdf": "pdfs", "spreadsheet": "spreadsheets", "email": "emails", "image": "images", "code": "code", "url": "links"}
BUCKET_NAMES = list(BUCKETS.values())
#: MIME types by extension; anything else has none.
MIME_TYPES = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "txt": "text/plain", "md": "text/markdown", "html": "text/html", "msg": "application/vnd.ms-outlook",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def extension(filename: Column) -> Column:
    """What follows the last dot, in lower case; the whole name where it has no dot."""
    return F.lower(F.substring_index(filename, ".", -1))


def node_type_of(filename: Column) -> Column:
    return F.coalesce(_lookup({e: t for t, es in NODE_TYPES.items() for e in es}, extension(filename)), F.lit("note"))


def bucket_of(node_type: Column) -> Column:
    """Bucket of a node type, null for types that belong to none."""
    return _lookup(BUCKETS, node_type)


def mime_of(ext: Column) -> Column:
    """MIME type of an extension with or without its dot; the empty string for unknown ones."""
    return F.coalesce(_lookup(MIME_TYPES, F.regexp_replace(F.lower(ext), r"^\.", "")), F.lit(""))


#: MIME types by extension of images within office files; others cannot be shown.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "jfif": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml"}


def image_mime_of(ext: Column) -> Column:
    """MIME type of an embedded image by its extension; null for those that browsers do not show, as TIFF and Windows metafiles."""
    return _lookup(IMAGE_TYPES, ext)
