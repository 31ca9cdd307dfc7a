"""Image kinds by signature, and names of localised images, as expressions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import escape_alt

#: Patterns that make an SVG unsafe, fixed values.
UNSAFE_SVG = (
    r"(?i)<script[\s>]",
    r"(?i)<(?:iframe|object|embed|link|meta|audio|video)[\s>]",
    r"(?i)\son[a-z]+\s*=",
    r"(?i)javascript\s*:",
    r"(?i)(?:href|src)\s*=\s*[\"']\s*data\s*:(?!image/(?:png|jpeg|gif|webp|avif)\s*;\s*base64\s*,)",
    r"(?i)(?:href|src)\s*=\s*[\"']\s*https?://",
    r"(?i)url\(\s*[\"']?\s*https?://",
    r"(?i)@import\b",
)


def sniff(content: Column, content_type: Column | None = None) -> Column:
    """MIME type by magic bytes; null for other contents, unsafe SVG, and other declared types."""
    head = F.hex(F.substring(content, 1, 32))
    text = F.regexp_replace(F.try_validate_utf8(content.cast("string")), r"^\ufeff?\s+|^\ufeff", "")
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1))) if content_type is not None else F.lit("")
    lead = F.left(text, F.lit(256 * 1024))
    svg = ((kind == "image/svg+xml") | lead.startswith("<svg") | (lead.startswith("<?xml") & lead.contains("<svg"))) & lead.rlike(r"(?i)<svg[\s>]")
    for pattern in UNSAFE_SVG:
        svg = svg & ~text.rlike(pattern)
    brand = F.substring(head, 17, 32)
    found = (
        F.when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(F.substring(head, 9, 16).contains("66747970") & brand.contains("61766966"), "image/avif")
        .when(F.coalesce(svg, F.lit(False)), "image/svg+xml")
    )
    return F.when((kind == "") | kind.startswith("image/"), found)


def local_name(number: Column, content: Column, mime: Column) -> Column:
    """``NN-<12 hex>.ext`` of an image."""
    ext = F.regexp_replace(F.regexp_replace(F.regexp_replace(mime, "^image/", ""), "^jpeg$", "jpg"), r"^svg\+xml$", "svg")
    return F.concat(F.lpad(number.cast("string"), 2, "0"), F.lit("-"), F.substring(F.sha2(content, 256), 1, 12), F.lit("."), ext)


def markdown_image(alt: Column, path: Column) -> Column:
    return F.concat(F.lit("!["), escape_alt(alt), F.lit("](<"), path, F.lit(">)"))


def localise(markdown: Column, images: Column) -> Column:
    """markdown with the token of each image, an array of (token, alt, path), replaced by the image; images
    without a path leave nothing behind."""
    def one(text: Column, i: Column) -> Column:
        return F.replace(text, i["token"], F.coalesce(markdown_image(i["alt"], i["path"]), F.lit("")))

    return F.aggregate(images, markdown, one)
