"""File names, media types, waiting times and unsafe addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.urls import host_of, none_if_empty, trimmed

# Extensions of images, and those of media types; MIME types by extension.
EXTENSIONS = [".bmp", ".eps", ".gif", ".jpeg", ".jpg", ".pdf", ".png", ".svg", ".tif", ".tiff", ".webp"]
TYPE_EXTENSIONS = {
    "application/pdf": ".pdf", "image/gif": ".gif", "image/jpeg": ".jpg", "image/png": ".png", "image/svg+xml": ".svg", "image/webp": ".webp",
}
IMAGE_EXTENSIONS = [".gif", ".jpeg", ".jpg", ".png", ".webp"]


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def extension_for(url: Column, content_type: Column | None = None) -> Column:
    """The known extension of the URL's path, else that of the media type, else ``.png``."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][\w+.-]*://[^/]*", "")
    own = F.lower(F.regexp_extract(F.coalesce(F.try_url_decode(path), path), r"([.][^./]+)$", 1))
    known = F.when(own.isin(EXTENSIONS), own)
    if content_type is None:
        return F.coalesce(known, F.lit(".png"))
    plain = F.lower(trimmed(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    return F.coalesce(known, F.try_element_at(_map(TYPE_EXTENSIONS), plain), F.lit(".png"))


def safe_image_name(name: Column, default: str = ".png") -> Column:
    """Letters, digits, ``-`` and ``_`` of any script, at most 60, with the extension the name has; ``image`` if nothing is left."""
    own = F.regexp_extract(F.lower(name), "(" + "|".join(x.replace(".", "[.]") for x in IMAGE_EXTENSIONS) + ")$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(own))
    clean = F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "-"), "^-+|-+$", "")
    return F.concat(F.coalesce(none_if_empty(F.substring(clean, 1, 60)), F.lit("image")), F.coalesce(none_if_empty(own), F.lit(default)))


def mime_type(path: Column) -> Column:
    """Of an image by its extension; PNG unless it says otherwise."""
    low = F.lower(path)
    return F.when(low.rlike("[.]jpe?g$"), "image/jpeg").when(low.endswith(".svg"), "image/svg+xml").otherwise("image/png")


def safe_member(name: Column) -> Column:
    """Whether a file name names a file of its own folder: no separators, no leading dot."""
    return ~name.rlike(r"[/\\]") & ~name.startswith(".")


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds to wait of a Retry-After header: a number, or an HTTP date minus ``now``; never less than 0, null if neither."""
    seconds = F.when(trimmed(value).rlike(r"^\d+(?:[.]\d+)?$"), trimmed(value).try_cast("double"))
    date = F.try_to_timestamp(F.regexp_extract(value, r"(\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.greatest(F.coalesce(seconds, (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double")), F.lit(0.0))


def unsafe_url(url: Column) -> Column:
    """Whether a fetcher must refuse a URL: no http(s), no host, a local name, or an address that isn't global."""
    raw, host = trimmed(url), host_of(url)
    part = lambda i: F.regexp_extract(host, r"^(\d{1,3})[.](\d{1,3})[.](\d{1,3})[.](\d{1,3})$", i).try_cast("int")
    a, b = part(1), part(2)
    private = (
        a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0)) | ((a == 198) & b.between(18, 19)) | (a >= 224)
    )
    local = host.rlike(r"^(?:localhost|.*[.](?:localhost|local|internal))$") | raw.rlike(r"(?i)^https?://(?:[^/@]*@)?\[(?:::1?|f[cd][0-9a-f]{2}:.*|fe80:.*)\]")
    return ~F.lower(raw).rlike("^https?://") | ((host == "") & ~raw.contains("[")) | local | F.coalesce(private, F.lit(False))
