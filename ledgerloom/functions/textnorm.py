"""Text normalisation as columns."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Precomposed letters of the Latin blocks and their base letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for lo, hi in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(lo, hi)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(col, map_d: bool = False):
    """Letters without their marks; ``map_d`` also turns đ and Đ into d and D."""
    a, b = _accent_table()
    out = F.regexp_replace(F.translate(col, a, b), r"\p{Mn}", "")
    return F.translate(out, "đĐ", "dD") if map_d else out


def norm_ascii(col, gap: str = " "):
    """Accents stripped, lower case, every run of other characters than a-z and 0-9 one ``gap``, none at the ends."""
    out = F.regexp_replace(F.lower(strip_accents(F.coalesce(col, F.lit("")), map_d=True)), "[^a-z0-9]+", gap)
    return F.regexp_replace(out, f"^{gap}+|{gap}+$", "")


def slugify(col):
    return norm_ascii(col, "_")


def tokenize(col):
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def token_set(col):
    """Distinct tokens of the ASCII-normalised text, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(norm_ascii(col), " "), lambda t: t != "")))


def normalize_ws(col):
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", " "))


def clean_text(col):
    """Control characters and (cid:n) marks go, three or more line breaks become two, lines lose trailing blanks."""
    out = F.regexp_replace(F.coalesce(col, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.regexp_replace(out, r"\(cid:\d+\)", "")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def tenant_from_filename(col):
    """The file's stem without a leading ``tenant_``, lower case, only a-z, 0-9 and underscores."""
    stem = F.regexp_extract(col, r"([^/\\]*?)(\.[^./\\]*)?$", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(stem), "^tenant_", ""), "[^a-z0-9_]", "")


def estimate_tokens(col):
    return F.floor(F.length(F.coalesce(col, F.lit(""))) / 4)


def content_key(cv, jd, size: int = 2000):
    """A key of 24 hex digits for the first ``size`` characters of both texts."""
    head = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, size)
    return F.substring(F.sha2(F.concat(head(cv), F.lit("||"), head(jd)), 256), 1, 24)


def decode_text(content):
    """Bytes as UTF-8 where they are valid, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
