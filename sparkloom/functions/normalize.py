"""Character normalization (N2 to N13) as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of Windows-1252 that were read as control characters, and what they mean.
_WINDOWS = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘",
    0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}
_MISREAD = {"¡¦": "’", "¡§": "“", "¡¨": "”", "Âº": "º", "Ã±": "ñ", "Ãº": "ú", "Ä±": "ı"}
_SPACES = "".join(map(chr, [0xA0, *range(0x2000, 0x200C), 0x202F, 0x205F, 0x3000]))
_GONE = "".join(map(chr, [*range(0, 9), 0xB, 0xC, *range(0xE, 0x20), 0x7F, *range(0x80, 0xA0), 0xAD, 0x640, 0x200E, 0x200F, 0xFEFF]))


def entities(c: Column) -> Column:
    """Entities for a no-break space are spaces."""
    return F.regexp_replace(c, r"(?i)&(?:#160|#xa0|nbsp);", " ")


def signs(c: Column) -> Column:
    """The micro sign is a mu, the one-dot leader a period."""
    return F.translate(c, "µ․", "μ.")


def misread(c: Column) -> Column:
    """Sequences of characters read in the wrong encoding, in texts that have a sign of that."""
    out = c
    for bad, good in _MISREAD.items():
        out = F.replace(out, F.lit(bad), F.lit(good))
    return F.when(c.rlike("[¦§¨±Ã]"), out).otherwise(c)


def windows(c: Column) -> Column:
    """Windows-1252 characters."""
    return F.translate(c, "".join(map(chr, _WINDOWS)), "".join(_WINDOWS.values()))


def wordspace(c: Column) -> Column:
    """A single Ethiopic wordspace is a space."""
    return F.regexp_replace(c, "(?<!፡)፡(?![፡-])", " ")


def controls(c: Column) -> Column:
    """Control and invisible characters go; all spaces are one kind."""
    return F.translate(c, _SPACES + _GONE, " " * len(_SPACES))


def joiners(c: Column) -> Column:
    """Zero-width joiners stay between letters or symbols only, one at a time."""
    c = F.regexp_replace(c, "[‌‍]*(?:‌‍|‍‌)[‌‍]*", "")
    c = F.regexp_replace(c, "([‌‍])\\1+", "$1")
    return F.regexp_replace(c, "^[‌‍]|[‌‍]$|(?<=[\\s\\p{P}])[‌‍]|[‌‍](?=[\\s\\p{P}])", "")


def variants(c: Column) -> Column:
    """Variation selectors go, but for those of symbols."""
    return F.regexp_replace(c, "(?<=[\\x{0}-\\x{218F}])[\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}]+", "")


def even_lower(c: Column) -> Column:
    """Lower case of the same length."""
    return F.lower(F.translate(c, "İ", "i"))


def normalized(c: Column) -> Column:
    """All of N2 to N12, in order."""
    for step in (entities, signs, misread, windows, wordspace, controls, joiners, variants):
        c = step(c)
    return c
