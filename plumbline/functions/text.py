"""String and claim expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import constants as K

# Unicode white space: as a pattern, and as the set of characters that ``btrim`` takes.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
WS_CHARS = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
CLAIM_BREAK = rf"[.!?]{WS}+"
# A word of two or more letters, digits or underscores; \w would be ASCII-only.
WORD = r"[\p{L}\p{N}_]{2,}"


def strip(c: Column) -> Column:
    """Trim white space of every kind (``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(WS_CHARS))


def clean(c: Column) -> Column:
    """Trim, and turn the usual spellings of 'missing' into null."""
    trimmed = strip(c.cast("string"))
    return F.when(~trimmed.isin(K.MISSING_WORDS), trimmed)


def truncate(c: Column, chars: int) -> Column:
    """Cut to ``chars`` characters and mark the cut with an ellipsis."""
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("..."))).otherwise(c)


def looks_like_formula(c: Column) -> Column:
    """True where a spreadsheet would read the cell as a formula."""
    return F.coalesce(c.rlike(rf"^{WS}*[=+@]"), F.lit(False))


def sanitise(c: Column) -> Column:
    """Put a tab before formula-like cells that do not start with one."""
    return F.when(looks_like_formula(c) & ~c.startswith("\t"), F.concat(F.lit("\t"), c)).otherwise(c)


# Each pattern needs these, and looking for them is far cheaper than the pattern itself.
_NEEDS_AT = "@"
_NEEDS_DIGITS = r"\d{4}"


def without_mail(c: Column) -> Column:
    return F.when(c.contains(_NEEDS_AT), F.regexp_replace(c, K.EMAIL_PATTERN, K.REDACTED)).otherwise(c)


def without_ssn(c: Column) -> Column:
    return F.when(c.rlike(_NEEDS_DIGITS), F.regexp_replace(c, K.SSN_PATTERN, K.REDACTED)).otherwise(c)


def without_phone(c: Column) -> Column:
    return F.when(c.rlike(_NEEDS_DIGITS), F.regexp_replace(c, K.PHONE_PATTERN, K.REDACTED)).otherwise(c)


def occurrences(c: Column, pattern: str, needs: Column) -> Column:
    return F.when(needs, F.regexp_count(c, F.lit(pattern))).otherwise(0)


def claims(c: Column) -> Column:
    """Split a text into trimmed, non-empty claims; the whole text, never a prefix."""
    pieces = F.transform(F.split(c, CLAIM_BREAK), strip)
    return F.filter(pieces, lambda piece: piece != "")


def words(c: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case words of length two or more, without stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    stop = K.STOP_WORDS if stop_words is None else stop_words
    if not stop:
        return found
    return F.filter(found, lambda w: ~w.isin(stop))


def word_pairs(ws: Column) -> Column:
    """Words followed by adjacent word pairs, from a column of words."""
    following = F.slice(ws, F.lit(2), F.greatest(F.size(ws), F.lit(1)))
    pairs = F.filter(
        F.zip_with(ws, following, lambda a, b: F.concat(a, F.lit(" "), b)),
        lambda pair: pair.isNotNull(),
    )
    return F.concat(ws, pairs)


def content_key(*parts: Column) -> Column:
    """SHA-256 over the parts: equal inputs share a key."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
