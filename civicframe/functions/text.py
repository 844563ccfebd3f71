"""Text functions: title case, address keys, replacements, extraction, keys and requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import _col, paste_present

# Street directions and the words they are written out as, in the order applied.
DIRECTION_WORDS = [
    (" S. ", " SOUTH "),
    (" S ", " SOUTH "),
    (" N. ", " NORTH "),
    (" N ", " NORTH "),
    (" W. ", " WEST "),
    (" W ", " WEST "),
    (" E. ", " EAST "),
    (" E ", " EAST "),
]

_WORD_OR_GAP = r"[\p{L}\p{M}\p{N}']+|[^\p{L}\p{M}\p{N}']+"


def title_case(c: Column | str) -> Column:
    """Upper-case the first letter of every word, lower-case the rest; any non-letter starts a word."""
    pieces = F.regexp_extract_all(_col(c), F.lit(_WORD_OR_GAP), F.lit(0))
    cased = F.transform(
        pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))
    )
    return F.array_join(cased, "")


def trim_right_to_letter(c: Column | str) -> Column:
    """Cut everything after the last letter."""
    return F.regexp_replace(_col(c), r"[^\p{L}]+$", "")


def address_key(c: Column | str) -> Column:
    """Runs of punctuation and blanks become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"[\p{Punct} ]+", " "))


def replace_first(c: Column | str, literal: str, replacement: str) -> Column:
    """Replace the first occurrence of a literal text."""
    quoted = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(_col(c), rf"^(?s)(.*?)\Q{literal}\E", "$1" + quoted)


def remove_first(c: Column | str, literal: str) -> Column:
    return replace_first(c, literal, "")


def expand_directions(c: Column | str) -> Column:
    """Write out abbreviated street directions, the first occurrence of each form."""
    out = _col(c)
    for short, word in DIRECTION_WORDS:
        out = replace_first(out, short, word)
    return out


def extract_first(c: Column | str, pattern: str) -> Column:
    """First match of ``pattern``, missing when there is none. The pattern must not match empty text."""
    return F.nullif(F.regexp_extract(_col(c), pattern, 0), F.lit(""))


def extract_all(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(0))


def parse_zip(c: Column | str) -> Column:
    """Five-digit code of a formatted address: the only match, else all after the first, a blank between them."""
    codes = extract_all(c, "[0-9]{5}")
    several = F.array_join(F.slice(codes, F.lit(2), F.greatest(F.size(codes), F.lit(1))), " ")
    return F.when(F.size(codes) > 1, several).otherwise(F.get(codes, 0))


def parse_city(c: Column | str) -> Column:
    """City of a formatted address: of the parts between commas, the second of three or more, else the first."""
    parts = extract_all(c, r",\s[A-Za-z\s]+,\s")
    part = F.get(parts, F.when(F.size(parts) > 2, 1).otherwise(0))
    return F.trim(F.replace(part, F.lit(","), F.lit("")))


def row_key(cols: Sequence[Column | str]) -> Column:
    """Stable key of a row: digest of its present fields with white space taken out."""
    return F.md5(F.regexp_replace(paste_present(cols), r"\s", ""))


def request_text(c: Column | str, space: str) -> Column:
    """Text as a query-string value: white space becomes ``space``, dots go."""
    return F.replace(F.regexp_replace(_col(c), r"\s", space), F.lit("."), F.lit(""))


def geocode_request(template: str, **fields: Column) -> Column:
    """Fill ``{name}`` places of a request template; builds the text and sends nothing."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out
