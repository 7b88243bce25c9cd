"""Text clean-up expressions shared by every operator.

Java's ``\\s`` and ``\\w`` are ASCII only and ``trim`` strips only U+0020, so whitespace and word characters are
spelled out. ``WS`` equals the Unicode whitespace set; ``WORD`` is letters, numbers and underscore.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes (usable inside [...]), CJK ranges, default relation type.
WS_CHARS = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD_CHARS = r"\p{L}\p{N}_"
CJK_SLUG_CHARS = r"\x{4E00}-\x{9FFF}"
CJK_KEYWORD_CHARS = r"\x{4E00}-\x{9FA5}"
EMPTY_RELATION_TYPE = "RELATED"

WS = f"[{WS_CHARS}]"
WS_TEXT = "".join(
    map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F])
) + "\u205f\u3000"
# Whitespace that is not already a single space.
WS_UNEVEN = f"{WS}{{2,}}|[{WS_CHARS.replace('-' + chr(92) + 'x{20}', '-' + chr(92) + 'x{1F}')}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(col(c), F.lit(WS_TEXT))


def rstrip(c: Column | str) -> Column:
    """Remove trailing whitespace of any kind."""
    return F.rtrim(col(c), F.lit(WS_TEXT))


def collapse(c: Column | str) -> Column:
    """Strip, then turn every whitespace run into one space."""
    return F.regexp_replace(strip(c), WS_UNEVEN, " ")


def is_blank(c: Column | str) -> Column:
    return strip(or_empty(c)) == ""


def normalize_name(c: Column | str) -> Column:
    return collapse(or_empty(c))


def normalize_description(c: Column | str) -> Column:
    return collapse(or_empty(c))


def normalize_aliases(aliases: Column | str, canonical: Column | str) -> Column:
    """Drop blanks and the canonical name (compared before inner whitespace is collapsed), then collapse, dedupe, sort."""
    name = col(canonical)
    kept = F.filter(
        F.coalesce(col(aliases), F.array().cast("array<string>")),
        lambda a: a.isNotNull() & (strip(a) != "") & (strip(a) != name),
    )
    return F.array_sort(F.array_distinct(F.transform(kept, collapse)))


def dedupe_aliases(aliases: Column | str, canonical: Column | str) -> Column:
    """Strip, drop blanks and the canonical name, dedupe, sort; inner whitespace stays."""
    name = col(canonical)
    stripped = F.transform(F.coalesce(col(aliases), F.array().cast("array<string>")), strip)
    kept = F.filter(stripped, lambda a: a.isNotNull() & (a != "") & (a != name))
    return F.array_sort(F.array_distinct(kept))


def slug(c: Column | str) -> Column:
    """Runs of non-word characters become one underscore; outer underscores go; lower case."""
    joined = F.regexp_replace(col(c), f"[^{WORD_CHARS}{CJK_SLUG_CHARS}]+", "_")
    return F.lower(F.btrim(joined, F.lit("_")))


def url_slug(c: Column | str) -> Column:
    """Lower case; characters other than word, space and hyphen are removed; separators become one underscore."""
    kept = F.regexp_replace(F.lower(or_empty(c)), f"[^{WORD_CHARS}{WS_CHARS}\\-]", "")
    return F.btrim(F.regexp_replace(kept, f"[{WS_CHARS}_\\-]+", "_"), F.lit("_"))


def canonical_keyword(c: Column | str) -> Column:
    """Comparison form of a keyword: lower case; every run of other than digits, a-z and CJK becomes one space."""
    return F.btrim(F.regexp_replace(F.lower(col(c)), f"[^0-9a-z{CJK_KEYWORD_CHARS}]+", " "), F.lit(" "))


def sanitize_rel_type(c: Column | str) -> Column:
    """A relation type reduced to A-Z, 0-9 and underscore; never empty and never starting with a digit."""
    squeezed = F.regexp_replace(F.regexp_replace(F.upper(or_empty(c)), "[^A-Z0-9_]", "_"), "_+", "_")
    name = F.btrim(squeezed, F.lit("_"))
    return (
        F.when(name == "", F.lit(EMPTY_RELATION_TYPE))
        .when(name.rlike("^[0-9]"), F.concat(F.lit("REL_"), name))
        .otherwise(name)
    )


def evidence_count(c: Column | str) -> Column:
    """Number of ``;``-separated parts; missing or empty evidence counts as one."""
    return F.when(or_empty(c) == "", F.lit(1)).otherwise(F.size(F.split(col(c), ";")))


def truncate_text(c: Column | str, n: int) -> Column:
    """The first ``n`` characters, as handed to a model with a bounded context."""
    return F.substring(col(c), 1, n)


def scaled_round(x: Column | str, digits: int) -> Column:
    """``x`` (not negative) times 10^digits, rounded half to even on its exact binary value, as a long.

    ``bround`` and ``format_string`` round the shortest decimal form instead, which differs on near ties such as 0.945.
    The double is split in two so that its product with 2·10^digits is exact, and compared with the odd tie value.
    """
    value, scale = col(x), float(10**digits)
    below = F.floor(value * scale)
    tie = (2 * below + 1).cast("double")
    shifted = value * 134217729.0
    high = shifted - (shifted - value)
    excess = (high * (2 * scale) - tie) + (value - high) * (2 * scale)
    return F.when(excess > 0, below + 1).when(excess < 0, below).otherwise(below + F.pmod(below, F.lit(2)))


def exact_round(x: Column | str, digits: int) -> Column:
    return scaled_round(x, digits) / float(10**digits)


def two_decimals(x: Column | str) -> Column:
    """``x`` (not negative) as text with two decimals."""
    n = scaled_round(x, 2)
    return F.format_string("%d.%02d", F.floor(n / 100), F.pmod(n, F.lit(100)))


def between_markers(c: Column | str, start: str, stop: str) -> Column:
    """Text after the first ``start`` up to the next ``stop``; NULL when ``start`` does not occur."""
    rest = F.get(F.split(col(c), F.lit(_quote(start)), 2), F.lit(1))
    return F.substring_index(rest, stop, 1)


def after_marker(c: Column | str, marker: str) -> Column:
    """Text between the first and the second occurrence of ``marker`` (or the end); NULL when it does not occur."""
    return F.get(F.split(col(c), F.lit(_quote(marker))), F.lit(1))


def before_first(c: Column, sep: str) -> Column:
    return F.substring_index(c, sep, 1)


def after_first(c: Column, sep: str) -> Column:
    """Text after the first ``sep``; callers check that it occurs."""
    return F.substr(c, F.instr(c, sep) + F.lit(len(sep)))


def _quote(literal: str) -> str:
    return "\\Q" + literal + "\\E"
