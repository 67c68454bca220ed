"""Scalar text functions as Spark columns; all run inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import values as V

#: Every character that counts as white space, for a regular expression class.
WS = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same as a class of its own. Visible ASCII is ruled out by one range, before the many parts of WS are tried.
SPACE = rf"[[^!-~]&&[{WS}]]"
#: A word boundary between ASCII word characters, whatever the Java version.
AB = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _accent_table() -> tuple[str, str]:
    """Precomposed letters and the single letters that remain when their combining marks go."""
    pairs = []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not 0x300 <= ord(x) <= 0x36F)
        if len(base) == 1 and base != chr(c):
            pairs.append((chr(c), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


ACCENTED, PLAIN = _accent_table()


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it or the optimizer moves it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(x: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def clean(x: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def unaccent(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, ACCENTED, PLAIN), r"[\x{300}-\x{36F}]", "")


def fold_upper(x: Column) -> Column:
    """The key for comparisons: no accents, upper case, plain dashes, single spaces."""
    return clean(F.regexp_replace(F.upper(unaccent(x)), "[–—]", "-"))


#: Lines of visible characters with single blanks between them: in ASCII, and in Latin-1. They have nothing to trim or clean,
#: no dash but the plain one and no combining mark, so folding is upper case, and for the latter a table of letters.
_ASCII_LINE = r"^[!-~]++(?: [!-~]++)*+\z"
_LATIN_LINE = r"^[!-~\x{A1}-\x{FF}]++(?: [!-~\x{A1}-\x{FF}]++)*+\z"


def trim_line(x: Column) -> Column:
    """``trim`` of a value that costs nothing to name twice: most lines are found to need none by one quick test."""
    return F.when(x.rlike(_LATIN_LINE), x).otherwise(trim(x))


def fold_line(x: Column) -> Column:
    """``fold_upper`` of a value that costs nothing to name twice; quick for plain lines."""
    return F.when(x.rlike(_ASCII_LINE), F.upper(x)).when(x.rlike(_LATIN_LINE), F.upper(F.translate(x, ACCENTED, PLAIN))).otherwise(fold_upper(x))


def fold_upper_text(x: Column) -> Column:
    """``fold_upper`` of a text of many lines, folded line by line."""
    return F.array_join(F.filter(F.transform(F.split(x, "\n"), fold_line), lambda f: f != ""), " ")


def line_forms(x: Column) -> Column:
    """struct<text, line, norm> of a line that costs nothing to name: trimmed, cleaned, folded."""
    made = lambda text, line, norm: F.struct(text.alias("text"), line.alias("line"), norm.alias("norm"))
    return F.when(x.rlike(_ASCII_LINE), made(x, x, F.upper(x))).when(x.rlike(_LATIN_LINE), made(x, x, F.upper(F.translate(x, ACCENTED, PLAIN)))).otherwise(made(trim(x), clean(trim(x)), fold_upper(x)))


def fold_upper_keep_dashes(x: Column) -> Column:
    return clean(F.upper(unaccent(x)))


def fold_lower(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(x, ACCENTED, PLAIN), r"\p{M}", ""))


def clean_text(x: Column) -> Column:
    """Blanks around line feeds and runs of blanks removed, line feeds kept."""
    x = F.regexp_replace(F.regexp_replace(x, "[ \t]+\n", "\n"), "\n[ \t]+", "\n")
    return trim(F.regexp_replace(x, "[ \t]{2,}", " "))


def join_lines(lines: Column) -> Column:
    """An array's lines, cleaned, without empty ones, joined by line feeds."""
    return F.array_join(F.filter(F.transform(lines, clean), lambda x: x != ""), "\n")


def decode_entities(x: Column) -> Column:
    """The five named XML entities, ampersand last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def _point(match: Column) -> Column:
    """The character of one numeric reference, hexadecimal or decimal, through its UTF-32 bytes."""
    hexa = match.rlike("^&#[xX]")
    code = F.when(hexa, F.conv(F.regexp_extract(match, "([0-9A-Fa-f]+);$", 1), 16, 16)).otherwise(F.conv(F.regexp_extract(match, r"(\d+);$", 1), 10, 16))
    return F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")


def decode_xml(x: Column) -> Column:
    """Numeric references, then named entities. Texts without ``&#`` skip the numeric step."""
    number = "&#[xX][0-9A-Fa-f]+;|&#[0-9]+;"
    found, rest = F.regexp_extract_all(x, F.lit(f"({number})"), F.lit(1)), F.split(x, number)
    pieces = F.transform(rest, lambda p, k: F.concat(p, F.coalesce(F.get(F.transform(found, _point), k), F.lit(""))))
    return decode_entities(F.when(F.contains(x, F.lit("&#")), F.array_join(pieces, "")).otherwise(x))


def escape_xml(x: Column) -> Column:
    """Four entities; apostrophes stay."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


def heading_base(folded: Column) -> Column:
    """A folded line without its leading number."""
    return F.regexp_replace(folded, r"^\d+(?:\.\d+)*\s*", "")


def line_base(folded: Column) -> Column:
    """``heading_base`` of a value that costs nothing to name twice; only lines that a digit leads are changed."""
    return F.when((folded >= "0") & (folded < ":"), heading_base(folded)).otherwise(folded)


def is_year(x: Column) -> Column:
    return x.rlike(rf"^{SPACE}*(19|20)\d{{2}}{SPACE}*$")


def has_year(x: Column) -> Column:
    return x.rlike(rf"{AB}(19|20)\d{{2}}{AB}")


def is_location(folded: Column, cities: tuple[str, ...] = V.CITIES) -> Column:
    """Of a folded line: it is a city's line or starts with a city."""
    return folded.isin(*V.CITY_LINES) | folded.rlike(rf"^(?:{'|'.join(cities)})\b")


def is_generic_cover_line(folded: Column) -> Column:
    return folded.isin(*V.GENERIC_COVER_LINES) | (F.length(folded) < 2)


def has_value(x: Column) -> Column:
    return F.length(trim(F.coalesce(x, F.lit("")))) > 0


def mime_type(extension: Column) -> Column:
    out = F.lit("application/octet-stream")
    for ext, kind in V.MIME_TYPES.items():
        out = F.when(F.lower(extension) == ext, kind).otherwise(out)
    return out


def cm_to_twip(cm: Column) -> Column:
    return F.floor(cm * (1440 / 2.54) + 0.5).cast("int")


def before_comma(x: Column) -> Column:
    return trim(F.substring_index(x, ",", 1))


def strip_block_marker(x: Column) -> Column:
    """A line without its leading heading, quote or reference mark."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^#{1,2}\s+", ""), r"^>\s+", ""), r"(?i)^\[REF\]\s+", "")


def strip_inline_markup(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\*\*([^*]+)\*\*", "$1"), r"\*([^*]+)\*", "$1")


def strip_trailing_data(x: Column) -> Column:
    """A title without the page counts and years after it, and without its last dot."""
    x = F.regexp_replace(trim(x), r"(?i)(?:\.\s*(?:\d+\s*p\.?|(?:19|20)\d{2})\s*)+$", "")
    return trim(F.regexp_replace(trim(x), r"\.$", ""))


def safe_file_name(title: Column, fallback: str = "trabalho") -> Column:
    """A title as a file name with .docx; ``fallback`` if nothing of it remains."""
    name = F.lower(F.regexp_replace(F.regexp_replace(unaccent(F.coalesce(title, F.lit(""))), "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.concat(F.when(name == "", fallback).otherwise(name), F.lit(".docx"))


def _each_line(x: Column, first: Column, last: Column, change) -> Column:
    """Lines first to last (from 0) changed, the others as they are."""
    return F.array_join(F.transform(F.split(x, "\n"), lambda line, k: F.when(k.between(first, last), change(line)).otherwise(line)), "\n")


def selected_lines(x: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """First and last line (from 0) that a selection from character ``start`` to before ``end`` touches."""
    breaks = lambda n: F.length(F.substring(x, F.lit(1), n)) - F.length(F.replace(F.substring(x, F.lit(1), n), F.lit("\n"), F.lit("")))
    return breaks(start), breaks(end)


def mark_lines(x: Column, first: Column | int, last: Column | int, prefix: str) -> Column:
    """Lines first to last (from 0) with their block mark replaced by ``prefix``; blank lines get none."""

    def change(line: Column) -> Column:
        return let(strip_block_marker(line), lambda bare: F.when(trim(bare) != "", F.concat(F.lit(prefix), bare)).otherwise(bare))

    return _each_line(x, first, last, change)


def clear_lines(x: Column, first: Column | int, last: Column | int) -> Column:
    """Lines first to last (from 0) without block and inline marks."""
    return _each_line(x, first, last, lambda line: strip_inline_markup(strip_block_marker(line)))


def wrap_selection(x: Column, start: Column, end: Column, mark: str) -> Column:
    """The characters from ``start`` to before ``end`` between two marks (``*`` or ``**``); an empty selection gets both marks."""
    piece = F.substring(x, start + 1, end - start)
    return F.concat(F.substring(x, F.lit(1), start), F.lit(mark), piece, F.lit(mark), F.substring(x, end + 1, F.length(x)))
