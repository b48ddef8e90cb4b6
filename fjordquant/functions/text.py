"""Accent folding, slugs, number wording and HTML stripping as column expressions."""

from __future__ import annotations

import unicodedata
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Every lower-case letter that decomposes into a base letter and accents."""
    pairs = []
    for point in range(0xC0, 0x2000):
        char = chr(point)
        plain = "".join(c for c in unicodedata.normalize("NFD", char)
                        if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and plain != char and char == char.lower():
            pairs.append((char, plain))
    pairs.append(("đ", "d"))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _fold_table()


def fold(text: Column) -> Column:
    """Lower case without accents; combining marks of decomposed input go too."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{Mn}", "")


def squeeze(text: Column) -> Column:
    """Folded text with single spaces."""
    return F.trim(F.regexp_replace(fold(text), r"(?U)\s+", " "))


def words_only(text: Column) -> Column:
    """Folded text with everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"),
                         "^-+|-+$", "")
    return F.when(s == "", "na").otherwise(s)


def node_key(level: Column | int, name: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.concat_ws("-", level.cast("string"), slug(name))


def snake(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^0-9a-z]+", "_"), "^_+|_+$", "")


def number_vi(v: Column, decimals: int = 0, na: str = "N/A") -> Column:
    """1.234,5 style; missing and NaN become ``na``."""
    text = F.translate(F.format_number(v, decimals), ",.", ".,")
    return F.when(v.isNull() | F.isnan(v), na).otherwise(text)


def percent_vi(v: Column, decimals: int = 1, na: str = "N/A", sign: bool = False) -> Column:
    text = F.concat(number_vi(v * 100, decimals), F.lit("%"))
    if sign:
        text = F.when(v > 0, F.concat(F.lit("+"), text)).otherwise(text)
    return F.when(v.isNull() | F.isnan(v), na).otherwise(text)


# every named character reference of one code point, from the standard table
ENTITIES = {name[:-1]: char for name, char in html5.items() if name.endswith(";") and len(char) == 1}


def unescape(text: Column) -> Column:
    """Character references resolved, named and numeric, each once."""
    cuts = F.split(text, "(?=&)")  # every piece but the first begins with an ampersand
    names = F.create_map(*[F.lit(x) for pair in sorted(ENTITIES.items()) for x in pair])

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^&(#?[0-9A-Za-z]+);", 1)
        code = F.when(name.rlike("^#[0-9]{1,7}$"), F.conv(F.substr(name, F.lit(2)), 10, 10)).when(
            name.rlike("^#[xX][0-9A-Fa-f]{1,6}$"), F.conv(F.substr(name, F.lit(3)), 16, 10))
        number = code.cast("long")
        # a code point as UTF-16 units in hex, decoded
        pair = F.concat(F.lpad(F.hex(F.lit(0xD800) + F.shiftright(number - 0x10000, 10)), 4, "0"),
                        F.lpad(F.hex(F.lit(0xDC00) + (number - 0x10000).bitwiseAND(0x3FF)), 4, "0"))
        units = F.when(number < 0x10000, F.lpad(F.hex(number), 4, "0")).otherwise(pair)
        char = F.when(number.between(1, 0x10FFFF), F.decode(F.unhex(units), "UTF-16BE")).otherwise(
            F.try_element_at(names, name))
        return F.when((name != "") & char.isNotNull(), F.concat(
            char, F.substr(piece, F.length(name) + 3))).otherwise(piece)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(cuts, one), "")).otherwise(text)


def strip_html(html: Column) -> Column:
    """Tags out, references resolved, white space collapsed."""
    text = unescape(F.regexp_replace(html, "<[^>]+>", " "))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    parts = F.split(text, r"(?U)(?<=[.!?;])\s+|\n+")
    return F.filter(F.transform(parts, F.trim), lambda s: s != "")


NUMBER = r"(?U)(?<!\w)[-+]?\d[\d.,]*(?!\w)"


def canonical_number(raw: Column) -> Column:
    """One spelling for Western and Vietnamese separators, null if not a number.

    With both separators the later one is the decimal mark; a lone comma is a
    decimal mark; dots followed by groups of three digits group thousands.
    """
    sign = F.regexp_extract(raw, "^[-+]", 0)
    v = F.regexp_replace(raw, "^[-+]", "")
    dot, comma = F.contains(v, F.lit(".")), F.contains(v, F.lit(","))
    comma_last = F.instr(F.reverse(v), ",") < F.instr(F.reverse(v), ".")
    text = (
        F.when(dot & comma & comma_last, F.translate(F.replace(v, F.lit("."), F.lit("")), ",", "."))
        .when(dot & comma, F.replace(v, F.lit(","), F.lit("")))
        .when(comma, F.translate(v, ",", "."))
        .when(v.rlike(r"^\d+(\.\d{3})+$"), F.replace(v, F.lit("."), F.lit("")))
        .otherwise(v))
    plain = F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0*$", "")).otherwise(text)
    plain = F.regexp_replace(plain, r"^0+(?=\d)", "")
    return F.when(text.rlike(r"^\d+\.?\d*$"), F.when(plain == "0", plain).otherwise(
        F.concat(sign, plain)))


def numbers_in(text: Column) -> Column:
    """Sorted canonical numbers of a text; equal arrays mean equal multisets."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.array_sort(F.array_compact(F.transform(found, canonical_number)))
