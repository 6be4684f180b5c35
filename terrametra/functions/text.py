"""Text folding, slugs, names and number parsing as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrametra.functions.constants import NAME_ABBREVIATIONS


def _fold_pairs(form: str) -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition is one ASCII character plus marks."""
    src, dst = [], []
    for code in [*range(0x00A0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = [c for c in unicodedata.normalize(form, chr(code)) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and ord(base[0]) < 128 and base[0] != chr(code):
            src.append(chr(code))
            dst.append(base[0])
    return "".join(src), "".join(dst)


_CANONICAL = _fold_pairs("NFD")
_COMPATIBLE = _fold_pairs("NFKD")
_MARKS = "\\p{Mn}+"


def fold(c: Column) -> Column:
    """Letters without their accents; other characters stay."""
    return F.regexp_replace(F.translate(c, *_CANONICAL), _MARKS, "")


def fold_lower(c: Column) -> Column:
    """Trimmed, unaccented lower case (NULL becomes the empty string)."""
    return F.trim(F.lower(fold(F.coalesce(c, F.lit("")))))


def ascii_upper(c: Column) -> Column:
    """Compatibility fold to ASCII, other characters dropped, upper case, trimmed."""
    plain = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), *_COMPATIBLE), "[^\\x00-\\x7F]", "")
    return F.trim(F.upper(plain))


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(fold(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def words(c: Column) -> Column:
    """Upper-case ASCII words with the official abbreviations expanded."""
    parts = F.filter(F.split(F.regexp_replace(ascii_upper(c), "[^A-Z0-9]+", " "), " "), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for kv in NAME_ABBREVIATIONS.items() for x in kv])
    return F.transform(parts, lambda w: F.coalesce(F.try_element_at(table, w), w))


def normalized_name(c: Column) -> Column:
    return F.array_join(words(c), " ")


def title_case(c: Column) -> Column:
    """Every run of letters starts upper case, also after digits and punctuation."""
    runs = F.regexp_extract_all(c, F.lit("(\\p{L}+|[^\\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def amount(c: Column) -> Column:
    """``$1,234.5`` to double; anything else to NULL."""
    return F.regexp_replace(F.trim(c), "[$, ]", "").try_cast("double")


def first_number(c: Column) -> Column:
    """First signed decimal in a text after dropping thousands commas; ``1.2.3`` reads as 1.2."""
    run = F.regexp_extract(F.regexp_replace(c.cast("string"), ",", ""), "-?[0-9.]+", 0)
    return F.regexp_extract(run, "^-?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)", 0).try_cast("double")


def year_in(c: Column) -> Column:
    """First 19xx or 20xx in a text."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), "(?:19|20)[0-9]{2}", 0).try_cast("int")


def leading_year(c: Column) -> Column:
    return F.substring(c.cast("string"), 1, 4).try_cast("int")


def contains_any(c: Column, needles: list[str]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | c.contains(n)
    return hit


def first_category(c: Column, catalogue: dict[str, list[str]], default: str | None = None) -> Column:
    """First category, in catalogue order, one of whose keywords occurs in the text."""
    out = None
    for name, keys in catalogue.items():
        cond = contains_any(c, keys)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(F.lit(default))


def all_categories(c: Column, catalogue: dict[str, list[str]]) -> Column:
    """All matching categories in catalogue order."""
    flags = F.array(*[F.when(contains_any(c, keys), F.lit(name)) for name, keys in catalogue.items()])
    return F.filter(flags, lambda x: x.isNotNull())


def distance_text(metres: Column) -> Column:
    none = F.lit("no competitor of this kind in the city")
    km = F.format_string("nearest competitor at %.1f km", metres / 1000.0)
    near = F.concat(F.lit("nearest competitor at "), F.format_number(metres.cast("bigint"), 0), F.lit(" m"))
    missing = metres.isNull() | F.isnan(metres)
    return F.when(missing, none).when(metres >= 1000, km).otherwise(near)


def money(c: Column, digits: int = 0) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, digits))


def percent(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%+.{digits}f%%", c)
