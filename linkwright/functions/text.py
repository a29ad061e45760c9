"""Titles and brands as comparable strings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Abbreviations in a title, in the order they are replaced.
ABBREVIATIONS = {"&": "and", "w/": "with", "pcs": "pieces", "pkg": "package", "qty": "quantity"}
#: Other names of a brand.
BRAND_ALIASES = {
    "hewlett-packard": "hp",
    "hewlett packard": "hp",
    "hp inc": "hp",
    "samsung electronics": "samsung",
    "sony corporation": "sony",
    "apple inc": "apple",
}
#: Brands that are known in a title.
KNOWN_BRANDS = ("apple", "samsung", "sony", "hp", "dell", "lenovo", "logitech", "bosch", "philips", "lg", "asus", "acer", "canon", "nikon")


@F.pandas_udf(T.StringType())
def _decomposed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)))


def without_accents(value: Column, beyond_latin: bool = False) -> Column:
    """Without diacritics. By default by a table of the precomposed Latin letters, in the JVM;
    ``beyond_latin`` decomposes any script, in Arrow batches."""
    if beyond_latin:
        return _decomposed(value)
    letters = {chr(c): d[0] for c in range(0xC0, 0x250) if (d := unicodedata.normalize("NFKD", chr(c))) != chr(c) and len(d) == 2 and unicodedata.combining(d[1])}
    return F.regexp_replace(F.translate(value, "".join(letters), "".join(letters.values())), r"\p{M}+", "")


def collapsed(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def title(value: Column, beyond_latin: bool = False) -> Column:
    """Lower case, no accents, abbreviations in full, letters and digits alone, single spaces."""
    out = F.trim(F.lower(without_accents(value, beyond_latin)))
    for short, full in ABBREVIATIONS.items():
        out = F.regexp_replace(out, rf"(?U)(?<!\w)\Q{short}\E(?!\w)", full)
    return collapsed(F.regexp_replace(out, r"(?U)[^a-z0-9\s]", " "))


def brand(value: Column, beyond_latin: bool = False) -> Column:
    """Lower case, no accents, by its main name; empty is null."""
    plain = collapsed(F.lower(without_accents(value, beyond_latin)))
    known = F.create_map(*(F.lit(x) for pair in BRAND_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, plain), F.nullif(plain, F.lit("")))


def brand_in_title(value: Column) -> Column:
    """The first word of the title that is a known brand."""
    return F.get(F.filter(F.split(title(value), " "), lambda w: w.isin(*KNOWN_BRANDS)), 0)


def product_text(brand_: Column, title_: Column, category: Column | None = None) -> Column:
    """What the semantic layer compares; blanks are left out."""
    parts = [brand(brand_), title(title_)] + ([] if category is None else [title(category)])
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def search_query(brand_: Column, title_: Column) -> Column:
    """Brand and title, without the brand if the title begins with it."""
    b, t = F.trim(F.coalesce(brand_, F.lit(""))), F.trim(title_)
    begins = (F.lower(t) == F.lower(b)) | F.startswith(F.lower(t), F.concat(F.lower(b), F.lit(" ")))
    return F.when((b == "") | begins, t).otherwise(F.concat_ws(" ", b, t))
