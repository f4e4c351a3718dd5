"""Column expressions that several operators share; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"


def safe_int(c: Column) -> Column:
    """Text to int by way of double, towards zero; anything else, NaN and infinities are null."""
    d = safe_float(c)
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(2147483648.0)), d.cast("int"))


def safe_float(c: Column) -> Column:
    """Text to double; a type suffix, NaN and infinities are null."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def safe_date(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("date")


def safe_text(c: Column) -> Column:
    """Trimmed text; blank, nan, none and null are null."""
    text = F.trim(c.cast("string"))
    return F.when(~F.lower(text).isin("", "nan", "none", "null", "nat"), text)


def strict_int(c: Column, lenient: bool = False) -> Column:
    """Text of an integer to int; with ``lenient`` a decimal's whole part too."""
    text = c.cast("string")
    return safe_int(text) if lenient else F.when(text.rlike(INTEGER_TEXT), F.trim(text).try_cast("int"))


def coerce(c: Column, kind: str) -> Column:
    """A column by class: int, float, date or text."""
    return {"int": safe_int, "float": safe_float, "date": safe_date, "text": safe_text}[kind](c)


def relationship_label(c: Column) -> Column:
    """Upper case, every other character an underscore; an empty label is RELATED_TO."""
    clean = F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), "[^A-Z0-9_]", "_")
    return F.when(clean == "", F.lit("RELATED_TO")).otherwise(clean)


def namespaced(db: Column, c: Column) -> Column:
    """``db__id``; ids that have the prefix already stay."""
    prefix = F.concat(db, F.lit("__"))
    return F.when(c.startswith(prefix), c).otherwise(F.concat(prefix, c))


def contains_ci(c: Column, word: str | Column) -> Column:
    word = F.lit(word) if isinstance(word, str) else word
    return F.coalesce(F.contains(F.lower(c), F.lower(word)), F.lit(False))


def display_name(display: Column, name: Column, title: Column, summary: Column, id_: Column) -> Column:
    """The first that isn't blank of displayName, name, title, 40 characters of the summary and 35 of the id."""
    full = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(full(display), full(name), full(title), full(F.substring(summary, 1, 40)), F.substring(id_, 1, 35))


def months_between_floor(late: Column, early: Column) -> Column:
    """(years apart) * 12 + (months apart), at least 0."""
    return F.greatest(F.lit(0), (F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early))


def age_years(born: Column, today: Column) -> Column:
    """Whole years: a year less before the birthday."""
    return F.floor(F.months_between(today, born) / 12).cast("int")


def shift_day(day: Column, by: Column | int) -> Column:
    """A day as yyyy-MM-dd text, some days on."""
    return F.date_format(F.date_add(F.to_date(day), F.lit(by) if isinstance(by, int) else by), "yyyy-MM-dd")


def email_of(name: Column, domain: str) -> Column:
    local = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "'", ""), ", ", "."), " ", ".")
    return F.concat(local, F.lit("@" + domain))


def day_class(c: Column) -> Column:
    return F.when(F.weekday(c) >= 5, F.lit("WEEKEND")).otherwise(F.lit("WEEKDAY"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays over their common length; 0 if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    down = norm(a) * norm(b)
    return F.when(down == 0, F.lit(0.0)).otherwise(dot / down)
