"""Column functions on words. Everything stays inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER_OR_DIGIT = r"^[\p{Lu}\p{Nd}]"


def half_even(x: Column, factor: Column | float = 1.0) -> Column:
    """x scaled and rounded half to even, as a long."""
    return F.bround(x * factor, 0).cast("long")


def visible(text: Column) -> Column:
    """What OCR text keeps: letters, digits, accented Latin, dots, parentheses and spaces."""
    return F.regexp_replace(text, r"[^a-zA-Z0-9À-ÿ\.\(\) ]", "")


def dense_enough(text: Column) -> Column:
    """Words worth keeping from digital pages: two characters, a dot, or letters and digits."""
    return (F.length(text) >= 2) | (text == ".") | text.rlike(r"^[\p{L}\p{N}]+$")


def starts_row(text: Column) -> Column:
    return text.rlike(UPPER_OR_DIGIT) | F.substring(text, 1, 5).rlike(r"[.)\-]")


def starts_column(text: Column) -> Column:
    return text.rlike(UPPER_OR_DIGIT) | (text.rlike(r"^[.()\-]") & (F.length(text) > 1))


def longest_capital_run(text: Column) -> Column:
    return F.array_max(F.transform(F.split(text, r"[^\p{Lu}]+"), F.length)).cast("long")


def inverted_capital_run(current: Column, following: Column) -> Column:
    """(6 - min) clipped to 0..5, over 6."""
    return F.least(F.greatest(6 - F.least(current, following), F.lit(0)), F.lit(5)) / F.lit(6.0)


def is_numeric(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).rlike(r"^\p{N}+$")


def without_dots(text: Column) -> Column:
    return F.replace(text, F.lit("."), F.lit(""))


def blank_to_null(text: Column) -> Column:
    return F.when(text.isin("", " "), F.lit(None)).otherwise(text)


def with_leading_dot(extension: Column) -> Column:
    return F.when(extension.startswith("."), extension).otherwise(F.concat(F.lit("."), extension))


def to_page(value: Column, low: Column | float, high: Column | float) -> Column:
    """Clamp to the page."""
    return F.least(F.greatest(value, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def squashed(p: Column, cut: float) -> Column:
    """Display value: probabilities under the cut are pressed into [0, 0.1)."""
    return F.when(p < cut, p / (cut * 10)).otherwise(p)


def luminosity(on: Column) -> Column:
    return F.bround((1 - on) * 240, 0).cast("long")


def average_hash_bits(values: Column) -> Column:
    """Bits of an image hash: value above the mean of all values."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return F.transform(values, lambda x: (x > mean).cast("int"))


def hash_similarity(a: Column, b: Column, size_gap: Column, most: float = 20.0) -> Column:
    """1 minus the share of differing bits; 0 if the images' sizes are too far apart."""
    differing = F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(size_gap > most, F.lit(0.0)).otherwise(1 - differing / F.size(a))
