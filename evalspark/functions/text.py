"""Column expressions on text. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that text comparison treats as blank at the ends
# of a value and between words (Unicode white space and separators).
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    """Drop all white space at both ends; SQL ``trim`` alone drops only the space sign."""
    return F.btrim(value, F.lit(BLANKS))


def normalize(value: Column) -> Column:
    """Comparable form of a value: null is empty, ends trimmed, lower case."""
    return F.lower(strip(F.coalesce(value.cast("string"), F.lit(""))))


def word_count(value: Column) -> Column:
    """Number of words between white space, in one pass; null counts as no words."""
    # Most signs of a word are in two ranges free of blanks, which are quick to test.
    word = f"(?:[!-~\u00a1-\u167f]++|[^{BLANKS}])++"
    return F.regexp_count(F.coalesce(value, F.lit("")), F.lit(word))


def any_pattern(value: Column, patterns: Sequence[str]) -> Column:
    """Whether one of the patterns occurs in the lower-cased text."""
    return F.lower(value).rlike("|".join(f"(?:{p})" for p in patterns))


def phrase_of(code: Column, phrases: Mapping[str, str], default: str) -> Column:
    """Phrase for a code; a code without one is put into ``default`` (with ``%s``)."""
    fallback = F.format_string(default, code.cast("string"))
    if not phrases:
        return fallback
    table = F.create_map(*[F.lit(v) for item in phrases.items() for v in item])
    return F.coalesce(F.try_element_at(table, code), fallback)


def amount_text(amount: Column) -> Column:
    """Number as text: digits where the exponent is from -4 to 15, else ``1.5e+16``.

    Spark switches to an exponent at 10 million and below a thousandth, so those
    values are written out through a decimal.
    """
    plain = amount.cast("double").cast("string")
    size = F.abs(amount.cast("double"))
    digits = F.regexp_replace(
        plain.try_cast("decimal(38,21)").cast("string"), r"(\.\d*?[1-9])0+$|(\.0)0+$", "$1$2"
    )
    mantissa = F.regexp_replace(F.split(plain, "E")[0], r"\.0$", "")
    exponent = F.split(plain, "E")[1].cast("int")
    sign = F.when(exponent < 0, "-").otherwise("+")
    scientific = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return (
        F.when(amount.cast("string").isNull(), F.lit("nan"))
        .when(~plain.contains("E"), plain)
        .when((size >= 1e-4) & (size < 1e16), digits)
        .otherwise(scientific)
    )
