"""Scalar cleaning rules.  All are built-in column expressions, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "missing" in exports, compared after trim and lower.
MISSING_TEXTS = ["n/a", "na", "null", "none", "nan", "", "-", "?"]

# Unit-of-measure spellings and the unit they stand for.
UNIT_NAMES = {
    "ea": "EA",
    "each": "EA",
    "pcs": "EA",
    "piece": "EA",
    "kg": "KG",
    "g": "G",
    "lb": "LB",
    "lbs": "LB",
    "oz": "OZ",
}

# Plausible ranges; anything outside becomes NULL.
QUANTITY_RANGE = (0, 1_000_000)
PRICE_RANGE = (0.0, 1_000_000.0)

# Month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

MARK = "\x01"  # between the parts of a date that was taken apart


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


CONTROLS = r"[\x00-\x1F\x7F]"
# What text has that cleaning may change: anything beyond printable ASCII, or a space at an end or after another one.
# One class or literal at a time: a repeated group would cost the JVM a stack frame for every word of a long text.
UNTIDY = r"[^ -~]|^ |  | \z"


def clean_text(value: Column | str) -> Column:
    """Delete control characters, then squeeze whitespace runs to one space and trim.

    Control characters go first, so a tab or newline joins its neighbours instead of becoming a space.
    Most cells of an export are clean already, and finding that out is cheaper than rewriting them.
    """
    c = _col(value)
    rewritten = F.trim(F.regexp_replace(F.regexp_replace(c, CONTROLS, ""), r"(?U)\s+", " "))
    return F.when(c.rlike(UNTIDY), rewritten).otherwise(c)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it.

    Spark shares repeated expressions only where they are always evaluated, so within a branch of ``when`` a costly text
    is worked out again for every mention.  The variable of a higher-order function is bound to its value.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_missing_text(value: Column | str) -> Column:
    c = _col(value)
    return c.isNull() | F.lower(F.trim(c)).isin(MISSING_TEXTS)


def missing_to_null(value: Column | str) -> Column:
    """Reader-level rule: only the exact spelling counts, no trimming and no case folding."""
    c = _col(value)
    return F.when(c.isin(MISSING_TEXTS), None).otherwise(c)


def normalize_sku(value: Column | str) -> Column:
    """Upper-case and drop everything that is not an ASCII letter or digit."""
    # Java looks the named class up in a table; the same class spelled out took ten times as long.
    return F.regexp_replace(F.upper(_col(value)), r"\P{Alnum}", "")


def normalize_uom(value: Column | str) -> Column:
    c = F.trim(_col(value))
    spelled = F.create_map(*[F.lit(x) for pair in UNIT_NAMES.items() for x in pair])
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(spelled, F.lower(c)), F.upper(c)))


# Spark's cast also takes a trailing type letter ("12d"); only plain decimal notation is a number here.
PLAIN_NUMBER = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?inf(inity)?$"


def _number(value: Column | str) -> Column:
    # None of the missing texts is a plain number.  Only text with a letter in it can be cast without being one.
    text = F.replace(F.trim(_col(value).cast("string")), F.lit(","), F.lit(""))
    return F.when(~text.rlike("[A-Za-z]") | text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def coerce_float(value: Column | str) -> Column:
    """Number with thousands commas allowed; anything else becomes NULL."""
    return _number(value)


def coerce_int(value: Column | str) -> Column:
    """As coerce_float, cut towards zero; values a long cannot hold become NULL."""
    n = _number(value)
    fits = (n >= F.lit(-(2.0**63))) & (n < F.lit(2.0**63))
    return F.when(fits, F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)))


def coerce_or_zero(value: Column | str, dtype: str = "string") -> Column:
    """Inventory rule: a value that is not a plain number (commas included) becomes 0.

    ``dtype`` is the column's Spark type name; a column that is numeric already skips the text rules.
    """
    c = _col(value)
    if dtype == "string":
        c = F.trim(c)
        number = F.when(c.rlike(PLAIN_NUMBER), c.try_cast("double"))
    elif dtype == "boolean":
        number = c.cast("int").cast("double")
    else:
        number = F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
    return F.coalesce(number, F.lit(0.0))


def parse_date_any(value: Column | str) -> Column:
    """Timestamp of a date as people write it, otherwise NULL.

    Year first (2024-01-05, 2024/1/5, 20240105), month or day first with slashes, dots or dashes (month first where
    both fit; two-digit years are 20xx), and month names (5 Jan 2024, 5-Jan-2024, Jan 5, 2024, Friday, January 5th
    2024).  A time of day may follow, with seconds and fractions, AM or PM, and a zone (Z, +02:00, UTC).
    """
    c = F.btrim(_col(value).cast("string"))
    first = F.substring(c, 5, 1)
    # One cheap look at the text decides which family of rewritings is tried; the cast knows year-first text and zones.
    return (
        F.when(c.rlike(r"^\d{4}-\d"), _cast_time(c))
        .when(c.rlike(r"^\d{8}$"), _cast_time(F.regexp_replace(c, r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3")))
        .when((first == "/") & c.rlike(r"^\d{4}/\d"), _cast_time(F.regexp_replace(c, r"^(\d{4})/(\d{1,2})/", "$1-$2-")))
        .when(c.rlike(r"^\d{1,2}[/.-]\d{1,2}[/.-]\d"), _numeric_date(c))
        .when(c.rlike(r"[A-Za-z]{3}"), _named_date(c))
    )


def _cast_time(c: Column) -> Column:
    """Year-first text to a timestamp; hours of AM and PM are turned into 24 hours first."""
    return once(c, _cast_known_time)


def _cast_known_time(c: Column) -> Column:
    half = r"(?i)^(\S+[ T])(\d{1,2})(:\d\d(?::\d\d(?:\.\d+)?)?|) ?([ap])\.?m\.?(.*)$"
    hour = F.regexp_extract(c, half, 2).cast("int")
    afternoon = F.lower(F.regexp_extract(c, half, 4)) == "p"
    minutes = F.regexp_extract(c, half, 3)
    day = F.when(hour.between(1, 12), hour % 12 + F.when(afternoon, 12).otherwise(0))
    full = F.concat(
        F.regexp_extract(c, half, 1), day.cast("string"), F.when(minutes == "", ":00").otherwise(minutes), F.regexp_extract(c, half, 5)
    )
    return F.when(c.rlike(r"(?i)[ap]\.?m\b"), full.try_cast("timestamp")).otherwise(c.try_cast("timestamp"))


def _numeric_date(c: Column) -> Column:
    """Month first, and if that is no date, day first."""
    shape = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?!\d)"
    # A group number swallows the digits behind it, so the century goes in with a mark in between.
    c = F.replace(F.regexp_replace(c, r"^(\d{1,2}[/.-]\d{1,2}[/.-])(\d{2})(?!\d)", "$1#$2"), F.lit("#"), F.lit("20"))
    return once(
        c,
        lambda c: F.coalesce(
            _cast_time(F.regexp_replace(c, shape, "$3-$1-$2")), _cast_time(F.regexp_replace(c, shape, "$3-$2-$1"))
        ),
    )


def _named_date(c: Column) -> Column:
    """Day and month name in either order, the weekday left out, then the year."""
    shape = (
        r"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[,.]? +)?(?:(\d{1,2})(?:st|nd|rd|th)?[ -])?([a-z]{3})[a-z]*\.?[ -]"
        r"(?:(\d{1,2})(?:st|nd|rd|th)?,? )?(\d{4})(?!\d),?(.*)$"
    )
    # One match gives all five parts; a text that does not match comes back as it was.
    parts = F.regexp_replace(c, shape, MARK.join(f"${k}" for k in range(1, 6)))
    return once(parts, lambda found: F.when(found != c, once(F.split(found, MARK, 5), _date_of_parts)))


def _date_of_parts(parts: Column) -> Column:
    part = lambda k: F.get(parts, F.lit(k - 1))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(2)))
    day = F.concat(part(1), part(3))  # one of them is empty
    fits = (month > 0) & ((part(1) == "") != (part(3) == ""))
    return F.when(fits, _cast_time(F.concat(part(4), F.lit("-"), month.cast("string"), F.lit("-"), day, part(5))))


def out_of_bounds(value: Column | str, low: float, high: float) -> Column:
    c = _col(value)
    return F.coalesce((c < low) | (c > high), F.lit(False))


def null_out_of_bounds(value: Column | str, low: float, high: float) -> Column:
    c = _col(value)
    return F.when(c.between(low, high), c)


def revenue(quantity: Column | str, price: Column | str) -> Column:
    """Quantity times price; NULL if either is NULL."""
    return _col(quantity).cast("double") * _col(price).cast("double")
