"""Amounts and dates out of text, as canonical strings; built-in column expressions only.

Nothing here raises under ANSI: what can't be read is null. Amounts are rounded half to
even to three decimals, and have at most 28 digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions import lexicon as lx

WIDE, EXACT = "decimal(38,10)", "decimal(28,3)"
#: Runs of white space of any kind but the blank; spelled out, as a class of Unicode's properties is slow.
OTHER_SPACE = r"[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: From the first digit, or a minus with neither marks nor white space between, to the last digit before another minus.
#: What isn't part of a number may stand within, as currencies do, so a text needn't be cleaned of it before.
FIRST_NUMBER = rf"(?:-[^0123456789,.\- {OTHER_SPACE[1:-2]}]*+)?\d(?:[^\-]*\d)?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body reads it: without this, plans
    grow with the product of the uses at each level."""
    return F.element_at(F.transform(F.array(value), body), 1)


def try_decimal(text: Column) -> Column:
    """A plain decimal number (decimal(38,10)), or null."""
    return F.trim(text).try_cast(WIDE)


def format_amount(value: Column) -> Column:
    """Three decimals, half to even, as a string; null beyond 28 digits."""
    return F.bround(value, 3).try_cast(EXACT).cast("string")


def extract_amount(text: Column, bind: Callable = lambda value, body: body(value)) -> Column:
    """First amount of a text: currencies and percentages go; of comma and point the later one is
    the decimal mark; a single comma is one if at most three digits follow. Texts without a digit
    have none and aren't read further.

    bind: let within a lambda; elsewhere Spark works out once what occurs several times."""
    return bind(amount_digits(text), amount_of)


def amount_digits(text: Column) -> Column:
    """The first number of a text with its marks, without blanks; empty or null if there is none."""
    # fixed values: currencies and percentages, which matter to one another; what may be part of a number
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, OTHER_SPACE, " "), r"TND|DT|[€$£]", ""), r"-?\d[\d.,]*\s*%", "")
    x = F.when(text.rlike("[0-9]"), F.when(text.contains("%"), bare).otherwise(text))
    return F.regexp_replace(F.regexp_extract(x, FIRST_NUMBER, 0), r"[^0123456789,.\-]+", "")


def amount_of(x: Column) -> Column:
    """The amount that such a number stands for."""
    comma, point = F.instr(F.reverse(x), ","), F.instr(F.reverse(x), ".")
    no_comma = F.replace(x, F.lit(","), F.lit(""))
    as_point = F.replace(x, F.lit(","), F.lit("."))
    once = F.length(x) - F.length(no_comma) == 1
    number = (
        F.when((comma > 0) & (point > 0), F.when(comma < point, F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(no_comma))
        .when(comma > 0, F.when(once & comma.between(2, 4), as_point).otherwise(no_comma))
        .otherwise(x)
    )
    return format_amount(number.try_cast(WIDE))


def parse_decimal(text: Column) -> Column:
    """A plain or French number ("1 250,00"), or null."""
    def read(x: Column) -> Column:
        bare = F.translate(x, " \u00a0", "")
        french = F.when(bare.contains(","), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(bare)
        return F.coalesce(x.try_cast(WIDE), french.try_cast(WIDE))

    return let(F.nullif(F.trim(text), F.lit("")), read)


def _iso(year: Column, month: Column, day: Column) -> Column:
    """The ISO date of digits, null if there is no such day. A cast tells that by itself; to_date raises within for each that is none."""
    text = F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return text.try_cast("date").cast("string")


#: Dates in digits; dates with a month's name.
DATE_DIGITS, DATE_NAMED = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b", r"\b(\d{1,2})\s+([a-z]+)\s+(\d{4})\b"


def spaced(text: Column) -> Column:
    """Single blanks for white space of any kind, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def extract_date(text: Column, norm: Column) -> Column:
    """ISO date of a text: day, month, year in digits, else day, French month name, year (in its
    normal form). Digits that make no date aren't tried as a name."""
    told = F.array(F.regexp_extract(spaced(text), DATE_DIGITS, 0), F.regexp_extract(norm, DATE_NAMED, 0))
    return F.when(text.rlike("[0-9]"), let(told, lambda own: date_of(own[0], own[1])))


def date_of(digits: Column, named: Column) -> Column:
    """The ISO date of what matched DATE_DIGITS, or else DATE_NAMED; each empty where nothing did."""
    table = F.str_to_map(F.lit(",".join(f"{name}:{k}" for k, name in enumerate(lx.MONTHS, 1))), F.lit(","), F.lit(":"))
    part = lambda i: F.split_part(F.translate(digits, "-", "/"), F.lit("/"), F.lit(i))
    word = lambda i: F.regexp_extract(named, DATE_NAMED, i)
    year = part(3).try_cast("int")
    full = (year + F.when(year < 100, F.lit(2000)).otherwise(F.lit(0))).cast("string")
    return F.when(digits != "", _iso(full, part(2), part(1))).when(named != "", _iso(word(3), table[word(2)], word(1)))
