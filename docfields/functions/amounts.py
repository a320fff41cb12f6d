"""Amount texts and exact sums of them, whatever their length.

A Spark decimal ends at 38 digits and amount texts do not, so an amount stays text. For a sum, amounts are scaled to
integers by their longest fraction.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions.text import WHITESPACE

# Digits of the widest decimal, less one for the carry of two additions.
_EXACT_DIGITS = 37
# Fixed value: sums are rounded to so many significant digits, half to even.
_SUM_DIGITS = 28
_INTEGER = "decimal(38,0)"
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"

_SHORT = r"^[0-9]{1,15}(?:\.[0-9]{0,2})?\z"

_SIGNS = ",$€£_"
_OUTER = f"[{WHITESPACE}{_SIGNS}]"
_DROPPED = rf"^{_OUTER}++|(?<!{_OUTER}){_OUTER}++\z|[{_SIGNS}]"


def amount_digits(value: Column) -> Column:
    """The text without thousands commas, currency signs, digit-group underscores and outer blanks."""
    return F.regexp_replace(value, _DROPPED, "")


def normalize_amount(value: Column) -> Column:
    """The number in an amount text, as text with all its digits; NULL if it is none.

    Exponents are written out, to ten places after the point.
    """
    digits = amount_digits(value)
    return F.when(digits.rlike(_NUMBER), digits).otherwise(digits.try_cast("decimal(38,10)").cast("string"))


def fraction_length(value: Column) -> Column:
    """Number of digits after the decimal point of an amount text."""
    return F.length(F.regexp_extract(amount_digits(value), r"\.([0-9]*)", 1))


def amount_text(value: Column) -> Column:
    """The number as it was written: same fraction digits, no superfluous zero, sign or point in front."""
    text = F.regexp_replace(amount_digits(value), r"^\+|^(-?)0+(?=[0-9])", "$1")
    text = F.regexp_replace(text, r"^(-?)(?=\.)", "$10")
    return F.regexp_replace(text, r"\.$", "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over one evaluation of ``value``."""
    return F.transform(F.array(value), body)[0]


def _zeros(count: Column) -> Column:
    return F.repeat(F.lit("0"), F.greatest(count, F.lit(0)))


def _fraction(number: Column) -> Column:
    return F.when(F.contains(number, F.lit(".")), F.substring_index(number, ".", -1)).otherwise(F.lit(""))


def _scaled(number: Column, places: Column) -> Column:
    """Digits of a number without sign and point, with ``places`` of them behind the point."""
    fraction = _fraction(number)
    whole = F.ltrim(F.substring_index(number, ".", 1), F.lit("+-"))
    return F.concat(whole, fraction, _zeros(places - F.length(fraction)))


def _to_integer(number: Column, digits: Column, dropped: Column) -> Column:
    kept = F.substring(digits, F.lit(1), F.length(digits) - dropped)
    unsigned = F.when(kept == "", F.lit("0")).otherwise(kept).cast(_INTEGER)
    return F.when(F.startswith(number, F.lit("-")), -unsigned).otherwise(unsigned)


def _rounded(total: Column) -> Column:
    """A sum to its significant digits."""
    def round_off(value: Column) -> Column:
        surplus = F.length(F.abs(value).cast("string")) - _SUM_DIGITS
        result = F.when(surplus <= 0, value)
        for count in range(1, _EXACT_DIGITS + 1 - _SUM_DIGITS + 1):
            result = result.when(surplus == count, F.bround(value, -count).cast(_INTEGER))
        return result

    return _let(total, round_off)


def sum_difference(first: Column, second: Column, total: Column) -> Column:
    """``|first + second - total|`` of three numbers as given by ``normalize_amount``: struct(units, places, zeros, rest).

    The difference is ``units`` followed by ``zeros`` zeros, with ``places`` of the digits behind the point. Numbers that
    have more than 37 digits between them lose their last ones, so many as ``zeros`` counts; ``rest`` tells whether the
    total had any but zeros there. NULL unless all three are numbers.
    """
    def measured(numbers: Column) -> Column:
        each = [numbers[name] for name in ("a", "b", "c")]
        places = F.greatest(*[F.length(_fraction(n)) for n in each], F.lit(2))
        digits = [_scaled(n, places) for n in each]
        longest = F.greatest(*[F.length(F.ltrim(d, F.lit("0"))) for d in digits])
        return F.struct(
            numbers.alias("numbers"), places.alias("places"), F.greatest(longest - _EXACT_DIGITS, F.lit(0)).alias("zeros"),
            *[d.alias(name) for d, name in zip(digits, ("a", "b", "c"), strict=True)],
        )

    def difference(m: Column) -> Column:
        a, b, c = (_to_integer(m["numbers"][name], m[name], m["zeros"]) for name in ("a", "b", "c"))
        units = F.abs(_rounded((_rounded((a + b).cast(_INTEGER)) - c).cast(_INTEGER)))
        rest = F.substring(m["c"], F.length(m["c"]) - m["zeros"] + 1, m["zeros"]).rlike("[1-9]")
        return F.struct(units.alias("units"), m["places"].alias("places"), m["zeros"].alias("zeros"), rest.alias("rest"))

    numbers = F.struct(first.alias("a"), second.alias("b"), total.alias("c"))
    found = _let(numbers, lambda n: _let(measured(n), difference))
    return F.when(first.isNotNull() & second.isNotNull() & total.isNotNull(), found)


def are_short(*amounts: Column) -> Column:
    """Whether all texts are plain amounts of at most 15 digits and two places, which decimals add exactly."""
    found = amounts[0].rlike(_SHORT)
    for amount in amounts[1:]:
        found = found & amount.rlike(_SHORT)
    return found


def short_difference(first: Column, second: Column, total: Column) -> Column:
    """``|first + second - total|`` of short amounts (``are_short``) as a decimal."""
    a, b, c = (amount.try_cast("decimal(17,2)") for amount in (first, second, total))
    return F.abs(a + b - c)


def exceeds(difference: Column, tolerance: str) -> Column:
    """Whether a difference is larger than a tolerance of at most two places; exactly on it is not."""
    hundredths = str(int(Decimal(tolerance) * 100))

    def above(d: Column) -> Column:
        below_point = d["places"] - d["zeros"]
        limit = F.when(below_point >= 2, F.concat(F.lit(hundredths), _zeros(below_point - 2)).cast(_INTEGER)).otherwise(
            F.lit(0).cast(_INTEGER)
        )
        return (d["units"] > limit) | ((below_point < 2) & d["rest"])

    return _let(difference, above)


def difference_text(difference: Column, digits: Column) -> Column:
    """A difference printed with the given number of fraction digits (those dropped are zeros)."""
    def printed(d: dict[str, Column]) -> Column:
        all_digits = F.when(d["units"] == 0, F.lit("0")).otherwise(F.concat(d["units"].cast("string"), _zeros(d["zeros"])))
        padded = F.concat(_zeros(d["places"] + 1 - F.length(all_digits)), all_digits)
        whole = F.length(padded) - d["places"]
        fraction = F.substring(padded, whole + 1, d["digits"])
        point = F.when(d["digits"] > 0, F.concat(F.lit("."), fraction)).otherwise(F.lit(""))
        return F.concat(F.substring(padded, F.lit(1), whole), point)

    both = F.struct(difference.alias("difference"), digits.alias("digits"))
    return _let(both, lambda b: printed({name: b["difference"][name] for name in ("units", "places", "zeros")} | {"digits": b["digits"]}))
