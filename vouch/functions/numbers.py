"""Number rules: tolerance, safe coercion, canonical digits and number texts.

Functions ending in ``_sql`` return SQL text for use inside larger expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouch.functions import fixed


def finite(value: Column) -> Column:
    """``value`` as double, null when it is no number or not finite."""
    number = value.try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def order_key(value: Column) -> Column:
    """64-bit integer in the order of doubles, equal only for equal ones: the bit pattern, negated below zero; NaN is last."""
    size = F.abs(value)
    guess = F.floor(F.log2(size)).cast("int")
    # the logarithm may be off by one next to a power of two; powers of two themselves are exact
    two = F.lit(2.0)
    exponent = guess + F.when(F.pow(two, guess) > size, -1).when(size / F.pow(two, guess) >= 2, 1).otherwise(0)
    normal = (exponent + 1023).cast("long") * (1 << 52) + ((size / F.pow(two, exponent) - 1) * 2.0 ** 52).cast("long")
    tiny = (size / 5e-324).cast("long")
    beyond = F.lit(2047 << 52) + F.isnan(value).cast("long")
    key = F.when(size >= float("inf"), beyond).when(size == 0, F.lit(0).cast("long")).when(size < 2.2250738585072014e-308, tiny).otherwise(normal)
    return F.when(value < 0, -key).otherwise(key)


def divide(top: Column, bottom: Column) -> Column:
    """top / bottom, null when the divisor is zero."""
    return F.when(bottom != 0, top / bottom)


def percent_change(change: Column, base: Column) -> Column:
    """Change in percent of the absolute base, null for a zero base."""
    return divide(change, F.abs(base)) * 100


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(value, F.lit(high))))


def close_sql(a: str, b: str, tolerance: float = fixed.TOLERANCE) -> str:
    """True when both are null, or both present and within relative or absolute tolerance.

    Equal infinities match; an infinity never matches a finite number.
    """
    x, y, limit = f"cast({a} as double)", f"cast({b} as double)", f"{tolerance!r}D"
    near = (
        f"abs({x} - {y}) <= greatest(greatest(abs({x}), abs({y})) * {limit}, {limit}) "
        f"and abs({x}) < double('Infinity') and abs({y}) < double('Infinity')"
    )
    return f"({x} <=> {y} or coalesce({near}, false))"


def canonical_sql(value: str) -> str:
    """Keep 12 significant digits, dropping binary representation noise."""
    return (
        f"(case when abs({value}) < double('Infinity') "
        f"then try_cast(format_string('%.11e', {value}) as double) else {value} end)"
    )


def canonical(value: str) -> Column:
    return F.expr(canonical_sql(value))


def number_text_sql(value: str) -> str:
    """Shortest text of a canonical double: fixed notation between 1e-4 and 1e16, else exponent."""
    plain = f"rtrim('0', cast(try_cast({value} as decimal(38,18)) as string))"
    scientific = f"format_string('%.11e', {value})"
    mantissa = f"rtrim('.', rtrim('0', split_part({scientific}, 'e', 1)))"
    return (
        f"(case when {value} = 0 then '0.0' "
        f"when abs({value}) >= 1e-4D and abs({value}) < 1e16D then "
        f"if(endswith({plain}, '.'), {plain} || '0', {plain}) "
        f"when abs({value}) < double('Infinity') then {mantissa} || 'e' || split_part({scientific}, 'e', 2) "
        f"when {value} > 0 then 'inf' when {value} < 0 then '-inf' end)"
    )


def number_text(value: str) -> Column:
    return F.expr(number_text_sql(value))


def numbers_in_sql(text: str) -> str:
    """Every number in a text as array<double>; leading ``1.`` list markers are not numbers."""
    body = f"regexp_replace({text}, r'{fixed.LIST_MARKER_PATTERN}', '')"
    return f"transform(regexp_extract_all({body}, r'({fixed.NUMBER_PATTERN})', 1), s -> try_cast(s as double))"


def numbers_in(text: str) -> Column:
    return F.expr(numbers_in_sql(text))
