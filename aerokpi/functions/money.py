"""Exact sums of money amounts, whatever their scale and order.

An amount is a DOUBLE. If it lies on the common scale (four decimals, up to 2**53 units of
1e-4) it counts as that decimal number; any other counts as the binary number that it is,
cut into 40-bit pieces of fixed weights ("windows"). Counts and pieces are integers, so sums
are the same bits under every partitioning, and only the end result is rounded, once, to
the nearest DOUBLE.

An `Amount` holds the expressions of one row's value; a *sum* column is STRUCT<u, off, w0
... w6> of DECIMAL(38,0). Both are built and read by the functions here alone. Rows on the
common scale touch two primitive longs; their windows stay null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerokpi.params import MONEY_UNITS

#: Bits of a window, number of windows, and the exponent of the lowest: amounts are exact
#: from 2**-120 to 2**160; finer bits are cut, amounts beyond are not amounts (`is_amount`).
WINDOW_BITS = 40
WINDOWS = 7
LOWEST = -120
LARGEST = 2.0 ** (LOWEST + WINDOW_BITS * WINDOWS)
#: A count of units is split into high and low part, so that sums of longs can't overflow
#: below 2**36 rows.
_LOW_BITS = 26
_EXACT = "decimal(38,0)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _big(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(str(x))).cast(_EXACT)


def _w(i: int) -> str:
    return f"w{i}"


def is_amount(x) -> Column:
    """Finite and within the range of the windows; null for null."""
    return ~F.isnan(_c(x)) & (F.abs(_c(x)) < F.lit(LARGEST))


def _units(x: Column) -> tuple[Column, Column]:
    """The nearest count of units, and whether the amount lies on the common scale. `rint` is
    exact there: x * 1e4 is within an ulp of an integer."""
    scaled = x * F.lit(float(MONEY_UNITS))
    units = F.rint(scaled)
    near = F.abs(scaled - units) <= F.greatest(F.lit(1e-9), F.abs(units) * F.lit(4e-16))
    return units, near & (F.abs(units) <= F.lit(2.0**53))


def _piece(x: Column, i: int) -> Column:
    """The part of x in window i, towards zero: remainders by powers of two are exact."""
    weight = 2.0 ** (LOWEST + WINDOW_BITS * i)
    return ((x % F.lit(weight * 2.0**WINDOW_BITS)) / F.lit(weight)).cast("bigint")


class Amount(dict[str, Column]):
    """The fields h, l (high and low part of the units), off (parts off the common scale) and
    w0 ... w6 of one row's amount, all null for a null amount."""


def _part(c) -> tuple[Column, Column]:
    """An amount on the common scale as a count of units, any other as it is; one of the two is
    null, and both for what is no amount."""
    x = _c(c)
    units, on = _units(x)
    return F.when(is_amount(x) & on, units.cast("bigint")), F.when(is_amount(x) & ~on, x)


def _total(parts: list[tuple[Column, Column]], nulls_as_zero: bool) -> Amount:
    zero = F.lit(0).cast("bigint")
    add = lambda cs: reduce(lambda a, b: a + b, cs)
    units = add([F.coalesce(u, zero) for u, _ in parts])
    off = add([F.when(x.isNotNull(), 1).otherwise(0).cast("bigint") for _, x in parts])
    fields = {"h": F.shiftright(units, _LOW_BITS), "l": units.bitwiseAND(F.lit((1 << _LOW_BITS) - 1)), "off": off}
    for i in range(WINDOWS):
        fields[_w(i)] = F.when(off > 0, add([F.coalesce(_piece(x, i), zero) for _, x in parts]))
    if not nulls_as_zero:
        present = reduce(lambda a, b: a & b, [u.isNotNull() | x.isNotNull() for u, x in parts])
        fields = {k: F.when(present, v) for k, v in fields.items()}
    return Amount(fields)


def money_total(*cols, nulls_as_zero: bool = True) -> Amount:
    """Row-wise exact total of money columns.

    With ``nulls_as_zero=False`` a null part makes the total null. What is no amount (NaN,
    infinite, 2**160 or more) counts as null."""
    return _total([_part(c) for c in cols], nulls_as_zero)


_UNITS, _OFF = "_units_of_", "_off_scale_"


def with_parts(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with two columns more for each of the money columns, which ``parts_total`` adds up:
    several totals of a row then look at each of its amounts once."""
    parts = {c: _part(c) for c in cols}
    return df.select("*", *[u.alias(_UNITS + c) for c, (u, _) in parts.items()], *[x.alias(_OFF + c) for c, (_, x) in parts.items()])


def parts_total(*cols: str, nulls_as_zero: bool = True) -> Amount:
    """``money_total`` over ``with_parts``."""
    return _total([(F.col(_UNITS + c), F.col(_OFF + c)) for c in cols], nulls_as_zero)


def money(x) -> Amount:
    """One money column as an amount; null stays null."""
    return money_total(x, nulls_as_zero=False)


def money_sum(amount: Amount) -> Column:
    """SUM of an amount over rows, as a sum column; its fields are null if all amounts are.

    Only longs are summed by row: a piece is split like the units, as sums of decimals read
    and write every one of their buffers for every row."""
    units = _big(F.sum(amount["h"])) * _big(1 << _LOW_BITS) + _big(F.sum(amount["l"]))

    def window(w: Column) -> Column:
        high, low = F.shiftright(w, _LOW_BITS), w.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
        return (_big(F.sum(high)) * _big(1 << _LOW_BITS) + _big(F.sum(low))).cast(_EXACT)

    return F.struct(units.cast(_EXACT).alias("u"), F.sum(amount["off"]).alias("off"),
                    *[window(amount[_w(i)]).alias(_w(i)) for i in range(WINDOWS)])


def money_resum(total) -> Column:
    """SUM of a sum column, for coarser groups."""
    t = _c(total)
    return F.struct(F.sum(t["u"]).alias("u"), F.sum(t["off"]).alias("off"), *[F.sum(t[_w(i)]).alias(_w(i)) for i in range(WINDOWS)])


def money_resum_times(total, n) -> Column:
    """SUM of a sum column times a whole number."""
    t, n = _c(total), _big(_c(n))
    return F.struct(F.sum((t["u"] * n).cast(_EXACT)).alias("u"), F.sum(t["off"]).alias("off"),
                    *[F.sum((t[_w(i)] * n).cast(_EXACT)).alias(_w(i)) for i in range(WINDOWS)])


def _quotient(a: Column, rest: Column, b: int) -> Column:
    """(a - rest) / b, which is whole and below 10**32."""
    return ((a - rest) / _big(b)).cast(_EXACT)


def _combined(units: Column, windows: list[Column]) -> Column:
    """Units and windows as one DOUBLE, rounded once.

    The whole units go to the window of weight 1; the rest of them, a binary fraction cut at
    2**-100, and all windows are carried upwards to digits of 40 bits. These make a
    hexadecimal number of any length, and its cast to DOUBLE is the one rounding. A
    number below 0 leaves a negative carry; its negative doesn't."""
    base = 1 << WINDOW_BITS
    whole = -LOWEST // WINDOW_BITS
    rest = (units % _big(MONEY_UNITS)).cast(_EXACT)
    odd = MONEY_UNITS // 16  # rest / 10**4 = rest / (16 * odd)
    scaled = (rest * _big(1 << 96)).cast(_EXACT)
    digits = [F.coalesce(w, _big(0)) for w in windows]
    digits[0] = digits[0] + _quotient(scaled, (scaled % _big(odd)).cast(_EXACT), odd) * _big(1 << (-LOWEST - 96 - 4))
    digits[whole] = digits[whole] + _quotient(units, rest, MONEY_UNITS)
    plus = F.array(*[d.cast(_EXACT) for d in digits])
    start = F.struct(_big(0).alias("carry"), F.lit("").alias("hex"))

    def step(state: Column, digit: Column) -> Column:
        low = F.pmod(state["carry"] + digit, _big(base)).cast(_EXACT)
        text = F.lpad(F.hex(low.cast("bigint")), WINDOW_BITS // 4, "0")
        return F.struct(_quotient(state["carry"] + digit, low, base).alias("carry"), F.concat(text, state["hex"]).alias("hex"))

    def number(sign: Column) -> Column:
        return F.aggregate(plus, start, lambda s, d: step(s, d * sign), lambda s: F.when(s["carry"] >= 0, sign * F.concat(
            F.lit("0x"), F.hex(s["carry"].cast("bigint")), s["hex"], F.lit(f"p{LOWEST}")).cast("double")))

    return F.array_max(F.transform(F.array(F.lit(1), F.lit(-1)), number))


def _value(units: Column, off: Column, windows: list[Column]) -> Column:
    return F.when(off > 0, _combined(units, windows)).otherwise(units.cast("double") / F.lit(float(MONEY_UNITS)))


def amount_value(amount: Amount) -> Column:
    """The DOUBLE nearest to an amount."""
    return _value(F.shiftleft(amount["h"], _LOW_BITS) + amount["l"], amount["off"], [amount[_w(i)] for i in range(WINDOWS)])


def sum_value(total) -> Column:
    """The DOUBLE nearest to a sum."""
    t = _c(total)
    return _value(t["u"], t["off"], [t[_w(i)] for i in range(WINDOWS)])
