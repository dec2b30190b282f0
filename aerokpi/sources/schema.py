"""Entity schemas, column-name normalisation and lenient type coercion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerokpi.functions.money import is_amount

_MONEY = T.DoubleType()

# Date-like columns accept DATE or TIMESTAMP_NTZ as delivered; strings are
# parsed leniently to TIMESTAMP_NTZ.
DATE_LIKE = "date_like"

BOOKING = [
    ("bookingid_pnr", T.StringType()),
    ("reservation_date", DATE_LIKE),
    ("cancellation_date", DATE_LIKE),
    ("flight_date", DATE_LIKE),
    ("origin", T.StringType()),
    ("destination", T.StringType()),
    ("routing", T.StringType()),
    ("flightnumber", T.StringType()),
    ("revenue_per_booking_ticket", _MONEY),
    ("revenue_per_booking_ancilliary_pre_check_in", _MONEY),
    ("revenue_per_booking_ancilliary_at_check_in", _MONEY),
    ("passengercount", T.LongType()),
]

PASSENGER = [
    ("bookingid", T.StringType()),
    ("ordinal", T.LongType()),
    ("booking_channel", T.StringType()),
    ("device_used", T.StringType()),
]

FLIGHT = [
    ("flightnumber", T.StringType()),
    ("flightdate", DATE_LIKE),
    ("availablecapacity", T.IntegerType()),
    ("timeofday", T.StringType()),
    ("routetype", T.StringType()),
]

ENTITIES = {"booking": BOOKING, "passenger": PASSENGER, "flight": FLIGHT}

REVENUE_COLS = (
    "revenue_per_booking_ticket",
    "revenue_per_booking_ancilliary_pre_check_in",
    "revenue_per_booking_ancilliary_at_check_in",
)
ANCILLARY_COLS = REVENUE_COLS[1:]


def normalize_name(name: str) -> str:
    """Header -> column name: trim, lower-case, blanks to '_', drop parentheses."""
    n = name.strip().lower().replace(" ", "_")
    return re.sub(r"[()]", "", n)


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_name(c) for c in df.columns])


# Accepted date formats of text cells, tried in this order after ISO 8601. Numeric dates
# with slashes can put the month or the day first: a column is read with one order alone
# (`date_orders`); without an election, month before day where both read as a month.
MONTH_FIRST, DAY_FIRST = "month first", "day first"
ORDERED_FORMATS = {
    MONTH_FIRST: ("M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss"),
    DAY_FIRST: ("d/M/yyyy", "d/M/yyyy H:mm", "d/M/yyyy H:mm:ss"),
}
DATE_FORMATS = (
    "yyyy/M/d", "yyyyMMdd", *ORDERED_FORMATS[MONTH_FIRST], *ORDERED_FORMATS[DAY_FIRST],
    "d.M.yyyy", "d MMM yyyy", "d-MMM-yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d, yyyy",
)


def formats_of(order: str | None) -> tuple[str, ...]:
    """The formats a column of that order is read with (None: all)."""
    other = {MONTH_FIRST: DAY_FIRST, DAY_FIRST: MONTH_FIRST}.get(order)
    return tuple(f for f in DATE_FORMATS if f not in ORDERED_FORMATS.get(other, ()))


def date_orders(df: DataFrame, entity: str) -> DataFrame:
    """How a sheet's text columns of dates write them, from one counting pass: a row per
    column with the cells that hold something, those readable with the month first and with
    the day first, those that either alone can tell, ``elected`` (the order that reads more,
    the month first if both read as many) and ``ambiguous`` (both read as many, and some)."""
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = [n for n, w in ENTITIES[entity] if w == DATE_LIKE and isinstance(types.get(n), T.StringType)]
    fields = "column string, cells long, month_first long, day_first long, only_month_first long, only_day_first long, elected string, ambiguous boolean"
    if not columns:
        return spark.createDataFrame([], fields)

    def counts(name: str) -> Column:
        text = F.trim(F.col(name))
        reads = {o: F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).isNotNull() for o, formats in ORDERED_FORMATS.items()}
        m, d = reads[MONTH_FIRST], reads[DAY_FIRST]
        return F.struct(F.lit(name).alias("column"), F.count_if(text != "").alias("cells"), F.count_if(m).alias("month_first"), F.count_if(d).alias("day_first"),
                        F.count_if(m & ~d).alias("only_month_first"), F.count_if(d & ~m).alias("only_day_first"))

    rows = df.agg(F.array(*[counts(n) for n in columns]).alias("found")).select(F.inline("found"))
    m, d = F.col("month_first"), F.col("day_first")
    return rows.withColumn("elected", F.when(m + d > 0, F.when(d > m, DAY_FIRST).otherwise(MONTH_FIRST))).withColumn("ambiguous", (m == d) & (m > 0))


def elected_orders(orders: DataFrame) -> dict[str, str | None]:
    """The elected order by column: at most one row a date column of the entity."""
    return {r["column"]: r["elected"] for r in orders.select("column", "elected").collect()}


def _finite(x: Column) -> Column:
    """NaN, infinities and numbers beyond any amount (2**160) are missing values."""
    return F.when(is_amount(x), x)


def _coerce(col: Column, have: T.DataType, want, order: str | None = None) -> Column:
    if want == DATE_LIKE:
        if isinstance(have, (T.DateType, T.TimestampNTZType)):
            return col
        if isinstance(have, T.TimestampType):
            return col.cast("timestamp_ntz")
        text = F.trim(col.cast("string"))
        return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in formats_of(order)]).cast("timestamp_ntz")
    if isinstance(want, T.DoubleType):
        return _finite(col.try_cast("double"))
    if isinstance(want, (T.LongType, T.IntegerType)) and not isinstance(have, T.IntegralType):
        # "12.0" is 12; "x", "NaN" and a fraction are missing, never cut
        number = _finite(col.try_cast("double"))
        return F.when(number == F.rint(number), number).try_cast(want)
    return col if have == want else col.try_cast(want)


def unparsed_cells(df: DataFrame, entity: str, orders: dict[str, str | None] | None = None) -> DataFrame:
    """(column, unparsed): cells of a sheet that hold something but become null, by column."""
    orders = orders or {}
    types = {f.name: f.dataType for f in df.schema.fields}
    present = [(n, w) for n, w in ENTITIES[entity] if n in types]
    counts = df.agg(*[
        F.count_if((F.trim(F.col(n).cast("string")) != "") & _coerce(F.col(n), types[n], w, orders.get(n)).isNull()).alias(n) for n, w in present])
    return counts.unpivot([], [n for n, _ in present], "column", "unparsed")


def conform(df: DataFrame, entity: str, orders: dict[str, str | None] | None = None) -> DataFrame:
    """Project ``df`` onto the entity schema, reading dates by the elected ``orders``.

    Present columns are coerced leniently (unparsable values become null,
    never an exception); absent optional columns are added as typed nulls.
    Unknown columns are dropped.
    """
    fields, orders = ENTITIES[entity], orders or {}
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name, want in fields:
        if name in types:
            out.append(_coerce(F.col(name), types[name], want, orders.get(name)).alias(name))
        else:
            t = T.TimestampNTZType() if want == DATE_LIKE else want
            out.append(F.lit(None).cast(t).alias(name))
    return df.select(*out)
