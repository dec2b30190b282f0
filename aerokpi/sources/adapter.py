"""Test-data adapter: TPC-style tables -> the three workbook sheets.

The generated tables at ``/root/testdata/sf*/`` have another domain, so a
fixed mapping turns them into Booking / Passenger / Flight sheets with the
workbook's display headers. The mapping is chosen so that every
data-quality rule has offenders (null dates, null revenue parts, zero
seats, legs without capacity, non-positive passenger counts).

All joins are plain DataFrame joins; Catalyst prunes the columns read from
each Parquet file. ``nation`` and ``region`` are fixed-size (25 and 5 rows)
and are broadcast explicitly; lineitem x orders is pinned to a shuffle
sort-merge join; the customer and supplier joins are left to the optimizer
and AQE, which switches to a broadcast only when the measured size of a
side is under the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# ---------------------------------------------------------------------------
# Workbook display headers of each sheet.
# ---------------------------------------------------------------------------
BOOKING_HEADERS = (
    "BookingID (PNR)", "Reservation Date", "Cancellation Date", "Flight Date",
    "Origin", "Destination", "Routing", "FlightNumber",
    "Revenue per Booking (Ticket)",
    "Revenue per Booking (Ancilliary pre Check in)",
    "Revenue per Booking (Ancilliary at Check in)",
    "PassengerCount",
)
PASSENGER_HEADERS = ("BookingID", "Ordinal", "Booking Channel", "Device Used")
FLIGHT_HEADERS = ("FlightNumber", "FlightDate", "AvailableCapacity", "TimeOfDay", "RouteType")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _region_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # 25 x 5 rows by definition of the schema: a proven size bound.
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "r_regionkey", "r_name"
    )


def _cents(x: str):
    """A two-decimal double as an exact BIGINT number of hundredths."""
    return F.rint(F.col(x) * F.lit(100.0)).cast("bigint")


def _money(units):
    """Exact amount given in 1e-4 units -> nearest DOUBLE."""
    return units.cast("double") / F.lit(10000.0)


def booking_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    ron = F.broadcast(_region_of_nation(spark, sf_dir))
    supp = (
        _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        .join(ron, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("r_regionkey").alias("o_rk"), F.col("r_name").alias("o_name"))
    )
    cust = (
        _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        .join(ron, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.col("r_regionkey").alias("d_rk"), F.col("r_name").alias("d_name"))
    )
    # order -> destination region first (orders is 1/4 of lineitem), then one
    # join of lineitem on the order key.
    order_dest = (
        _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "d_rk", "d_name")
    )
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate",
    )
    # The fact-to-fact join is a shuffle sort-merge join on the order key:
    # neither side has a size bound, so neither may be broadcast on the
    # strength of a file-size estimate. The supplier join is left to AQE,
    # which broadcasts the supplier side only if its measured size is small.
    j = li.hint("shuffle_merge").join(order_dest, F.col("l_orderkey") == F.col("o_orderkey")).join(
        supp, F.col("l_suppkey") == F.col("s_suppkey")
    )

    ship = F.to_date("l_shipdate")
    qty = F.col("l_quantity").cast("int")
    pk = F.col("l_partkey")
    price = _cents("l_extendedprice")
    od_arrow = F.concat("o_name", F.lit("→"), "d_name")
    od_dash = F.lower(F.concat("o_name", F.lit(" - "), "d_name"))
    return j.select(
        F.concat(F.lit("PNR-"), F.col("l_orderkey").cast("string")).alias(BOOKING_HEADERS[0]),
        F.when(pk % 97 != 0, F.date_sub(ship, F.col("l_linenumber") * 7 + qty % 7 - 9)).alias(BOOKING_HEADERS[1]),
        F.when(F.col("l_returnflag") == "R", F.date_sub(ship, qty % 20 - 3)).alias(BOOKING_HEADERS[2]),
        F.when(pk % 89 != 0, ship).alias(BOOKING_HEADERS[3]),
        F.col("o_name").alias(BOOKING_HEADERS[4]),
        F.col("d_name").alias(BOOKING_HEADERS[5]),
        F.when(pk % 103 == 0, F.lit(None).cast("string"))
        .when(pk % 101 == 0, F.lit("XXX-YYY"))
        .when(F.col("l_linenumber") % 2 == 0, od_arrow)
        .otherwise(od_dash)
        .alias(BOOKING_HEADERS[6]),
        F.concat(F.lit("TX"), (F.col("o_rk") * 5 + F.col("d_rk") + 1000).cast("string")).alias(BOOKING_HEADERS[7]),
        _money((price - 150000) * 100).alias(BOOKING_HEADERS[8]),
        _money(price * _cents("l_tax")).alias(BOOKING_HEADERS[9]),
        F.when(F.col("l_suppkey") % 10 != 0, _money(price * _cents("l_discount"))).alias(BOOKING_HEADERS[10]),
        (F.col("l_quantity").cast("bigint") - 2).alias(BOOKING_HEADERS[11]),
    )


def flight_sheet(booking: DataFrame) -> DataFrame:
    """One row per (flight number, date) seen in the (normalised) bookings."""
    d = (
        booking.where(F.col("flight_date").isNotNull())
        .select("flightnumber", F.col("flight_date").alias("flightdate"))
        .distinct()
        .select(
            "flightnumber", "flightdate",
            F.dayofyear("flightdate").alias("doy"),
            F.expr("substring(flightnumber, 3)").cast("int").alias("fn"),
        )
        .where(F.col("doy") % 50 != 0)
    )
    tod = (F.col("doy") + F.col("fn")) % 3
    return d.select(
        F.col("flightnumber").alias(FLIGHT_HEADERS[0]),
        F.col("flightdate").alias(FLIGHT_HEADERS[1]),
        F.when(F.col("doy") % 90 == 0, F.lit(0)).otherwise((F.col("doy") + F.col("fn")) % 45 + 158).alias(FLIGHT_HEADERS[2]),
        F.when(tod == 0, "Morning").when(tod == 1, "Afternoon").otherwise("Evening").alias(FLIGHT_HEADERS[3]),
        F.when(F.col("fn") % 2 == 0, "Outbound").otherwise("Inbound").alias(FLIGHT_HEADERS[4]),
    )


def passenger_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    et = F.col("event_type")
    dev = F.floor("value").cast("int") % 3
    return ev.select(
        F.concat(F.lit("pnr "), (F.col("event_id") - F.col("event_id") % 3).cast("string")).alias(PASSENGER_HEADERS[0]),
        F.col("event_id").alias(PASSENGER_HEADERS[1]),
        F.when(et == "click", "App").when(et == "view", " Web ").when(et == "signup", "OTA")
        .when(et == "error", F.lit(None).cast("string")).otherwise("Travel Agency").alias(PASSENGER_HEADERS[2]),
        F.when(dev == 0, "Mobile").when(dev == 1, "Desktop ").alias(PASSENGER_HEADERS[3]),
    )
