"""All tunable numbers and fixed lookup values in one place.

Operators never hard-code a constant: they take a ``KpiParams`` (default
``DEFAULT``) and turn its fields into literals, so Catalyst folds them.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace


# ---------------------------------------------------------------------------
# Fixed values (must equal the analysed project's values for equal results)
# ---------------------------------------------------------------------------

# Weekday labels in calendar order, as produced by a "full day name" format.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Time-of-day labels in display order.
TIMES_OF_DAY = ("Morning", "Afternoon", "Evening")

# Booking-channel synonyms, applied after trimming and lower-casing; any
# other value passes through unchanged.
CHANNEL_SYNONYMS = {
    "condor app": "condor app",
    "condor-app": "condor app",
    "app": "condor app",
    "website": "website",
    "web": "website",
    "call center": "call center",
    "travel agency": "travel agency",
    "ota": "ota",
    "online travel agency": "ota",
}

# The fifteen data-quality checks, in their reporting order (ties in the
# summary are broken by this order).
DQ_CHECKS = (
    "canceled_with_checkin_ancillary",
    "cancellation_before_reservation",
    "reservation_after_flight",
    "same_booking_multiple_channels",
    "same_booking_multiple_devices",
    "revenue_with_zero_passengers",
    "negative_revenue_fields",
    "negative_passengers",
    "pax_exceeds_capacity",
    "missing_capacity_for_leg",
    "capacity_out_of_range",
    "routing_inconsistent_with_od",
    "duplicate_legs_within_pnr",
    "cancellation_with_positive_pax",
    "missing_flight_date",
)

# Separators used in labels.
SEGMENT_ARROW = "→"
ROUTING_DASH = "-"

# Money: the common scale of amounts is four decimals. Amounts are stored as DOUBLE (the
# nearest double); those on the common scale are summed as counts of 1e-4, others as
# the binary numbers they are (functions/money.py), so no sum depends on the order in
# which partitions are combined.
MONEY_UNITS = 10000


@dataclass(frozen=True)
class KpiParams:
    # SQL PACS (per leg)
    connection_value_pct: float = 0.15
    variable_cost_per_seat_leg: float = 25.0
    # weekday PACS (feeder credit)
    dow_connection_value_pct: float = 0.25
    dow_variable_cost_per_seat_leg: float = 40.0
    feeder_segment: tuple[str, str] = ("FRA", "FCO")
    onward_segment: tuple[str, str] = ("FCO", "PMO")
    # data quality
    capacity_min: int = 160
    capacity_max: int = 200
    lf_upper_bound: float = 1.2
    # yield index
    yield_buckets: int = 5
    # insights
    channel_min_bookings: int = 25
    last_minute_days: int = 1
    correlation_cut: float = 0.1
    min_corr_pairs: int = 2
    # top-k sizes
    top_pacs_print: int = 5
    top_pacs_chart: int = 20
    top_outliers: int = 10
    top_segments_chart: int = 8
    top_segments_aras: int = 10
    # columns of the wide weekday table, by segment label (None: one map column)
    wide_segments: tuple[str, ...] | None = None
    channel_synonyms: dict = field(default_factory=lambda: dict(CHANNEL_SYNONYMS))


    def __post_init__(self) -> None:
        for name in ("connection_value_pct", "dow_connection_value_pct"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1, not {getattr(self, name)}")
        if self.capacity_min > self.capacity_max:
            raise ValueError(f"capacity_min {self.capacity_min} exceeds capacity_max {self.capacity_max}")
        for f in fields(self):
            if (f.name.startswith("top_") or f.name == "yield_buckets") and getattr(self, f.name) < 1:
                raise ValueError(f"{f.name} must be at least 1")

    def with_values(self, values: Mapping[str, object]) -> KpiParams:
        """These parameters with some replaced. An unknown name, a value of another type or
        an impossible one is an error; whole numbers stand for doubles, lists for tuples."""
        known = {f.name: getattr(self, f.name) for f in fields(self)}
        unknown = sorted(set(values) - set(known))
        if unknown:
            raise ValueError(f"unknown parameters: {', '.join(unknown)}; known are {', '.join(sorted(known))}")
        return replace(self, **{k: _as_type_of(k, known[k], v) for k, v in values.items()})


def _as_type_of(name: str, example: object, value: object) -> object:
    if name == "wide_segments" and value is None:
        return None
    if isinstance(example, tuple) or name == "wide_segments":
        ok = isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value)
        if ok and (name == "wide_segments" or len(value) == len(example)):  # type: ignore[arg-type]
            return tuple(value)  # type: ignore[arg-type]
    elif isinstance(example, dict):
        if isinstance(value, Mapping) and all(isinstance(x, str) for kv in value.items() for x in kv):
            return dict(value)
    elif isinstance(example, float):
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return float(value)
    elif isinstance(value, int) and not isinstance(value, bool):
        return value
    raise ValueError(f"parameter {name}: {value!r} can't replace {example!r}")


def params_from_text(text: str, base: KpiParams | None = None, source: str = "parameters") -> KpiParams:
    """Parameters from a JSON object or from a YAML mapping: ``name: value`` lines whose values
    are JSON (or bare words), in sections that only order them, with ``#`` comments."""
    if text.lstrip().startswith("{"):
        values = json.loads(text)
    else:
        values = {}
        for number, line in enumerate(text.splitlines(), 1):
            line = line.split(" #")[0].rstrip()
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            name, colon, value = line.strip().partition(":")
            if not colon:
                raise ValueError(f"{source}, line {number}: expected `name: value`, not {line.strip()!r}")
            if not value.strip():
                continue  # a section
            if name in values:
                raise ValueError(f"{source}, line {number}: {name} is given twice")
            try:
                values[name] = json.loads(value)
            except ValueError:
                values[name] = value.strip()
    if not isinstance(values, dict):
        raise ValueError(f"{source}: expected a mapping of names to values")
    return (base or DEFAULT).with_values(values)


DEFAULT = KpiParams()

# Segments of the TPC-style test data play the feeder / onward roles
# (its airports are the five region names).
TEST_AIRPORTS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
TESTDATA = KpiParams(
    feeder_segment=("AFRICA", "AMERICA"), onward_segment=("AMERICA", "ASIA"),
    wide_segments=tuple(f"{o}{SEGMENT_ARROW}{d}" for o in TEST_AIRPORTS for d in TEST_AIRPORTS))
