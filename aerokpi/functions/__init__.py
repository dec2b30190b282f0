"""Scalar Column expressions (all built-in Spark functions, no Python UDF)."""

from aerokpi.functions.columns import (  # noqa: F401
    booking_id_norm,
    canon_code,
    channel_norm,
    device_norm,
    has_booking_id,
    ratio,
    routing_key,
    segment_label,
    strip_ws,
    weekday_name,
    whole_days,
)
from aerokpi.functions.money import (  # noqa: F401
    amount_value,
    is_amount,
    money,
    money_resum,
    money_resum_times,
    money_sum,
    money_total,
    parts_total,
    sum_value,
    with_parts,
)
