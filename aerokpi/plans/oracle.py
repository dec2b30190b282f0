"""DuckDB SQL counterparts of the registered queries (the correctness oracle).

Only the base Parquet tables are registered on the DuckDB side, so every
oracle text is a single statement that starts with the test-data adapter
as CTEs, followed by the shared derived relations it needs, then its own
SELECT. ``sql(final, deps)`` assembles that statement; relations are
listed once, in dependency order.
"""

from __future__ import annotations

from aerokpi.params import CHANNEL_SYNONYMS, DQ_CHECKS, TEST_AIRPORTS, TESTDATA, TIMES_OF_DAY, WEEKDAYS

P = TESTDATA

# ---------------------------------------------------------------------------
# Shared relations: name -> (dependencies, body)
# ---------------------------------------------------------------------------
REL: dict[str, tuple[tuple[str, ...], str]] = {}


def rel(name: str, deps: tuple[str, ...], body: str) -> None:
    REL[name] = (deps, body)


rel("booking", (), """
SELECT 'PNR-' || CAST(l.l_orderkey AS VARCHAR) AS bookingid_pnr,
  CASE WHEN l.l_partkey % 97 <> 0 THEN CAST(l.l_shipdate AS DATE) - CAST(7*l.l_linenumber + CAST(l.l_quantity AS INT) % 7 - 9 AS INT) END AS reservation_date,
  CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_shipdate AS DATE) - CAST(CAST(l.l_quantity AS INT) % 20 - 3 AS INT) END AS cancellation_date,
  CASE WHEN l.l_partkey % 89 <> 0 THEN CAST(l.l_shipdate AS DATE) END AS flight_date,
  sr.r_name AS origin, cr.r_name AS destination,
  CASE WHEN l.l_partkey % 103 = 0 THEN NULL WHEN l.l_partkey % 101 = 0 THEN 'XXX-YYY'
       WHEN l.l_linenumber % 2 = 0 THEN sr.r_name || '→' || cr.r_name
       ELSE lower(sr.r_name || ' - ' || cr.r_name) END AS routing,
  'TX' || CAST(1000 + 5*sr.r_regionkey + cr.r_regionkey AS VARCHAR) AS flightnumber,
  CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) - 1500 AS DECIMAL(18,4)) AS revenue_per_booking_ticket,
  CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_tax AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS revenue_per_booking_ancilliary_pre_check_in,
  CASE WHEN l.l_suppkey % 10 <> 0 THEN CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(18,2)) AS DECIMAL(18,4)) END AS revenue_per_booking_ancilliary_at_check_in,
  CAST(l.l_quantity AS BIGINT) - 2 AS passengercount
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation sn ON s.s_nationkey = sn.n_nationkey
JOIN region sr ON sn.n_regionkey = sr.r_regionkey
JOIN customer cu ON o.o_custkey = cu.c_custkey
JOIN nation cn ON cu.c_nationkey = cn.n_nationkey
JOIN region cr ON cn.n_regionkey = cr.r_regionkey""")

rel("flight", ("booking",), """
SELECT flightnumber, flightdate,
  CASE WHEN doy % 90 = 0 THEN 0 ELSE 158 + (doy + fn) % 45 END AS availablecapacity,
  CASE (doy + fn) % 3 WHEN 0 THEN 'Morning' WHEN 1 THEN 'Afternoon' ELSE 'Evening' END AS timeofday,
  CASE WHEN fn % 2 = 0 THEN 'Outbound' ELSE 'Inbound' END AS routetype
FROM (SELECT DISTINCT flightnumber, flight_date AS flightdate,
        CAST(dayofyear(flight_date) AS INT) AS doy, CAST(substr(flightnumber, 3) AS INT) AS fn
      FROM booking WHERE flight_date IS NOT NULL) d
WHERE doy % 50 <> 0""")

rel("passenger", (), """
SELECT 'pnr ' || CAST(event_id - event_id % 3 AS VARCHAR) AS bookingid, event_id AS ordinal,
  CASE event_type WHEN 'click' THEN 'App' WHEN 'view' THEN ' Web ' WHEN 'signup' THEN 'OTA'
       WHEN 'error' THEN NULL ELSE 'Travel Agency' END AS booking_channel,
  CASE CAST(FLOOR(value) AS INT) % 3 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'Desktop ' ELSE NULL END AS device_used
FROM events""")

# SQL-convention leg mart
rel("leg", ("booking", "flight"), """
SELECT a.flightnumber, a.flight_date, a.origin, a.destination, a.pax, a.total_revenue, a.cancels,
  f.availablecapacity AS seats, f.timeofday, f.routetype,
  CASE WHEN f.availablecapacity > 0 THEN CAST(a.pax AS DOUBLE) / f.availablecapacity END AS leg_lf
FROM (SELECT flightnumber, CAST(flight_date AS DATE) AS flight_date, origin, destination,
        CAST(SUM(passengercount) AS BIGINT) AS pax,
        CAST(SUM(revenue_per_booking_ticket + revenue_per_booking_ancilliary_pre_check_in
                 + revenue_per_booking_ancilliary_at_check_in) AS DOUBLE) AS total_revenue,
        CAST(COUNT(cancellation_date) AS BIGINT) AS cancels
      FROM booking GROUP BY 1, 2, 3, 4) a
LEFT JOIN flight f ON a.flightnumber = f.flightnumber AND a.flight_date = CAST(f.flightdate AS DATE)""")



# ---------------------------------------------------------------------------
# SQL snippets
# ---------------------------------------------------------------------------
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def canon(x: str) -> str:
    return f"upper({strip(x)})"


def idnorm(x: str) -> str:
    return f"NULLIF(regexp_replace({x}, '[^0-9]+', '', 'g'), '')"


def channel(x: str) -> str:
    k = f"lower({strip(x)})"
    whens = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CHANNEL_SYNONYMS.items())
    return f"CASE {k} {whens} ELSE {k} END"


T, PRE, AT = ("revenue_per_booking_ticket", "revenue_per_booking_ancilliary_pre_check_in",
              "revenue_per_booking_ancilliary_at_check_in")
ZERO_TOTAL = f"COALESCE({T}, 0) + COALESCE({PRE}, 0) + COALESCE({AT}, 0)"
ZERO_ANC = f"COALESCE({PRE}, 0) + COALESCE({AT}, 0)"
RAW_COLS = ("bookingid_pnr, reservation_date, cancellation_date, flight_date, origin, destination, routing, "
            f"flightnumber, CAST({T} AS DOUBLE) AS {T}, CAST({PRE} AS DOUBLE) AS {PRE}, "
            f"CAST({AT} AS DOUBLE) AS {AT}, passengercount")


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({', '.join(cols)})"


rel("calendar", (), values([(d, i + 1) for i, d in enumerate(WEEKDAYS)], ("dow", "dow_ord")))
rel("tod_spine", (), values([(t, i) for i, t in enumerate(TIMES_OF_DAY)], ("timeofday", "tod_ord")))

rel("leg_anc", ("booking",), f"""
SELECT flightnumber, CAST(flight_date AS DATE) AS flight_date, origin, destination, SUM({PRE} + {AT}) AS anc_rev
FROM booking GROUP BY 1, 2, 3, 4""")

rel("leg_revpp", ("leg",), "SELECT *, CASE WHEN pax > 0 THEN total_revenue / pax END AS rev_per_pax FROM leg")

rel("leg_yield", ("leg_revpp",), f"""
SELECT *, CAST(q5 - 1 AS DOUBLE) / 4.0 AS yield_index
FROM (SELECT *, CAST(NTILE({P.yield_buckets}) OVER (PARTITION BY origin, destination
        ORDER BY rev_per_pax ASC NULLS LAST, flight_date ASC NULLS LAST, flightnumber ASC NULLS LAST) AS INTEGER) AS q5
      FROM leg_revpp) r""")

rel("booking_clean", ("booking",), f"""
SELECT bookingid_pnr, reservation_date, cancellation_date, flight_date,
  {canon('origin')} AS origin, {canon('destination')} AS destination, routing, flightnumber, passengercount,
  CAST({T} AS DOUBLE) AS {T}, CAST({PRE} AS DOUBLE) AS {PRE}, CAST({AT} AS DOUBLE) AS {AT},
  {idnorm('bookingid_pnr')} AS bookingid_norm,
  CAST({ZERO_TOTAL} AS DOUBLE) AS total_revenue,
  {canon('origin')} || '-' || {canon('destination')} AS routing_canonical,
  cancellation_date IS NOT NULL AS is_cancelled,
  dayname(flight_date) AS flight_dow,
  CAST(cancellation_date - reservation_date AS BIGINT) AS days_after_booking_to_cancel,
  CAST(flight_date - cancellation_date AS BIGINT) AS days_before_flight_to_cancel,
  CAST(flight_date - reservation_date AS BIGINT) AS lead_time_days,
  CAST({ZERO_ANC} AS DOUBLE) AS ancillary_total
FROM booking""")

# canonical-O&D sums straight from the bookings, money summed exactly
rel("seg_report", ("booking",), f"""
SELECT {canon('origin')} AS origin, {canon('destination')} AS destination,
  CAST(COUNT({idnorm('bookingid_pnr')}) AS BIGINT) AS bookings,
  CAST(COUNT(cancellation_date) AS BIGINT) AS cancels,
  CAST(COALESCE(SUM(passengercount), 0) AS BIGINT) AS pax,
  CAST(SUM({ZERO_TOTAL}) AS DOUBLE) AS revenue,
  CAST(SUM({ZERO_ANC}) AS DOUBLE) AS num
FROM booking GROUP BY 1, 2""")

rel("segment_kpis", ("seg_report",), """
SELECT origin, destination, bookings, cancels, pax, revenue,
  CASE WHEN bookings > 0 THEN CAST(cancels AS DOUBLE) / bookings END AS cancel_rate,
  CASE WHEN pax > 0 THEN revenue / pax END AS rev_per_pax,
  revenue AS denom, num,
  CASE WHEN revenue > 0 THEN num / revenue END AS anc_share
FROM seg_report""")

rel("aseg", ("seg_report",), """
SELECT origin, destination, revenue, num AS ancillary,
  CASE WHEN revenue > 0 THEN num / revenue END AS aras, origin || '→' || destination AS od
FROM seg_report""")

rel("leg_report", ("booking", "flight"), f"""
SELECT a.flightnumber, a.flight_date, a.origin, a.destination, a.pax, a.revenue, a.cancels,
  f.availablecapacity, f.timeofday, f.routetype,
  CASE WHEN f.availablecapacity > 0 THEN CAST(a.pax AS DOUBLE) / f.availablecapacity END AS load_factor,
  CASE WHEN a.pax > 0 THEN a.revenue / a.pax END AS rev_per_pax,
  dayname(a.flight_date) AS dow
FROM (SELECT flightnumber, flight_date, {canon('origin')} AS origin, {canon('destination')} AS destination,
        CAST(COALESCE(SUM(passengercount), 0) AS BIGINT) AS pax,
        CAST(SUM({ZERO_TOTAL}) AS DOUBLE) AS revenue,
        CAST(COUNT(cancellation_date) AS BIGINT) AS cancels
      FROM booking GROUP BY 1, 2, 3, 4) a
LEFT JOIN flight f ON a.flightnumber IS NOT DISTINCT FROM f.flightnumber
                 AND a.flight_date IS NOT DISTINCT FROM f.flightdate""")

rel("realized", ("booking",), """
SELECT flightnumber, flight_date,
  CAST(SUM(COALESCE(passengercount, 0) - CASE WHEN cancellation_date IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS realized_pax
FROM booking WHERE flightnumber IS NOT NULL AND flight_date IS NOT NULL GROUP BY 1, 2""")

rel("fwlf_dow", ("leg_report",), """
SELECT dow, CASE WHEN SUM(availablecapacity) > 0 THEN CAST(SUM(pax) AS DOUBLE) / SUM(availablecapacity) END AS fwlf
FROM leg_report WHERE dow IS NOT NULL GROUP BY 1""")

rel("calf_dow", ("leg_report", "realized"), f"""
SELECT l.dow, R6(avg(CASE WHEN l.availablecapacity > 0 THEN CAST(r.realized_pax AS DOUBLE) / l.availablecapacity END)) AS calf
FROM leg_report l LEFT JOIN realized r ON l.flightnumber = r.flightnumber AND l.flight_date = r.flight_date
WHERE l.dow IS NOT NULL GROUP BY 1""")

fo, fd = P.feeder_segment
oo, od = P.onward_segment
rel("pacs_dow", ("leg_report",), f"""
SELECT l.dow, R6(avg(CASE WHEN l.availablecapacity > 0 THEN
   ((CASE WHEN l.origin = '{fo}' AND l.destination = '{fd}'
          THEN l.revenue + {P.dow_connection_value_pct}::DOUBLE * COALESCE(o.onward_rev, 0.0) ELSE l.revenue END)
    - l.availablecapacity * {P.dow_variable_cost_per_seat_leg}::DOUBLE) / CAST(l.availablecapacity AS DOUBLE) END)) AS pacs
FROM leg_report l
LEFT JOIN (SELECT dow, avg(revenue) AS onward_rev FROM leg_report
           WHERE origin = '{oo}' AND destination = '{od}' AND dow IS NOT NULL GROUP BY 1) o USING (dow)
WHERE l.dow IS NOT NULL GROUP BY 1""")

rel("passenger_clean", ("passenger",), f"""
SELECT *, {idnorm('bookingid')} AS bookingid_norm, {channel('booking_channel')} AS booking_channel_norm,
  lower({strip('device_used')}) AS device_used_norm
FROM passenger""")

rel("pnr_channel", ("passenger_clean",), """
SELECT bookingid_norm, arg_min(booking_channel_norm, ordinal) FILTER (WHERE booking_channel_norm IS NOT NULL) AS primary_channel
FROM passenger_clean WHERE bookingid_norm IS NOT NULL GROUP BY 1""")

rel("lf_long", ("leg_report",), f"""
SELECT origin, destination, dow, R6(avg(load_factor)) AS load_factor, origin || '→' || destination AS segment
FROM leg_report WHERE dow IS NOT NULL GROUP BY 1, 2, 3""")

rel("dq_booking", ("booking",), f"""
SELECT {RAW_COLS}, {idnorm('bookingid_pnr')} AS bookingid_norm,
  {canon('origin')} || '-' || {canon('destination')} AS routing_canonical,
  CAST({ZERO_TOTAL} AS DOUBLE) AS total_revenue
FROM booking""")

rel("dq_leg", ("booking", "flight"), """
SELECT a.flightnumber, a.flight_date, a.origin, a.destination, a.pax, f.flightdate, f.availablecapacity,
  COALESCE(a.pax > f.availablecapacity, false) AND f.availablecapacity IS NOT NULL AS capacity_anomaly
FROM (SELECT flightnumber, flight_date, origin, destination, CAST(COALESCE(SUM(passengercount), 0) AS BIGINT) AS pax
      FROM booking GROUP BY 1, 2, 3, 4) a
LEFT JOIN flight f ON a.flightnumber IS NOT DISTINCT FROM f.flightnumber
                 AND a.flight_date IS NOT DISTINCT FROM f.flightdate""")

rel("dq_passenger", ("passenger",), f"SELECT *, {idnorm('bookingid')} AS bookingid_norm FROM passenger")

rel("dq_pnr", ("dq_passenger",), """
SELECT bookingid_norm, COUNT(*) AS n,
  COUNT(DISTINCT booking_channel) + MAX(CASE WHEN booking_channel IS NULL THEN 1 ELSE 0 END) AS n_channels,
  COUNT(DISTINCT device_used) + MAX(CASE WHEN device_used IS NULL THEN 1 ELSE 0 END) AS n_devices
FROM dq_passenger WHERE bookingid_norm IS NOT NULL GROUP BY 1""")


ENTITY_RELATIONS = ("booking", "flight", "passenger")


def sql(final: str, *deps: str, skip: tuple[str, ...] = ()) -> str:
    """One statement: WITH <deps in dependency order> <final>.

    Relations named in ``skip`` are not emitted (they must then exist as
    tables, e.g. entity tables in a test)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order or n in skip:
            return
        for d in REL[n][0]:
            visit(d)
        order.append(n)

    for d in deps:
        visit(d)
    if not order:
        return published(final.strip())
    ctes = ",\n".join(f"{n} AS ({REL[n][1].strip()}\n)" for n in order)
    return published(f"WITH {ctes}\n{final.strip()}")


def published(statement: str, rounded: bool = True) -> str:
    """``R6(x)`` in a statement: x rounded as published, or x itself."""
    while (i := statement.find("R6(")) >= 0:
        depth, j = 1, i + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(statement[j], 0)
            j += 1
        x = statement[i + 3 : j - 1]
        new = f"(round_even(round_even(({x}) * 1e10, 0) / 1e10 * 1e6, 0) / 1e6)" if rounded else f"({x})"
        statement = statement[:i] + new + statement[j:]
    return statement


# ---------------------------------------------------------------------------
# Oracle statements per query
# ---------------------------------------------------------------------------
ORACLE: dict[str, str] = {}
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def q(name: str, final: str, *deps: str) -> None:
    PARTS[name] = (final, deps)
    ORACLE[name] = sql(final, *deps)


def entity_sql(name: str) -> str:
    """The oracle statement of ``name`` over existing booking / flight /
    passenger tables instead of the test-data adapter."""
    final, deps = PARTS[name]
    return sql(final, *deps, skip=ENTITY_RELATIONS)


def on_calendar(inner: str, cols: str) -> str:
    return f"SELECT c.dow, {cols} FROM calendar c LEFT JOIN ({inner}) s USING (dow)"


LEG_TIES = "flight_date ASC NULLS LAST, flightnumber ASC NULLS LAST, origin ASC NULLS LAST, destination ASC NULLS LAST"

# ---- sources / cleaning
q("src_booking", f"SELECT {RAW_COLS} FROM booking", "booking")
q("normalize_columns", f"SELECT {RAW_COLS} FROM booking", "booking")
q("src_passenger", "SELECT * FROM passenger", "passenger")
q("src_flight", "SELECT * FROM flight", "flight")
q("booking_id_norm", f"SELECT bookingid_pnr, {idnorm('bookingid_pnr')} AS bookingid_norm FROM booking", "booking")
SEGMENT = """SELECT origin, destination, CAST(SUM(pax) AS BIGINT) AS pax, CAST(SUM(seats) AS BIGINT) AS seats,
  CAST(SUM(CAST(total_revenue AS DECIMAL(38,4))) AS DOUBLE) AS total_revenue FROM leg GROUP BY 1, 2"""
q("segment", SEGMENT, "leg")
q("segment_label", f"SELECT *, origin || '→' || destination AS segment FROM ({SEGMENT}) s", "leg")
q("booking_clean", "SELECT * FROM booking_clean", "booking_clean")
q("passenger_clean", "SELECT * FROM passenger_clean", "passenger_clean")
q("pnr_channel", "SELECT * FROM pnr_channel", "pnr_channel")
q("pnr_devices", """
SELECT bookingid_norm,
  COALESCE(list(device_used_norm ORDER BY first_ord) FILTER (WHERE device_used_norm IS NOT NULL), CAST([] AS VARCHAR[])) AS devices
FROM (SELECT bookingid_norm, device_used_norm, MIN(ordinal) AS first_ord FROM passenger_clean
      WHERE bookingid_norm IS NOT NULL GROUP BY 1, 2) d
GROUP BY 1""", "passenger_clean")
q("booking_enriched", """
SELECT b.*, p.primary_channel FROM booking_clean b LEFT JOIN pnr_channel p ON b.bookingid_norm = p.bookingid_norm""",
  "booking_clean", "pnr_channel")

# ---- marts
q("leg", "SELECT * FROM leg", "leg")
q("leg_revpp", "SELECT * FROM leg_revpp", "leg_revpp")
q("leg_yield_index", "SELECT * FROM leg_yield", "leg_yield")
q("leg_report", "SELECT * FROM leg_report", "leg_report")

# ---- core KPIs
q("fwlf_overall", "SELECT CAST(SUM(pax) AS DOUBLE) / NULLIF(SUM(seats), 0) AS fwlf FROM leg", "leg")
q("fwlf_by_segment", """
SELECT origin, destination, CAST(SUM(pax) AS DOUBLE) / NULLIF(SUM(seats), 0) AS fwlf
FROM leg GROUP BY 1, 2""", "leg")
q("calf_overall", "SELECT CAST(SUM(pax) AS DOUBLE) / NULLIF(SUM(seats), 0) AS calf FROM leg", "leg")
PACS = f"""
SELECT flightnumber, flight_date, origin, destination, seats, total_revenue,
  total_revenue * {P.connection_value_pct}::DOUBLE AS connection_value,
  (total_revenue + total_revenue * {P.connection_value_pct}::DOUBLE - seats * {P.variable_cost_per_seat_leg}::DOUBLE)
    / NULLIF(CAST(seats AS DOUBLE), 0) AS pacs_per_seat_leg
FROM leg"""
q("pacs_leg", PACS, "leg")
q("pacs_top5", f"SELECT * FROM ({PACS}) p ORDER BY pacs_per_seat_leg DESC NULLS LAST, {LEG_TIES} LIMIT {P.top_pacs_print}", "leg")
for _nm, _dir in (("pacs_top20", "DESC"), ("pacs_bottom20", "ASC")):
    q(_nm, f"""
SELECT flightnumber, flight_date, origin, destination, pacs_per_seat_leg,
  origin || '→' || destination || ' ' || CAST(flight_date AS VARCHAR) AS label
FROM ({PACS}) p ORDER BY pacs_per_seat_leg {_dir} NULLS LAST, {LEG_TIES} LIMIT {P.top_pacs_chart}""", "leg")
q("yalf_overall", "SELECT CAST(SUM(pax * yield_index) AS DOUBLE) / NULLIF(CAST(SUM(seats) AS DOUBLE), 0) AS yalf FROM leg_yield", "leg_yield")
q("aras_overall", f"""
SELECT CAST(SUM(a.ancillary_rev) AS DOUBLE) / NULLIF(CAST(SUM(l.seats) AS DOUBLE), 0) AS aras
FROM (SELECT flightnumber, CAST(flight_date AS DATE) AS flight_date, SUM({PRE} + {AT}) AS ancillary_rev
      FROM booking GROUP BY 1, 2) a
JOIN leg l USING (flightnumber, flight_date)""", "leg")
q("srm_proxy", """
SELECT CAST(SUM(pax) AS DOUBLE) / NULLIF(COUNT(DISTINCT flightnumber || '_' || CAST(flight_date AS VARCHAR)), 0)
  AS passenger_legs_per_flight FROM leg""", "leg")
q("mart_checks", f"""
SELECT COUNT(*) FILTER (WHERE pax < 0) AS cnt_bad_pax,
  COUNT(*) FILTER (WHERE seats IS NULL OR seats <= 0) AS cnt_bad_seats,
  COUNT(*) FILTER (WHERE leg_lf < 0 OR leg_lf > {P.lf_upper_bound}) AS cnt_bad_lf
FROM leg""", "leg")

# ---- weekday KPIs
q("fwlf_by_dow", on_calendar("SELECT * FROM fwlf_dow", "s.fwlf") + " ORDER BY c.dow_ord", "calendar", "fwlf_dow")
q("calf_realized_by_dow", on_calendar("SELECT * FROM calf_dow", "s.calf") + " ORDER BY c.dow_ord", "calendar", "calf_dow")
q("pacs_feeder_by_dow", on_calendar("SELECT * FROM pacs_dow", "s.pacs") + " ORDER BY c.dow_ord", "calendar", "pacs_dow")
q("kpi_summary_by_dow", """
SELECT c.dow, f.fwlf, p.pacs AS pacs_per_seat, k.calf FROM calendar c
LEFT JOIN fwlf_dow f USING (dow) LEFT JOIN pacs_dow p USING (dow) LEFT JOIN calf_dow k USING (dow)
ORDER BY c.dow_ord""", "calendar", "fwlf_dow", "pacs_dow", "calf_dow")
q("fwlf_calf_by_dow", """
SELECT c.dow, f.fwlf, k.calf FROM calendar c LEFT JOIN fwlf_dow f USING (dow) LEFT JOIN calf_dow k USING (dow)
ORDER BY c.dow_ord""", "calendar", "fwlf_dow", "calf_dow")
q("ancillary_share_top10", f"""
SELECT * FROM aseg ORDER BY revenue DESC NULLS LAST, origin ASC NULLS LAST, destination ASC NULLS LAST
LIMIT {P.top_segments_aras}""", "aseg")
q("network_avg_ancillary_share", f"SELECT R6(avg(aras)) AS network_avg_ancillary_share FROM aseg", "aseg")

# ---- exploration, SQL convention
q("lf_by_time", f"SELECT timeofday, R6(avg(leg_lf)) AS avg_lf FROM leg GROUP BY 1", "leg")
q("lf_by_time_ordered", f"""
SELECT t.timeofday, s.avg_lf FROM tod_spine t
LEFT JOIN (SELECT timeofday, R6(avg(leg_lf)) AS avg_lf FROM leg GROUP BY 1) s USING (timeofday)
ORDER BY t.tod_ord""", "tod_spine", "leg")
q("anc_share_segment", """
SELECT a.origin, a.destination,
  CAST(SUM(a.anc_rev) AS DOUBLE) / NULLIF(CAST(SUM(CAST(l.total_revenue AS DECIMAL(38,4))) AS DOUBLE), 0) AS anc_share
FROM leg_anc a JOIN leg l ON a.flightnumber = l.flightnumber AND a.flight_date = l.flight_date
GROUP BY 1, 2""", "leg_anc", "leg")
q("cancel_rate_segment", f"""
SELECT origin, destination,
  R6(avg(CASE WHEN pax + cancels > 0 THEN CAST(cancels AS DOUBLE) / (pax + cancels) END)) AS cancel_rate
FROM leg GROUP BY 1, 2""", "leg")
k = P.top_outliers
q("low_lf_legs", f"""
SELECT flightnumber, flight_date, origin, destination, leg_lf, total_revenue FROM leg
ORDER BY leg_lf ASC NULLS LAST, {LEG_TIES} LIMIT {k}""", "leg")
q("high_lf_legs", f"""
SELECT flightnumber, flight_date, origin, destination, leg_lf, total_revenue FROM leg
ORDER BY leg_lf DESC NULLS LAST, {LEG_TIES} LIMIT {k}""", "leg")
q("high_yield_legs", f"""
SELECT flightnumber, flight_date, origin, destination, rev_per_pax, leg_lf FROM leg_revpp
ORDER BY rev_per_pax DESC NULLS LAST, {LEG_TIES} LIMIT {k}""", "leg_revpp")
q("low_yield_legs", f"""
SELECT flightnumber, flight_date, origin, destination, rev_per_pax, leg_lf FROM leg_revpp
WHERE rev_per_pax IS NOT NULL ORDER BY rev_per_pax ASC, {LEG_TIES} LIMIT {k}""", "leg_revpp")
q("scatter_lf_revpp", """
SELECT flightnumber, flight_date, origin, destination, leg_lf, rev_per_pax FROM leg_revpp
WHERE leg_lf IS NOT NULL AND rev_per_pax IS NOT NULL""", "leg_revpp")

# ---- exploration, report convention
q("cancellation_by_dow", """
SELECT c.dow AS flight_dow, CAST(COALESCE(s.bookings, 0) AS BIGINT) AS bookings,
  CAST(COALESCE(s.cancel_count, 0) AS BIGINT) AS cancel_count,
  CASE WHEN s.bookings > 0 THEN CAST(s.cancel_count AS DOUBLE) / s.bookings END AS cancel_rate
FROM calendar c LEFT JOIN (
  SELECT flight_dow AS dow, COUNT(*) AS bookings, COUNT(*) FILTER (WHERE is_cancelled) AS cancel_count
  FROM booking_clean WHERE flight_dow IS NOT NULL GROUP BY 1) s USING (dow)
ORDER BY c.dow_ord""", "calendar", "booking_clean")
for _col, _nm in (("days_after_booking_to_cancel", "cancel_days_after_booking"),
                  ("days_before_flight_to_cancel", "cancel_days_before_flight")):
    q(_nm, f"""
SELECT {_col}, COUNT(*) AS count FROM booking_clean
WHERE is_cancelled AND {_col} IS NOT NULL GROUP BY 1 ORDER BY 1""", "booking_clean")
q("cancellation_by_channel", """
SELECT p.primary_channel, CAST(SUM(b.n) AS BIGINT) AS bookings, CAST(SUM(b.c) AS BIGINT) AS cancels,
  CASE WHEN SUM(b.n) > 0 THEN CAST(SUM(b.c) AS DOUBLE) / SUM(b.n) END AS cancel_rate
FROM (SELECT bookingid_norm, COUNT(*) AS n, COUNT(cancellation_date) AS c FROM booking_clean
      WHERE bookingid_norm IS NOT NULL GROUP BY 1) b
JOIN pnr_channel p USING (bookingid_norm)
WHERE p.primary_channel IS NOT NULL GROUP BY 1""", "booking_clean", "pnr_channel")
q("lf_by_dow", on_calendar(f"""
SELECT dayname(flight_date) AS dow, R6(avg(load)) AS avg_load_factor
FROM (SELECT flight_date, avg(load_factor) AS load FROM leg_report WHERE flight_date IS NOT NULL GROUP BY 1) d
GROUP BY 1""", "s.avg_load_factor") + " ORDER BY c.dow_ord", "calendar", "leg_report")
q("lf_by_time_of_day", f"""
SELECT timeofday, R6(avg(load_factor)) AS avg_load_factor FROM leg_report
WHERE timeofday IS NOT NULL GROUP BY 1""", "leg_report")
q("lf_segment_dow_long", "SELECT * FROM lf_long", "lf_long")
# one filtered aggregate per segment (a PIVOT cannot be stored as a view); the
# adapter's O&D codes are the names of the five regions
q("lf_segment_dow_wide", "SELECT dow, " + ", ".join(
    f"max(load_factor) FILTER (WHERE segment = '{o}→{d}') AS \"{o}→{d}\"" for o in TEST_AIRPORTS for d in TEST_AIRPORTS)
  + " FROM lf_long WHERE load_factor IS NOT NULL AND segment IS NOT NULL GROUP BY dow", "lf_long")
q("segment_kpis", "SELECT * FROM segment_kpis", "segment_kpis")
q("anc_share_top_segments", f"""
SELECT *, origin || '→' || destination AS od FROM segment_kpis
ORDER BY revenue DESC NULLS LAST, origin ASC NULLS LAST, destination ASC NULLS LAST LIMIT {P.top_segments_chart}""",
  "segment_kpis")
q("directional_imbalance", f"""
SELECT s.origin, s.destination, R6(s.load_factor) AS load_factor,
  R6(r.load_factor) AS load_factor_rev, R6(s.load_factor - r.load_factor) AS lf_diff_vs_reverse
FROM (SELECT origin, destination, avg(load_factor) AS load_factor FROM leg_report GROUP BY 1, 2) s
LEFT JOIN (SELECT origin, destination, avg(load_factor) AS load_factor FROM leg_report GROUP BY 1, 2) r
  ON s.origin = r.destination AND s.destination = r.origin""", "leg_report")
q("rev_lf_correlation", f"""
SELECT CASE WHEN COUNT(*) > {P.min_corr_pairs} THEN R6(corr(load_factor, rev_per_pax)) END AS rev_lf_corr
FROM leg_report WHERE load_factor IS NOT NULL AND rev_per_pax IS NOT NULL""", "leg_report")
q("cancel_timing_stats", f"""
SELECT R6(CAST(quantile_cont(days_after_booking_to_cancel, 0.5) AS DOUBLE)) AS median_days_after_booking,
  R6(CAST(quantile_cont(days_after_booking_to_cancel, 0.9) AS DOUBLE)) AS p90_days_after_booking,
  R6(CAST(quantile_cont(days_before_flight_to_cancel, 0.5) AS DOUBLE)) AS median_days_before_flight,
  R6(CAST(quantile_cont(days_before_flight_to_cancel, 0.9) AS DOUBLE)) AS p90_days_before_flight
FROM booking_clean WHERE is_cancelled""", "booking_clean")
q("last_minute_share", f"""
SELECT R6(avg(CASE WHEN COALESCE(days_before_flight_to_cancel <= {P.last_minute_days}, false) THEN 1.0 ELSE 0.0 END))
  AS last_minute_share
FROM booking_clean WHERE is_cancelled""", "booking_clean")

# ---- data quality
_RQ = "replace(upper(routing), ' ', '')"
_O, _D = "replace(upper(origin), ' ', '')", "replace(upper(destination), ' ', '')"
DQ_BOOKING_PRED = {
    "canceled_with_checkin_ancillary": f"cancellation_date IS NOT NULL AND COALESCE({AT} > 0, false)",
    "cancellation_before_reservation": "COALESCE(cancellation_date < reservation_date, false)",
    "reservation_after_flight": "COALESCE(reservation_date > flight_date, false)",
    "revenue_with_zero_passengers": "COALESCE(passengercount = 0 AND total_revenue > 0, false)",
    "negative_revenue_fields": " OR ".join(f"COALESCE({c} < 0, false)" for c in (T, PRE, AT)),
    "negative_passengers": "COALESCE(passengercount < 0, false)",
    "routing_inconsistent_with_od": f"NOT COALESCE({_RQ} = {_O} || '-' || {_D} OR {_RQ} = {_O} || '→' || {_D}, false)",
    "cancellation_with_positive_pax": "cancellation_date IS NOT NULL AND COALESCE(passengercount > 0, false)",
    "missing_flight_date": "flight_date IS NULL",
}
DQ_BODY: dict[str, tuple[str, tuple[str, ...]]] = {}
for _n, _pred in DQ_BOOKING_PRED.items():
    DQ_BODY[_n] = (f"SELECT * FROM dq_booking WHERE {_pred}", ("dq_booking",))
DQ_BODY["same_booking_multiple_channels"] = (
    "SELECT * FROM dq_passenger WHERE bookingid_norm IN (SELECT bookingid_norm FROM dq_pnr WHERE n_channels > 1)",
    ("dq_passenger", "dq_pnr"))
DQ_BODY["same_booking_multiple_devices"] = (
    "SELECT * FROM dq_passenger WHERE bookingid_norm IN (SELECT bookingid_norm FROM dq_pnr WHERE n_devices > 1)",
    ("dq_passenger", "dq_pnr"))
DQ_BODY["pax_exceeds_capacity"] = ("SELECT * FROM dq_leg WHERE capacity_anomaly", ("dq_leg",))
DQ_BODY["missing_capacity_for_leg"] = ("SELECT * FROM dq_leg WHERE availablecapacity IS NULL", ("dq_leg",))
DQ_BODY["capacity_out_of_range"] = (
    f"SELECT * FROM dq_leg WHERE availablecapacity IS NOT NULL AND "
    f"(availablecapacity < {P.capacity_min} OR availablecapacity > {P.capacity_max})", ("dq_leg",))
DQ_BODY["duplicate_legs_within_pnr"] = ("""
SELECT * EXCLUDE (dup_n) FROM (
  SELECT *, COUNT(*) OVER (PARTITION BY bookingid_norm, flightnumber, flight_date, origin, destination) AS dup_n
  FROM dq_booking) d WHERE dup_n > 1""", ("dq_booking",))

for _n in DQ_CHECKS:
    _body, _deps = DQ_BODY[_n]
    q(f"dq_{_n}", _body, *_deps)

_all_deps = sorted({d for _b, ds in DQ_BODY.values() for d in ds})
_union = "\nUNION ALL ".join(
    f"SELECT '{n}' AS \"check\", {i} AS ord, CAST(COUNT(*) AS BIGINT) AS \"count\" FROM ({DQ_BODY[n][0]}) x"
    for i, n in enumerate(DQ_CHECKS)
)
q("dq_summary", f'SELECT "check", "count" FROM ({_union}) u ORDER BY "count" DESC, ord', *_all_deps)

# ---- insights (R-20): each rule a 0/1-row SELECT over the tables above
from aerokpi.operators.insights import TEMPLATES, template_parts  # noqa: E402

def _table(name: str) -> str:
    """Name of a relation holding the unrounded oracle result of query ``name``."""
    rn = f"t_{name}"
    if rn not in REL:
        final, deps = PARTS[name]
        REL[rn] = (deps, published(final, rounded=False))
    return rn


def _fmt_sql(x: str, kind: str | None) -> str:
    if kind == "pct":
        return f"(printf('%.1f', round_even(CAST({x} AS DOUBLE) * 100.0, 1)) || '%')"
    if kind == "int":
        return f"CAST(CAST(round_even(CAST({x} AS DOUBLE), 0) AS BIGINT) AS VARCHAR)"
    if kind == "2f":
        return f"printf('%.2f', round_even(CAST({x} AS DOUBLE), 2))"
    return f"CAST({x} AS VARCHAR)"


def render_sql(template: str, cols: dict) -> str:
    parts = []
    for lit, name, kind in template_parts(template):
        if lit:
            parts.append("'" + lit.replace("'", "''") + "'")
        if name:
            parts.append(_fmt_sql(cols[name], kind))
    return " || ".join(parts)


_WD = "[" + ", ".join(f"'{d}'" for d in WEEKDAYS) + "]"
_I = {n: _table(n) for n in ("cancellation_by_dow", "cancellation_by_channel", "lf_by_dow", "lf_by_time_of_day",
                             "rev_lf_correlation", "directional_imbalance", "anc_share_top_segments",
                             "cancel_timing_stats", "last_minute_share")}
_TT = TEMPLATES


def _rule(rule, frm, subject="NULL", value="NULL", value2="NULL", text="NULL"):
    return (f"SELECT '{rule}' AS rule, CAST({subject} AS VARCHAR) AS subject, R6(CAST({value} AS DOUBLE)) AS value, "
            f"R6(CAST({value2} AS DOUBLE)) AS value2, {text} AS text FROM {frm}")


_cdow = f"(SELECT *, list_position({_WD}, flight_dow) AS ord FROM {_I['cancellation_by_dow']})"
_ncancel = "(SELECT COUNT(cancellation_date) AS n_cancel FROM booking)"
_rules = [
    _rule("A", f"(SELECT string_agg(flight_dow, ', ' ORDER BY ord) AS days, COUNT(*) AS n FROM {_cdow} z "
               f"WHERE cancel_count = 0 HAVING COUNT(*) > 0) a",
          "days", "n", "NULL", render_sql(_TT["A"], {"days": "days"})),
    _rule("B", f"(SELECT * FROM (SELECT * FROM {_cdow} z ORDER BY COALESCE(cancel_rate, -1.0) DESC, ord LIMIT 1) t "
               f"WHERE cancel_rate IS NOT NULL) b",
          "flight_dow", "cancel_rate", "NULL", render_sql(_TT["B"], {"dow": "flight_dow", "rate": "cancel_rate"})),
]
for _r, _m, _p in (("C", "median_days_after_booking", "p90_days_after_booking"),
                   ("D", "median_days_before_flight", "p90_days_before_flight")):
    _rules.append(_rule(_r, f"(SELECT * FROM {_I['cancel_timing_stats']}, {_ncancel} n WHERE n_cancel > 0 "
                            f"AND {_m} IS NOT NULL AND {_p} IS NOT NULL) t",
                        "NULL", _m, _p, render_sql(_TT[_r], {"med": _m, "p90": _p})))
_rules.append(_rule(
    "E", f"(SELECT * FROM (SELECT * FROM {_I['cancellation_by_channel']} WHERE bookings > {P.channel_min_bookings} "
         f"ORDER BY cancel_rate DESC NULLS LAST, primary_channel ASC NULLS LAST LIMIT 1) t WHERE cancel_rate IS NOT NULL) e",
    "primary_channel", "cancel_rate", "NULL", render_sql(_TT["E"], {"channel": "primary_channel", "rate": "cancel_rate"})))


def _extremes_sql(tbl: str, key: str, val: str, order: str) -> str:
    lo = f"(SELECT {key} AS low, {val} AS low_v FROM {tbl} WHERE {val} IS NOT NULL ORDER BY {val} ASC, {order} LIMIT 1)"
    hi = f"(SELECT {key} AS high, {val} AS high_v FROM {tbl} WHERE {val} IS NOT NULL ORDER BY {val} DESC, {order} LIMIT 1)"
    return f"(SELECT * FROM {lo} lo, {hi} hi)"


_ext_cols = {k: k for k in ("low", "low_v", "high", "high_v")}
_rules.append(_rule("F", _extremes_sql(f"(SELECT *, list_position({_WD}, dow) AS ord FROM {_I['lf_by_dow']})",
                                       "dow", "avg_load_factor", "ord") + " f",
                    "low || ' / ' || high", "low_v", "high_v", render_sql(_TT["F"], _ext_cols)))
_rules.append(_rule("G", _extremes_sql(_I["lf_by_time_of_day"], "timeofday", "avg_load_factor", "timeofday") + " g",
                    "low || ' / ' || high", "low_v", "high_v", render_sql(_TT["G"], _ext_cols)))
_rules.append(_rule(
    "H", f"(SELECT * FROM {_I['rev_lf_correlation']} WHERE rev_lf_corr IS NOT NULL) h", "NULL", "rev_lf_corr", "NULL",
    f"CASE WHEN rev_lf_corr < {P.correlation_cut} THEN {render_sql(_TT['H_low'], {'corr': 'rev_lf_corr'})} "
    f"ELSE {render_sql(_TT['H_high'], {'corr': 'rev_lf_corr'})} END"))
_rules.append(_rule(
    "I", f"(SELECT * FROM {_I['directional_imbalance']} ORDER BY abs(lf_diff_vs_reverse) DESC NULLS LAST, "
         f"origin ASC NULLS LAST, destination ASC NULLS LAST LIMIT 1) i WHERE lf_diff_vs_reverse IS NOT NULL",
    "origin || '→' || destination", "lf_diff_vs_reverse", "NULL",
    render_sql(_TT["I"], {"origin": "origin", "destination": "destination", "diff": "lf_diff_vs_reverse"})))
_ties = "revenue DESC NULLS LAST, origin ASC NULLS LAST, destination ASC NULLS LAST"
_tops = _I["anc_share_top_segments"]
_rules.append(_rule(
    "J", f"(SELECT * FROM (SELECT origin AS low_o, destination AS low_d, anc_share AS low_v FROM {_tops} "
         f"ORDER BY anc_share ASC NULLS LAST, {_ties} LIMIT 1) lo, "
         f"(SELECT origin AS high_o, destination AS high_d, anc_share AS high_v FROM {_tops} "
         f"ORDER BY anc_share DESC NULLS LAST, {_ties} LIMIT 1) hi) j WHERE low_v IS NOT NULL AND high_v IS NOT NULL",
    "low_o || '→' || low_d || ' / ' || high_o || '→' || high_d", "low_v", "high_v",
    render_sql(_TT["J"], {k: k for k in ("low_o", "low_d", "low_v", "high_o", "high_d", "high_v")})))
_rules.append(_rule("K", f"(SELECT * FROM {_I['last_minute_share']}, {_ncancel} n WHERE n_cancel > 0) k",
                    "NULL", "last_minute_share", "NULL", render_sql(_TT["K"], {"share": "last_minute_share"})))
_rules.append(_rule("L", "(SELECT 1) l", text="'" + _TT["L"].replace("'", "''") + "'"))

q("insights", "SELECT * FROM (\n" + "\nUNION ALL\n".join(f"({r})" for r in _rules) + "\n) u ORDER BY rule",
  "booking", *_I.values())
