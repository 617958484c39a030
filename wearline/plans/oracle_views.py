"""DuckDB SQL that derives the fixtures' tables step by step, to compare with."""

from wearline.fixtures import EVENTS_SQL, TREATED_DROP, UNTREATED_DROP, VALID


def days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000) AS DOUBLE)"


RAW = f"raw AS ({EVENTS_SQL})"
EV = f"{RAW}, ev AS (SELECT * FROM raw WHERE {VALID})"
SEG = f"{EV}, seg AS (SELECT * FROM ev WHERE Segment_ID IN (SELECT Segment_ID FROM ev WHERE event_type = 'PTM'))"
P0 = f"""{SEG}, p0 AS (
  SELECT *, lag(event_date) OVER w AS prev_meas_date, lead(event_date) OVER w AS next_meas_date, lag(URA) OVER w AS prev_URA, lag(IRI) OVER w AS prev_IRI
  FROM seg WHERE event_type = 'PTM' WINDOW w AS (PARTITION BY Segment_ID ORDER BY event_date, slot_idx))"""
P1 = f"""{P0}, pc AS (
  SELECT p0.Segment_ID, p0.slot_idx, count(t.event_date) AS tp_count_interval
  FROM p0 LEFT JOIN seg t ON t.event_type = 'TP' AND t.Segment_ID = p0.Segment_ID AND t.event_date <= p0.event_date
       AND (p0.prev_meas_date IS NULL OR t.event_date > p0.prev_meas_date) GROUP BY ALL),
p1 AS (SELECT p0.*, tp_count_interval, URA - prev_URA AS delta_URA, IRI - prev_IRI AS delta_IRI, {days('event_date', 'prev_meas_date')} AS Delta_t_days,
  {days('event_date', 'prev_meas_date')} / CAST(365.25 AS DOUBLE) AS Delta_t_years, {days('event_date', 'prev_meas_date')} AS days_since_prev_meas,
  {days('next_meas_date', 'event_date')} AS days_until_next_meas FROM p0 JOIN pc USING (Segment_ID, slot_idx))"""
P2 = f"""{P1}, p2 AS (SELECT *, tp_count_interval > 0 AS has_TP_interval,
  coalesce((tp_count_interval > 0 AND delta_URA <= {TREATED_DROP}) OR (tp_count_interval = 0 AND delta_URA <= {UNTREATED_DROP}), false) AS is_major_reset,
  coalesce(tp_count_interval = 0 AND delta_URA <= {UNTREATED_DROP}, false) AS is_phantom_reset FROM p1),
p3 AS (SELECT *, has_TP_interval AND NOT is_major_reset AS is_minor_treatment,
  sum(is_major_reset::BIGINT) OVER (PARTITION BY Segment_ID ORDER BY event_date, slot_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS cycle_num FROM p2),
p4 AS (SELECT *, row_number() OVER w AS Measurement_Idx, min(event_date) OVER (PARTITION BY Segment_ID, cycle_num) AS start_date,
  first_value(URA IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS Initial_URA,
  sum(is_minor_treatment::BIGINT) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS Minor_TP_Count
  FROM p3 WINDOW w AS (PARTITION BY Segment_ID, cycle_num ORDER BY event_date, slot_idx)),
m AS (SELECT * EXCLUDE (start_date), greatest({days('event_date', 'start_date')} / CAST(365.25 AS DOUBLE), 0.0) AS Pavement_Age_years, start_date,
  Segment_ID || '_C' || cycle_num AS Lifecycle_ID, year(event_date)::BIGINT AS year FROM p4)"""
HIST = f"""{P2}, tb AS (
  SELECT t.Segment_ID, t.slot_idx, max_by(p.slot_idx, (p.event_date, p.slot_idx)) AS b FROM seg t JOIN m p ON p.Segment_ID = t.Segment_ID AND p.event_date <= t.event_date WHERE t.event_type = 'TP' GROUP BY ALL),
ta AS (SELECT t.Segment_ID, t.slot_idx, min(p.event_date) AS next_meas_date FROM seg t JOIN m p ON p.Segment_ID = t.Segment_ID AND p.event_date >= t.event_date WHERE t.event_type = 'TP' GROUP BY ALL),
tp AS (SELECT t.*, p.event_date AS prev_meas_date, ta.next_meas_date, p.cycle_num, p.Initial_URA, p.Lifecycle_ID,
  {days('t.event_date', 'p.event_date')} AS days_since_prev_meas, {days('ta.next_meas_date', 't.event_date')} AS days_until_next_meas,
  greatest({days('t.event_date', 'p.start_date')} / CAST(365.25 AS DOUBLE), CASE WHEN p.start_date IS NOT NULL THEN 0.0 END) AS Pavement_Age_years, year(t.event_date)::BIGINT AS year
  FROM seg t LEFT JOIN tb USING (Segment_ID, slot_idx) LEFT JOIN ta USING (Segment_ID, slot_idx) LEFT JOIN m p ON p.Segment_ID = t.Segment_ID AND p.slot_idx = tb.b WHERE t.event_type = 'TP'),
h0 AS (SELECT * EXCLUDE (start_date) FROM m UNION ALL BY NAME SELECT * FROM tp),
hist AS (SELECT *, row_number() OVER (PARTITION BY Segment_ID ORDER BY event_date, event_order, slot_idx) AS Event_Idx FROM h0)"""
SURFACE = "CASE WHEN nullif(lower(trim({c})), '') IS NULL THEN '{n}' WHEN lower(trim({c})) IN ('ab','abk','abs','ea') THEN 'AB' WHEN lower(trim({c})) IN ('pab-v','pab-b','pab-o') THEN 'PAB' WHEN lower(trim({c})) = 'sma' THEN 'SMA' ELSE 'other' END"
MATERIAL = "CASE WHEN nullif(lower(trim({c})), '') IS NULL THEN '{n}' WHEN lower(trim({c})) IN ('lta','mp','mpkj','art','mpk') THEN 'new' WHEN lower(trim({c})) IN ('rem','urem','remo','rem+') THEN 'recycled' ELSE 'other' END"
LATEST = f"""{HIST}, lt AS (
  SELECT p.Segment_ID, p.slot_idx, max_by(t.Tp_pinta, (t.event_date, t.slot_idx)) AS s, max_by(t.Tp_tyomen, (t.event_date, t.slot_idx)) AS w, max(t.event_date) AS d,
         arg_max(t.slot_idx, (t.event_date, t.slot_idx)) AS ts
  FROM m p JOIN seg t ON t.event_type = 'TP' AND t.Segment_ID = p.Segment_ID AND t.event_date <= p.event_date GROUP BY ALL),
lx AS (SELECT lt.Segment_ID, lt.slot_idx, lt.d, t.Tp_pinta AS s, t.Tp_tyomen AS w FROM lt JOIN seg t ON t.event_type = 'TP' AND t.Segment_ID = lt.Segment_ID AND t.slot_idx = lt.ts)"""
SUP = f"""{LATEST}, s0 AS (
  SELECT m.* EXCLUDE (start_date), CASE WHEN lx.d > m.prev_meas_date OR (lx.d IS NOT NULL AND m.prev_meas_date IS NULL) THEN {SURFACE.format(c='lx.s', n='none')} ELSE 'none' END AS tp_surface_type,
    CASE WHEN lx.d > m.prev_meas_date OR (lx.d IS NOT NULL AND m.prev_meas_date IS NULL) THEN {MATERIAL.format(c='lx.w', n='none')} ELSE 'none' END AS tp_material_type
  FROM m LEFT JOIN lx USING (Segment_ID, slot_idx)),
s1 AS (SELECT *, lead(URA) OVER w AS target_next_URA, lead(IRI) OVER w AS target_next_IRI, lead(event_date) OVER w AS target_next_event_date, lead(Measurement_Idx) OVER w AS target_next_measurement_idx,
  max(Measurement_Idx) OVER (PARTITION BY Lifecycle_ID) - Measurement_Idx AS measurements_remaining_in_lifecycle
  FROM s0 WINDOW w AS (PARTITION BY Lifecycle_ID ORDER BY event_date, slot_idx)),
sup AS (SELECT *, {days('target_next_event_date', 'event_date')} AS target_horizon_days, {days('target_next_event_date', 'event_date')} / CAST(365.25 AS DOUBLE) AS target_horizon_years,
  Measurement_Idx = 1 AS is_first_measurement_in_lifecycle, Measurement_Idx > 1 AS has_previous_measurement_in_lifecycle, target_next_event_date IS NOT NULL AS has_next_measurement_in_lifecycle,
  URA AS baseline_persist_URA, IRI AS baseline_persist_IRI FROM s1 WHERE target_next_URA IS NOT NULL AND target_next_IRI IS NOT NULL)"""


def _near(name: str, shift_years: int) -> str:
    """The nearest row of the lifecycle to a shifted date, by distance and then date, first or last of its day."""
    shift = f"({shift_years} * 31557600000000)"
    return f"""{name} AS (SELECT Segment_ID, slot_idx, us, IRI, URA FROM (
      SELECT a.Segment_ID, a.slot_idx, epoch_us(b.event_date) AS us, b.IRI, b.URA,
        row_number() OVER (PARTITION BY a.Segment_ID, a.slot_idx ORDER BY abs(epoch_us(b.event_date) - epoch_us(a.event_date) - {shift}), epoch_us(b.event_date),
          CASE WHEN epoch_us(b.event_date) < epoch_us(a.event_date) + {shift} THEN -b.Measurement_Idx ELSE b.Measurement_Idx END) AS k
      FROM sup a JOIN sup b ON a.Lifecycle_ID = b.Lifecycle_ID AND abs(epoch_us(b.event_date) - epoch_us(a.event_date) - {shift}) <= 7889400000000) WHERE k = 1)"""


BACK, AHEAD = (1, 2, 3), (1, 2, 3, 4)
FH = (
    SUP + ", " + ", ".join([_near(f"b{k}", -k) for k in BACK] + [_near(f"f{h}", h) for h in AHEAD]) + ", fh AS (SELECT sup.*, "
    + ", ".join(f"b{k}.IRI AS IRI_hist_{k}y, b{k}.URA AS URA_hist_{k}y, (epoch_us(event_date) - b{k}.us) / CAST(31557600000000 AS DOUBLE) AS history_gap_years_{k}y" for k in BACK) + ", "
    + ", ".join(f"f{h}.IRI AS target_IRI_{h}y, f{h}.URA AS target_URA_{h}y, (f{h}.us - epoch_us(event_date)) / CAST(31557600000000 AS DOUBLE) AS actual_horizon_years_{h}y" for h in AHEAD)
    + " FROM sup " + " ".join(f"LEFT JOIN {n} USING (Segment_ID, slot_idx)" for n in [*(f"b{k}" for k in BACK), *(f"f{h}" for h in AHEAD)]) + ")"
)
