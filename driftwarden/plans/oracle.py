"""DuckDB SQL for the registered queries: the same results by plain window functions over whole stations."""

from __future__ import annotations

import itertools
import math

from driftwarden.operators.fusion import SEVERITY, V1_TEXTS, V2_TEXTS, WEIGHTS
from driftwarden.operators.detectors import path_normaliser
from driftwarden.operators.health import CHECK_CONNECTION, PENALTY, STATUS, TEXTS
from driftwarden.plans import fitted
from driftwarden.plans.queries import ACCOUNTED, EVIDENCE_V1, EVIDENCE_V2, FAMILIES, FAULTS, FUSED_V1, FUSED_V2, POISON_EVERY, RESET_EVERY, SCALED, SHARES, digits_of
from driftwarden.schema import SENSORS, SHORT, WINDOWS_MIN

W = "PARTITION BY station_id ORDER BY ts"
OBS = """obs AS (SELECT event_id, CAST(event_id % 4 AS INTEGER) AS station_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(seq * 600 + (seq // 60) * 2400) AS ts,
  CASE WHEN event_id % 50 = 7 OR seq % 100 BETWEEN 70 AND 74 THEN NULL ELSE 15.0::DOUBLE + value / 50.0 END AS temperature,
  CASE WHEN seq % 100 BETWEEN 70 AND 74 THEN NULL ELSE 980.0::DOUBLE + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10.0 END AS pressure,
  CASE WHEN seq % 100 BETWEEN 70 AND 74 THEN NULL WHEN seq % 150 BETWEEN 25 AND 56 THEN 55.0::DOUBLE ELSE 40.0 + CAST((event_id * 37) % 41 AS DOUBLE) END AS humidity
  FROM (SELECT *, event_id // 4 AS seq FROM events))"""


def q(x: str, digits: int = 4) -> str:
    return f"floor(CAST({x} AS DOUBLE) * 1e{digits} + 0.5) / 1e{digits}"


def r(*columns: str) -> str:
    """Columns rounded under their own names."""
    return ", ".join(f"{q(c, digits_of(c))} AS {c}" for c in columns)


def n(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)


def zero(x: str) -> str:
    return f"coalesce({x}, 0.0::DOUBLE)"


def each(f, sensors: tuple[str, ...] = SENSORS) -> str:
    return ", ".join(f(s) for s in sensors)


KEY = "CAST(station_id AS BIGINT) AS station_id, ts"
PLAN = "plan AS (SELECT * FROM (VALUES " + ", ".join(f"({s}, '{i}', TIMESTAMP '{a}', TIMESTAMP '{b}', '{k}', '{c}', {float(m)}::DOUBLE)" for s, i, a, b, k, c, m in FAULTS) + ") t(station_id, anomaly_id, start_ts, end_ts, anomaly_type, affected_sensor, magnitude))"


def _injected(s: str) -> str:
    return f"""CASE WHEN fid IS NULL OR NOT (sensor = '{s}' OR sensor = 'all') THEN {s} WHEN kind = 'missing' THEN NULL WHEN kind = 'frozen' THEN first_{s}
      WHEN kind = 'drift' THEN {s} + (CASE WHEN last > 0 THEN magnitude * place / last ELSE 0.0 END) ELSE {s} + magnitude END AS {s}"""


LABELLED = f"""{PLAN},
m AS (SELECT o.*, p.anomaly_id AS fid, p.anomaly_type AS kind, p.affected_sensor AS sensor, p.magnitude FROM obs o LEFT JOIN plan p ON o.station_id = p.station_id AND o.ts BETWEEN p.start_ts AND p.end_ts),
mm AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY ts) - 1 AS place, count(*) OVER (PARTITION BY fid) - 1 AS last, {each(lambda s: f"first_value({s}) OVER (PARTITION BY fid ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_{s}")} FROM m),
lab AS (SELECT station_id, ts, {each(_injected)}, CASE WHEN fid IS NULL THEN 0 ELSE 1 END AS is_anomaly, coalesce(kind, 'normal') AS anomaly_type, coalesce(sensor, 'none') AS affected_sensor, coalesce(fid, 'none') AS anomaly_id FROM mm)"""


def base(source: str) -> str:
    """CTE b: previous rows, gaps, differences, rates, missing flags, run counters."""
    near = lambda s: f"coalesce({s}_abs_delta_1 < 1e-4, false)"
    return f"""
p AS (SELECT *, lag(ts) OVER w AS prev_ts, {each(lambda s: f"lag({s}) OVER w AS prev_{s}")}, {each(lambda s: f"CASE WHEN {s} IS NULL THEN 1 ELSE 0 END AS {s}_missing")} FROM {source} WINDOW w AS ({W})),
g AS (SELECT *, greatest(temperature_missing, pressure_missing, humidity_missing) AS any_sensor_missing, least(temperature_missing, pressure_missing, humidity_missing) AS all_sensors_missing,
  coalesce((epoch_us(ts) - epoch_us(prev_ts)) / 1e6, 600.0) AS time_gap_seconds, {each(lambda s: f"{s} - prev_{s} AS {s}_delta_1, abs({s} - prev_{s}) AS {s}_abs_delta_1")} FROM p),
i AS (SELECT *, time_gap_seconds / 60.0 AS sampling_interval_mins, {each(lambda s: f"{s}_delta_1 / greatest(time_gap_seconds / 60.0, 1.0) * 60.0 AS {s}_rate_per_hour, sum(CASE WHEN {near(s)} THEN 0 ELSE 1 END) OVER ({W}) AS {s}_isl")} FROM g),
b AS (SELECT *, {each(lambda s: f"sum(CASE WHEN {near(s)} THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, {s}_isl ORDER BY ts) AS {s}_consec_unchanged")} FROM i)"""


def frame(w: int) -> str:
    return f"({W} RANGE BETWEEN INTERVAL {w} MINUTE PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"


def rolled(source: str, windows: tuple[int, ...] = WINDOWS_MIN, sensors: tuple[str, ...] = SENSORS) -> str:
    """CTE z: rolling statistics, deviations and z-scores over ``windows``."""
    aggregates = {"roll_mean": "avg({s})", "roll_std": "stddev_samp({s})", "roll_min": "min({s})", "roll_max": "max({s})", "roll_median": "quantile_cont({s}, 0.5)"}
    cols = [f"{a.format(s=s)} OVER w{w} AS {s}_{name}_{w}m" for w in windows for s in sensors for name, a in aggregates.items()]
    if 60 in windows:
        cols += [f"var_samp({s}) OVER w60 AS {s}_roll_var_60m, quantile_cont({s}, 0.25) OVER w60 AS {s}_q25, quantile_cont({s}, 0.75) OVER w60 AS {s}_q75" for s in sensors]
    pairs = [(s, w) for w in windows for s in sensors]
    guard = lambda x: f"CASE WHEN {x} IS NULL OR {x} < 1e-6 THEN 1e-6 ELSE {x} END"
    dev = [f"{s} - {s}_roll_mean_{w}m AS {s}_dev_mean_{w}m, {s} - {s}_roll_median_{w}m AS {s}_dev_med_{w}m, ({s} - {s}_roll_mean_{w}m) / ({guard(f'{s}_roll_std_{w}m')}) AS {s}_roll_z_{w}m" for s, w in pairs]
    if 60 in windows:
        dev += [f"{s}_roll_max_60m - {s}_roll_min_60m AS {s}_roll_range_60m, {s}_q75 - {s}_q25 AS {s}_roll_iqr_60m, ({s} - {s}_roll_median_60m) / ({guard(f'({s}_q75 - {s}_q25)')}) AS {s}_robust_z_60m" for s in sensors]
    return f"ro AS (SELECT *, {', '.join(cols)} FROM {source} WINDOW {', '.join(f'w{w} AS {frame(w)}' for w in windows)}),\nz AS (SELECT *, {', '.join(dev)} FROM ro)"


Z = [f"{s}_roll_z_60m" for s in SENSORS]
DISAGREE = f"CASE WHEN {' OR '.join(f'{z} IS NULL' for z in Z)} THEN NULL ELSE greatest(abs({Z[0]} - {Z[1]}), abs({Z[0]} - {Z[2]}), abs({Z[1]} - {Z[2]})) END"
STAT = zero(f"greatest({', '.join(f'abs({z})' for z in Z)})")
RATE = zero(f"greatest({each(lambda s: f'abs({s}_rate_per_hour)')})")
CONSEC = f"greatest({each(lambda s: f'{s}_consec_unchanged')})"


def bound(x: str, k: float) -> str:
    return f"(1 - exp(-({x}) / {k}))"


def clip(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def _depth(tree) -> str:
    """Depth of the leaf that a row falls in."""
    if not isinstance(tree, tuple):
        return f"{float(tree)}::DOUBLE"
    return f"CASE WHEN x{tree[0]} > {tree[1]}::DOUBLE THEN {_depth(tree[3])} ELSE {_depth(tree[2])} END"


def _split_on(tree) -> set[int]:
    return {tree[0]}.union(*map(_split_on, tree[2:])) if isinstance(tree, tuple) else set()


def _known(tree, columns: frozenset, level: int = 1) -> str | float:
    """What a tree gives where only ``columns`` are known: other splits send on the shares of the fitted rows."""
    if not isinstance(tree, tuple):
        return float(tree)
    low, high = (_known(t, columns, level + 1) for t in tree[2:])
    text = [x if isinstance(x, str) else f"{x!r}::DOUBLE" for x in (low, high)]
    if tree[0] in columns:
        return f"(CASE WHEN x{tree[0]} > {tree[1]}::DOUBLE THEN {text[1]} ELSE {text[0]} END)"
    rows = [fitted.rows_of(t, level) for t in tree[2:]]
    share = rows[0] / sum(rows)
    if isinstance(low, float) and isinstance(high, float):
        return share * low + (1 - share) * high
    return f"({share!r}::DOUBLE * {text[0]} + {1 - share!r}::DOUBLE * {text[1]})"


def _shapley(tree, column: int) -> str:
    """A column's Shapley value by its definition: what it changes, over all subsets of the tree's other columns."""
    others = sorted(_split_on(tree) - {column})
    if column not in _split_on(tree):
        return "0.0::DOUBLE"
    parts = []
    for size in range(len(others) + 1):
        weight = math.factorial(size) * math.factorial(len(others) - size) / math.factorial(len(others) + 1)
        parts += [f"{weight!r}::DOUBLE * ({_known(tree, frozenset({*held, column}))} - {_known(tree, frozenset(held))})" for held in itertools.combinations(others, size)]
    return f"({' + '.join(parts)})"


_N = len(fitted.COLUMNS)
_scaled = [f"(coalesce({c}, {m}::DOUBLE) - {a}::DOUBLE) / {d}::DOUBLE AS x{k}" for k, (c, m, a, d) in enumerate(zip(fitted.COLUMNS, fitted.MEDIAN, fitted.MEAN, fitted.DEVIATION, strict=True))]
_along = [" + ".join(f"x{k} * {v}::DOUBLE" for k, v in enumerate(c)) + f" AS y{i}" for i, c in enumerate(fitted.COMPONENTS)]
_left = [f"pow(x{k} - ({' + '.join(f'y{i} * {c[k]}::DOUBLE' for i, c in enumerate(fitted.COMPONENTS))}), 2)" for k in range(_N)]
_robust = [f"({c} - {fitted.CENTRE[c]}::DOUBLE) / {fitted.SPREAD[c]}::DOUBLE" for c in fitted.CENTRE]


def models(source: str) -> str:
    """CTEs from features with ``statistical_score`` to s: the stored models' scores, predictions and joint evidence."""
    clipped = [f"greatest(0.0::DOUBLE, least(10.0::DOUBLE, {x}))" for x in _robust]
    return f"""
sx AS (SELECT *, {", ".join(_scaled)} FROM {source}),
sy AS (SELECT *, {", ".join(_along)} FROM sx),
sz AS (SELECT *, ({" + ".join(_left)}) / {_N}.0::DOUBLE AS pca_score, pow(2.0::DOUBLE, -({" + ".join(_depth(t) for t in fitted.TREES)}) / {len(fitted.TREES)}.0::DOUBLE / {float(path_normaliser(fitted.TREE_ROWS))!r}::DOUBLE) AS isolation_forest_score FROM sy),
s AS (SELECT *, {zero("abs(multivariate_z_disagreement)")} AS dis, ({" + ".join(_robust)}) / 3.0::DOUBLE AS scaled, ({" + ".join(clipped)}) / 3.0::DOUBLE AS scaled_v2,
  {", ".join(f"CASE WHEN {k}_score > {v}::DOUBLE THEN 1 ELSE 0 END AS {k}_prediction" for k, v in fitted.LIMITS.items())} FROM sz)"""


SCORED = f"""{base("lab")}, {rolled("b", (60, 360))},
s0 AS (SELECT *, {DISAGREE} AS multivariate_z_disagreement, {STAT} AS statistical_score FROM z), {models("s0")}"""
ANY = "greatest(statistical_prediction, pca_prediction, isolation_forest_prediction)"

_v1_four = [f"e1_{k}" for k in ("temporal", "statistical", "multivariate", "stability")]
_v1_top = f"greatest({', '.join(_v1_four)})"
V1 = f"""{SCORED},
e1 AS (SELECT *, {bound(RATE, 10.0)} AS e1_temporal, {bound("least(statistical_score, 100.0)", 4.0)} AS e1_statistical, {bound("dis", 4.0)} AS e1_multivariate, {bound(CONSEC, 80.0)} AS e1_stability,
  CASE WHEN all_sensors_missing = 1 THEN 1.0 WHEN any_sensor_missing = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS e1_missing, {bound("greatest(scaled, 0.0)", 2.0)} AS e1_model FROM s),
f1 AS (SELECT *, {" + ".join(f"e1_{k} * {w}::DOUBLE" for k, w in WEIGHTS.items())} AS base_score, 1.0 - e1_multivariate AS contextual_consistency, CASE WHEN dis < 2.0 AND e1_missing = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS suppression_factor FROM e1),
g1 AS (SELECT *, {clip("CASE WHEN all_sensors_missing = 1 THEN " + clip("base_score * suppression_factor + 0.8") + " ELSE base_score * suppression_factor END")} AS hybrid_anomaly_score,
  least(({" + ".join(f"(CASE WHEN e1_{k} > 0.2 THEN 1 ELSE 0 END)" for k in WEIGHTS)}) / 3.0, 1.0) AS v1_confidence FROM f1),
v1 AS (SELECT *, CASE WHEN hybrid_anomaly_score > 0.9 THEN 1 ELSE 0 END AS hybrid_prediction,
  CASE WHEN all_sensors_missing = 1 THEN '{V1_TEXTS["all_missing"]}' WHEN any_sensor_missing = 1 THEN '{V1_TEXTS["any_missing"]}'
    WHEN {_v1_top} < 0.2 AND suppression_factor < 1.0 THEN '{V1_TEXTS["suppressed"]}' WHEN {_v1_top} >= 0.2 THEN CASE {" ".join(f"WHEN {c} = {_v1_top} THEN '{V1_TEXTS[c[3:]]}'" for c in _v1_four)} END ELSE '{V1_TEXTS["none"]}' END AS v1_primary_evidence FROM g1)"""

_act = lambda *cs: " + ".join(f"(CASE WHEN {c} >= 0.30 THEN 1 ELSE 0 END)" for c in cs)
_apart = each(lambda s: zero(f"abs({s}_roll_mean_60m - {s}_roll_mean_360m)"))
_zcap = each(lambda s: f"least({zero(f'abs({s}_roll_z_60m)')}, 50.0::DOUBLE)")
V2_STEPS = f"""e2 AS (SELECT *, {bound(RATE, 25.0)} AS e2_temporal, {bound(f"greatest({_zcap})", 30.0)} AS e2_statistical, {bound("dis", 30.0)} AS e2_multivariate, {bound(CONSEC, 6.0)} AS e2_stability, {bound(f"greatest({_apart})", 3.5)} AS e2_drift,
  least({bound("scaled_v2", 3.0)}, 0.20::DOUBLE) AS e2_model FROM s),
f2 AS (SELECT *, {_act("e2_temporal", "e2_statistical", "e2_multivariate")} AS sudden_active, {_act("e2_stability", "e2_drift")} AS persistent_active, CASE WHEN dis < 2.0 AND any_sensor_missing = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS context_factor FROM e2),
g2 AS (SELECT *, {clip("greatest(e2_temporal, e2_statistical, e2_multivariate) + sudden_active * 0.10::DOUBLE + e2_model")} * context_factor AS sudden_event_score,
  {clip("greatest(e2_stability, e2_drift) + persistent_active * 0.10::DOUBLE + e2_model")} AS persistent_fault_score, CASE WHEN all_sensors_missing = 1 THEN 1.0 WHEN any_sensor_missing = 1 THEN 0.6 ELSE 0.0 END::DOUBLE AS communication_score FROM f2),
h2 AS (SELECT *, greatest(sudden_event_score, persistent_fault_score, communication_score) AS final_anomaly_score,
  CASE WHEN communication_score >= sudden_event_score AND communication_score >= persistent_fault_score THEN '{FAMILIES[2]}' WHEN sudden_event_score >= persistent_fault_score THEN '{FAMILIES[0]}' ELSE '{FAMILIES[1]}' END AS winner,
  (sudden_event_score >= 1.0 OR persistent_fault_score >= 1.0 OR communication_score > 0.5) AS anomaly_flag FROM g2),
k2 AS (SELECT *, CASE WHEN final_anomaly_score = 0 OR winner = '{FAMILIES[2]}' THEN 1.0 ELSE {clip(f"0.5 * final_anomaly_score + 0.5 * (CASE WHEN (CASE WHEN winner = '{FAMILIES[0]}' THEN sudden_active ELSE persistent_active END) >= 2 THEN 1.0 WHEN (CASE WHEN winner = '{FAMILIES[0]}' THEN sudden_active ELSE persistent_active END) = 1 THEN 0.5 ELSE 0.0 END)")} END AS anomaly_confidence,
  CASE WHEN anomaly_flag THEN winner ELSE 'NORMAL' END AS candidate_fault_family,
  CASE WHEN NOT anomaly_flag THEN 'NORMAL' WHEN winner = '{FAMILIES[2]}' THEN 'MISSING'
    WHEN winner = '{FAMILIES[1]}' THEN CASE WHEN e2_stability > e2_drift THEN 'FROZEN' WHEN e2_drift > 0.3 THEN 'DRIFT' ELSE 'UNKNOWN' END
    WHEN e2_multivariate > e2_temporal AND e2_multivariate > e2_statistical THEN 'MULTIVARIATE_INCONSISTENCY' WHEN e2_temporal > e2_statistical THEN 'SPIKE' ELSE 'OFFSET' END AS fault_type_hint FROM h2),
v2 AS (SELECT *, CASE WHEN anomaly_flag THEN 1 ELSE 0 END AS predicted, {q("final_anomaly_score")} AS score,
  CASE WHEN NOT anomaly_flag THEN 'NORMAL' WHEN winner = '{FAMILIES[2]}' AND communication_score = 1.0 THEN 'CRITICAL' {" ".join(f"WHEN final_anomaly_score < {t} THEN '{name}'" for t, name in SEVERITY)} ELSE 'CRITICAL' END AS severity,
  CASE WHEN NOT anomaly_flag THEN '' WHEN winner = '{FAMILIES[2]}' THEN CASE WHEN communication_score = 1.0 THEN '{V2_TEXTS["all_missing"]}' ELSE '{V2_TEXTS["any_missing"]}' END
    ELSE CASE fault_type_hint {" ".join(f"WHEN '{k}' THEN '{V2_TEXTS[k]}'" for k in ("FROZEN", "DRIFT", "UNKNOWN", "MULTIVARIATE_INCONSISTENCY", "SPIKE", "OFFSET"))} END || CASE WHEN winner = '{FAMILIES[0]}' AND context_factor < 1.0 THEN '{V2_TEXTS["suffix"]}' ELSE '' END END AS primary_evidence FROM k2)"""

V2 = f"{SCORED},\n{V2_STEPS}"

_ev = lambda s: f"CASE WHEN {s} IS NULL THEN 1.0 ELSE greatest(least(1.0, coalesce(abs({s}_rate_per_hour) / 10.0, 1.0)), least(1.0, coalesce(abs({s}_roll_z_60m) / 4.0, 1.0))) END::DOUBLE"
_over = lambda s: f"(CASE WHEN ev_{s} > 0.5 THEN ev_{s} END)"
_hit = lambda s: f"affected IN ('{s.upper()}', 'MULTIPLE', 'ALL_SENSORS')"
_cnt = lambda c: f"sum(CASE WHEN anomaly_flag AND {c} THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, grp ORDER BY ts)"
HEALTH_STEPS = f"""c1 AS (SELECT *, temperature_missing + pressure_missing + humidity_missing AS nm, {each(lambda s: f"{_ev(s)} AS ev_{s}")} FROM judged),
c2 AS (SELECT *, CASE WHEN nm = 3 THEN 'DATA_LOSS' WHEN nm > 0 THEN 'DEGRADED' ELSE 'GOOD' END AS data_quality_status, CASE WHEN nm > 0 THEN 'MISSING' WHEN anomaly_flag THEN fault_type_hint ELSE 'NORMAL' END AS classified_fault_type,
  list_reverse_sort(list_filter([{each(_over)}], lambda x: x IS NOT NULL)) AS held FROM c1),
c3 AS (SELECT *, CASE WHEN classified_fault_type = 'NORMAL' THEN 'NONE' WHEN nm = 3 THEN 'ALL_SENSORS' WHEN len(held) = 0 THEN 'UNKNOWN'
    WHEN len(held) > 1 AND (classified_fault_type = 'MULTIVARIATE_INCONSISTENCY' OR held[1] <= held[2] * 1.5) THEN 'MULTIPLE' {" ".join(f"WHEN ev_{s} = held[1] THEN '{s.upper()}'" for s in SENSORS)} END AS affected,
  sum(CASE WHEN NOT anomaly_flag OR (prev_ts IS NOT NULL AND ts - prev_ts > INTERVAL 30 MINUTE) THEN 1 ELSE 0 END) OVER ({W}) AS grp FROM c2),
c4 AS (SELECT *, {_cnt("true")} AS anomaly_streak, {_cnt("classified_fault_type = 'MISSING'")} AS missing_streak, {_cnt("classified_fault_type = 'FROZEN'")} AS frozen_streak, {each(lambda s: f"{_cnt(_hit(s))} AS st_{s}")} FROM c3),
c5 AS (SELECT *, greatest({each(lambda s: f"st_{s}")}) AS sensor_fault_streak, row_number() OVER ({W}) AS rn,
  {each(lambda s: f'''CASE WHEN NOT anomaly_flag AND st_{s} = 0 THEN 0.2 WHEN {_hit(s)} THEN -((CASE classified_fault_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in PENALTY.items())} ELSE 1.0 END)::DOUBLE * ev_{s} * anomaly_confidence * least(5.0, 1.0 + 0.5 * greatest(0, st_{s} - 1))) ELSE 0.0 END::DOUBLE AS d_{s}''')} FROM c4)"""
HEALTH = f"{V2},\njudged AS (SELECT * FROM v2),\n{HEALTH_STEPS}"
MAINTENANCE = f"CASE WHEN NOT anomaly_flag THEN 'NO_ACTION' WHEN classified_fault_type = 'MISSING' THEN '{CHECK_CONNECTION}' WHEN classified_fault_type = 'FROZEN' AND frozen_streak > 3 THEN 'MAINTENANCE_RECOMMENDED' WHEN classified_fault_type = 'DRIFT' THEN 'INSPECT' WHEN anomaly_streak > 3 THEN 'MONITOR / INSPECT' ELSE 'MONITOR' END"
_fold = lambda s, prior: f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, {prior} + d.d_{s}))"
FOLD_STEPS = f"""d AS MATERIALIZED (SELECT station_id, ts, rn, data_quality_status, anomaly_flag, {each(lambda s: f"d_{s}")} FROM c5),
hf AS (SELECT d.station_id, d.ts, d.rn, d.data_quality_status, d.anomaly_flag, {each(lambda s: f"{_fold(s, '100.0')} AS {s}_health")} FROM d WHERE rn = 1
  UNION ALL SELECT d.station_id, d.ts, d.rn, d.data_quality_status, d.anomaly_flag, {each(lambda s: f"{_fold(s, f'hf.{s}_health')} AS {s}_health")} FROM hf JOIN d ON d.station_id = hf.station_id AND d.rn = hf.rn + 1)"""
FOLD = f"{HEALTH},\n{FOLD_STEPS}"


def _said(k: str) -> str:
    parts = TEXTS[k].replace("%2$.2f", "\0c\0").replace("%1$s", "\0s\0").split("\0")
    shown = {"c": f"printf('%.2f', {q('anomaly_confidence', 2)})", "s": "lower(affected)"}
    return " || ".join(shown.get(x) or f"'{x}'" for x in parts)


_one = f"affected IN ({', '.join(repr(s.upper()) for s in SENSORS)})"
EXPLANATION = f"CASE {' '.join(f'''WHEN classified_fault_type = '{k}' THEN {_said(k)}''' for k in ('NORMAL', 'MISSING'))} {' '.join(f'''WHEN {_one} AND classified_fault_type = '{k}' THEN {_said(k)}''' for k in ('SPIKE', 'FROZEN', 'DRIFT', 'OFFSET', 'NOISE'))} WHEN classified_fault_type = 'MULTIVARIATE_INCONSISTENCY' THEN {_said('MULTIVARIATE_INCONSISTENCY')} ELSE {_said('other')} END"

# What the stream rules change: deviations are at least 1e-6 and absent for one value, disagreement uses the pairs there are.
STREAM_Z = "zs AS (SELECT * REPLACE (" + ", ".join(f"greatest({s}_roll_std_60m + CASE WHEN {s}_roll_std_60m IS NULL THEN NULL ELSE 0.0 END, CASE WHEN {s}_roll_std_60m IS NULL THEN NULL ELSE 1e-6 END) AS {s}_roll_std_60m, CASE WHEN {s}_roll_std_60m IS NOT NULL THEN ({s} - {s}_roll_mean_60m) / greatest({s}_roll_std_60m, 1e-6) END AS {s}_roll_z_60m" for s in SENSORS) + ") FROM z)"
PAIRS = f"greatest(abs({Z[0]} - {Z[1]}), abs({Z[0]} - {Z[2]}), abs({Z[1]} - {Z[2]}))"
_quiet = "seen < 12 AND fault_type_hint NOT IN ('MISSING', 'FROZEN')"
_phi = [f"(({' + '.join(_shapley(t, k) for t in fitted.TREES)}) / {len(fitted.TREES)}.0::DOUBLE)" for k in range(_N)]
STREAM = f"""{base("obs")}, {rolled("b", (60, 360))}, {STREAM_Z},
s0 AS (SELECT *, {PAIRS} AS multivariate_z_disagreement, {STAT} AS statistical_score FROM zs), {models("s0")},
{V2_STEPS},
w0 AS (SELECT *, count(*) OVER c AS seen, {each(lambda s: f"quantile_cont({s}, 0.5) OVER c AS {s}_held")}, list_sort(list_filter([{", ".join(f"{{'v': -round(abs({x}), 9), 'k': {k}}}" for k, x in enumerate(_phi))}], lambda x: x.v < 0)) AS told FROM v2 WINDOW c AS ({W} RANGE BETWEEN INTERVAL 360 MINUTE PRECEDING AND CURRENT ROW)),
judged AS (SELECT * REPLACE (CASE WHEN {_quiet} THEN false ELSE anomaly_flag END AS anomaly_flag, CASE WHEN {_quiet} THEN 'NORMAL' ELSE fault_type_hint END AS fault_type_hint, CASE WHEN seen < 12 THEN 'NORMAL' ELSE severity END AS severity) FROM w0),
{HEALTH_STEPS},
{FOLD_STEPS}"""
_name = lambda k: f"[{', '.join(repr(c) for c in fitted.COLUMNS)}][told[{k}].k + 1]"
STATUS_SQL = lambda s: f"CASE {' '.join(f'''WHEN {s}_health >= {low} THEN '{name}' ''' for low, name in STATUS)} ELSE 'CRITICAL' END AS {s}_status"

REPEATS = """w AS (SELECT station_id, ts, temperature, pressure, humidity FROM obs UNION ALL SELECT station_id, ts, temperature, pressure, humidity FROM obs WHERE (minute(ts) + 60 * hour(ts)) % 170 = 0
  UNION ALL SELECT station_id, ts, coalesce(temperature, 0.0) + 1.0, pressure, humidity FROM obs WHERE (minute(ts) + 60 * hour(ts)) % 310 = 0)"""
LONG = " UNION ALL ".join(f"SELECT '{s}' AS sensor, {s} AS x FROM obs" for s in SENSORS)
GAPS = f"gp AS (SELECT *, lag(ts) OVER ({W}) AS prev_ts FROM obs)"
CURVE = f"""{V2},
cs AS (SELECT score, sum(is_anomaly) AS pos, sum(1 - is_anomaly) AS neg FROM v2 GROUP BY score),
cu AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM cs),
st AS (SELECT *, coalesce(lag(tp) OVER (ORDER BY score DESC), 0) AS t0, coalesce(lag(fp) OVER (ORDER BY score DESC), 0) AS f0 FROM cu),
tot AS (SELECT max(tp) AS P, max(fp) AS N FROM cu)"""
COUNTS = "count(*) FILTER (is_anomaly = 1 AND predicted = 1) AS tp, count(*) FILTER (is_anomaly <> 1 AND predicted = 1) AS fp, count(*) FILTER (is_anomaly <> 1 AND predicted <> 1) AS tn, count(*) FILTER (is_anomaly = 1 AND predicted <> 1) AS fn"
div = lambda a, b: q(f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a}) / nullif({b}, 0)::DOUBLE END")
RATES = f"{div('tp', '(tp + fp)')} AS precision, {div('tp', '(tp + fn)')} AS recall, {div('2 * tp', '(2 * tp + fp + fn)')} AS f1, {div('tp + tn', '(tp + fp + tn + fn)')} AS accuracy, {div('fp', '(fp + tn)')} AS fpr"


def on(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{OBS}, " + ", ".join(ctes) + "\n"


def of_obs(body: str) -> str:
    return f"WITH {OBS}\n{body}"


#: Two runs, one without the later half of the events: nothing else may set them apart.
HALVES = of_obs("SELECT CAST(station_id AS BIGINT) AS station_id, count(*) FILTER (early) AS rows, 0::BIGINT AS only_left, count(*) FILTER (NOT early) AS only_right, 0::BIGINT AS differing FROM (SELECT *, event_id < (SELECT count(*) FROM events) // 2 AS early FROM obs) GROUP BY 1")


def rolling_query(w: int) -> str:
    names = [f"{s}_{c}_{w}m" for s in SENSORS for c in ("roll_mean", "roll_std", "roll_min", "roll_max", "roll_median", "dev_mean", "dev_med", "roll_z")]
    return on(rolled("obs", (w,))) + f"SELECT {KEY}, {r(*names)} FROM z"


def _median_held(s: str) -> str:
    return f"quantile_cont({s}, 0.5) OVER c AS {s}_correction"


def uniform(k: int) -> str:
    return f"((CAST('0x' || substr(md5('1:' || CAST(epoch_us(ts) AS VARCHAR) || ':{k}'), 1, 12) AS BIGINT) + 1) / {float((1 << 48) + 1)!r}::DOUBLE)"


FEATS = on(base("obs"))
L = on(LABELLED)
X1, X2, XH = on(LABELLED, V1), on(LABELLED, V2), on(LABELLED, HEALTH)

_turned = {"hour_sin": "sin(2 * pi() * hour(ts) / 24.0)", "hour_cos": "cos(2 * pi() * hour(ts) / 24.0)", "month_sin": "sin(2 * pi() * (month(ts) - 1) / 12.0)", "month_cos": "cos(2 * pi() * (month(ts) - 1) / 12.0)"}
_times = {"hour": "hour(ts)", "minute": "minute(ts)", "day_of_week": "isodow(ts) - 1", "day_of_year": "dayofyear(ts)", "month": "month(ts)", "is_weekend": "(isodow(ts) >= 6)::INT", **_turned, "time_gap_flag": "(sampling_interval_mins > 15.0)::INT"}
#: Names and expressions of the features without a frame, in the models' order.
ORDER = [
    *((s, s) for s in SENSORS), *((f"{s}_missing", f"{s}_missing") for s in SENSORS), *((c, c) for c in ("any_sensor_missing", "all_sensors_missing")),
    *((c, _times.get(c, c)) for c in ("hour", "minute", "day_of_week", "day_of_year", "month", "is_weekend", "hour_sin", "hour_cos", "month_sin", "month_cos", "time_gap_seconds", "sampling_interval_mins", "time_gap_flag")),
    *((f"{s}_{c}", f"{s}_{c}") for s in SENSORS for c in ("delta_1", "abs_delta_1", "rate_per_hour")), *((f"{s}_consec_unchanged", f"{s}_consec_unchanged") for s in SENSORS),
]

ORACLE: dict[str, str] = {
    "observations": of_obs(f"SELECT {KEY}, {r(*SENSORS)} FROM obs"),
    "clean_dedup": on(REPEATS) + f"SELECT DISTINCT {KEY}, {r(*SENSORS)} FROM w",
    "dup_conflicts": on(REPEATS) + ", v AS (SELECT station_id, ts, temperature, pressure, humidity, count(*) AS n FROM w GROUP BY ALL), k AS (SELECT station_id, ts, sum(n) AS rows, count(*) AS kinds FROM v GROUP BY ALL) SELECT CAST(sum(rows) AS BIGINT) AS total_rows, CAST(sum(rows - kinds) AS BIGINT) AS exact_duplicates, CAST(sum(rows - 1) AS BIGINT) AS duplicate_keys, CAST(sum(kinds - 1) AS BIGINT) AS conflicting FROM k",
    "semi_join": on(REPEATS) + f", v AS (SELECT DISTINCT * FROM w), k AS (SELECT station_id AS sid, ts AS t FROM v GROUP BY ALL HAVING count(*) > 1) SELECT {KEY}, {r(*SENSORS)} FROM w WHERE EXISTS (SELECT 1 FROM k WHERE sid = station_id AND t = ts)",
    "audit_basic": of_obs(f"SELECT sensor, count(x) AS n, {q('min(x)')} AS min, {q('max(x)')} AS max, {q('avg(x)')} AS mean, {q('stddev_samp(x)')} AS std FROM ({LONG}) GROUP BY sensor"),
    "describe": of_obs(f"SELECT sensor, count(x) AS n, {q('avg(x)')} AS mean, {q('stddev_samp(x)')} AS std, {q('min(x)')} AS min, {q('quantile_cont(x, 0.25)')} AS p25, {q('quantile_cont(x, 0.5)')} AS p50, {q('quantile_cont(x, 0.75)')} AS p75, {q('max(x)')} AS max FROM ({LONG}) GROUP BY sensor"),
    "physical_range": of_obs(f"SELECT count(*) FILTER (temperature < -50 OR temperature > 60) AS temperature_out, count(*) FILTER (pressure <= 0) AS pressure_out, count(*) FILTER (humidity < 0 OR humidity > 100) AS humidity_out, {each(lambda s: f'count(*) FILTER (isinf({s})) AS {s}_infinite')} FROM obs"),
    "null_counts": of_obs(f"SELECT count(*) AS rows, {each(lambda s: f'count(*) FILTER ({s} IS NULL) AS {s}_nulls')} FROM obs"),
    "gap_topk": on(GAPS) + f"SELECT {KEY}, prev_ts AS gap_start, {q('(epoch_us(ts) - epoch_us(prev_ts)) / 6e7')} AS gap_minutes, CAST(floor((epoch_us(ts) - epoch_us(prev_ts)) / 6e8) - 1 AS BIGINT) AS missing_slots FROM gp WHERE ts - prev_ts > INTERVAL 10 MINUTE ORDER BY gap_minutes DESC, station_id, ts LIMIT 10",
    "interval_stats": on(GAPS) + f"SELECT CAST(station_id AS BIGINT) AS station_id, {q('quantile_cont(d, 0.5)')} AS median_s, {q('mode(d)')} AS mode_s, {q('min(d)')} AS min_s, {q('max(d)')} AS max_s, count(*) FILTER (d < 0) AS negative, count(*) FILTER (d = 0) AS zero FROM (SELECT station_id, (epoch_us(ts) - epoch_us(prev_ts)) / 1e6 AS d FROM gp) GROUP BY station_id",
    "monotonic_check": of_obs("SELECT CAST(station_id AS BIGINT) AS station_id, count(*) AS rows, count(*) FILTER (ts < prior) AS backward FROM (SELECT station_id, ts, lag(ts) OVER (PARTITION BY station_id ORDER BY (event_id * 7) % 1009 + event_id) AS prior FROM obs) GROUP BY station_id"),
    "constant_runs": of_obs(f"SELECT CAST(station_id AS BIGINT) AS station_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS size, {q('min(humidity)')} AS value, {q('(epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7')} AS duration_minutes FROM (SELECT *, sum(CASE WHEN humidity = prior THEN 0 ELSE 1 END) OVER ({W}) AS isl FROM (SELECT *, lag(humidity) OVER ({W}) AS prior FROM obs)) GROUP BY station_id, isl ORDER BY size DESC, station_id, first_ts LIMIT 5"),
    "clean_segments": of_obs(f"SELECT CAST(station_id AS BIGINT) AS station_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS size FROM (SELECT *, sum(CASE WHEN ts - prior = INTERVAL 10 MINUTE THEN 0 ELSE 1 END) OVER ({W}) AS isl FROM (SELECT *, lag(ts) OVER ({W}) AS prior FROM obs WHERE temperature IS NOT NULL AND pressure IS NOT NULL AND humidity IS NOT NULL)) GROUP BY station_id, isl HAVING count(*) >= 20"),
    "safe_starts": of_obs(f"SELECT {KEY} FROM (SELECT *, lead(ts, 35) OVER ({W}) AS e, sum(CASE WHEN temperature IS NULL OR pressure IS NULL OR humidity IS NULL THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN CURRENT ROW AND 35 FOLLOWING) AS nm FROM obs) WHERE nm = 0 AND abs(epoch_us(e) - epoch_us(ts) - CAST(35 AS BIGINT) * 600000000) <= 1800000000"),
    "first_days": of_obs(f"SELECT {KEY}, {r(*SENSORS)} FROM (SELECT *, min(ts) OVER (PARTITION BY station_id) AS s FROM obs) WHERE ts <= s + INTERVAL 1 DAY"),
    "context_slice": on(PLAN) + f", x AS (SELECT *, row_number() OVER ({W}) AS rn FROM obs), mk AS (SELECT x.station_id AS sid, x.ts AS mark_ts, x.rn AS mrn FROM x JOIN (SELECT DISTINCT station_id, start_ts FROM plan) p ON x.station_id = p.station_id AND x.ts = p.start_ts) SELECT {KEY}, {r(*SENSORS)}, mark_ts, rn - mrn AS distance FROM x JOIN mk ON sid = station_id AND abs(rn - mrn) <= 5",
    "corr_pairs": of_obs(f"SELECT {q('corr(temperature, pressure)')} AS temperature_pressure, {q('corr(temperature, humidity)')} AS temperature_humidity, {q('corr(pressure, humidity)')} AS pressure_humidity FROM obs"),
    "replay_faults": of_obs(f"SELECT {KEY}, row, {r(*SENSORS)} FROM (SELECT station_id, ts, row, {each(lambda s: f'CASE WHEN row = 48 THEN NULL WHEN row BETWEEN 42 AND 46 THEN held_{s} ELSE {s} + ' + ('CASE WHEN row = 38 THEN 25.0 ELSE 0.0 END' if s == 'temperature' else '0.0') + f' END AS {s}')} FROM (SELECT *, {each(lambda s: f'max(CASE WHEN row = 41 THEN {s} END) OVER (PARTITION BY station_id) AS held_{s}')} FROM (SELECT *, row_number() OVER ({W}) - 1 AS row FROM obs)) WHERE row < 50)"),
    "feat_missing": FEATS + f"SELECT {KEY}, {n(*(f'{s}_missing' for s in SENSORS), 'any_sensor_missing', 'all_sensors_missing')} FROM b",
    "feat_time": FEATS + f"SELECT {KEY}, hour(ts) AS hour, minute(ts) AS minute, isodow(ts) - 1 AS day_of_week, dayofyear(ts) AS day_of_year, month(ts) AS month, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend, {q('sin(2 * pi() * hour(ts) / 24.0)')} AS hour_sin, {q('cos(2 * pi() * hour(ts) / 24.0)')} AS hour_cos, {q('sin(2 * pi() * (month(ts) - 1) / 12.0)')} AS month_sin, {q('cos(2 * pi() * (month(ts) - 1) / 12.0)')} AS month_cos, {r('time_gap_seconds', 'sampling_interval_mins')}, CAST(sampling_interval_mins > 15.0 AS BIGINT) AS time_gap_flag FROM b",
    "feat_first_order": FEATS + f"SELECT {KEY}, {r(*(f'{s}_{c}' for s in SENSORS for c in ('delta_1', 'abs_delta_1', 'rate_per_hour')))} FROM b",
    **{f"feat_rolling_{w}": rolling_query(w) for w in WINDOWS_MIN},
    "feat_stability": on(base("obs"), rolled("b", (60,))) + f"SELECT {KEY}, {n(*(f'{s}_consec_unchanged' for s in SENSORS))}, {r(*(f'{s}_{c}_60m' for s in SENSORS for c in ('roll_var', 'roll_range')))} FROM z",
    "feat_multivariate": on(rolled("obs", (60,))) + f"SELECT {KEY}, {q(DISAGREE)} AS multivariate_z_disagreement, {' + '.join(f'(CASE WHEN abs({z}) > 2 THEN 1 ELSE 0 END)' for z in Z)} AS num_sensors_large_dev, CASE {' '.join(f'WHEN abs({z}) = greatest(' + ', '.join(f'abs({y})' for y in Z) + f') THEN {k}' for k, z in enumerate(Z))} ELSE -1 END AS dominant_sensor_z FROM z",
    "feat_ratio": FEATS + f"SELECT {KEY}, {', '.join(q(f'abs({s}_rate_per_hour) / (' + ' + '.join(f'abs({t}_rate_per_hour)' for t in SENSORS) + ' + 1e-6)') + f' AS {SHORT[s]}_rate_ratio' for s in SENSORS)} FROM b",
    "feat_robust": on(rolled("obs", (60,))) + f"SELECT {KEY}, {r(*(f'{s}_{c}_60m' for s in SENSORS for c in ('roll_iqr', 'robust_z')))} FROM z",
    "stat_score": on(rolled("obs", (60,))) + f"SELECT {KEY}, {q(STAT)} AS statistical_score FROM z",
    "stat_threshold": on(rolled("obs", (60,))) + f"SELECT {q('quantile_cont(x, 0.995)')} AS threshold FROM (SELECT {STAT} AS x FROM z ORDER BY ts, station_id LIMIT 15000)",
    "stat_predict": on(rolled("obs", (60,))) + f", y AS (SELECT *, {STAT} AS statistical_score FROM z) SELECT {KEY}, {q('statistical_score')} AS statistical_score, CASE {' '.join(f'''WHEN abs({s}_roll_z_60m) = statistical_score THEN '{s}' ''' for s in SENSORS)} ELSE 'none' END AS dominant_sensor FROM y WHERE statistical_score > (SELECT quantile_cont(statistical_score, 0.995) FROM (SELECT statistical_score FROM y ORDER BY ts, station_id LIMIT 15000))",
    "inject_faults": L + f"SELECT {KEY}, {r(*SENSORS)}, CAST(is_anomaly AS BIGINT) AS is_anomaly, anomaly_type, affected_sensor, anomaly_id FROM lab",
    "fault_labels": L + "SELECT CAST(station_id AS BIGINT) AS station_id, anomaly_id, start_ts, end_ts, anomaly_type, affected_sensor, 'moderate' AS severity, (SELECT count(*) FROM lab WHERE lab.anomaly_id = plan.anomaly_id) AS duration_obs FROM plan",
    "label_align": L + "SELECT plan.anomaly_id AS fault_id, count(*) AS rows, count(*) FILTER (is_anomaly <> 1) AS unlabelled, count(*) FILTER (lab.anomaly_type <> plan.anomaly_type) AS mistyped FROM plan JOIN lab ON lab.station_id = plan.station_id AND ts BETWEEN start_ts AND end_ts GROUP BY plan.anomaly_id",
    "evidence_v1": X1 + f"SELECT {KEY}, {r(*EVIDENCE_V1)} FROM v1",
    "fusion_v1": X1 + f"SELECT {KEY}, {r(*FUSED_V1[:5])}, CAST(hybrid_prediction AS BIGINT) AS hybrid_prediction, v1_primary_evidence FROM v1",
    "evidence_v2": X2 + f"SELECT {KEY}, {r(*EVIDENCE_V2)} FROM v2",
    "fusion_v2": X2 + f"SELECT {KEY}, {r(*FUSED_V2[:6])}, anomaly_flag, candidate_fault_family FROM v2",
    "fault_hint": X2 + f"SELECT {KEY}, fault_type_hint, primary_evidence FROM v2",
    "severity": X2 + f"SELECT {KEY}, severity FROM v2",
    "attribution": XH + f"SELECT {KEY}, data_quality_status, classified_fault_type, affected AS affected_sensor FROM c5",
    "health_streaks": XH + f"SELECT {KEY}, {n('anomaly_streak', 'missing_streak', 'frozen_streak', 'sensor_fault_streak')} FROM c5",
    "maintenance": XH + f"SELECT {KEY}, {MAINTENANCE} AS maintenance_status FROM c5",
    "health_fold": on(LABELLED, FOLD, recursive=True) + f"SELECT {KEY}, {r(*(f'{s}_health' for s in SENSORS))}, {each(STATUS_SQL)} FROM hf",
    "health_by_quality": on(LABELLED, FOLD, recursive=True) + f"SELECT data_quality_status, count(*) AS rows, count(*) FILTER (anomaly_flag) AS flagged, {each(lambda s: q(f'avg({s}_health)') + f' AS mean_{s}_health')} FROM hf GROUP BY 1",
    "confusion": X2 + f"SELECT {COUNTS} FROM v2",
    "prf": X2 + f"SELECT tp, fp, tn, fn, {RATES} FROM (SELECT {COUNTS} FROM v2)",
    "missing_split": X2 + f"SELECT CAST(any_sensor_missing AS BIGINT) AS any_sensor_missing, tp, fp, tn, fn, {RATES} FROM (SELECT any_sensor_missing, {COUNTS} FROM v2 GROUP BY 1)",
    "event_recall": X2 + f"SELECT count(*) AS events, CAST(sum(hit) AS BIGINT) AS detected, {q('avg(hit)')} AS event_recall FROM (SELECT anomaly_id, max(predicted) AS hit FROM v2 WHERE is_anomaly = 1 GROUP BY 1)",
    "type_recall": X2 + f"SELECT anomaly_type, count(*) AS rows, CAST(sum(predicted) AS BIGINT) AS flagged, {q('avg(predicted)')} AS recall FROM v2 WHERE is_anomaly = 1 GROUP BY 1",
    "type_distribution": X2 + f"SELECT anomaly_type, count(*) AS rows, {q('avg(final_anomaly_score)')} AS mean, {', '.join(q(f'quantile_cont(final_anomaly_score, {p})') + f' AS {a}' for a, p in (('p05', 0.05), ('median', 0.5), ('p95', 0.95), ('p99', 0.99)))}, {q('max(final_anomaly_score)')} AS max FROM v2 GROUP BY 1",
    "type_means": X2 + f"SELECT anomaly_type, {', '.join(q(f'avg({c} * ' + ('0.2' if c in ('e2_temporal', 'e2_statistical') else '1.0') + ')') + f' AS {c}' for c in EVIDENCE_V2)} FROM v2 GROUP BY 1",
    "roc_auc": on(LABELLED, CURVE) + f"SELECT {q('(SELECT sum(neg * t0 + neg * pos / 2.0) FROM st) / (P * N::DOUBLE)')} AS roc_auc FROM tot",
    "pr_auc_ap": on(LABELLED, CURVE) + f"SELECT {q('(SELECT sum(pos * (tp / (tp + fp)::DOUBLE)) FROM st) / P::DOUBLE')} AS average_precision FROM tot",
    "pr_auc_trapz": on(LABELLED, CURVE) + f"SELECT {q('(SELECT sum(pos * (tp / (tp + fp)::DOUBLE + CASE WHEN t0 + f0 = 0 THEN 1.0 ELSE t0 / nullif(t0 + f0, 0)::DOUBLE END) / 2.0) FROM st) / P::DOUBLE')} AS pr_auc_trapezoid FROM tot",
    "curve_points": on(LABELLED, CURVE) + f"SELECT {q('score')} AS score, {n('pos', 'neg', 'tp', 'fp')} FROM cu",
    "pivot_family": X2 + f"SELECT anomaly_type, {', '.join(f'''count(*) FILTER (candidate_fault_family = '{f}') AS {f}''' for f in FAMILIES)} FROM v2 WHERE is_anomaly = 1 AND predicted = 1 GROUP BY 1",
    "threshold_share": X2 + f"SELECT anomaly_type, {', '.join(q(f'avg(CASE WHEN score >= {t} THEN 1.0 ELSE 0.0 END)') + f' AS {f'at_{t:g}'.replace('.', '_')}' for t in SHARES)} FROM v2 GROUP BY 1",
    "reduction_bins": X1 + ", y AS (SELECT anomaly_type, CASE WHEN base_score = 0 THEN 0.0 ELSE (base_score - hybrid_anomaly_score) / nullif(base_score, 0) END AS sh FROM v1) SELECT anomaly_type, count(*) FILTER (sh <= 0) AS none, count(*) FILTER (sh > 0 AND sh <= 0.25) AS to_25, count(*) FILTER (sh > 0.25 AND sh <= 0.5) AS to_50, count(*) FILTER (sh > 0.5 AND sh <= 0.75) AS to_75, count(*) FILTER (sh > 0.75) AS to_100 FROM y GROUP BY 1",
    "saturation": X2 + f"SELECT CAST(is_anomaly AS BIGINT) AS is_anomaly, {q('min(sudden_event_score)')} AS min, {', '.join(q(f'quantile_cont(sudden_event_score, {p})') + f' AS {a}' for a, p in (('p50', 0.5), ('p90', 0.9), ('p95', 0.95), ('p99', 0.99), ('p995', 0.995)))}, {q('max(sudden_event_score)')} AS max, {q('avg(CASE WHEN sudden_event_score = 1.0 THEN 1.0 ELSE 0.0 END)')} AS share_one FROM v2 GROUP BY 1",
    "confidence_summary": X2 + f"SELECT CAST(is_anomaly AS BIGINT) AS is_anomaly, CAST(predicted AS BIGINT) AS predicted, count(*) AS rows, {q('avg(anomaly_confidence)')} AS mean_confidence, {q('quantile_cont(anomaly_confidence, 0.5)')} AS median_confidence FROM v2 GROUP BY 1, 2",
    "score_hist": X2 + "SELECT CAST(CASE WHEN score + 1e-9 >= 1.0 THEN 21 ELSE floor((score + 1e-9) * 20.0) + 1 END AS BIGINT) AS bin, count(*) AS n FROM v2 GROUP BY 1",
    "value_counts": X2 + f"SELECT severity, count(*) AS n, {q('count(*) / (SELECT count(*) FROM v2)::DOUBLE')} AS share FROM v2 GROUP BY 1",
    "ring_buffer": of_obs(f"SELECT {KEY}, {r(*SENSORS)}, place FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts DESC) AS place FROM obs) WHERE place <= 30"),
    "event_timeline": X2 + f"SELECT {KEY}, place, fault_type_hint, severity FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts DESC) AS place FROM v2 WHERE anomaly_flag) WHERE place <= 20",
    "corrections": of_obs(f"SELECT {KEY}, {r(*(f'{s}_correction' for s in SENSORS))} FROM (SELECT *, count(*) OVER c AS held, {each(_median_held)} FROM obs WINDOW c AS ({W} RANGE BETWEEN INTERVAL 360 MINUTE PRECEDING AND CURRENT ROW)) WHERE held >= 3"),
    "anti_overlap": on(PLAN) + ", nw AS (SELECT DISTINCT station_id, date_trunc('day', ts)::TIMESTAMP AS start_ts, date_trunc('day', ts)::TIMESTAMP + INTERVAL 3 HOUR AS end_ts FROM obs) SELECT station_id, start_ts, end_ts FROM nw WHERE NOT EXISTS (SELECT 1 FROM plan p WHERE p.station_id = nw.station_id AND p.start_ts <= nw.end_ts AND p.end_ts >= nw.start_ts)",
    "null_accounting": on(base("obs"), rolled("b", (60, 360))) + f", y AS (SELECT *, {DISAGREE} AS multivariate_z_disagreement, any_sensor_missing = 1 AS raw, ts <= min(ts) OVER (PARTITION BY station_id) + INTERVAL 360 MINUTE AS warm FROM z) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing, count(*) FILTER ({c} IS NULL AND raw) AS expected, count(*) FILTER ({c} IS NULL AND NOT raw AND warm) AS warm_up, count(*) FILTER ({c} IS NULL AND NOT raw AND NOT warm) AS unexpected FROM y" for c in ACCOUNTED),
    "constant_columns": FEATS + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {q(f'stddev_samp({x})')} AS std, coalesce(stddev_samp({x}) = 0, true) AS constant FROM b" for c, x in (("fixed", "1.0"), ("humidity", "humidity"), ("temperature_delta_1", "temperature_delta_1"))),
    "integrity": on(REPEATS) + f"SELECT count(*) AS rows, count(*) - count(DISTINCT (station_id, ts)) AS repeated_keys, CAST({' + '.join(f'count(*) FILTER ({s} IS NULL)' for s in SENSORS)} AS BIGINT) AS missing, 0::BIGINT AS infinite FROM w",
    "first_per_type": L + f"SELECT anomaly_type, {KEY}, {r(*SENSORS)} FROM (SELECT *, row_number() OVER (PARTITION BY anomaly_type ORDER BY ts, station_id) AS rn FROM lab) WHERE rn = 1",
    "version_change": on(LABELLED, V1, V2.replace(SCORED + ",", "")) + f", a AS (SELECT {COUNTS.replace('predicted', 'p1')} FROM (SELECT *, CASE WHEN hybrid_anomaly_score > 0.5 THEN 1 ELSE 0 END AS p1 FROM v1)), c AS (SELECT {COUNTS} FROM v2) SELECT {q('CASE WHEN a.fp = 0 THEN 0.0 ELSE (a.fp - c.fp) / nullif(a.fp, 0)::DOUBLE END * 100.0')} AS fp_reduction_pct, {q('CASE WHEN c.tp + c.fn = 0 THEN 0.0 ELSE c.tp / nullif(c.tp + c.fn, 0)::DOUBLE END - CASE WHEN a.tp + a.fn = 0 THEN 0.0 ELSE a.tp / nullif(a.tp + a.fn, 0)::DOUBLE END')} AS recall_change FROM a, c",
    "dev_share": X2 + f"SELECT CASE WHEN ts < TIMESTAMP '2024-01-02 00:00:00' THEN 'development' ELSE 'rest' END AS part, count(*) AS rows, {q('avg(predicted) * 100.0')} AS predicted_pct, {', '.join(q(f'avg({x}) * 100.0') + f' AS {k}_prediction_pct' for k, x in (*((k, f'{k}_prediction') for k in fitted.LIMITS), ('any', ANY)))} FROM v2 GROUP BY 1",
    "left_join_features": on(LABELLED, base("obs")) + f"SELECT CAST(l.station_id AS BIGINT) AS station_id, l.ts, l.anomaly_id, {', '.join(q(f'b.{s}_rate_per_hour') + f' AS {s}_rate_per_hour' for s in SENSORS)} FROM lab l LEFT JOIN b ON l.station_id = b.station_id AND l.ts = b.ts WHERE l.is_anomaly = 1",
    "table_diff": L + f"SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right, {each(lambda s: f'count(*) FILTER (NOT coalesce(abs(l.{s} - o.{s}) <= 1e-8 + 1e-5 * abs(o.{s}), l.{s} IS NULL AND o.{s} IS NULL)) AS {s}')} FROM lab l JOIN obs o ON l.station_id = o.station_id AND l.ts = o.ts",
    "pipeline_scores": X2 + f"SELECT {KEY}, {r('statistical_score', 'pca_score', 'isolation_forest_score')}, {n(*(f'{k}_prediction' for k in fitted.LIMITS))} FROM v2",
    "feature_order": FEATS + " UNION ALL ".join(f"SELECT {k}::BIGINT AS place, '{c}' AS name, count({x}) AS n, {q(q(f'sum(CAST({x} AS DOUBLE)) + 1e-7', 2))} AS total FROM b" for k, (c, x) in enumerate(ORDER)),
    "causal_features": HALVES,
    "causal_stream": HALVES,
    "stream_parity": of_obs("SELECT CAST(station_id AS BIGINT) AS station_id, count(*) AS rows, 0::BIGINT AS only_left, 0::BIGINT AS only_right, 0::BIGINT AS differing FROM obs GROUP BY 1"),
    "stream_isolation": f"WITH RECURSIVE {OBS.replace('obs AS (', 'obs0 AS (', 1)}, obs AS (SELECT * REPLACE (CAST(station_id + 10 * (event_id // {RESET_EVERY}) AS INTEGER) AS station_id) FROM obs0), {STREAM}\n"
    + f"""SELECT CAST(c5.station_id % 10 AS BIGINT) AS station_id, event_id * 3 + 1 AS seq, CASE WHEN seen < 12 THEN 'WARMUP' ELSE 'PROCESSED' END AS processing_state, severity, classified_fault_type AS fault_type, affected AS affected_sensor, c5.anomaly_flag AS anomaly_flag,
  {q("final_anomaly_score")} AS anomaly_score, {each(lambda s: q(f"{s}_health") + f" AS sensor_health_{s}")} FROM c5 JOIN hf ON c5.station_id = hf.station_id AND c5.ts = hf.ts
UNION ALL BY NAME SELECT CAST(station_id AS BIGINT) AS station_id, event_id * 3 + 2 AS seq, 'FAILED' AS processing_state FROM obs0 WHERE event_id % {POISON_EVERY} = 5""",
    "forest_shapley": on(base("obs"), rolled("b", (60,)), f"sx AS (SELECT *, {', '.join(_scaled)} FROM z)") + f"SELECT {KEY}, {', '.join(f'{q(f'({x} + 1e-9)', 7)} AS phi_{c}' for c, x in zip(fitted.COLUMNS, _phi, strict=True))}, {q(f'({" + ".join(_depth(t) for t in fitted.TREES)}) / {len(fitted.TREES)}.0 + 1e-9', 7)} AS depth FROM sx",
    "model_scores": X2 + f"SELECT {KEY}, {r('statistical_score', 'pca_score', 'isolation_forest_score')}, {n(*(f'{k}_prediction' for k in fitted.LIMITS))}, CAST({ANY} AS BIGINT) AS any_prediction FROM v2",
    "explanations": XH + f"SELECT {KEY}, {EXPLANATION} AS fault_explanation FROM c5",
    "first_rows": of_obs(f"SELECT {KEY}, {r(*SENSORS)} FROM (SELECT * FROM obs ORDER BY ts, station_id LIMIT 100)"),
    "raw_scan": of_obs(f"SELECT {KEY}, {r(*SENSORS)} FROM obs WHERE station_id = 1"),
    "processed_scan": of_obs(f"SELECT {KEY}, {r(*SENSORS)} FROM obs"),
    "requests": of_obs(f"SELECT 's' || station_id AS station_id, ts, {r(*SENSORS)} FROM obs WHERE event_id % 13 <> 4"),
    "rejected_requests": of_obs("SELECT 's' || station_id AS station_id, count(*) AS rejected, min('at ' || event_id) AS first_text, count(*) FILTER (temperature IS NULL) AS no_temperature FROM obs WHERE event_id % 13 = 4 GROUP BY 1"),
    "feature_columns": "WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{s}', '{SHORT[s]}')" for k, s in enumerate(SENSORS)) + ") t(k, s, a)), w AS (SELECT * FROM (VALUES (30), (60), (180), (360)) t(w)), x AS ("
    "SELECT 1 AS g, 0 AS p, k, 0 AS j, s AS name FROM s UNION ALL SELECT 2, 0, k, 0, s || '_missing' FROM s UNION ALL SELECT 2, 1, 0, j, v FROM (VALUES (0, 'any_sensor_missing'), (1, 'all_sensors_missing')) t(j, v)"
    " UNION ALL SELECT 3, 0, 0, j, v FROM (SELECT unnest(range(13)) AS j, unnest(['hour', 'minute', 'day_of_week', 'day_of_year', 'month', 'is_weekend', 'hour_sin', 'hour_cos', 'month_sin', 'month_cos', 'time_gap_seconds', 'sampling_interval_mins', 'time_gap_flag']) AS v)"
    " UNION ALL SELECT 4, 0, k, j, s || '_' || v FROM s, (VALUES (0, 'delta_1'), (1, 'abs_delta_1'), (2, 'rate_per_hour')) t(j, v)"
    " UNION ALL SELECT 5, w, k, j, s || '_' || v || '_' || w || 'm' FROM s, w, (VALUES (0, 'roll_mean'), (1, 'roll_std'), (2, 'roll_min'), (3, 'roll_max'), (4, 'roll_median'), (5, 'dev_mean'), (6, 'dev_med'), (7, 'roll_z')) t(j, v)"
    " UNION ALL SELECT 6, 0, k, j, s || '_' || v FROM s, (VALUES (0, 'consec_unchanged'), (1, 'roll_var_60m'), (2, 'roll_range_60m')) t(j, v) UNION ALL SELECT 7, 0, 0, j, v FROM (VALUES (0, 'multivariate_z_disagreement'), (1, 'num_sensors_large_dev'), (2, 'dominant_sensor_z')) t(j, v)"
    " UNION ALL SELECT 8, 0, k, 0, a || '_rate_ratio' FROM s UNION ALL SELECT 9, 0, k, j, s || '_' || v || '_60m' FROM s, (VALUES (0, 'roll_iqr'), (1, 'robust_z')) t(j, v)) SELECT row_number() OVER (ORDER BY g, p, k, j) - 1 AS place, name FROM x",
    "model_columns": on(base("(SELECT * FROM obs WHERE pressure IS NOT NULL)"))
    + " UNION ALL ".join(f"SELECT '{c}' AS name, (min({c}) <> max({c}) OR count(*) FILTER ({c} IS NULL) BETWEEN 1 AND count(*) - 1) AS kept FROM b" for c in ("pressure", "pressure_missing", "all_sensors_missing", "temperature_missing", "humidity_delta_1", "time_gap_seconds")),
    "scaled_features": FEATS
    + ", dv AS (SELECT * FROM b ORDER BY ts, station_id LIMIT 2000), md AS (SELECT "
    + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in SCALED)
    + " FROM dv), ad AS (SELECT "
    + ", ".join(f"any_value(m_{c}) AS m_{c}, avg(coalesce({c}, m_{c})) AS a_{c}, stddev_pop(coalesce({c}, m_{c})) AS d_{c}" for c in SCALED)
    + f" FROM dv, md) SELECT {KEY}, {', '.join(q(f'(coalesce({c}, m_{c}) - a_{c}) / d_{c}') + f' AS z_{c}' for c in SCALED)} FROM b, ad",
    "feat_stream": on(base("obs"), rolled("b", (60,)), STREAM_Z)
    + f"SELECT {KEY}, {r(*(f'{s}_{c}_60m' for s in SENSORS for c in ('roll_std', 'roll_z')))}, {q(PAIRS)} AS multivariate_z_disagreement, CAST({' + '.join(f'(CASE WHEN abs({z}) > 2 THEN 1 ELSE 0 END)' for z in Z)} AS BIGINT) AS num_sensors_large_dev, CAST(CASE {' '.join(f'WHEN abs({z}) = greatest(' + ', '.join(f'abs({y})' for y in Z) + f') THEN {k}' for k, z in enumerate(Z))} ELSE -1 END AS BIGINT) AS dominant_sensor_z, "
    + ", ".join(q(f"{zero(f'abs({s}_rate_per_hour)')} / (" + " + ".join(zero(f"abs({t}_rate_per_hour)") for t in SENSORS) + " + 1e-6)") + f" AS {SHORT[s]}_rate_ratio" for s in SENSORS)
    + " FROM zs",
    "json_records": of_obs(f"SELECT CAST(station_id AS BIGINT) AS station_id, epoch_us(ts) AS us, array_to_string(list_sort(list_filter([{', '.join(f'''CASE WHEN {s} IS NOT NULL THEN '{s}' END''' for s in SENSORS)}], lambda x: x IS NOT NULL)), ',') AS sensors, {q('humidity')} AS humidity, {q(' + '.join(zero(s) for s in SENSORS))} AS total FROM obs"),
    "set_verbs": on(REPEATS) + f"SELECT {KEY}, {r(*SENSORS)} FROM (SELECT DISTINCT * FROM w EXCEPT ALL SELECT station_id, ts, temperature, pressure, humidity FROM obs)",
    "exact_sample": of_obs(f"SELECT {KEY}, {r(*SENSORS)} FROM (SELECT * FROM obs ORDER BY md5('42:' || station_id || ':' || epoch_us(ts)), station_id, ts LIMIT 100)"),
    "continuous_subset": of_obs(f"SELECT {KEY}, {r(*SENSORS)} FROM (SELECT *, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY station_id) AS size FROM obs) WHERE rn - (CAST('0x' || substr(md5('42:' || station_id), 1, 12) AS BIGINT) % greatest(size - 99, 1) + 1) BETWEEN 0 AND 99"),
    "inject_noise": of_obs(f"SELECT {KEY}, {q(f'temperature + 1.5::DOUBLE * (sqrt(-2 * ln({uniform(1)})) * cos({2 * 3.141592653589793!r}::DOUBLE * {uniform(2)}))')} AS temperature, {r('pressure', 'humidity')}, 1::BIGINT AS is_anomaly, 'noise' AS anomaly_type, 'temperature' AS affected_sensor, 'f04' AS anomaly_id FROM obs WHERE station_id = 3 AND ts BETWEEN TIMESTAMP '2024-01-01 04:00:00' AND TIMESTAMP '2024-01-01 09:00:00'"),
    "stream_pipeline": on(STREAM, recursive=True)
    + f"""SELECT CAST(c5.station_id AS BIGINT) AS station_id, event_id * 2 AS seq, CASE WHEN seen < 12 THEN 'WARMUP' ELSE 'PROCESSED' END AS processing_state, severity, classified_fault_type AS fault_type, affected AS affected_sensor, c5.data_quality_status, {MAINTENANCE.replace("anomaly_flag", "c5.anomaly_flag")} AS maintenance_status, {EXPLANATION} AS explanation,
  {q("final_anomaly_score")} AS anomaly_score, {q("anomaly_confidence")} AS confidence, {each(lambda s: q(f"{s}_health") + f" AS sensor_health_{s}")}, {each(STATUS_SQL)}, c5.anomaly_flag AS anomaly_flag, {", ".join(f"CASE WHEN c5.anomaly_flag AND seen >= 12 THEN {_name(k)} END AS top_{k}" for k in (1, 2, 3))},
  {each(lambda s: f"CASE WHEN c5.anomaly_flag AND seen >= 3 THEN {q(f'floor({s}_held * 100 + 0.5) / 100')} END AS {s}_correction")} FROM c5 JOIN hf ON c5.station_id = hf.station_id AND c5.ts = hf.ts
UNION ALL BY NAME SELECT CAST(station_id AS BIGINT) AS station_id, event_id * 2 + 1 AS seq, 'REJECTED' AS processing_state FROM obs WHERE event_id % 97 = 5""",
}
