"""The online path: observations as they arrive, with durable typed state per station.

State is a row of counters and health (``station``) and a list of up to 360 minutes of readings (``history``), kept by RocksDB: a
micro-batch appends its readings to the list, and rewrites it only when over half of it is out of date. With ``silent_ms`` a station that
sent nothing for so long is forgotten. A station's records are taken in ingest order; a time that is not later than the last
accepted one is rejected and changes nothing.

What a record alone decides (those of the 147 features that are read, under the stream rules, the scores of the three fitted detectors, evidence,
fusion) is computed for all records of a station's micro-batch at once, as are streaks; only health is summed record by record. A
record that cannot be processed fails alone: the station goes back to where it was before, the record comes out as FAILED with its error, and
those around it are taken as if it had not been sent. A flagged record is explained by the features with the largest Shapley
values of its path length in the forest.
"""

from __future__ import annotations

import copy
import itertools
import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from driftwarden.operators.fusion import AGREEMENT, BONUS, COHERENT, COMMUNICATION, DRIFT_LEAST, LOST, LOST_LEAST, MODEL_CAP, PERSISTENT, SCALES_V2, SEVERITY, SUDDEN, SUPPRESSION, Z_CAP
from driftwarden.operators.health import CHECK_CONNECTION, DOMINANT, GAP_US, GROWTH, IMPLICATED, MOST_GROWTH, PENALTY, RATE_SCALE, RECOVERY, STATUS, TEXTS, Z_SCALE
from driftwarden.operators.timeline import frame_statistics
from driftwarden.plans.batch import Artifacts
from driftwarden.plans.fitted import stored
from driftwarden.schema import FEATURES, MINUTE_US, MULTIVARIATE, RATIO, SENSORS, TIME, WINDOWS_MIN
from driftwarden.session import scratch_path, ship
from driftwarden.sources.tables import micros, observations
from driftwarden.streaming.records import read_json, record_stream, write_json

HISTORY_US = 360 * MINUTE_US
WARM_UP = 12
#: The last microsecond, either way from 1970, of a clock that counts nanoseconds in 64 bits.
LAST_US = np.iinfo(np.int64).max // 1000
RESULT = T.StructType(
    [
        *(T.StructField(n, k) for n, k in (("station_id", T.IntegerType()), ("seq", T.LongType()), ("us", T.LongType()))),
        *(T.StructField(s, T.DoubleType()) for s in SENSORS),
        *(T.StructField(n, T.StringType()) for n in ("processing_state", "severity", "fault_type", "affected_sensor", "data_quality_status", "maintenance_status", "explanation")),
        *(T.StructField(n, T.DoubleType()) for n in ("anomaly_score", "confidence", *(f"sensor_health_{s}" for s in SENSORS))),
        *(T.StructField(f"{s}_status", T.StringType()) for s in SENSORS),
        T.StructField("anomaly_flag", T.BooleanType()),
        T.StructField("top_features", T.StringType()),
        T.StructField("suggested_corrections", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
#: Columns of texts and flags, which may be missing altogether in a micro-batch.
AS_OBJECTS = {f.name: object for f in RESULT if isinstance(f.dataType, T.StringType | T.BooleanType)}
STREAKS = ("anomaly", "missing", "frozen", *SENSORS)
#: Of the typed state: counters and health, with how many readings the list holds; a reading.
STATION = T.StructType([T.StructField("listed", T.LongType()), T.StructField("last_us", T.LongType()), *(T.StructField(f"unchanged_{s}", T.LongType()) for s in SENSORS), *(T.StructField(f"health_{s}", T.DoubleType()) for s in SENSORS), *(T.StructField(f"streak_{k}", T.LongType()) for k in STREAKS)])
READING = T.StructType([T.StructField("us", T.LongType()), *(T.StructField(s, T.DoubleType()) for s in SENSORS)])
#: On local disks the usual manager of checkpoints starts a process to set the mode of each file, several in every micro-batch.
FILE_MANAGER = "spark.sql.streaming.checkpointFileManagerClass"
BY_FILE_SYSTEM = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: The statistics of a frame that its features are made of.
MADE_OF = {"roll_mean": ("mean",), "roll_std": ("std",), "roll_min": (0,), "roll_max": (1,), "roll_median": (0.5,), "dev_mean": ("mean",), "dev_med": (0.5,), "roll_z": ("mean", "std"), "roll_var": ("var",), "roll_range": (0, 1), "roll_iqr": (0.25, 0.75), "robust_z": (0.5, 0.25, 0.75)}


def features_of(us: np.ndarray, values: np.ndarray, held: int, unchanged: dict[str, int], columns: Iterable[str] = FEATURES) -> pd.DataFrame:
    """The features ``columns`` of the rows from ``held`` on, under the stream rules; those before are history.

    ``unchanged`` has the run counters of the last history row. Frames give only what ``columns`` are made of, by the batch plan's own sums.
    """
    columns = list(columns)
    wanted = {*columns, *(f"{s}_roll_z_60m" for s in SENSORS if not {*MULTIVARIATE}.isdisjoint(columns))}
    new = np.arange(held, len(us))
    out: dict[str, np.ndarray] = {s: values[held:, k] for k, s in enumerate(SENSORS)}
    for s in SENSORS:
        out[f"{s}_missing"] = np.isnan(out[s]) * 1.0
    gone = np.stack([out[f"{s}_missing"] for s in SENSORS])
    gap = np.where(new > 0, (us[new] - us[np.maximum(new - 1, 0)]) / 1e6, 600.0)
    minutes = gap / 60.0
    out |= {"any_sensor_missing": gone.max(axis=0), "all_sensors_missing": gone.min(axis=0), "time_gap_seconds": gap, "sampling_interval_mins": minutes, "time_gap_flag": (minutes > 15.0) * 1.0}
    if not wanted.isdisjoint({*TIME} - {*out}):
        at = pd.to_datetime(us[held:], unit="us")
        turn = lambda f, x, n: f(2 * math.pi * x / n)
        hour, month, day = at.hour.to_numpy(), at.month.to_numpy(), at.dayofweek.to_numpy()
        out |= {"hour": hour, "minute": at.minute.to_numpy(), "day_of_week": day, "day_of_year": at.dayofyear.to_numpy(), "month": month, "is_weekend": (day >= 5) * 1.0}
        out |= {"hour_sin": turn(np.sin, hour, 24), "hour_cos": turn(np.cos, hour, 24), "month_sin": turn(np.sin, month - 1, 12), "month_cos": turn(np.cos, month - 1, 12)}
    for k, s in enumerate(SENSORS):
        delta = np.where(new > 0, out[s] - values[np.maximum(new - 1, 0), k], np.nan)
        near = np.abs(delta) < 1e-4
        place = np.arange(1, len(new) + 1)
        last = np.maximum.accumulate(np.where(near, 0, place))
        out |= {f"{s}_delta_1": delta, f"{s}_abs_delta_1": np.abs(delta), f"{s}_rate_per_hour": delta / np.maximum(minutes, 1.0) * 60.0, f"{s}_consec_unchanged": np.where(last == 0, place + unchanged[s], place - last) * near}
    end = np.arange(len(us))
    for w in WINDOWS_MIN:
        start = np.searchsorted(us, us - w * MINUTE_US, "left")
        for k, s in enumerate(SENSORS):
            names = [n for n in MADE_OF if f"{s}_{n}_{w}m" in wanted]
            if names:
                found = frame_statistics(values[:, k], start, end, held, {q: q for n in names for q in MADE_OF[n]})
                out |= {f"{s}_{n}_{w}m": made(n, out[s], found) for n in names}
    if not {*MULTIVARIATE}.isdisjoint(wanted):
        z = np.stack([out[f"{s}_roll_z_60m"] for s in SENSORS])
        size = np.abs(z)
        top = np.fmax.reduce(size)
        out["multivariate_z_disagreement"] = np.fmax.reduce([np.abs(z[i] - z[j]) for i in range(3) for j in range(i + 1, 3)])
        out |= {"num_sensors_large_dev": (size > 2).sum(axis=0), "dominant_sensor_z": np.where(np.isnan(top), -1, (size == top).argmax(axis=0))}
    rates = [np.nan_to_num(np.abs(out[f"{s}_rate_per_hour"])) for s in SENSORS]
    out |= {name: r / (rates[0] + rates[1] + rates[2] + 1e-6) for name, r in zip(RATIO, rates, strict=True)}
    return pd.DataFrame({c: np.asarray(out[c], np.float64) for c in columns})


def made(name: str, x: np.ndarray, of: dict[float | str, np.ndarray]) -> np.ndarray:
    """A feature of the values ``x`` and their frames' statistics."""
    match name:
        case "roll_std":
            return np.maximum(of["std"], 1e-6)
        case "dev_mean":
            return x - of["mean"]
        case "dev_med":
            return x - of[0.5]
        case "roll_z":
            return (x - of["mean"]) / np.maximum(of["std"], 1e-6)
        case "roll_range":
            return of[1] - of[0]
        case "roll_iqr":
            return of[0.75] - of[0.25]
        case "robust_z":
            return (x - of[0.5]) / np.maximum(of[0.75] - of[0.25], 1e-6)
    return of[MADE_OF[name][0]]


#: What evidence and health read of the features, beside what the models do.
EVIDENCE = (*(f"{s}_{c}" for s in SENSORS for c in ("rate_per_hour", "consec_unchanged", "roll_z_60m", "roll_mean_60m", "roll_mean_360m")), "multivariate_z_disagreement", "any_sensor_missing", "all_sensors_missing")


def columns_of(a: Artifacts) -> list[str]:
    """The features that a record needs."""
    return list(dict.fromkeys([*EVIDENCE, *a.components.scaler.columns, *a.forest.scaler.columns]))


def largest(f: pd.DataFrame, suffix: str) -> np.ndarray:
    return np.nan_to_num(np.fmax.reduce([np.abs(f[f"{s}_{suffix}"].to_numpy()) for s in SENSORS]))


def fuse(f: pd.DataFrame, a: Artifacts) -> dict[str, np.ndarray]:
    """Score, flag, hint, confidence and severity of every row of features, and the rows as the forest sees them."""
    x = a.forest.scaler.matrix(f[a.forest.scaler.columns].to_numpy())
    own = x if a.components.scaler == a.forest.scaler else a.components.scaler.matrix(f[a.components.scaler.columns].to_numpy())
    scores = {"statistical_score": largest(f, "roll_z_60m"), "pca_score": a.components.errors(own), "isolation_forest_score": a.forest.isolation(x)}
    bounded = lambda v, k: 1 - np.exp(-v / SCALES_V2[k])
    apart = np.nan_to_num(np.fmax.reduce([np.abs(f[f"{s}_roll_mean_60m"].to_numpy() - f[f"{s}_roll_mean_360m"].to_numpy()) for s in SENSORS]))
    split = np.nan_to_num(f["multivariate_z_disagreement"].to_numpy())
    tem, sta, mul = bounded(largest(f, "rate_per_hour"), "temporal"), bounded(np.minimum(scores["statistical_score"], Z_CAP), "statistical"), bounded(split, "multivariate")
    stb, drf = bounded(np.max([f[f"{s}_consec_unchanged"] for s in SENSORS], axis=0), "stability"), bounded(apart, "drift")
    mod = np.minimum(a.evidence.v2_of(scores), MODEL_CAP)
    some, every = f["any_sensor_missing"].to_numpy() == 1, f["all_sensors_missing"].to_numpy() == 1
    active = {SUDDEN: sum((e >= AGREEMENT) * 1 for e in (tem, sta, mul)), PERSISTENT: sum((e >= AGREEMENT) * 1 for e in (stb, drf))}
    factor = np.where((split < COHERENT) & ~some, SUPPRESSION, 1.0)
    com = np.select([every, some], LOST, 0.0)
    sud = np.minimum(np.max([tem, sta, mul], axis=0) + active[SUDDEN] * BONUS + mod, 1.0) * factor
    per = np.minimum(np.maximum(stb, drf) + active[PERSISTENT] * BONUS + mod, 1.0)
    score = np.max([sud, per, com], axis=0)
    winner = np.select([com == score, sud == score], [COMMUNICATION, SUDDEN], PERSISTENT)
    flag = (sud >= a.sudden_threshold) | (per >= a.persistent_threshold) | (com > LOST_LEAST)
    agree = np.minimum(np.where(winner == SUDDEN, active[SUDDEN], active[PERSISTENT]), 2) * 0.5
    hint = np.select(
        [~flag, winner == COMMUNICATION, (winner == PERSISTENT) & (stb > drf), (winner == PERSISTENT) & (drf > DRIFT_LEAST), winner == PERSISTENT, (mul > tem) & (mul > sta), tem > sta],
        ["NORMAL", "MISSING", "FROZEN", "DRIFT", "UNKNOWN", "MULTIVARIATE_INCONSISTENCY", "SPIKE"],
        "OFFSET",
    )
    band = np.select([score < top for top, _ in SEVERITY], [name for _, name in SEVERITY], "CRITICAL")
    severity = np.select([~flag, (winner == COMMUNICATION) & every], ["NORMAL", "CRITICAL"], band)
    return {"score": score, "flag": flag, "hint": hint, "confidence": np.where((score == 0) | (winner == COMMUNICATION), 1.0, np.minimum(0.5 * score + 0.5 * agree, 1.0)), "severity": severity, "matrix": x}


@dataclass
class Station:
    """State of one station; ``table`` takes records and gives their results as columns, ``taken`` and ``process`` as a dict each, or None where a time is not later."""

    history: list[list] = field(default_factory=list)  # [us, temperature, pressure, humidity], the last one always
    unchanged: dict[str, int] = field(default_factory=lambda: dict.fromkeys(SENSORS, 0))
    health: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SENSORS, 100.0))
    streaks: dict[str, int] = field(default_factory=lambda: dict.fromkeys(STREAKS, 0))

    def table(self, us: np.ndarray, values: np.ndarray, a: Artifacts) -> pd.DataFrame:
        """Results of ``us`` and ``values`` (NaN: missing) in ingest order: REJECTED where a time is not later, FAILED for each record that raises an error; such a record leaves the station as it was."""
        before = copy.deepcopy(self.__dict__)
        try:
            return self._table(us, values, a)
        except Exception as e:  # whatever the record does to the arithmetic, it is the record's
            self.__dict__.update(before)
            if len(us) == 1:
                return failed(values, f"{type(e).__name__}: {e}")
        half = len(us) // 2
        return pd.concat([self.table(us[:half], values[:half], a), self.table(us[half:], values[half:], a)], ignore_index=True)

    def taken(self, us: np.ndarray, values: np.ndarray, a: Artifacts) -> list[dict | None]:
        return records(self.table(us, values, a))

    def process(self, us: np.ndarray, values: np.ndarray, a: Artifacts) -> list[dict | None]:
        """``taken``, but an error in the arithmetic is raised."""
        return records(self._table(us, values, a))

    def _table(self, us: np.ndarray, values: np.ndarray, a: Artifacts) -> pd.DataFrame:
        # A time that no clock can hold would fail: told beforehand, it does not cost the records around it a second try.
        lost = (us < -LAST_US) | (us > LAST_US)
        before = self.history[-1][0] if self.history else np.iinfo(np.int64).min
        later = us > np.maximum.accumulate(np.concatenate([[before], np.where(lost, np.iinfo(np.int64).min, us)]))[:-1]
        at = np.flatnonzero(later & ~lost)
        out = pd.DataFrame(self._accepted(us[at], values[at], a) if len(at) else {"processing_state": np.array([], object)}, index=at)
        if len(at) == len(us):
            return out
        parts = [out]
        if (later & lost).any():
            no = np.flatnonzero(later & lost)
            parts.append(failed(values[no], [f"OutOfBoundsDatetime: {t} microseconds lie beyond the years 1677 to 2262" for t in us[no].tolist()]).set_index(no))
        if not later.all():
            parts.append(pd.DataFrame({"processing_state": "REJECTED"}, index=np.flatnonzero(~later)))
        return pd.concat([x for x in parts if len(x)]).sort_index()

    def _accepted(self, us: np.ndarray, values: np.ndarray, a: Artifacts) -> dict[str, np.ndarray]:
        held = len(self.history)
        times = np.concatenate([np.array([h[0] for h in self.history], np.int64), us])
        rows = np.concatenate([np.array([h[1:] for h in self.history], np.float64).reshape(-1, len(SENSORS)), values])
        f = features_of(times, rows, held, self.unchanged, columns_of(a))
        fused = fuse(f, a)
        begin = np.searchsorted(times, times[held:] - HISTORY_US, side="left")
        size = np.arange(held, len(times)) + 1 - begin
        warm = size < WARM_UP
        hint = np.where(warm & ~np.isin(fused["hint"], ("MISSING", "FROZEN")), "NORMAL", fused["hint"])
        flag = fused["flag"] & (hint != "NORMAL")
        top = self._explained(np.flatnonzero(flag & ~warm), fused["matrix"], a)
        gap = np.diff(times, prepend=times[:1])[held:] > GAP_US
        medians = corrections(times, rows, held) if flag.any() else {}
        evidence = np.stack([np.where(np.isnan(values[:, k]), 1.0, np.maximum(_capped(f[f"{s}_rate_per_hour"].to_numpy(), RATE_SCALE), _capped(f[f"{s}_roll_z_60m"].to_numpy(), Z_SCALE))) for k, s in enumerate(SENSORS)])
        found = {s: values[:, k] for k, s in enumerate(SENSORS)}
        found |= self._track(np.isnan(values).sum(axis=1), evidence, gap, flag, hint, fused["confidence"])
        text = np.full(len(us), None, object)
        for i in np.flatnonzero(flag & (size >= 3)).tolist():
            text[i] = "{" + ", ".join(f'"{s}": {x[i]!r}' for s, x in medians.items() if not math.isnan(x[i])) + "}"
        text[flag & (size < 3)] = "{}"
        explained = np.full(len(us), "[]", object)
        for i, parts in top.items():
            explained[i] = f"[{', '.join(parts)}]"
        found |= {
            "processing_state": np.where(warm, "WARMUP", "PROCESSED").astype(object),
            "severity": np.where(warm, "NORMAL", fused["severity"]).astype(object),
            "anomaly_score": fused["score"],
            "confidence": fused["confidence"],
            "anomaly_flag": flag,
            "top_features": explained,
            "suggested_corrections": text,
        }
        self.unchanged = {s: int(f[f"{s}_consec_unchanged"].iloc[-1]) for s in SENSORS}
        self.history = [[int(t), *(None if math.isnan(v) else v for v in r)] for t, r in zip(times[begin[-1] :], rows[begin[-1] :].tolist(), strict=True)]
        return found

    @staticmethod
    def _explained(at: np.ndarray, matrix: np.ndarray, a: Artifacts, k: int = 3) -> dict[int, list[str]]:
        """For each of the rows ``at`` the ``k`` features with the largest Shapley values, either way (below 0: easier to isolate), as JSON objects."""
        if not len(at):
            return {}
        names = [f'{{"feature": {json.dumps(c)}, "contribution": ' for c in a.forest.scaler.columns]
        values = np.round(a.forest.shapley(matrix[at]), 9)
        order = np.argsort(-np.abs(values), axis=1, kind="stable")[:, :k]
        return {i: [f"{names[c]}{round(row[c], 4)!r}}}" for c in best if row[c]] for i, row, best in zip(at.tolist(), values.tolist(), order.tolist(), strict=True)}

    def _track(self, missing: np.ndarray, evidence: np.ndarray, gap: np.ndarray, flag: np.ndarray, hint: np.ndarray, confidence: np.ndarray) -> dict[str, np.ndarray]:
        """Columns of the rows in order; only the clamped sums of health go a row at a time."""
        fault = np.where(missing > 0, "MISSING", np.where(flag, hint, "NORMAL"))
        affected = attribute(fault, missing, evidence)
        hit = {s: np.isin(affected, (s.upper(), "MULTIPLE", "ALL_SENSORS")) for s in SENSORS}
        grown = {"anomaly": flag, "missing": flag & (fault == "MISSING"), "frozen": flag & (fault == "FROZEN"), **{s: flag & hit[s] for s in SENSORS}}
        streaks = {k: counted(grown[k], gap | ~flag, self.streaks[k]) for k in STREAKS}
        penalty = np.array([PENALTY.get(x, 1.0) for x in fault.tolist()])
        out: dict[str, np.ndarray] = {}
        for k, s in enumerate(SENSORS):
            loss = penalty * evidence[k] * confidence * np.minimum(MOST_GROWTH, 1.0 + GROWTH * np.maximum(0, streaks[s] - 1))
            steps = np.where(~flag & (streaks[s] == 0), RECOVERY, np.where(hit[s], -loss, 0.0))
            health = np.array(list(itertools.accumulate(steps.tolist(), lambda h, d: max(0.0, min(100.0, h + d)), initial=self.health[s]))[1:])
            self.health[s] = float(health[-1])
            out |= {f"sensor_health_{s}": health, f"{s}_status": np.select([health >= low for low, _ in STATUS], [name for _, name in STATUS], "CRITICAL").astype(object)}
        self.streaks = {k: int(n[-1]) for k, n in streaks.items()}
        text = cache(explain)  # few mixes of fault, sensor and rounded confidence
        return out | {
            "fault_type": fault.astype(object),
            "affected_sensor": affected.astype(object),
            "data_quality_status": np.select([missing == 3, missing > 0], ["DATA_LOSS", "DEGRADED"], "GOOD").astype(object),
            "maintenance_status": recommend(flag, fault, streaks).astype(object),
            "explanation": [text(*x) for x in zip(fault.tolist(), affected.tolist(), np.floor(confidence * 100 + 0.5).tolist(), strict=True)],
        }


def failed(values: np.ndarray, error: str | list[str]) -> pd.DataFrame:
    """Results of records that cannot be processed."""
    return pd.DataFrame({"processing_state": "FAILED", "error": error, **{s: values[:, k] for k, s in enumerate(SENSORS)}}, index=range(len(values)))


def records(found: pd.DataFrame) -> list[dict | None]:
    """Rows of ``Station.table``: a dict of what a record has, None where it was rejected."""
    plain = [[None if v is None or v != v else v for v in found[c].tolist()] for c in found.columns]
    lacks = {"FAILED": {*RESULT.names} - {"processing_state", "error", *SENSORS}}
    out: list[dict | None] = []
    for row in zip(*plain, strict=True):
        one = dict(zip(found.columns, row, strict=True))
        state = one["processing_state"]
        out.append(None if state == "REJECTED" else {k: v for k, v in one.items() if k not in lacks.get(state, {"error"})})
    return out


def corrections(us: np.ndarray, values: np.ndarray, held: int) -> dict[str, list[float]]:
    """Medians of the history and the row itself for the rows from ``held`` on (NaN: no value there); two decimals, half up."""
    all_rows = pd.DataFrame(values, index=pd.to_datetime(us, unit="us"), columns=list(SENSORS))
    found = all_rows.rolling(pd.Timedelta(HISTORY_US, "us"), min_periods=1, closed="both").median().iloc[held:]
    return {s: (np.floor(found[s].to_numpy() * 100 + 0.5) / 100).tolist() for s in SENSORS}


def counted(grown: np.ndarray, reset: np.ndarray, before: int) -> np.ndarray:
    """Rows that ``grown`` marks since the last reset, which starts at its own mark; ``before`` is the count so far."""
    total, own = np.cumsum(grown), grown.astype(np.int64)
    last = np.maximum.accumulate(np.where(reset, np.arange(len(grown)), -1))
    return total - np.where(last >= 0, (total - own)[last], -before)


def _capped(x: np.ndarray, scale: float) -> np.ndarray:
    return np.where(np.isnan(x), 1.0, np.minimum(1.0, np.abs(x) / scale))


def attribute(fault: np.ndarray, missing: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """The affected sensor of every row, from the sensors' evidence (a row a sensor)."""
    held = np.where(evidence > IMPLICATED, evidence, 0.0)
    n, (_, second, first) = (held > 0).sum(axis=0), np.sort(held, axis=0)
    several = (n > 1) & ((fault == "MULTIVARIATE_INCONSISTENCY") | (first <= second * DOMINANT))
    one = np.array([s.upper() for s in SENSORS])[held.argmax(axis=0)]
    return np.select([fault == "NORMAL", (fault == "MISSING") & (missing == 3), n == 0, several], ["NONE", "ALL_SENSORS", "UNKNOWN", "MULTIPLE"], one)


def recommend(flag: np.ndarray, fault: np.ndarray, streaks: dict[str, np.ndarray]) -> np.ndarray:
    return np.select(
        [~flag, fault == "MISSING", (fault == "FROZEN") & (streaks["frozen"] > 3), fault == "DRIFT", streaks["anomaly"] > 3],
        ["NO_ACTION", CHECK_CONNECTION, "MAINTENANCE_RECOMMENDED", "INSPECT", "MONITOR / INSPECT"],
        "MONITOR",
    )


def explain(fault: str, affected: str, percent: float) -> str:
    """The text of a fault; ``percent`` is the confidence in hundredths, half up."""
    if fault in ("NORMAL", "MISSING"):
        return TEXTS[fault]
    one = affected in [s.upper() for s in SENSORS] and fault in ("SPIKE", "FROZEN", "DRIFT", "OFFSET", "NOISE")
    text = TEXTS[fault] if one or fault == "MULTIVARIATE_INCONSISTENCY" else TEXTS["other"]
    return text.replace("%1$s", affected.lower()).replace("%2$.2f", f"{percent / 100:.2f}")


@cache
def artifacts_at(path: str | None) -> Artifacts:
    """Artifacts written for the workers, read once by each; the stored set without a path."""
    return Artifacts.of(read_json(path)) if path else stored()


class Stations(StatefulProcessor):
    """Typed state of the stations: what a micro-batch's rows of one station do to it.

    ``artifacts`` is a path: Spark also makes the processor on the driver, where broadcasts are not loaded.
    """

    def __init__(self, artifacts: str | None, silent_ms: int | None):
        self.artifacts, self.silent_ms = artifacts, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.station = handle.getValueState("station", STATION, self.silent_ms)
        self.history = handle.getListState("history", READING, self.silent_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        station, listed = self.read()
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        cleared = batch["reset"].to_numpy(bool)
        last = station.history[-1][0] if station.history else None
        out: list[pd.DataFrame] = []
        # Records between two resets are processed together.
        ends = [0, *np.flatnonzero(cleared), len(batch)]
        seq, times, values = batch["seq"].to_numpy(np.int64), batch["us"].to_numpy(np.int64), batch[list(SENSORS)].to_numpy(np.float64)
        for k, (first, end) in enumerate(zip(ends, ends[1:])):
            if k:
                station, first, last, listed = Station(), first + 1, None, None
            if first < end:
                us = times[first:end]
                found = station.table(us, values[first:end], artifacts_at(self.artifacts))
                out.append(found.assign(station_id=key[0], seq=seq[first:end], us=us))
        self.write(station, last, listed)
        if out:
            yield pd.concat(out, ignore_index=True).reindex(columns=RESULT.names).astype(AS_OBJECTS)

    def read(self) -> tuple[Station, int | None]:
        """The station, and how many readings its list holds."""
        held = self.station.get()
        if held is None:
            return Station(), None
        n = len(SENSORS)
        listed, last, counters = held[0], held[1], held[2:]
        history = sorted([int(r[0]), *r[1:]] for r in self.history.get() if r[0] >= last - HISTORY_US) if listed else []
        parts = (dict(zip(names, values, strict=True)) for names, values in ((SENSORS, counters[:n]), (SENSORS, counters[n : 2 * n]), (STREAKS, counters[2 * n :])))
        return Station(history, *parts), listed

    def write(self, station: Station, last: int | None, listed: int | None) -> None:
        """Appends readings later than ``last``; the list is written anew after a reset or when it is over twice as long as needed."""
        new = [tuple(h) for h in station.history if last is None or h[0] > last]
        if listed is None or listed + len(new) > 2 * len(station.history) + 64:
            new = [tuple(h) for h in station.history]
            self.history.put(new) if new else self.history.clear()
            listed = len(new)
        elif new:
            self.history.appendList(new)
            listed += len(new)
        at = station.history[-1][0] if station.history else None
        self.station.update((listed, at, *station.unchanged.values(), *map(float, station.health.values()), *station.streaks.values()))


def process_stream(obs: DataFrame, artifacts: Artifacts | None = None, silent_ms: int | None = None) -> DataFrame:
    """Observations (station_id, seq, ts, sensors; optionally ``reset`` to clear a station) to results, in ``seq`` order.

    Rejected records come out with the processing state REJECTED, those that raise an error with FAILED and the error, and nothing else. The
    micro-batches' size bounds how many records of a station a task holds: limit it at the source. State is kept by the
    RocksDB provider, which this sets for the session.
    With ``silent_ms`` Spark goes on with empty micro-batches, as time passes: use a trigger other than ``availableNow``, which would not end.
    """
    spark = ship(obs.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a commit writes what changed
    path = f"{scratch_path(spark, 'artifacts')}.json" if artifacts else None
    if path:
        write_json(path, artifacts.plain())
    keyed = obs.select("station_id", "seq", micros().alias("us"), *SENSORS, (F.col("reset") if "reset" in obs.columns else F.lit(False)).alias("reset"))
    return keyed.groupBy("station_id").transformWithStateInPandas(Stations(path, silent_ms), RESULT, "Append", "ProcessingTime" if silent_ms else "None")


DEAD_LETTER = ("station_id", "seq", "us", *SENSORS, "error")


def sink(results: DataFrame, root: str, state_partitions: int | None = None, **options) -> StreamingQuery:
    """Starts the stream: a micro-batch writes its results to ``root``/out under its number, once however often it is repeated.

    Dead letters lie among them (``results_of`` and ``dead_letters`` tell them apart), so that a micro-batch is computed and written in one job.
    Every micro-batch opens and commits all partitions of the state, also those without a station in it: by default there are as many as cores,
    or as shuffle partitions if those are fewer. A checkpoint keeps the number that it began with.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    spark = results.sparkSession
    settings = {"spark.sql.shuffle.partitions": str(state_partitions or min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))}
    if root.startswith("file:") and spark.conf.get(FILE_MANAGER, None) is None:
        settings[FILE_MANAGER] = BY_FILE_SYSTEM
    before = {name: spark.conf.get(name, None) for name in settings}
    try:  # the query copies the session's settings as it starts
        for name, value in settings.items():
            spark.conf.set(name, value)
        return results.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").outputMode("append").trigger(**(options or {"availableNow": True})).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_available(spark: SparkSession, path: str, schema: T.StructType, prepare=observations, artifacts: Artifacts | None = None, files_per_trigger: int = 16) -> DataFrame:
    """Everything under ``path`` through the stream, a few files at a time; the results are a table in the shared folder.

    ``prepare`` makes observations, with ``event_id`` or ``seq`` for their order, of the source's rows.
    """
    folder, name = path.rsplit("/", 1)
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    root = scratch_path(spark, "stream")
    sink(process_stream(with_seq(prepare(source)), artifacts), root).awaitTermination()
    return results_of(spark, root)


def spread(spark: SparkSession, stations: Iterable[int]) -> int:
    """As few partitions of the state, up to the cores, as hold known ``stations`` with the fewest in the fullest one: a micro-batch waits for that."""
    keys = spark.createDataFrame(pa.table({"station_id": pa.array(stations, pa.int32())}))
    hashes = np.array([r[0] for r in keys.select(F.hash("station_id")).collect()])
    return min(range(1, spark.sparkContext.defaultParallelism + 1), key=lambda n: (np.bincount(hashes % n).max(), n))


def start_records(spark: SparkSession, path: str, schema: T.StructType, root: str, prepare=observations, artifacts: Artifacts | None = None, rows_per_trigger: int = 5_000, state_partitions: int | None = None) -> StreamingQuery:
    """Starts ``run_records``; the caller waits for it and stops it."""
    log = record_stream(spark, path, schema, rows_per_trigger, f"{root}/position.json")
    return sink(process_stream(with_seq(prepare(log)), artifacts), root, state_partitions, processingTime="0 seconds")


def run_records(spark: SparkSession, path: str, schema: T.StructType, root: str, prepare=observations, artifacts: Artifacts | None = None, rows_per_trigger: int = 5_000, most_batches: int | None = None, state_partitions: int | None = None) -> None:
    """All records of the log at ``path`` through the stream, at most ``rows_per_trigger`` a micro-batch; goes on where an earlier run into ``root`` ended.

    ``most_batches`` stops it after about so many micro-batches.
    """
    query = start_records(spark, path, schema, root, prepare, artifacts, rows_per_trigger, state_partitions)
    try:
        if most_batches is None:
            query.processAllAvailable()
        while most_batches is not None and query.isActive and sum(p.numInputRows > 0 for p in query.recentProgress) < most_batches:
            query.awaitTermination(1)
    finally:
        query.stop()


def with_seq(obs: DataFrame) -> DataFrame:
    return obs if "seq" in obs.columns else obs.withColumnRenamed("event_id", "seq")


def results_of(spark: SparkSession, root: str) -> DataFrame:
    """What ``sink`` has written under ``root`` of records that could be processed; nothing before the first micro-batch."""
    return _table(spark, f"{root}/out", RESULT).where("processing_state <> 'FAILED'")


def dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """Records that failed, also those that a sink of before wrote to a folder of their own."""
    own = _table(spark, f"{root}/out", RESULT).where("processing_state = 'FAILED'").select(*DEAD_LETTER)
    return own.unionByName(_table(spark, f"{root}/dead_letters", T.StructType([RESULT[c] for c in DEAD_LETTER])))


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path).drop("batch")
