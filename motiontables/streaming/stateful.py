"""Keyed state machines on streams: identity tracking and packet lifecycle.

Both reuse the step functions of the batch operators. State is one small JSON value per
key in the state store; rows of a micro-batch are ordered per key before stepping, so
``maxFilesPerTrigger`` bounds what one key can bring at once. The RocksDB state store
provider must be configured for the session (see :func:`use_rocksdb`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.fold import records
from ..operators.identity import TRACK_COLUMNS, TrackingRules, frame_rows, new_state, observation, plausible, track_frame
from ..operators.lifecycle import star_components

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME_ROWS = "clip_id string, view_id string, timestamp_ms bigint, hands array<struct<det_idx bigint, side string, score double, landmarks array<array<double>>>>"
IDENTITY_COLUMNS = "clip_id string, view_id string, " + TRACK_COLUMNS
LIFECYCLE_COLUMNS = """clip_id string, event string, frame bigint, confirmed_at bigint, members string, node_id bigint,
birth_frame bigint, death_frame bigint, reason string"""


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _names(schema: str) -> list[str]:
    return [c.strip().split()[0] for c in schema.replace("\n", " ").split(",")]


class _JsonState(StatefulProcessor):
    """Keeps one JSON document per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._value = handle.getValueState("state", "body string")

    def load(self, fresh):
        return json.loads(self._value.get()[0]) if self._value.exists() else fresh()

    def store(self, state) -> None:
        self._value.update((json.dumps(state),))

    def close(self) -> None:
        pass


class IdentityProcessor(_JsonState):
    """One input row per frame with its detections; late or crowded frames come out as rejected rows."""

    def __init__(self, rules: TrackingRules = TrackingRules()):
        self.rules = rules

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.load(new_state)
        frame = pd.concat(list(rows)).sort_values("timestamp_ms", kind="stable")
        out = []
        for ts, hands in zip(frame["timestamp_ms"], frame["hands"]):
            hands = sorted(hands if hands is not None else [], key=lambda h: h["det_idx"])
            if len(hands) > 2:
                out.append({"timestamp_ms": int(ts), "det_idx": -1, "source": "rejected_more_than_two_detections"})
                continue
            if ts < 0 or not all(plausible(h["side"], h["score"], h["landmarks"]) for h in hands):
                out.append({"timestamp_ms": int(ts), "det_idx": -1, "source": "rejected_invalid_detection"})
                continue
            seen = [observation(h["side"], h["score"], h["landmarks"]) for h in hands]
            results = track_frame(state, seen, int(ts), self.rules)
            if results is None:
                out.append({"timestamp_ms": int(ts), "det_idx": -1, "source": "rejected_late_timestamp"})
            else:
                out += frame_rows(ts, [int(h["det_idx"]) for h in hands], results)
        self.store(state)
        yield records([{"clip_id": key[0], "view_id": key[1], **r} for r in out], _names(IDENTITY_COLUMNS))


def track_stream(frames: DataFrame, rules: TrackingRules = TrackingRules()) -> DataFrame:
    """Identity tracking on a stream of frame rows (see ``FRAME_ROWS``)."""
    return frames.groupBy("clip_id", "view_id").transformWithStateInPandas(
        statefulProcessor=IdentityProcessor(rules), outputStructType=IDENTITY_COLUMNS, outputMode="Append", timeMode="None")


def frame_rows_of(views: DataFrame) -> DataFrame:
    """Frame rows from exploded views of the frame log."""
    hands = F.transform("hands", lambda h, i: F.struct(
        i.cast("long").alias("det_idx"), h.getField("side").alias("side"),
        h.getField("handedness_confidence").alias("score"), h.getField("image_landmarks").alias("landmarks")))
    return views.filter("available").select("clip_id", "view_id", "timestamp_ms", hands.alias("hands"))


def fresh_lifecycle() -> dict:
    return {"active": {}, "pending": None, "since": None, "count": 0, "next": 0, "last": None, "seen": None}


def lifecycle_step(state: dict, frame: int, partition: str | None, confirmation: int) -> list[dict]:
    """Advance one frame; partition is the canonical text or None when unknown. A frame left out ends a pending run."""
    if state["last"] is not None and frame != state["last"] + 1:
        state.update(pending=None, count=0)
    state["last"] = frame
    active = "|".join(sorted(state["active"]))
    if partition is None or partition == active:
        state.update(pending=None, count=0)
        if partition is not None:
            state["seen"] = frame
        return []
    if partition != state["pending"]:
        state.update(pending=partition, since=frame, count=0)
    state["count"] += 1
    if state["count"] < confirmation:
        return []
    start, old, new = state["since"], sorted(state["active"]), partition.split("|")
    state.update(pending=None, count=0)
    parts = star_components(tuple(old), tuple(new)) if old else [([], new)]
    if parts is None:
        return [{"event": "unresolved", "frame": start, "confirmed_at": frame, "members": partition}]
    out = []
    for gone, came in parts:
        kind = "birth" if not gone else ("split" if len(gone) == 1 else "merge")
        out.append({"event": kind, "frame": start, "confirmed_at": frame, "members": "|".join(sorted(came))})
        for g in gone:
            node = state["active"].pop(g)
            out.append({"event": "node", "members": g, "node_id": node[0], "birth_frame": node[1],
                        "death_frame": start - 1, "reason": kind})
        for g in sorted(came):
            state["active"][g] = [state["next"], start]
            state["next"] += 1
    state["seen"] = frame
    return [r for r in out if r["event"] != "birth"]


def lifecycle_finish(state: dict) -> list[dict]:
    """Close every open node at the last frame and report an unconfirmed tail."""
    out = [{"event": "node", "members": g, "node_id": n[0], "birth_frame": n[1], "death_frame": state["last"],
            "reason": "end_of_observed_clip"} for g, n in sorted(state["active"].items())]
    if state["count"]:
        out.append({"event": "unconfirmed_terminal_partition", "frame": state["since"], "members": state["pending"]})
    state.update(active={}, pending=None, count=0)
    return out


class LifecycleProcessor(_JsonState):
    """Rows (clip_id, frame, partition, finished); a finished row closes the clip."""

    def __init__(self, confirmation: int = 3):
        self.confirmation = confirmation

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.load(fresh_lifecycle)
        frame = pd.concat(list(rows)).sort_values(["finished", "frame"], kind="stable")
        out = []
        for f, partition, finished in zip(frame["frame"], frame["partition"], frame["finished"]):
            if finished:
                out += lifecycle_finish(state)
            elif state["last"] is not None and f <= state["last"]:
                out.append({"event": "rejected_late_frame", "frame": int(f)})
            else:
                if state["last"] is not None and f > state["last"] + 1:  # a hole is unknown
                    lifecycle_step(state, int(f) - 1, None, self.confirmation)
                out += lifecycle_step(state, int(f), partition if isinstance(partition, str) else None, self.confirmation)
        self.store(state)
        yield records([{"clip_id": key[0], **r} for r in out], _names(LIFECYCLE_COLUMNS))


def lifecycle_stream(rows: DataFrame, confirmation: int = 3) -> DataFrame:
    return rows.groupBy("clip_id").transformWithStateInPandas(
        statefulProcessor=LifecycleProcessor(confirmation), outputStructType=LIFECYCLE_COLUMNS, outputMode="Append",
        timeMode="None")
