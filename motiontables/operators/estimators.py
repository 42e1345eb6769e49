"""A place for the user's own hand estimator: frames in, checked estimates out. No model is part of this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .contract import estimate_issues

ESTIMATE = """side string, handedness_confidence double, image_landmarks array<array<double>>, world_landmarks_m array<array<double>>,
world_coordinate_system string, joint_confidences array<double>, global_orient array<double>, hand_pose array<double>, shape array<double>"""
RECORDING = "__recording"


class Estimator(Protocol):
    """One instance sees the frames of one recording (or one span of it) in order of time."""

    def estimate(self, frame: Mapping, timestamp_ms: int) -> Sequence[Mapping]:
        """Detections of a frame, each with the fields of ``ESTIMATE``; a field left out is null."""

    def close(self) -> None:
        """Give back what the instance holds."""


def estimates(frames: DataFrame, make: Callable[[], Estimator], keys: Sequence[str], width: int | None = None) -> DataFrame:
    """(keys, frame, timestamp_ms, det_idx, the fields of ``ESTIMATE``, issues) for ``frames(keys, frame, timestamp_ms, ...)``.

    Every recording is one sorted run through one instance, in bounded memory; with ``width`` a recording is cut into
    spans of so many frames, each with an instance of its own, so that a long one spreads over tasks. Only detections
    without issues are fit for use. A frame gets one row without side and with its issue where its time is missing or
    does not exceed that of the frame before it (it is not shown to the estimator), where the estimator fails, and where
    it returns what has not the types of ``ESTIMATE``. A frame without detections gives no row.
    """
    fields = StructType.fromDDL(ESTIMATE)
    names = [*keys, "frame", "timestamp_ms"]
    out = StructType([frames.schema[c] for c in names] + StructType.fromDDL("det_idx int").fields + fields.fields
                     + StructType.fromDDL("failure string").fields)
    arrow = to_arrow_schema(out)
    span = F.floor(F.col("frame") / width) if width else F.lit(0)
    recording = F.struct(*keys, span.cast("long").alias("span"))
    ordered = frames.withColumn(RECORDING, recording).repartition(RECORDING).sortWithinPartitions(RECORDING, "timestamp_ms", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, instance, last = None, None, None
        try:
            for batch in batches:
                rows = []
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    recording, at = row.pop(RECORDING), row["timestamp_ms"]
                    if instance is None or recording != current:
                        if instance is not None:
                            instance.close()
                        current, instance, last = recording, make(), None
                    rows.extend(_detections(instance, row, names, fields.names, arrow, at, last))
                    last = last if at is None else at
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        finally:
            if instance is not None:
                instance.close()

    found = ordered.mapInArrow(run, out)
    failed = F.col("failure").isNotNull()
    return found.withColumn("issues", F.when(failed, F.array("failure")).otherwise(estimate_issues())).drop("failure")


def _detections(instance: Estimator, row: dict, names: list[str], fields: list[str], arrow: pa.Schema, at, last) -> list[dict]:
    here = {c: row[c] for c in names}
    if at is None or (last is not None and at <= last):
        return [{**here, "failure": "timestamps must increase"}]
    try:
        found = instance.estimate(row, at)
        rows = [{**here, "det_idx": i, **{f: d.get(f) for f in fields}} for i, d in enumerate(found)]
        pa.RecordBatch.from_pylist(rows, schema=arrow)  # types are checked while the frame is known
        return rows
    except Exception as error:  # one frame that a model cannot read must not end the job
        return [{**here, "failure": f"estimator failed: {type(error).__name__}"}]
