"""Sequential state machines over sorted rows with bounded memory.

Rows are shuffled by key and sorted inside the partition; a Python step then reads Arrow
batches as they stream by, carrying a small state per key. No group is ever collected.
Callers keep keys small where the problem allows it (sessions, compressed islands).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def records(rows: list[dict], columns: Sequence[str]) -> pd.DataFrame:
    """Rows as a frame whose missing values stay None (NaN is not null for lists or integers)."""
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(),
         "array<string>": pa.list_(pa.string())}


def sorted_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], new_state: Callable,
                step: Callable, schema: str) -> DataFrame:
    """``step(state, row_dict) -> list of output dicts``; ``row_dict`` None flushes a key at its end.

    Columns of ``schema`` that are no keys have one of the types of ``ARROW``.
    """
    fields = [c.split() for c in schema.replace("\n", " ").split(",") if c.strip()]
    key_list = list(keys)
    more = [(name, ARROW[kind]) for name, kind in fields if name not in key_list]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, key_types = None, None, {}
        owners, found = [], []

        def take(rows):
            if rows:
                found.extend(rows)
                owners.extend([current] * len(rows))

        def flushed():
            own = dict(zip(key_list, zip(*owners))) if owners else dict.fromkeys(key_list, ())
            types = {**key_types, **dict(more)}
            arrays = [pa.array(own[n] if n in own else [r.get(n) for r in found], types[n]) for n, _ in fields]
            owners.clear()
            found.clear()
            return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])

        for batch in batches:
            names = batch.schema.names
            key_types = {k: batch.schema.field(k).type for k in key_list}
            values = [c.to_pylist() for c in batch.columns]
            row_keys = zip(*[values[names.index(k)] for k in key_list])
            for key, row in zip(row_keys, zip(*values)):
                if key != current:
                    if current is not None:
                        take(step(state, None))
                    current, state = key, new_state()
                take(step(state, dict(zip(names, row))))
            yield flushed()
        if current is not None:
            take(step(state, None))
            yield flushed()

    arranged = df.repartition(*key_list).sortWithinPartitions(*key_list, *order)
    return arranged.mapInArrow(run, schema)
