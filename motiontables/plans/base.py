"""A query is a callable and, where plain SQL can say it, the equivalent ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    queries: dict[str, Query]
    sql: dict[str, str]

    @classmethod
    def empty(cls) -> Catalog:
        return cls({}, {})

    def add(self, name: str, sql: str | None = None):
        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name!r} registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql.strip()
            return fn
        return register

    def merge(self, other: Catalog) -> None:
        for name, fn in other.queries.items():
            self.add(name, other.sql.get(name))(fn)


# The motion views as SQL, for reference queries.
FRAME_COUNT = "(SELECT 4 * (date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1) FROM events)"
EVENT_MS = ("(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 86400000"
            " + extract(hour FROM ts) * 3600000 + extract(minute FROM ts) * 60000"
            " + CAST(floor(extract(microsecond FROM ts) / 1000) AS BIGINT))")

OBS = f"""
obs AS (
  SELECT user_id AS clip_id,
         CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) * 4
              + floor(extract(hour FROM ts) / 6) AS BIGINT) AS frame,
         CASE WHEN event_type IN ('click', 'view') THEN 'left' ELSE 'right' END AS side,
         event_id AS det_idx, event_type AS kind, value / 500.0 AS score,
         event_type = 'error' AS ambiguous,
         value AS x, value / 2 AS y,
         CAST(regexp_extract(props, '"k": *(-?[0-9.]+)', 1) AS DOUBLE) AS z,
         value * pi() / 500.0 AS angle, {EVENT_MS} AS timestamp_ms
  FROM events)"""

GROUPS = OBS + """,
grp AS (
  SELECT clip_id, frame, side, count(*) AS n,
         count(*) FILTER (WHERE NOT ambiguous) AS n_sure,
         min(det_idx) AS any_id, min(det_idx) FILTER (WHERE NOT ambiguous) AS sure_id
  FROM obs GROUP BY clip_id, frame, side),
outcomes AS (
  SELECT *, CASE WHEN n = 1 THEN 'retained' WHEN n_sure = n OR n_sure > 1 THEN 'conflict'
                 WHEN n_sure = 1 THEN 'retained' ELSE 'excluded' END AS outcome,
         CASE WHEN n = 1 THEN any_id ELSE sure_id END AS kept_id
  FROM grp),
kept AS (
  SELECT o.* FROM outcomes g JOIN obs o
    ON g.outcome = 'retained' AND o.det_idx = g.kept_id AND o.clip_id = g.clip_id
       AND o.frame = g.frame AND o.side = g.side)"""

STATES = f"""
states AS (
  SELECT user_id AS clip_id, {EVENT_MS} AS at_ms, event_id AS seq,
         CASE WHEN event_type <> 'error' THEN event_type END AS state
  FROM events)"""

BOXES = """
boxes AS (
  SELECT l_orderkey AS clip_id, CAST(l_linenumber AS BIGINT) AS y, l_suppkey AS object_id,
         l_partkey AS part_id, l_returnflag AS flag, CAST(l_linenumber AS BIGINT) AS x0,
         CAST(l_linenumber + l_quantity AS BIGINT) AS x1
  FROM lineitem)"""
