"""The sweep moves few values: depth centres alone give the preferred focal wherever a clip has one."""

import pytest

from motiontables.operators import sweep

SCHEMA = "clip_id string, frame int, lc array<double>, rc array<double>, ls double, rs double"


def test_boundaries_are_ranked_only_without_centres(spark, monkeypatch):
    rows = [("usual", i, [0., 0., 1. + i], [0., 1., 2. + i], 0.5, 0.25) for i in range(5)]
    rows += [("far", i, [0., 0., 7. + i], [0., 0., 7.5 + i], 0.5, 0.25) for i in range(3)]  # middle passed, far limit not
    rows += [("none", 0, [0., 0., 20.], [0., 0., 20.], 0.5, 0.25)]
    df = spark.createDataFrame(rows, SCHEMA)
    ranked, whole = [], sweep.exact_quantiles

    def counting(own, keys, value, probs):
        ranked.extend(r[0] for r in own.filter(value.isNotNull()).select("clip_id").collect())
        return whole(own, keys, value, probs)

    monkeypatch.setattr(sweep, "exact_quantiles", counting)
    got = {r.clip_id: r for r in sweep.select_focal(df, ["clip_id"], 1.0).collect()}
    centres = sorted(c for i in range(5) for c in ((5. - i) / 0.5, (4. - i) / 0.25) if c > 0)
    assert ranked.count("usual") == len(centres)  # neither slopes nor boundaries
    assert got["usual"].preferred == pytest.approx((centres[(len(centres) - 1) // 2] + centres[len(centres) // 2]) / 2)
    depths = [(10. - 7 - i) / 0.5 for i in range(3)] + [(10. - 7.5 - i) / 0.25 for i in range(3)]
    _, bounds = sweep.pass_intervals(1.0, sweep.GeometryCriteria())
    values = sorted(v for r in df.filter("clip_id = 'far'").select(bounds.alias("b")).collect() for v in r.b if v is not None and v > 0)
    assert set(d for d in depths if d > 0) <= set(values)
    assert got["far"].preferred == pytest.approx((values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2)
    assert {c: got[c].frame_count for c in got} == {"usual": 5, "far": 3, "none": 1}
