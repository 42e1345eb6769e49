"""The interior of a frame is found where its runs are dealt to: one shuffle, nothing written in between."""

from motiontables.operators import masks


def test_interior_moves_runs_once(spark):
    runs = [(c, 0, y, x, x + 6) for c in range(9) for y in range(4) for x in (0, 3, 9)]
    schema = "clip_id int, frame int, y long, x0 long, x1 long"
    df = spark.createDataFrame(runs, schema)
    got = masks.interior_support(df, df.filter("y < 2"), min_interior=3, min_share=.5)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted((r.clip_id, r.interior_px, r.dark_px) for r in got.collect()) == [(c, 26, 13) for c in range(9)]
