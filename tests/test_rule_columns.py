"""Estimate rules as columns of their own: the same issues as the array of them, and each rule compiled."""

import contextlib
import io

from pyspark.sql import functions as F

from motiontables.operators import contract

NAN, INF = float("nan"), float("inf")
COLUMNS = ("k int, side string, handedness_confidence double, image_landmarks array<array<double>>, world_landmarks_m array<array<double>>, "
           "world_coordinate_system string, joint_confidences array<double>, global_orient array<double>, hand_pose array<double>, shape array<double>")


def finite(v, n):
    return v is not None and len(v) == n and all(x is not None and x == x and abs(x) != INF for x in v)


def expected(row):
    _, side, score, image, world, space, joints, orient, pose, shape = row
    out = ["invalid side"] * (side not in ("left", "right")) + ["confidence must be in [0, 1]"] * (not (score is not None and 0 <= score <= 1))
    for name, points in (("image_landmarks", image), ("world_landmarks_m", world)):
        if points is None or len(points) != 21 or not all(finite(p, 3) for p in points):
            out.append(f"{name} must hold 21 finite points")
    out += ["coordinate convention must be explicit"] * (not (space or "").strip())
    if joints is not None and not (finite(joints, 21) and all(0 <= x <= 1 for x in joints)):
        out.append("joint_confidences must hold 21 finite values")
    return out + [f"{name} must hold {n} finite values" for name, v, n in (("global_orient", orient, 3), ("hand_pose", pose, 45), ("shape", shape, 10))
                  if v is not None and not finite(v, n)]


def cases():
    point = [.1, .2, .3]
    whole = [point] * 21
    good = ["left", .5, whole, whole, "y up", [.5] * 21, [.5] * 3, [.5] * 45, [.5] * 10]
    odd = [None, [], [None], [point] * 20, [point] * 22]
    odd += [[p] + [point] * 20 for p in (None, [], [.1, .2], point + [.4], [NAN, .2, .3], [.1, INF, .3], [.1, .2, -INF], [.1, None, .3])]
    odd += [[[.1, .2], point + [.4]] + [point] * 19]  # 63 numbers, but not three a point
    rows = [good] + [good[:2] + [o] + good[3:] for o in odd] + [good[:3] + [o] + good[4:] for o in odd]
    for i, n in ((5, 21), (6, 3), (7, 45), (8, 10)):
        for v in (None, [], [None] * n, [.5] * (n - 1), [.5] * (n + 1), *[[.5] * (n - 1) + [x] for x in (None, NAN, INF, -INF, 1.0, 0.0, 1.5, -.5)]):
            rows.append(good[:i] + [v] + good[i + 1:])
    rows += [[s] + good[1:] for s in (None, "top")] + [["left", c] + good[2:] for c in (None, NAN, INF, -.1, 0.0, 1.0)] + [good[:4] + [" "] + good[5:]]
    return [(k, *r) for k, r in enumerate(rows)]


def test_each_rule_finds_what_a_plain_walk_finds(spark):
    data = cases()
    rows = spark.createDataFrame(data, COLUMNS)
    want = sorted((r[0], m) for r in data for m in expected(r))
    assert sorted(tuple(r) for r in contract.estimate_violations(rows, ["k"]).collect()) == want
    assert sorted(tuple(r) for r in rows.select("k", F.explode(contract.estimate_issues()).alias("m")).collect()) == want


def test_no_rule_is_evaluated_inside_a_filter_of_the_array(spark):
    rows = spark.createDataFrame(cases()[:1], COLUMNS)
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        contract.estimate_violations(rows, ["k"]).explain()
    assert "filter(array(" not in shown.getvalue() and "explode(array(CASE" not in shown.getvalue()
