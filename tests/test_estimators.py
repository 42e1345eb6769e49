"""The estimator hook with a fake backend, and hashes of files of any size."""

import hashlib

from pyspark.sql import functions as F

from motiontables.operators import estimators, lineage


def fake_backend():
    """Defined inside, so that workers get it by value."""
    def fake():
        class Fake:
            """Counts the frames that it saw; its confidence tells how many."""
            seen = 0

            def estimate(self, frame, timestamp_ms):
                self.seen += 1
                if frame["kind"] == "broken":
                    raise ValueError("unreadable")
                if frame["kind"] == "mistyped":
                    return [{"side": ["left"]}]
                points = [[0.1, 0.2, 0.3]] * (20 if frame["kind"] == "short" else 21)
                hand = {"side": "left", "handedness_confidence": self.seen / 100, "image_landmarks": points,
                        "world_landmarks_m": [[0.1, 0.2, 0.3]] * 21, "world_coordinate_system": "camera"}
                return [] if frame["kind"] == "empty" else [hand, {**hand, "side": "right"}]

            def close(self):
                self.seen = -10**6
        return Fake()
    return fake


def test_estimates_of_a_fake_backend(spark):
    kinds = ["good", "empty", "short", "broken", "mistyped", "good"]
    rows = [("a", i, 10 * i, k) for i, k in enumerate(kinds)] + [("b", 0, 0, "good"), ("b", 1, 0, "good"), ("b", 2, None, "good"), ("b", 3, 5, "good")]
    frames = spark.createDataFrame(rows, "clip_id string, frame int, timestamp_ms long, kind string")
    got = estimators.estimates(frames, fake_backend(), ["clip_id"]).cache()
    good = {(r.clip_id, r.frame, r.det_idx, r.side): r.handedness_confidence for r in got.filter(F.size("issues") == 0).collect()}
    seen = {("a", 0): .01, ("a", 5): .06, ("b", 0): .01, ("b", 3): .02}
    assert good == {(c, f, i, s): v for (c, f), v in seen.items() for i, s in enumerate(("left", "right"))}
    bad = {(r.clip_id, r.frame, r.det_idx, tuple(r.issues)) for r in got.filter(F.size("issues") > 0).collect()}
    short = ("image_landmarks must hold 21 finite points",)
    assert bad == {("a", 2, 0, short), ("a", 2, 1, short), ("a", 3, None, ("estimator failed: ValueError",)),
                   ("a", 4, None, bad_type(bad)), ("b", 1, None, ("timestamps must increase",)), ("b", 2, None, ("timestamps must increase",))}
    assert estimators.estimates(frames.limit(0), fake_backend(), ["clip_id"]).count() == 0


def bad_type(bad):
    found = next(issues for clip, frame, _, issues in bad if (clip, frame) == ("a", 4))
    assert found[0].startswith("estimator failed: Arrow")
    return found


def test_spans_have_an_instance_of_their_own(spark):
    frames = spark.range(40).selectExpr("'a' AS clip_id", "CAST(id AS INT) AS frame", "id AS timestamp_ms", "'good' AS kind")
    got = estimators.estimates(frames, fake_backend(), ["clip_id"], width=8).filter("det_idx = 0").collect()
    assert {r.frame: r.handedness_confidence for r in got} == {i: (i % 8 + 1) / 100 for i in range(40)}


def test_files_over_two_gigabytes_are_hashed_in_pieces(spark, tmp_path):
    size = (1 << 31) + 5
    with open(tmp_path / "large one%20.bin", "wb") as f:
        f.truncate(size)
    (tmp_path / "small.bin").write_bytes(b"x")
    want, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(1 << 11):
        want.update(zeros)
    want.update(bytes(5))
    got = {r.size: r.sha256 for r in lineage.file_inventory(spark, str(tmp_path), "*.bin").collect()}
    assert got == {size: want.hexdigest(), 1: hashlib.sha256(b"x").hexdigest()}
