"""Plain texts are read by one cast, others by the walk over their nodes: same values, over all tasks."""

import json

from motiontables.sources import captures as docs

VALUES = [None, True, 5, 2.0, 2.5, "5", "true", "P1", [], [1, "a"], [True, 1], {}, {"a": 1}, 3000000000, ", true,", "a : b"]


def test_plain_and_escaped_texts_are_read_alike(spark):
    def one(value):
        return {"Format_Version": value, "meta": {"fps": value, "frame_count": value, "resolution": value}, "camera": {"calibrated": value},
                "HANDS": [{"side": value, "frames": [{"Sample_Kind": value, "validity": {"pose": value}, "bone_rotations": {"Index_01": value}}]}],
                "packets": value, "quality": {"warnings": [value, "W"]}}

    rows = []
    for i, value in enumerate(VALUES):
        rows += [(f"{i}", json.dumps(one(value))), (f"{i}e", json.dumps({**one(value), "other": "back\\slash"}))]
    got = {r.clip_id: r[1:] for r in docs.typed(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert len(got) == len(rows)
    for i in range(len(VALUES)):
        assert got[f"{i}"] == got[f"{i}e"]
    assert got["7"][0] == "P1" and got["1"][2].calibrated is True and got["2"][1].frame_count == 5 and got["5"][1].fps is None


def test_documents_of_one_file_are_read_by_many_tasks(spark):
    one = spark.createDataFrame([(str(i), '{"format_version": "1.0"}') for i in range(100)], "doc_id string, text string").coalesce(1)
    assert docs.typed(one).rdd.getNumPartitions() > 1 and docs.leaves(one).rdd.getNumPartitions() > 1
