"""The command line on small files."""

import json

from scene_helpers import rows
from test_sources import video

from sceneframe import __main__ as cli
from sceneframe.plans import datasets as D
from sceneframe.plans import extraction as X
from sceneframe.sources import annotations as AN
from pyspark.sql import functions as F


def test_inspect_and_audit(spark, tmp_path, capsys):
    folder = tmp_path / "train"
    folder.mkdir()
    box = (0, 0, 4, 4)
    for d in (video("a", [(0, "dog"), (1, "cat")], [[(0, box)], [(0, box), (1, box)]]), video("b", [(0, "cat")], [[(0, box)]])):
        (folder / f"{d['video_id']}.json").write_text(json.dumps(d))
    base = ["--annotations", str(tmp_path), "--split", "train"]
    assert cli.main(["inspect", *base, "--threshold", "1"]) == 0
    out = capsys.readouterr().out
    assert "dog" in out and "true" in out
    assert cli.main(["audit", *base, "--category", "cat"]) == 0
    assert cli.main(["audit", *base, "--category", "cat", "--loose"]) == 1


def test_answers(spark, tmp_path, capsys):
    path = tmp_path / "answers.json"
    path.write_text(json.dumps([{"image": "1.jpg", "output": '[{"class":"dog","bbox_2d":[1,2,3,4]}, {"cl'}, {"image": "2.jpg", "output": "none"}]))
    assert cli.main(["answers", str(path), str(tmp_path / "out")]) == 0
    assert "dog" in capsys.readouterr().out
    assert rows(AN.read_labeled_images(spark, str(tmp_path / "out"), multi_line=False).select("image")) == [("1.jpg",)]


def test_extract_writes_every_table(spark, tmp_path):
    df = spark.createDataFrame([(i, [i % 2, 1], [[[0.9, 0.1]]], ["dog", "cat"], f"{i}.jpg") for i in range(4)],
                               "state_id int, bits array<int>, attention array<array<array<double>>>, object_names array<string>, image string")
    df.write.parquet(str(tmp_path / "in"))
    args = ["extract", str(tmp_path / "in"), str(tmp_path / "out"), "--units", "1", "--arguments", "1", "--predicates", "2", "--objects", "2", "--num", "3"]
    assert cli.main(args) == 0
    assert spark.read.json(str(tmp_path / "out" / "atoms" / "states")).count() == 3
    assert spark.read.json(str(tmp_path / "out" / "usage")).first().total_states == 3
    assert spark.read.json(str(tmp_path / "out" / "state_mapping")).count() == 3
    assert spark.read.text(str(tmp_path / "out" / "atoms_text")).where("value like 'State %'").count() == 3


def test_splits_are_written_by_folder(spark, tmp_path):
    slots = spark.range(150).select(F.col("id").alias("state_id"), F.lit(0).alias("slot"))
    frames = spark.range(150).select(F.lit("v").alias("video_id"), F.col("id").alias("fid"))
    slots = slots.withColumn("video_id", F.lit("v"))
    D.write_splits(slots, D.video_splits(frames), ["video_id", "state_id"], str(tmp_path / "s"))
    got = {r.split: r["count"] for r in spark.read.parquet(str(tmp_path / "s")).groupBy("split").count().collect()}
    assert got == {"train": 268, "val": 15, "test": 15}


def test_frame_numbers_may_restart_in_every_video(spark, tmp_path):
    frames = spark.range(120).select((F.col("id") % 2).cast("string").alias("video_id"), F.floor(F.col("id") / 2).alias("fid"))
    splits = D.video_splits(frames)
    slots = frames.withColumn("slot", F.lit(0))
    D.write_splits(slots, splits, ["video_id", "fid"], str(tmp_path / "s"))
    assert splits.count() == 2 * 2 * 59 and spark.read.parquet(str(tmp_path / "s")).count() == 236


def test_small_sets_are_in_all_splits_only_when_asked(spark):
    frames = spark.range(20).select(F.lit("v").alias("video_id"), F.col("id").alias("fid"))
    assert D.video_splits(frames).count() == 38 and D.video_splits(frames, small_set=100).count() == 3 * 38


def test_first_images_follow_the_file_names(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"image": "a0", "objects": []}]))
    (tmp_path / "b.json").write_text(json.dumps([{"image": f"b{i}", "objects": []} for i in range(50)]))
    got = AN.read_labeled_images(spark, str(tmp_path), max_images=2, skip_empty=False)
    assert sorted(r.image for r in got.collect()) == ["a0", "b0"]
