"""Outputs that become visible as a whole or not at all."""

import pytest
from pyspark.sql import functions as F
from scene_helpers import rows

from sceneframe import session
from sceneframe.sources import sinks as SK


def summary(spark, states):
    return spark.createDataFrame([("v1", states)], "video_id string, states long")


def failing(spark):
    return spark.range(3).select(F.raise_error(F.lit("lost")).cast("string").alias("names"))


def read(spark, path):
    return spark.read.json(f"{path}/manifest").first().num_states, [r.names for r in spark.read.json(f"{path}/object_names").collect()]


def names(spark, name):
    return spark.createDataFrame([(name,)], "names string")


def test_failure_of_a_later_part_leaves_the_old_output(spark, tmp_path):
    path = str(tmp_path / "out" / "manifest of a run")
    SK.write_manifest(summary(spark, 5), names(spark, "old"), path, None, False, 3, "sequential")
    with pytest.raises(Exception, match="lost"):
        SK.write_manifest(summary(spark, 6), failing(spark), path, None, False, 3, "sequential")
    assert read(spark, path) == (5, ["old"])
    SK.write_manifest(summary(spark, 7), names(spark, "new"), path, None, False, 3, "sequential")
    assert read(spark, path) == (7, ["new"])
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")] == ["manifest of a run"]


def test_first_write_that_fails_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="lost"):
        SK.write_codes_csv(failing(spark).select(F.array("names").alias("bits")), str(tmp_path / "codes"))
    assert list(tmp_path.iterdir()) == []


def test_other_files_are_not_lost(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("mine")
    with pytest.raises(ValueError, match="notes.txt"):
        SK.write_manifest(summary(spark, 5), names(spark, "a"), str(tmp_path), None, False, 3, "sequential")
    assert [p.name for p in tmp_path.iterdir()] == ["notes.txt"]


def test_exchange_that_fails_is_undone(spark, tmp_path, monkeypatch):
    path, rename = str(tmp_path / "t"), session._rename
    spark.range(2).write.parquet(path)

    def broken(fs, old, new):
        if "staged" in str(old):
            raise OSError("store is away")
        rename(fs, old, new)

    monkeypatch.setattr(session, "_rename", broken)
    with pytest.raises(OSError, match="away"):
        with session.replacing(spark, path) as new:
            spark.range(9).write.parquet(new)
    assert rows(spark.read.parquet(path)) == [(0,), (1,)] and [p.name for p in tmp_path.iterdir()] == ["t"]
