"""Listing of folder trees by tasks, and frames that are kept by it."""

import pytest
from scene_helpers import rows

from sceneframe.operators.slots import frames_present
from sceneframe.sources import annotations as AN
from sceneframe.sources.listing import list_files


def tree(root, files):
    for name in files:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)


def test_every_file_once_at_any_depth(spark, tmp_path):
    files = ["a.txt", "v 1/000001.jpg", "v 1/deep/er/b%20c.txt", *[f"w/{d}/{k}.txt" for d in range(30) for k in range(3)], "ü/x=1/ü.txt"]
    tree(tmp_path, [*files, "_hidden/a.txt", "v 1/.b.txt"])
    (tmp_path / "empty").mkdir()
    got = list_files(spark, str(tmp_path)).collect()
    assert sorted(r.path for r in got) == sorted(f"file://{tmp_path}/{f}" for f in files)
    assert {r.path: r.size for r in got} == {f"file://{tmp_path}/{f}": len(f.encode()) for f in files}
    assert rows(list_files(spark, f"file://{tmp_path}")) == rows(list_files(spark, str(tmp_path)))


def test_missing_and_empty_folders(spark, tmp_path):
    assert list_files(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="(?i)no such file|not found|does not exist"):
        list_files(spark, str(tmp_path / "none"))


def test_many_names_in_one_folder(spark, tmp_path):
    tree(tmp_path, [f"v/{k:06d}.jpg" for k in range(10_005)])
    assert sorted(AN.list_frames(spark, str(tmp_path)).collect()) == [("v", k) for k in range(10_005)]


def test_detections_of_listed_frames(spark, tmp_path):
    tree(tmp_path, ["v1/000000.jpg", "v1/000002.jpg", "v2/000000.txt"])
    seen = spark.createDataFrame([("v1", 0, 1), ("v1", 1, 1), ("v1", 2, 1), ("v2", 0, 1)], "video_id string, fid long, tid int")
    assert rows(frames_present(seen, AN.list_frames(spark, str(tmp_path)))) == [("v1", 0, 1), ("v1", 2, 1)]
