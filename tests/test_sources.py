"""Readers and writers on small files in the original formats."""

import json
import struct
import zlib

import numpy as np
import pytest
from scene_helpers import rows
from pyspark.sql import functions as F

from sceneframe.operators import atoms as L
from sceneframe.operators import usage as U
from sceneframe.session import shared_folder
from sceneframe.sources import annotations as AN
from sceneframe.sources import sinks as SK
from sceneframe.sources import trials as TL


def video(name, subjects, trajectories):
    box = lambda b: dict(zip(["xmin", "ymin", "xmax", "ymax"], b))
    return {"video_id": name, "width": 640, "height": 480, "frame_count": len(trajectories),
            **({"subject/objects": [{"tid": t, "category": c} for t, c in subjects]} if subjects is not None else {}),
            "trajectories": [[{"tid": t, "bbox": box(b)} for t, b in f] for f in trajectories]}


@pytest.fixture
def videos(tmp_path):
    folder = tmp_path / "ann" / "train"
    folder.mkdir(parents=True)
    docs = [video("a", [(0, "dog"), (0, "cat")], [[(0, (0, 0, 4, 4)), (5, (1, 1, 2, 2))], [], [(0, (0, 0, 1, 1))]]),
            video("b", None, [[(1, (0, 0, 1, 1))]]), video("c", [(0, "dog")], [])]
    for d in docs:
        (folder / f"{d['video_id']}.json").write_text(json.dumps(d, indent=1))
    return str(tmp_path / "ann")


def test_video_annotations(spark, videos):
    docs = AN.read_video_annotations(spark, videos, "train")
    got = rows(AN.video_detections(docs).select("video_id", "fid", "pos", "tid", "name"))
    assert got == [("a", 0, 0, 0, "cat"), ("a", 0, 1, 5, "obj5"), ("a", 2, 0, 0, "cat"), ("b", 0, 0, 1, "obj1")]
    assert rows(AN.video_subjects(docs).select("video_id", "category")) == [("a", "cat"), ("a", "dog"), ("c", "dog")]
    first = AN.read_video_annotations(spark, videos, "train", max_videos=2)
    assert rows(first.select("video_id")) == [("a",), ("b",)]


def test_missing_annotations_raise(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        AN.read_video_annotations(spark, str(tmp_path / "none"))


def test_labelled_images_cut_before_dropping_empty(spark, tmp_path):
    data = [{"image": "1.jpg", "objects": []}, {"image": "2.jpg", "objects": [{"class": "dog", "bbox": [1, 2, 3, 4.5]}]}, {"image": "3.jpg"},
            {"image": "4.jpg", "objects": [{"class": "cat", "bbox": [0, 0, 1, 1]}]}]
    path = tmp_path / "labels.json"
    path.write_text(json.dumps(data, indent=2))
    assert rows(AN.read_labeled_images(spark, str(path), max_images=2).select("image")) == [("2.jpg",)]
    assert AN.read_labeled_images(spark, str(path), skip_empty=False).count() == 4
    d = AN.image_detections(AN.read_labeled_images(spark, str(path)))
    box = ["xmin", "ymin", "xmax", "ymax"]
    assert rows(d.select("image", "pos", "class", *box)) == [("2.jpg", 0, "dog", 1.0, 2.0, 3.0, 4.5), ("4.jpg", 0, "cat", 0.0, 0.0, 1.0, 1.0)]
    sized = AN.image_detections(AN.read_labeled_images(spark, str(path)), 640, 480)
    assert {(r.state_id, r.category, r.width, r.height) for r in sized.collect()} == {("2.jpg", "dog", 640, 480), ("4.jpg", "cat", 640, 480)}


def png(pixels):
    h, w, _ = pixels.shape
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_frame_listing_and_pixels(spark, tmp_path):
    pixels = np.random.default_rng(0).integers(0, 256, (3, 4, 3), dtype=np.uint8)
    for name in ("v1/000000.jpg", "v1/000012.jpg", "v2/000003.jpg", "v2/notes.txt"):
        p = tmp_path / "frames" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    assert rows(AN.list_frames(spark, str(tmp_path / "frames"))) == [("v1", 0), ("v1", 12), ("v2", 3)]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "p.png").write_bytes(png(pixels))
    r = AN.read_frames_pixels(spark, str(tmp_path / "img")).first()
    assert (r.height, r.width, r.channels) == (3, 4, 3)
    np.testing.assert_array_equal(np.frombuffer(bytes(r.data), np.uint8).reshape(3, 4, 3)[:, :, ::-1], pixels)


def test_array_archive(spark, tmp_path):
    pres, sucs = np.arange(27).reshape(3, 9), np.arange(27)[::-1].reshape(3, 9)
    np.savez(tmp_path / "t.npz", pres=pres, sucs=sucs)
    got = AN.read_array_archive(spark, str(tmp_path), "pres array<int>, sucs array<int>", rows_per_batch=2).orderBy("row").collect()
    assert [list(r.pres) for r in got] == pres.tolist() and [list(r.sucs) for r in got] == sucs.tolist()


def test_names_file_falls_back_to_image_ids(spark, tmp_path):
    for key in ("frame_ids", "image_ids"):
        path = tmp_path / f"{key}.json"
        path.write_text(json.dumps({key: ["x", "y"], "object_names": [["a"], ["b", "c"]]}))
        assert rows(AN.read_names_manifest(spark, str(path))) == [(0, "x", ["a"]), (1, "y", ["b", "c"])]


def test_trial_log_back_to_back(spark, tmp_path):
    path = tmp_path / "log"
    path.write_text('[0.5, {"a": 1, "act": ["relu", "MSE"]}, {"epoch": 10}][0.25, {"a": 2}, {"epoch": null}]\n[1e-07, {"a": 3}, {}]\n')
    got = [(r.eval, r.config["a"], r.config.get("act"), r.defaults) for r in TL.read_trial_log(spark, str(path)).orderBy("eval").collect()]
    assert got == [(1e-07, "3", None, {}), (0.25, "2", None, {"epoch": None}), (0.5, "1", '["relu","MSE"]', {"epoch": "10"})]


def results(spark):
    df = spark.createDataFrame([(0, [0, 1], [[[0.0625, 0.0]]], ["dog", "cat"]), (1, [0, 0], [[[0.1, 1.0]]], ["dog", "cat"])],
                               "s int, bits array<int>, attention array<array<array<double>>>, names array<string>")
    return L.state_results(L.bind_arguments(df), "s", 2, "names", threshold=0.0)


def test_atom_text_blocks(spark, tmp_path):
    blocks = {r.s: r.value for r in SK.atom_blocks(results(spark), "s").collect()}
    assert blocks == {0: "State 0:\n  pred_1(dog)  [conf=0.062]\n", 1: "State 1:\n  (no active predicates)\n"}
    negated = {r.s: r.value for r in SK.atom_blocks(results(spark), "s", show_negated=True).collect()}
    assert negated[1] == "State 1:\n  ~pred_0(cat)  [conf=1.000]\n  ~pred_1(cat)  [conf=1.000]\n"
    SK.write_atoms_text(results(spark), "s", str(tmp_path / "t"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    assert text == blocks[0] + "\n" + blocks[1] + "\n"


def test_header_and_report(spark, tmp_path):
    SK.write_atoms_json(results(spark), str(tmp_path / "j"), 1, 1, 2, 2)
    header = json.loads("".join(p.read_text() for p in (tmp_path / "j" / "header").glob("part-*")))
    assert header["num_states"] == 2 and header["model_parameters"] == {"U": 1, "A": 1, "P": 2, "num_objs": 2}
    u = U.predicate_usage(spark.createDataFrame([([0, 1],), ([0, 0],)], "bits array<int>"), 2)
    r = SK.usage_report(u, 2).first()
    assert (r.num_always_off, r.num_variable, r.variable[0].activation_rate) == (1, 1, 0.5)


def test_code_lines_and_tag(spark):
    df = spark.createDataFrame([([0, 1], [1, 1], 7)], "pre array<int>, suc array<int>, a int")
    assert SK.code_lines(df, "pre", "suc", action="a").first().value == "0 1 1 1 7"
    assert SK.run_tag("Net", 40, 2, 20) == "Net_U40_A2_P20" and SK.run_tag("Net", 40, 2, 20, 50) == "Net_U40_A2_P20_n50"


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark) == named.rstrip("/")
