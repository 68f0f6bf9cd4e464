"""Values cut from byte ranges against a whole-file parse."""

import json
import random

import pytest
from scene_helpers import rows

from sceneframe.sources import annotations as AN
from sceneframe.sources import json_values as J
from sceneframe.sources import trials as TL


def random_value(rnd, deep=3):
    text = lambda: "".join(rnd.choices('ab"\\[]{},\n é😀:', k=rnd.randint(0, 9)))
    kind = rnd.randint(0, 6 if deep else 3)
    if kind == 4:
        return [random_value(rnd, deep - 1) for _ in range(rnd.randint(0, 4))]
    if kind > 4:
        return {text(): random_value(rnd, deep - 1) for _ in range(rnd.randint(0, 4))}
    return [text(), rnd.randint(-5, 5), None, 0.5][kind]


@pytest.fixture
def small_splits(spark):
    """Byte ranges of 300 bytes, so that small files are read by many tasks."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "300")
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("seed", range(40))
def test_every_cut_of_a_text_gives_the_same_values(seed):
    """Scanning in chunks of any size and composing their transitions equals one scan."""
    rnd = random.Random(seed)
    values = [random_value(rnd) for _ in range(rnd.randint(0, 12))]
    elements = seed % 2 == 0
    kept = [v for v in values if isinstance(v, (list, dict))]
    text = json.dumps(values, indent=rnd.choice([None, 1]), ensure_ascii=seed % 3 == 0) if elements else rnd.choice(["", " ", "\n"]).join(map(json.dumps, kept))
    size = rnd.choice([1, 2, 3, 7, 50, 10_000])
    text = text.encode()
    state, depth, ordinal, parts = J.OUTSIDE, 0, 0, {}
    for at in range(0, len(text), size):
        chunk = text[at:at + size]
        for n, piece, _ in J.pieces(chunk, state, depth, ordinal, elements):
            parts[n] = parts.get(n, b"") + piece
        move = J.transitions(chunk, elements)[state]
        ordinal += dict(move["marks"]).get(-depth, 0)
        state, depth = move["state"], depth + move["delta"]
    got = [json.loads(parts[n]) for n in sorted(parts) if parts[n].strip()]
    assert got == (values if elements else kept) and (state, depth) == (J.OUTSIDE, 0)


def test_one_array_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rnd = random.Random(1)
    data = [{"image": f'{k}"}}{{[].jpg', "objects": [{"class": rnd.choice(["a}", "\\", "é,"]), "bbox": [k, 1, 2, 3.5]}] * (k % 3)} for k in range(400)]
    (tmp_path / "labels.json").write_text(json.dumps(data, indent=2, ensure_ascii=False))
    got = AN.read_labeled_images(spark, str(tmp_path), skip_empty=False)
    assert [(r.ord, r.image, len(r.objects)) for r in got.orderBy("ord").collect()] == [(k, d["image"], k % 3) for k, d in enumerate(data)]
    assert AN.read_labeled_images(spark, str(tmp_path), max_images=10, skip_empty=False).count() == 10
    chunks = J._chunks(spark, str(tmp_path), True, J.CHUNK)
    assert chunks.select("block").distinct().count() > 50
    whole = spark.read.schema(AN.IMAGE_SCHEMA).option("multiLine", True).json(str(tmp_path))
    assert rows(got.drop("ord")) == rows(whole)


def test_a_log_with_brackets_in_strings_and_values_over_lines(spark, tmp_path, small_splits):
    log = [[0.5, {"a": "x] [y", "b": '"]}['}, {}], [0.25, {"a": "\\"}, {"d": [1, {"e": "}"}]}]] * 40 + [[1e-7, {"a": "last"}, {}]]
    text = "".join(json.dumps(v, indent=k % 3 or None) + ["", "\n", "  "][k % 3] for k, v in enumerate(log))
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "b.log").write_text('[NaN, {"a": "n"}, {}]\n[0.125, {"a": "cut"\n[3, {"a": "after"}, {}]\noops')
    got = TL.read_trial_log(spark, str(tmp_path)).orderBy("line", "malformed").collect()
    good = [(r.line, r.eval, r.config["a"]) for r in got if r.config and r.line < len(log)]
    assert good == [(k, v[0], v[1]["a"]) for k, v in enumerate(log)]
    rest = [r for r in got if r.line >= len(log)]
    assert [(r.line, r.config, r.malformed) for r in rest[1:]] == [(82, {"a": "after"}, None), (82, None, '[0.125, {"a": "cut"')]
    assert (rest[0].line, rest[0].config) == (81, {"a": "n"}) and rest[0].eval != rest[0].eval


@pytest.mark.parametrize("text,want", [("", []), ("[]", []), (" \n", []), ("[1]", ["1"]), ('["}"]', ['"}"']), ('[{"a":1}]\n', ['{"a":1}']), ("[1][2,3]", ["1", "2", "3"])])
def test_small_files(spark, tmp_path, text, want):
    (tmp_path / "x.json").write_text(text)
    assert [r.text for r in J.read_json_values(spark, str(tmp_path), elements=True).orderBy("ordinal").collect()] == want


def test_objects_back_to_back_end_with_or_without_a_brace(spark, tmp_path):
    for name, text in (("a", '{"k": {}}'), ("b", '{"k": 1}{"k": 2}\n'), ("c", '[{"k": 3}]')):
        (tmp_path / name).write_text(text)
    got = J.read_json_values(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.text) for r in got] == [(0, '{"k": {}}'), (1, '{"k": 1}'), (2, '{"k": 2}'), (3, '[{"k": 3}]')]


def test_a_surplus_bracket_is_named(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"a": 1}]] [{"b": 2}]')
    with pytest.raises(Exception, match="not opened"):
        J.read_json_values(spark, str(tmp_path)).count()


def test_a_chunk_is_searched_once_for_both_states(monkeypatch):
    calls, marks = [], J._marks
    monkeypatch.setattr(J, "_marks", lambda *a: calls.append(a) or marks(*a))
    text = rb'{"a": "x\"}, [", "b": [1, 2]}, {"c": "\\"}'
    moves = J.transitions(text, True)
    assert len(calls) == 1
    assert moves == [J.transition(text, s, True) for s in (J.OUTSIDE, J.STRING, J.ESCAPED)]
