"""Literal edge cases: ties, padding, rounding, thresholds, guards."""

import pytest
from scene_helpers import rows
from pyspark.sql import functions as F

from sceneframe.functions import boxes as B
from sceneframe.functions import codes as C
from sceneframe.functions import text as T
from sceneframe.operators import actions as A
from sceneframe.operators import atoms as L
from sceneframe.operators import curves as K
from sceneframe.operators import ordering as O
from sceneframe.operators import profile as P
from sceneframe.operators import rowsets as Z
from sceneframe.operators import sampling as SA
from sceneframe.operators import slots as S
from sceneframe.operators import transitions as R
from sceneframe.operators import trials as TR
from sceneframe.operators import usage as U
from sceneframe.plans.scenes import scene_slots
from sceneframe.sources import trials as TL


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def detections(spark, objects):
    """objects: (state, pos, category, area)"""
    data = [(s, p, c, 0, 0, a, 1, 900, 600) for s, p, c, a in objects]
    return spark.createDataFrame(
        data, "state_id string, pos int, category string, xmin int, ymin int, xmax int, ymax int, width int, height int")


def names(df):
    return [r["name"] for r in df.orderBy("slot").collect()]


def test_equal_areas_keep_input_order(spark):
    d = detections(spark, [("s", 1, "b", 5), ("s", 0, "a", 5)])
    assert names(scene_slots(d))[:2] == ["a", "b"]


def test_twelve_objects_are_cut_before_naming(spark):
    d = detections(spark, [("s", i, "dog" if i in (0, 11) else f"c{i}", 100 - i) for i in range(12)])
    got = names(scene_slots(d))
    assert len(got) == 10 and got[0] == "dog"


def test_single_object_is_padded(spark):
    assert names(scene_slots(detections(spark, [("s", 0, "dog", 9)]))) == ["dog"] + [f"pad_{i}" for i in range(1, 10)]


def test_repeated_classes_are_numbered_by_slot(spark):
    d = detections(spark, [("s", 0, "cat", 30), ("s", 1, "dog", 20), ("s", 2, "cat", 10)])
    assert names(scene_slots(d))[:3] == ["cat_0", "dog", "cat_1"]
    assert names(scene_slots(d, unique=False))[:3] == ["cat", "dog", "cat"]


def test_unknown_track_and_last_subject_wins(spark):
    subjects = spark.createDataFrame([("v", 1, "old", 0), ("v", 1, "new", 1)], "video_id string, tid int, category string, pos int")
    d = spark.createDataFrame([("v", 1), ("v", 7)], "video_id string, tid int")
    assert rows(S.name_objects(d, S.subject_categories(subjects)).select("tid", "name")) == [(1, "new"), (7, "obj7")]


def test_clamp_marks_inverted_boxes(spark):
    box = one(spark, B.clamp_box(*[F.lit(x) for x in (10.7, -3.0, 5.0, 999.0, 640, 480)]))
    assert (box.x1, box.y1, box.x2, box.y2, box.degenerate) == (10, 0, 5, 480, True)


def test_right_edge_lands_in_last_bin(spark):
    edge = B.scale_to_canvas(F.lit(640), F.lit(640), 300)
    assert one(spark, edge) == 299 and one(spark, B.grid_bin(edge)) == 59


def test_padding_box_has_four_ones(spark):
    zero = F.lit(0)
    code = list(one(spark, B.onehot_boxes(zero, zero, zero, zero)))
    assert len(code) == 200 and [i for i, v in enumerate(code) if v] == [0, 60, 100, 160]


def test_empty_center_box_is_null(spark):
    assert one(spark, B.center_box_to_corners(F.lit(0.5), F.lit(0.5), F.lit(0.0), F.lit(0.2))) is None
    box = one(spark, B.center_box_to_corners(F.lit(0.5), F.lit(0.5), F.lit(0.001), F.lit(0.001)))
    assert (box.x2 - box.x1, box.y2 - box.y1) == (1, 1)


def test_half_bits_round_to_even(spark):
    assert list(one(spark, C.round_bits(F.array(*[F.lit(x) for x in (0.5, 1.5, 2.5)])))) == [0, 2, 2]


def test_attention_tie_takes_the_first(spark):
    w = F.array(*[F.lit(x) for x in (0.1, 0.45, 0.45)])
    assert one(spark, C.argmax_first(w)) == 1 and list(one(spark, C.hard_onehot(w))) == [0, 1, 0]


def bound(spark, bits, attention, names=None):
    df = spark.createDataFrame([(0, bits, attention, names)], "s int, bits array<int>, attention array<array<array<double>>>, names array<string>")
    return L.bind_arguments(df)


def test_threshold_is_inclusive_and_negation_is_marked(spark):
    b = bound(spark, [0, 1], [[[0.5, 0.3], [0.2, 0.6]]], ["a", "b"])
    got = rows(L.atoms(b, "s", 2, "names", threshold=0.5).select("atom_str", "value"))
    assert got == [("pred_1(a, b)", True), ("~pred_0(a, b)", False)]
    assert L.atoms(b, "s", 2, "names", threshold=0.51).count() == 0


def test_short_name_lists_fall_back(spark):
    b = bound(spark, [1, 1], [[[0.1, 0.9]]], ["a"])
    got = rows(L.atoms(b, "s", 2, "names", predicate_names=["near"], threshold=0.0).select("atom_str"))
    assert got == [("near(obj_1)",), ("pred_1(obj_1)",)]


def test_usage_classes_at_the_bounds(spark):
    rates = [995, 5, 990, 10]
    data = [([int(i < r) for r in rates],) for i in range(1000)]
    u = U.predicate_usage(spark.createDataFrame(data, "bits array<int>"), 2).orderBy("unit", "predicate")
    assert [r.usage for r in u.collect()] == ["always_on", "always_off", "variable", "variable"]
    totals = U.usage_totals(u).first()
    assert totals.num_always_on + totals.num_always_off + totals.num_variable == 4


def test_action_effects_and_application(spark):
    t = spark.createDataFrame([(0, 3, [0, 1, 0], [1, 0, 0])], "pre_id int, action int, pre array<int>, suc array<int>")
    e = A.action_effects(t)
    assert rows(e) == [(3, 0, 1, 0), (3, 1, 0, 1), (3, 2, 0, 0)]
    r = A.predict_successors(t, e).first()
    assert list(r.predicted) == list(r.suc)


def test_union_keeps_duplicates_of_the_right_side(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "x int") for xs in ([1, 2, 2], [2, 2, 3]))
    assert rows(Z.union(a, b)) == [(1,), (2,), (2,), (3,)]


def flat_curve(spark, n):
    return spark.range(n).select(F.lit("r").alias("run"), F.col("id").alias("epoch"), F.lit(0.5).alias("loss"))


@pytest.mark.parametrize("chunk", [3, 7, 20, 1000])
def test_flat_curve_stops_at_the_21st_epoch(spark, chunk):
    assert K.plateau_stop(flat_curve(spark, 30), "run", "epoch", "loss", chunk=chunk).first().stop_epoch == 20
    assert K.plateau_stop(flat_curve(spark, 20), "run", "epoch", "loss", chunk=chunk).first().stop_epoch is None
    assert K.gradient_stop(flat_curve(spark, 30), "run", "epoch", "loss", chunk=chunk).first().stop_epoch == 20
    assert K.high_value_stop(flat_curve(spark, 30), "run", "epoch", "loss", start=25, chunk=chunk).first().stop_epoch == 25


def test_stops_count_observations_whatever_the_chunk(spark):
    # every fifth epoch from 50 on: the 21st observation is at epoch 150
    log = spark.range(30).select(F.lit("r").alias("run"), (50 + 5 * F.col("id")).alias("epoch"), F.lit(0.5).alias("loss"))
    for chunk in (3, 40, 100_000):
        assert K.plateau_stop(log, "run", "epoch", "loss", chunk=chunk).first().stop_epoch == 150
        assert K.plateau_stop(log.where("epoch < 65"), "run", "epoch", "loss", chunk=chunk).first().stop_epoch is None


def test_schedules(spark):
    at = lambda f, e: one(spark, f(F.lit(e), {5: 1.0, 10: 3.0}))
    assert [at(K.step_schedule, e) for e in (0, 5, 9, 10)] == [1.0, 1.0, 1.0, 3.0]
    assert [at(K.linear_schedule, e) for e in (0, 5, 7, 10, 99)] == [1.0, 1.0, pytest.approx(1.8), 3.0, 3.0]


def frames(spark, *keys):
    return spark.createDataFrame([(v, f) for v, fs in keys for f in fs], "video string, fid int")


def test_gaps_do_not_break_pairs(spark):
    f = frames(spark, ("a", [0, 3, 9]), ("b", [4]))
    for chunk in (1, 2, 4, 100):
        assert rows(R.sequential_in_group(f, "video", "fid", chunk)) == [("a", 0, 3), ("a", 3, 9)]


def test_two_category_video_counts_once_in_total(spark):
    subjects = spark.createDataFrame([("v", "dog"), ("v", "person"), ("w", "dog")], "video_id string, category string")
    f = spark.createDataFrame([("v",)] * 3, "video_id string")
    got = rows(P.viability(subjects, f, threshold=2))
    assert got == [("dog", 2, 1, 3, 2, True), ("person", 1, 1, 3, 2, True)]
    assert tuple(P.viability_total(f, 2).first()) == (1, 3, 2, True)


def test_primary_tie_goes_to_the_larger_area_then_to_the_first(spark):
    schema = "video_id string, fid int, pos int, tid int, xmin int, ymin int, xmax int, ymax int"
    cats = spark.createDataFrame([("v", 1, "cat"), ("v", 2, "dog"), ("w", 1, "cat"), ("w", 2, "dog")], "video_id string, tid int, category string")
    d = spark.createDataFrame([("v", 0, 0, 1, 0, 0, 10, 1), ("v", 0, 1, 2, 0, 0, 20, 1),
                               ("w", 0, 1, 1, 0, 0, 5, 1), ("w", 0, 0, 2, 0, 0, 5, 1)], schema)
    videos = spark.createDataFrame([("v",), ("w",), ("x",)], "video_id string")
    assert rows(P.primary_category(d, cats, videos)) == [("v", "dog"), ("w", "dog"), ("x", None)]


def test_small_sets_are_in_all_splits(spark):
    for n, expected in ((99, {"train": 99, "val": 99, "test": 99}), (100, {"train": 90, "val": 5, "test": 5})):
        placed = spark.range(n).withColumnRenamed("id", "position")
        got = {r.split: r["count"] for r in R.positional_split(placed, small_set=R.SMALL_SET).groupBy("split").count().collect()}
        assert got == expected


@pytest.mark.parametrize("text, objects", [
    ('no json', []),
    ('<|im_start|>user {"class":"p","bbox":[1]}<|im_end|><|im_start|>assistant [{"class":"a","bbox":[1,2,3,4],}, {"class":"b"', [("a", [1.0, 2.0, 3.0, 4.0])]),
    ('{"label":"","class":"b","bbox_2d":[],"bbox":[]}', [("b", [])]),
    ('{"class":"x"}{"bbox":[1]}{"class" "y"}', []),
    ('```json [{"label":"l","class":"c","bbox_2d":[1.5],"bbox":[2]}] ```', [("l", [1.5])]),
])
def test_answer_parsing(spark, text, objects):
    got = one(spark, T.parse_answer_objects(F.lit(text)))
    assert [(o["class"], list(o["bbox"])) for o in got] == objects


def test_job_log(spark):
    jobs = spark.createDataFrame([("1-02:00:00", "2048M"), ("00:00:10", "1G"), ("", "9999G")], "elapsed string, max_rss string")
    r = P.run_sizing_from_history(jobs).first()
    assert (r.runs, r.max_seconds, r.max_mb) == (2, 93600, 2048)
    assert (r.request_seconds, r.request_mb, r.request_gb) == (118800, 16384, 16)


def test_odd_job_log_rows(spark):
    jobs = spark.createDataFrame([("05:30", "1G"), ("40", "xG"), ("soon", "2G"), ("1:2:3:4", "1G")], "elapsed string, max_rss string")
    assert P.run_sizing_from_history(jobs).first().max_seconds == 330


def test_trial_log_keeps_nan_and_reports_what_it_cannot_read(spark):
    lines = spark.createDataFrame([('[0.5, {"a": "x"}, {}]',), ('[NaN, {"a": "y"}, {}]',), ("[oops",)], "value string")
    got = {(r.config or {}).get("a"): r for r in TL.parse_trial_lines(lines).collect()}
    assert got["x"].eval == 0.5 and got["y"].eval != got["y"].eval and got[None].malformed == "[oops"


def test_manifest_guard_raises(spark):
    m = spark.createDataFrame([("dog",)], "category_filter string")
    assert P.manifest_guard(m, "dog").count() == 1
    with pytest.raises(Exception, match="requested cat"):
        P.manifest_guard(m, "cat").collect()


def test_balance_and_calibration_guards(spark):
    r = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.9), (3, 0, 0.1)], "id int, label int, score double")
    assert SA.class_balance(r, "label").first().ratio == 2.0
    assert rows(SA.calibrate_scores(r, "score", "label").select("id", "calibrated")) == [(1, 1.0), (2, 1.8), (3, 0.2)]
    with pytest.raises(Exception, match="outnumber"):
        SA.class_balance(r.where("id < 3"), "label").collect()
    with pytest.raises(Exception, match="no labelled positives"):
        SA.calibrate_scores(r.where("label = 0"), "score", "label").collect()


def test_positions_are_dense_with_a_hot_key(spark):
    hot = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 9).alias("k"), F.col("id"))
    placed = O.natural_position(hot, ["k", "id"], partitions=7).orderBy("k", "id").collect()
    assert [r.position for r in placed] == list(range(1000))
    hashed = O.hashed_position(hot, ["id"], seed=3)
    assert sorted(r.position for r in hashed.select("position").collect()) == list(range(1000))


def test_sample_is_the_start_of_the_hash_order(spark):
    df = spark.range(500)
    first = df.orderBy(O.stable_hash("id", seed=5), "id").limit(40)
    assert rows(SA.sample_rows(df, ["id"], 40, 5)) == rows(first)
    assert len(rows(SA.sample_rows(df, ["id"], 900, 5))) == 500


@pytest.mark.parametrize("negatives, bags", [(10, 3), (2, 4), (4, 4), (0, 2)])
def test_bags_hold_every_negative_once(spark, negatives, bags):
    r = spark.range(negatives + 3).select("id", F.when(F.col("id") < 3, 1).otherwise(0).alias("label"))
    dealt = SA.assign_bags(r, ["id"], "label", bags, 1)
    sizes = {b: n for b, n in rows(dealt.where("label = 0").groupBy("bag").count())}
    assert sum(sizes.values()) == negatives and all(0 <= b < bags for b in sizes)
    assert max(sizes.values(), default=0) - min((sizes.get(b, 0) for b in range(bags))) <= 1
    assert dealt.where("label = 1").count() == 3 * bags


def test_trials_skip_failures_and_reraise_others(spark):
    c = spark.createDataFrame([(i, {"x": str(i)}) for i in range(4)], "trial int, config map<string,string>")

    def task(config):
        if config["x"] == "2":
            raise ValueError("invalid")
        return float(config["x"])

    done = TR.run_trials(c, task, "trial")
    assert rows(done) == [(0, 0, 0.0, None), (1, 0, 1.0, None), (2, 0, None, "ValueError: invalid"), (3, 0, 3.0, None)]
    assert TR.best_trial(done, order="trial", keep=["repeat"]).first().trial == 0
    with pytest.raises(Exception, match="boom"):
        def broken(config):
            raise RuntimeError("boom")

        TR.run_trials(c, broken, "trial").collect()


def test_best_trial_keeps_the_earliest_on_ties(spark):
    t = spark.createDataFrame([(2, 0.5, {"a": "z"}), (1, 0.5, {"a": "y"}), (0, 0.9, {"a": "x"})], "trial int, eval double, config map<string,string>")
    assert TR.best_trial(t).first().trial == 1


def test_config_key_ignores_entry_order_and_tells_scalars_apart(spark):
    m = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    assert one(spark, T.config_key(m("a", "1", "b", "2"))) == one(spark, T.config_key(m("b", "2", "a", "1")))
    assert one(spark, T.config_key(m("a", "1"))) != one(spark, T.config_key(m("a", "2")))


def test_legal_needs_pair_and_both_states(spark):
    obs = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "pre int, suc int")
    legal = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "pre int, suc int")
    valid = spark.createDataFrame([(1,), (2,)], "s int")
    assert rows(R.legal_transitions(obs, legal, valid, "s").select("pre", "suc", "is_legal")) == [(1, 2, True), (1, 3, False), (2, 1, False)]
