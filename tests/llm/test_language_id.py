"""Language identification: held-out accuracy, odd inputs."""

import random

import pytest
from llm_helpers import clashing

from sceneframe.llm import language_id as l

SYLLABLES = {"en": "the ing tion and ly er".split(), "de": "ung heit sch der keit ein".split(), "fr": "eau tion ment les oi aux".split(),
             "es": "ción mente os las rr ado".split(), "xx": "qqa zzo kku wwi ttu".split()}


def texts(lang, seed, n=40):
    rnd = random.Random(f"{lang}{seed}")
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(k, texts(lang, k), lang, "s", 1) for k, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(1000, None, "en", "s", 0), (1001, "", "de", "s", 0), (1002, " 12 ?! ", "fr", "s", 0), (1003, texts("es", 1), None, "s", 0),
             (None, texts("de", 2), "de", None, None), (1004, texts("fr", 3, 20_000), "fr", "s", 0), (1005, "É", "fr", "s", 0)]
    return spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def predicted(labelled):
    return l.identify(clashing(labelled)).collect()


def test_held_out_accuracy(labelled, predicted):
    lang = {r.doc_id: r.lang for r in labelled.collect()}
    test = [r for r in predicted if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(test) > 30 and sum(r.lang_pred == lang[r.doc_id] for r in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in predicted)


def test_odd_inputs(labelled, predicted, empty):
    got = {r.doc_id: r for r in predicted}
    assert len(predicted) == labelled.count()
    assert all((got[d].lang_pred, got[d].score) == ("und", 0.0) for d in (1000, 1001, 1002))
    assert got[1003].lang_pred == "es" and got[1004].lang_pred == "fr" and got[1005].lang_pred != "und"
    assert got[None].held_out and got[None].lang_pred == "de"
    assert l.identify(empty).count() == 0


def test_without_labels_all_is_undetermined(labelled):
    from pyspark.sql import functions as F

    assert {r.lang_pred for r in l.identify(labelled.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_sample_is_bounded(labelled):
    sizes = l.sample(labelled, "text", "doc_id", "lang", 7).groupBy("lang").count().collect()
    assert sizes and all(0 < r["count"] <= 7 for r in sizes)
