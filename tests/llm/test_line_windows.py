"""Line dedup against brute force."""

import random

import pytest
from llm_helpers import clashing, rows

from sceneframe.llm import line_windows as w

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(docs):
    """docs: (doc_id, text) of different ids; gives the texts that are left."""
    first, out = {}, {}
    for doc, text in sorted(docs):
        lines = text.split("\n")
        spoken = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        gone = set()
        for p in range(len(spoken) - 2):
            home = first.setdefault(tuple(lines[i] for i in spoken[p:p + 3]), (doc, p))
            if home != (doc, p):
                gone |= {spoken[q] for q in range(p, p + 3) if home[0] != doc or q > home[1] + 2}
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    docs = [(d, "\n".join(rnd.choice(["a", "b", "c d", "", " ", "é"]) for _ in range(rnd.randint(0, 14)))) for d in range(60)]
    docs += [(100, "\n".join("xy" * 300)), (101, "q\n" * 900), (102, "x\ny\n" * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in w.report(df).collect()}
    for d, text in brute(docs).items():
        before = dict(docs)[d].split("\n")
        assert got[d][0] == text and got[d][1] == len(before)
    assert w.report(df).count() == len(docs)


def test_odd_inputs(edge, empty):
    done = rows(w.report(edge).select("doc_id", "text"))
    assert len(done) == edge.count() and (None, None) in done and (4, None) in done and (5, "") in done
    wide = clashing(edge)
    assert w.cleaned(wide).columns == wide.columns and {r["n"] for r in w.cleaned(wide).collect()} == {"clash"}
    assert w.report(empty).count() == 0 and w.cleaned(empty).columns == empty.columns


def test_copies_lose_their_lines_and_go(spark):
    text = "one\ntwo\nthree\nfour"
    df = spark.createDataFrame([(2, text, "", "", 0), (1, text, "", "", 0), (3, text + "\nfive", "", "", 0), (4, "", "", "", 0)], SCHEMA)
    assert rows(w.cleaned(df).select("doc_id", "text", "n_chars")) == [(1, text, len(text)), (3, "five", 4), (4, "", 0)]
