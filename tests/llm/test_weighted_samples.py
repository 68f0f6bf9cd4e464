"""Fingerprints: collision rate against the exact generalised Jaccard similarity, next documents, odd inputs."""

import hashlib
import re
from collections import Counter

import numpy as np
from llm_helpers import clashing, rows

from sceneframe.llm import weighted_samples as w


def terms(text):
    word = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return Counter(tuple(word[i:i + 5]) for i in range(max(1, len(word) - 4))) if word else Counter()


def similarity(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


def expected(docs):
    """docs in order: (doc_id, text)."""
    for (d, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        yield d, len(text), hashlib.sha256(edited.encode()).hexdigest(), similarity(terms(text), terms(edited)), similarity(terms(text), terms(following))


def test_likeness_is_generalised_jaccard(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = sorted((r.doc_id, r.text) for r in df.collect())
    got = {r.doc_id: r for r in w.fingerprints(df, ranges=7).collect()}
    errors, noise = [], []
    for d, n, sha, edited, following in expected(docs):
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (n, sha) and len(r.fingerprint) in (0, 4 * w.SAMPLES)
        errors.append(r.near_edited - edited)
        noise.append(edited * (1 - edited) / w.SAMPLES)
        assert abs(r.near_next - following) < 0.35
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.3 * np.sqrt(np.mean(noise))


def test_weights_count(spark):
    # the shingles of "a" * n and "a" * m are one term of different weights
    df = spark.createDataFrame([(k, " ".join(["a"] * (4 + n)) + ".") for k, n in enumerate([10, 20] * 30)], "doc_id long, text string")
    near = [r.near_next for r in w.fingerprints(df).collect()]
    exact = similarity(terms("a " * 13 + "a."), terms("a " * 23 + "a."))
    assert abs(np.mean(near) - exact) < 0.2


def test_enough_samples(spark):
    df = spark.createDataFrame([(7, "one two three four five six seven")], "doc_id long, text string")
    got = w.fingerprints(df).first().fingerprint
    samples = [got[i:i + 4] for i in range(0, len(got), 4)]
    assert len(samples) >= 48 and len(set(samples)) > 40


def test_odd_inputs(edge, edge_rows, empty):
    got = w.fingerprints(clashing(edge), ranges=5).collect()
    assert len(got) == len(edge_rows) and w.fingerprints(empty).count() == 0
    plain = {r.doc_id: r for r in got}
    assert plain[4].fingerprint == plain[5].fingerprint == plain[6].fingerprint == ""
    assert plain[1].fingerprint == plain[10].fingerprint != plain[7].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_a_lone_document_is_its_own_next(spark):
    df = spark.createDataFrame([(7, "one two three four five six")], "doc_id long, text string")
    assert w.fingerprints(df).first().near_next == 1.0


def test_ranges_do_not_matter(edge):
    assert rows(w.fingerprints(edge, ranges=1)) == rows(w.fingerprints(edge, ranges=9))


def test_native(edge):
    plan = w.fingerprints(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
