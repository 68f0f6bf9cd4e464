"""The pipeline against a brute-force version of its stages."""

import re
import zlib

import numpy as np
import pytest
from test_jaccard_join import brute as classes
from test_line_windows import brute as deduplicated
from test_quality_cascade import brute as counts
from test_secret_owners import BARE_TOKEN, base

SF = "/root/testdata/sf0.001"


def good(text):
    n, chars, symbols, repeated, _, failed = counts(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lettered = sum(any(c.isalpha() for c in w) for w in words)
    return not (failed or 100 * symbols > 20 * n or 100 * lettered < 70 * n or 100 * repeated > 50 * len(text.split("\n")) or chars > 25 * n)


def redacted(docs):
    """docs: (id, text, owner)."""
    found, owners = {}, {}
    for d, text, owner in docs:
        spans = base(text)
        bare = [(m.start(), 3, m.end()) for m in BARE_TOKEN.finditer(text)
                if len(set(m[0])) >= 10 and not any(a < m.end() and m.start() < b for a, _, b in spans)]
        found[d] = spans, bare
        for value in [text[a:b] for a, _, b in bare] + [v for a, k, b in spans for v in [BASE_VALUE(text[a:b], k)]]:
            owners.setdefault(value, set()).add(owner)
    for d, text, _ in docs:
        spans, bare = found[d]
        out, at = "", 0
        for a, _, b in sorted(spans + [x for x in bare if len(owners[text[x[0]:x[2]]]) == 1]):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        yield d, out + text[at:]


def BASE_VALUE(match, kind):
    return re.search(r"[A-Za-z0-9+/_.=-]+$", match)[0] if kind == 0 else match


@pytest.fixture(scope="module")
def survivors(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    docs = [(r.doc_id, r.text) for r in rows if good(r.text or "")]
    docs = [(d, t) for d, t in deduplicated(docs).items() if t.strip(" \t\n\v\f\r")]
    kept = [(d, t) for (d, t), (_, _, c) in zip(docs, classes(docs)) if d == c]
    source = {r.doc_id: r.source for r in rows}
    return dict(redacted([(d, t, source[d]) for d, t in kept]))


def test_stages_return_the_columns_of_documents(spark, survivors):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in c.STAGES[:-1]:
        docs = c.written(stage(spark, docs, SF), "test")
        assert docs.columns == columns
    got = {r.doc_id: r for r in docs.collect()}
    assert {d: r.text for d, r in got.items()} == survivors
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_run_packs_what_is_left(spark, survivors):
    import corpus_pipeline as c
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(c.TOKENIZER))
    ids = {d: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4") for d, t in survivors.items()}
    pieces = c.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == set(ids) and sum(p.length for p in pieces) == sum(map(len, ids.values()))
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start:p.start + p.length].tobytes())


def test_empty_table(spark, empty):
    import corpus_pipeline as c

    docs = empty
    for _, stage in c.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_edge_rows_pass_all_stages(spark, edge):
    import corpus_pipeline as c

    docs = edge
    for _, stage in c.STAGES:
        docs = c.written(stage(spark, docs, SF), "test")
    assert docs.count() > 0
