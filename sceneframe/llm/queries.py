"""The registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sceneframe.llm import (
    byte_bpe, centroid_clusters, embedding_dedup, jaccard_join, language_id, lattice_lm, lexical_search, line_windows, packed_ids,
    quality_cascade, retrieval_packing, secret_owners, weighted_samples,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WORD_VOCABULARY = "word_bpe_49k.json"


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register("op1_secret_owners")
def op1(spark, sf_dir):
    return secret_owners.report(documents(spark, sf_dir))


@register("op8_quality_cascade", oracle=r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS word, string_split(text, chr(10)) AS line FROM t),
    spoken AS (SELECT *, list_filter(line, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM w),
    windows AS (SELECT doc_id, i, word[i] || ' ' || word[i + 1] || ' ' || word[i + 2] AS win
                FROM (SELECT doc_id, word, unnest(range(1, len(word) - 1)) AS i FROM w)),
    covered AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
                FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
    repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM covered GROUP BY doc_id),
    s AS (SELECT doc_id, len(word) AS n_words, coalesce(len(array_to_string(word, '')), 0) AS word_chars,
                 len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                 len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                 len(list_filter(word, lambda x: regexp_matches(x, '\p{L}'))) AS lettered, len(line) AS n_lines
          FROM spoken LEFT JOIN repeats USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 20 * n_words
                OR 100 * lettered < 70 * n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars > 25 * n_words) AS kept
    FROM s
""")
def op8(spark, sf_dir):
    return quality_cascade.measure(documents(spark, sf_dir))


@register("op9_packed_ids")
def op9(spark, sf_dir):
    return packed_ids.round_trip(spark, documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY))


@register("op10_retrieval_packing")
def op10(spark, sf_dir):
    return retrieval_packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY))


@register("op6_line_windows", oracle=r"""
    WITH t AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
                      generate_subscripts(string_split(text, chr(10)), 1) AS nr FROM documents),
    s AS (SELECT doc_id, line, nr, row_number() OVER (PARTITION BY doc_id ORDER BY nr) - 1 AS place
          FROM t WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    w AS (SELECT doc_id, place, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS win
          FROM s WINDOW d AS (PARTITION BY doc_id ORDER BY place)),
    f AS (SELECT *, min((doc_id, place)) OVER (PARTITION BY win) AS first FROM w WHERE win IS NOT NULL),
    c AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = first[1] THEN greatest(place, first[2] + 3) ELSE place END,
                                               place + 3)) AS place
          FROM f WHERE (doc_id, place) <> first),
    gone AS (SELECT s.doc_id, s.nr FROM s JOIN c USING (doc_id, place)),
    left_over AS (SELECT t.doc_id, string_agg(t.line, chr(10) ORDER BY t.nr) AS text, count(*) AS n
                  FROM t ANTI JOIN gone USING (doc_id, nr) GROUP BY t.doc_id)
    SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines,
           coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(l.n, 0) AS n_removed,
           CASE WHEN d.text IS NOT NULL THEN coalesce(l.text, '') END AS text
    FROM documents d LEFT JOIN left_over l USING (doc_id)
""")
def op6(spark, sf_dir):
    return line_windows.report(documents(spark, sf_dir))


@register("op7_jaccard_join")
def op7(spark, sf_dir):
    return jaccard_join.report(documents(spark, sf_dir))


@register("op3_lattice_lm")
def op3(spark, sf_dir):
    return lattice_lm.score_documents(documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY))


@register("op4_language_families")
def op4(spark, sf_dir):
    return language_id.identify(documents(spark, sf_dir))


@register("op2_byte_bpe")
def op2(spark, sf_dir):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.decode_documents(byte_bpe.encode_documents(documents(spark, sf_dir), path, pattern), path, pattern)


@register("op5_weighted_samples")
def op5(spark, sf_dir):
    return weighted_samples.fingerprints(documents(spark, sf_dir))


TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@register("op12_lexical_search", oracle=f"""
    WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents),
    g AS (SELECT count(*) FILTER (len(w) > 0) AS total, sum(len(w))::BIGINT AS length FROM d),
    tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL),
    s AS (SELECT item_id, doc_id,
                 sum(c * floor(1000 * ln((2 * total + 2) / (2 * df + 1)))::BIGINT
                     * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * total) // length))))::BIGINT AS score
          FROM q JOIN tf USING (term) JOIN df USING (term), g GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
""")
def op12(spark, sf_dir):
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def clustering_sql(rounds: int) -> str:
    """Rounds of assigning every vector and moving every centroid, written out one after the other."""
    parts = ["""kept AS (SELECT vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)::BIGINT) AS x FROM embeddings
                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: coalesce(isfinite(v), false))) = 64)""",
             "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, x AS c FROM kept QUALIFY k < 16)"]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (SELECT vec_id, x, min((d, k)) AS best FROM (
            SELECT vec_id, x, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
            FROM kept, c{r}) GROUP BY vec_id, x)""")
        if r < rounds:
            parts.append(f"""m{r} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM (
                SELECT best[2] AS k, j, sum(x[j]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(j) GROUP BY ALL) GROUP BY k),
            c{r + 1} AS (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, best[2]::INT AS cluster, best[1] AS distance, sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia,
               sum(best[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON k = best[2]"""


@register("op13_centroid_clusters", oracle=clustering_sql(centroid_clusters.ROUNDS))
def op13(spark, sf_dir):
    return centroid_clusters.clusters(embeddings(spark, sf_dir))


@register("op11_embedding_dedup", oracle="""
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
    good AS (SELECT * FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: coalesce(isfinite(c), false))) = len(x)
             AND len(list_filter(x, lambda c: c <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
          ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
    r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM c LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
""")
def op11(spark, sf_dir):
    return embedding_dedup.near_duplicates(embeddings(spark, sf_dir))
