"""Quality cascade: counts against brute force, the verdict whatever the order, odd inputs."""

import re
from collections import Counter

from llm_helpers import clashing, rows

from sceneframe.llm import quality_cascade as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    covered = {p for i, g in enumerate(grams) if times[g] > 1 for p in (i, i + 1, i + 2)}
    spoken = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(spoken) - len(set(spoken)), len(covered), failed)


def test_counts_equal_brute_force(edge, edge_rows):
    got = sorted(((r.doc_id, *r[1:7]) for r in q.measure(edge).collect()), key=repr)
    assert got == sorted(((r[0], *brute(r[1])) for r in edge_rows), key=repr)


def test_verdict_does_not_depend_on_the_order(edge):
    rules = q.base_rules() + q.text_rules()
    kept = [rows(q.with_words(edge).filter(q.passes(order)).select("_row.*")) for order in (rules, rules[::-1])]
    assert kept[0] == kept[1] == rows(q.keep(edge))


def test_cheap_selective_rules_come_first(spark, edge):
    ordered, measured = q.plan_cascade(edge, q.base_rules() + q.text_rules())
    rate = [m.rejected / m.seconds for m in measured]
    assert rate == sorted(rate, reverse=True) and len(ordered) == 6


def test_empty_table_and_clashing_columns(edge, empty):
    assert q.measure(empty).count() == 0 and q.keep(empty).count() == 0
    wide = clashing(edge)
    assert q.keep(wide).columns == wide.columns
    assert rows(q.keep(wide).select(*edge.columns)) == rows(q.keep(edge))
    assert {r["_text"] for r in q.keep(wide).collect()} == {"clash"}


def test_native(edge):
    plan = q.measure(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "hashpartitioning" not in plan
