from collections import defaultdict

from quillmark.plans import queries as plans

DATA = "/root/testdata/sf0.001"


def best(rows):
    """Largest total, answer by answer, over all sets of taken questions."""
    options = defaultdict(list)
    for r in rows:
        options[r.answer_id].append((r.question_id, r.confidence))
    totals = {frozenset(): 0.0}
    for edges in options.values():
        after = dict(totals)
        for taken, total in totals.items():
            for q, c in edges:
                if q not in taken:
                    after[taken | {q}] = max(after.get(taken | {q}, 0.0), total + c)
        totals = after
    return max(totals.values())


def test_every_assessment_has_its_best_total(spark):
    groups = defaultdict(list)
    for r in plans.edges(spark, DATA).collect():
        groups[r.assessment_id].append(r)
    got = {r.assessment_id: r.total for r in plans.QUERIES["decide_all_totals"](spark, DATA).collect()}
    small = plans.QUERIES["decide_best_totals"](spark, DATA).count()
    spark.catalog.clearCache()
    assert got.keys() == groups.keys()
    assert all(abs(got[k] - best(rows)) < 2e-6 for k, rows in groups.items())
    print("assessments", len(got), "of which decide_best_totals has", small)
    assert max(len({r.answer_id for r in rows}) for rows in groups.values()) > 3
