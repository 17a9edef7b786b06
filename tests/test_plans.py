"""What plans must not do twice or carry along, read off the optimized plan; and the results of the steps concerned."""

import re

import numpy as np

from quillmark.operators import candidates as cd
from quillmark.operators import ingest as ig
from quillmark.operators import merge as mg
from quillmark.operators import validate as vd


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_answer_responses_are_parsed_once(spark):
    body = '{"answers":[{"claimedLabelRaw":"Q1","text":"t","regions":[{"pageNumber":"2","x":"0.5","y":0.1,"width":0.7,"height":0.1,"kind":"blob"}]}]}'
    bodies = [(1, body), (2, body.replace("0.1", '"high"')), (3, '{"answers":'), (4, None), (5, body.replace('"2"', '"2.5"')), (6, '{"answers":[]}'), (7, '{"answers":[null]}'), (8, body.replace('"0.5"', '"Infinity"'))]
    good, bad = ig.parse_answer_responses(spark.createDataFrame(bodies, "answer_id long, body string"))
    assert plan(good).count("from_json") == 1 and plan(bad).count("from_json") == 1
    rows = good.collect()
    assert [(r.answer_id, r.ordinal, r.claimed_label_raw, r.text) for r in rows] == [(1, 0, "Q1", "t")]
    assert [tuple(x) for x in rows[0].regions] == [(2, 0.5, 0.1, 0.7, 0.1, "text")]
    found = {r.answer_id: r.reject_reason for r in bad.collect()}
    assert found == {2: "invalid item", 3: "malformed", 4: "malformed", 5: "invalid item", 7: "invalid item", 8: "invalid item"}


def test_question_responses_are_parsed_once(spark):
    body = '{"questions":[{"labelRaw":"1","text":"t","marks":"3","pageNumber":1,"rects":[{"rectPageNumber":"1","x":0,"y":0,"width":1,"height":1}]}]}'
    bodies = [(1, body), (2, body.replace('"marks":"3",', "")), (3, body.replace('"3"', '"many"')), (4, body.replace('"rectPageNumber":"1"', '"rectPageNumber":"0"')), (5, "[")]
    good, bad = ig.parse_question_responses(spark.createDataFrame(bodies, "question_id long, body string"))
    assert plan(good).count("from_json") == 1 and plan(bad).count("from_json") == 1
    assert sorted((r.question_id, r.label_raw, r.marks, r.page, len(r.rects)) for r in good.collect()) == [(1, "1", 3.0, 1, 1), (2, "1", None, 1, 1)]
    assert {r.question_id: r.reject_reason for r in bad.collect()} == {3: "invalid item", 4: "invalid item", 5: "malformed"}


def test_texts_are_judged_before_pages_are_joined(spark):
    rows = [(1, 1, "a", 1, 0.1, 0.5), (1, 2, " ", 1, 0.1, 0.5), (1, 3, "[unclear]", 1, 0.1, 0.5), (1, 4, "a", 9, 2.0, 0.5), (1, 5, "a", 1, 2.0, 0.5), (1, 6, "a", 1, 0.1, 0.0), (2, 7, "a", 1, 0.1, 0.5), (1, 8, None, 1, 0.1, 0.5)]
    readings = spark.createDataFrame([(*r, 0.1, 0.1) for r in rows], "assessment_id long, answer_id long, text string, page long, x double, width double, y double, height double")
    good, bad = vd.validate_answers(readings, spark.createDataFrame([(1, 1)], "assessment_id long, page long"))
    for df in (good, bad):
        above = plan(df.select("answer_id"))
        assert "Join" in above and not re.search(r"\btext#", above.split("Join")[0])
    assert [r.answer_id for r in good.collect()] == [1]
    assert {r.answer_id: r.reject_reason for r in bad.collect()} == {2: "no text", 3: "all unclear", 4: "page", 5: "geometry", 6: "zero area", 7: "page", 8: "no text"}


def test_pairs_with_cosines_stay_where_they_are(spark):
    vectors = [(5, [3.0, 4.0]), (7, [4.0, 3.0]), (9, [0.0, 0.0]), (5, [3.0, 4.0])]
    pairs = spark.createDataFrame([(0, 5, 5), (1, 5, 7), (2, 9, 7), (3, 5, 6), (4, None, 7), (5, 7, None)], "i long, a_vec long, q_vec long")
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    looked_up = cd.with_cosines(pairs.repartition("i"), table)
    assert "ArrowEvalPython" not in plan(looked_up)
    for df in (looked_up, cd.with_cosines(pairs, table, held_bytes=100)):
        assert np.allclose([r.cosine for r in df.orderBy("i").collect()], [1, 0.96, 0, 0, 0, 0])


def test_tokens_are_counted_without_a_join_and_only_where_a_row_has_no_label(spark):
    rows = [(1, 1, k, k % 2, f"common word{k // 2} and more", None if k < 2 else f"Q{k}") for k in range(8)] + [(1, 2, 20 + k, k, "the same text here", f"Q{k}") for k in range(2)] + [(1, 3, 30 + k, 1, "the same text here", None) for k in range(2)]
    readings = spark.createDataFrame(rows, "assessment_id long, page long, reading_id long, chunk long, text string, label_raw string")
    tokens = mg._tokens(readings).withColumnRenamed("label_raw", "key")
    assert plan(mg._text_pairs(tokens, 0.7)).count("Join ") == 1
    found = sorted(tuple(r) for r in mg.same_question_pairs(readings, page_rows=0).collect())
    assert found == sorted(tuple(r) for r in mg.same_question_pairs(readings).collect()) == [(1, 0, 1)]
