import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.config import Config
from quillmark.functions import hooks
from quillmark.operators import candidates as cd
from quillmark.operators import grading as gr
from quillmark.operators import ingest as ig
from quillmark.operators import matching as mt
from quillmark.operators import merge as mg
from quillmark.operators import review as rv


def brute(w):
    n, m = w.shape
    best = 0.0
    for pick in itertools.product(range(-1, m), repeat=n):
        used = [p for p in pick if p >= 0]
        if len(used) == len(set(used)):
            best = max(best, sum(w[i, p] for i, p in enumerate(pick) if p >= 0))
    return best


def total(w):
    options = [[(j, round(x * 1_000_000)) for j, x in enumerate(row) if x > 0] for row in w]
    got = mt.best_assignment(options, w.shape[1])
    used = [j for j in got if j >= 0]
    assert len(used) == len(set(used))
    return sum(w[i, j] for i, j in enumerate(got) if j >= 0)


def test_best_assignment_equals_brute_force():
    for w, want in (([[0.9, 0.1], [0.2, 0.8]], 1.7), ([[0.92, 0.9], [0.91, 0.3]], 1.81), ([[0.4]], 0.4)):
        assert abs(total(np.array(w)) - want) < 1e-9
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m = rng.integers(1, 6), rng.integers(1, 6)
        w = np.round(rng.random((n, m)), int(rng.integers(1, 3))) * (rng.random((n, m)) < 0.7)
        assert abs(total(w) - brute(w)) < 1e-9


def test_assignment_does_not_depend_on_how_an_assessment_is_split(spark):
    rng = random.Random(3)
    rows = [(b, b * 100 + a, b * 100 + q, rng.choice([0.4, 0.5, 0.75, 0.9])) for b in range(3) for a in range(30) for q in rng.sample(range(30), 2)]
    rows += [rows[0], (1, None, 5, 0.9), (1, 5, None, 0.9), (1, 100, 101, None), (9, 1, 1, 0.2)]
    edges = spark.createDataFrame(rows, "assessment_id long, answer_id long, question_id long, confidence double")
    whole, split = sorted(mt.assign_one_to_one(edges).collect()), sorted(mt.assign_one_to_one(edges.repartition(7), whole_edges=5).collect())
    assert whole == split and {r.assessment_id for r in whole} == {0, 1, 2}
    safe, rest = mt.settle_safe_edges(edges.dropna().where("confidence >= 0.35").distinct())
    assert set(safe.collect()) <= set(whole) and rest.count() > 0


def test_assignment_of_many_blocks_beats_greedy(spark):
    rng = random.Random(2)
    rows = [(b, b * 10 + a, b * 10 + q, round(rng.random(), 3)) for b in range(60) for a in range(4) for q in rng.sample(range(4), 3)]
    edges = spark.createDataFrame(rows, "assessment_id long, answer_id long, question_id long, confidence double")
    best, greedy = mt.assign_one_to_one(edges).collect(), mt.greedy_assignment(edges).collect()
    for got in (best, greedy):
        assert len({r.answer_id for r in got}) == len(got) == len({r.question_id for r in got}) and all(r.confidence >= 0.35 for r in got)
    for b in range(60):
        w = np.zeros((4, 4))
        for x, a, q, c in rows:
            if x == b and c >= 0.35:
                w[a - b * 10, q - b * 10] = c
        mine = sum(r.confidence for r in best if r.assessment_id == b)
        assert abs(mine - brute(w)) < 1e-6 and mine >= sum(r.confidence for r in greedy if r.assessment_id == b) - 1e-9
    assert mt.assign_one_to_one(edges.limit(0)).count() == 0


def test_chunk_plan(spark):
    cases = {(2, 4, 1): [[1, 2]], (4, 4, 1): [[1, 2, 3, 4]], (10, 4, 1): [[1, 2, 3, 4], [4, 5, 6, 7], [7, 8, 9, 10]], (8, 4, 0): [[1, 2, 3, 4], [5, 6, 7, 8]], (7, 4, 1): [[1, 2, 3, 4], [4, 5, 6, 7]]}
    for (n, size, overlap), want in cases.items():
        pages = spark.createDataFrame([(1, p) for p in range(n, 0, -1)], "document_id long, page long")
        got = mg.plan_chunks(pages, size, overlap).groupBy("chunk").agg(F.array_sort(F.collect_list("page")).alias("p")).orderBy("chunk").collect()
        assert [r.p for r in got] == want
        assert mg.spanning_violations(pages, mg.plan_chunks(pages, size, overlap), overlap + 1).count() == 0
    with pytest.raises(ValueError):
        mg.plan_chunks(pages, 2, 2)


def test_dedupe_regions_keeps_the_first_of_each_place(spark):
    rows = [(1, 0.1, 0.1, 0.4, 0.1), (1, 0.11, 0.1, 0.4, 0.1), (2, 0.1, 0.1, 0.4, 0.1), (1, 0.5, 0.1, 0.4, 0.1)]
    df = spark.createDataFrame([(rows,)], "r array<struct<page: int, y: double, x: double, width: double, height: double>>")
    for questions in (False, True):
        got = df.select(mg.dedupe_regions(F.col("r"), questions).alias("k")).first().k
        assert [(r.page, r.y) for r in got] == [(1, 0.1), (1, 0.5), (2, 0.1)]


def test_groups_join_the_first_match_and_never_merge_later(spark):
    readings = spark.createDataFrame([(1, 10, 0), (1, 20, 1), (1, 30, 2), (1, 40, 2)], "assessment_id long, reading_id long, chunk long")
    pairs = spark.createDataFrame([(1, 10, 30), (1, 20, 30)], "assessment_id long, first long, second long")
    got = {r.reading_id: r.group_id for r in mg.group_readings(readings, pairs).collect()}
    assert got == {10: 10, 20: 20, 30: 10, 40: 40}


def test_review_actions_in_order(spark):
    reviews = spark.createDataFrame([(5, 1, 11), (5, 2, 12)], "assessment_id long, answer_id long, original_question_id long")
    questions = spark.createDataFrame([(5, q) for q in (11, 12, 13)], "assessment_id long, question_id long")
    acts = [(1, 1, "SKIP", None), (2, 1, "SKIP", None), (3, 1, "REMAP", 12), (4, 1, "REMAP", 99), (5, 2, "REJECT", None), (6, 1, "REMAP", 12), (7, 1, "REMAP", 12), (8, 1, "ACCEPT", None), (9, 7, "ACCEPT", None), (10, 2, "REMAP", None)]
    log = spark.createDataFrame([(5, a, e, x, t) for e, a, x, t in acts], "assessment_id long, answer_id long, event_id long, action string, target long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    got = rv.apply_review_actions(reviews, questions, log).orderBy("step").collect()
    assert [r.outcome for r in got] == ["APPLIED", "REPEAT", "QUESTION_ALREADY_ASSIGNED", "UNKNOWN_QUESTION", "APPLIED", "APPLIED", "REPEAT", "CONFLICT_SETTLED", "NOT_FOUND", "CONFLICT_SETTLED"]
    states = {r.answer_id: (r.status, r.action, r.target) for r in rv.review_states(reviews, spark.createDataFrame(got, rv.OUTCOMES)).collect()}
    assert states == {1: ("RESOLVED", "REMAP", 12), 2: ("RESOLVED", "REJECT", None)}


def test_unreadable_readings_pass_through(spark):
    readings = spark.createDataFrame([(1, 10, 0, "a"), (1, 20, 1, "a"), (1, 30, 1, " [unclear] "), (1, 40, 2, None)], "assessment_id long, reading_id long, chunk long, text string")
    pairs = spark.createDataFrame([(1, 10, 20), (1, 10, 30), (1, 10, 40)], "assessment_id long, first long, second long")
    assert {r.reading_id: r.group_id for r in mg.group_readings(readings, pairs).collect()} == {10: 10, 20: 10, 30: 30, 40: 40}


def test_marks(spark):
    df = spark.createDataFrame([(1.0, True, True), (0.5, False, True), (-1.0, False, False), (0.3, False, False), (float("nan"), False, False), (None, False, False)], "m double, whole boolean, half boolean")
    assert df.where((gr.valid_mark(F.col("m"), "WHOLE") != F.col("whole")) | (gr.valid_mark(F.col("m"), "HALF") != F.col("half"))).count() == 0


def test_flatten_write_and_public(spark, tmp_path):
    record = '{"id":"a1","status":"QUEUED","questions":[{"id":"q1","labelRaw":"1."}],"answers":[{"id":"x","text":"t","regions":[{"pageNumber":1,"x":0.1}]}],"documents":[{"id":"d","type":"ANSWER_SHEET","pages":[{"pageNumber":1,"width":10}]}],"grades":null}'
    (tmp_path / "in.json").write_text(record + '\n{"id":"a2"}\n')
    got = ig.flatten_assessments(ig.read_assessments(spark, str(tmp_path / "in.json")))
    assert {k: v.count() for k, v in got.items()} == {"assessments": 2, "documents": 1, "questions": 1, "answers": 1, "mappings": 0, "reviews": 0, "grades": 0, "completedStages": 0, "pages": 1, "regions": 1}
    out = str(tmp_path / "out")
    for rows in ([(1, "a"), (2, "b")], [(2, "c")]):
        ig.write_results(spark.createDataFrame(rows, "k long, v string"), out, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(out).collect()} == {(1, "a"), (2, "c")}
    assert ig.public_projection(spark.createDataFrame([(1, "s")], "k long, storage_key string")).columns == ["k"]
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "x.png").write_bytes(b"%PDF-1.7 body")
    small = Config(max_bytes=5)
    large = ig.classify_uploads(ig.scan_uploads(spark, str(tmp_path / "up"), small).withColumn("mime", F.lit(None).cast("string")), small).first()
    assert (large.verdict, large.size, large.head) == ("TOO_LARGE", 13, None)
    up = ig.classify_uploads(ig.scan_uploads(spark, str(tmp_path / "up")).withColumn("mime", F.lit(None).cast("string"))).first()
    assert (up.verdict, up.format, up.claim_mismatch) == ("ACCEPTED", "PDF", True)


def test_hooks(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "A  b"), (3, "c")], "id long, text string")
    run = hooks.embedder(lambda xs: [[3.0, 4.0] for _ in xs], 2)
    got = hooks.embed_distinct(texts, "text", run, "m", 2).collect()
    assert len(got) == 3 and all(abs(r.vector[0] - 0.6) < 1e-12 for r in got)

    def ask(r):
        if r["answer_id"] == 2:
            raise RuntimeError("down")
        return {"decision": "MATCH", "question_id": 1, "model_confidence": 0.5}

    requests = spark.createDataFrame([(1, 1), (1, 2)], "assessment_id long, answer_id long")
    assert [r.answer_id for r in hooks.adjudicate(requests, ask).collect()] == [1]

    def mark(r):
        if r["answer_id"] == 2:
            raise RuntimeError("down")
        return {"criteria": [{"criterion_id": "c", "awarded": 1.0, "reason": "r"}], "total": 1.0, "confidence": 0.5, "feedback": "f", "failure": None}

    graded = hooks.grade(requests, mark)
    assert {r.answer_id: r.failure for r in graded.collect()} == {1: None, 2: "down"}
    assert [(r.answer_id, r.criterion_id, r.awarded, r.reported_total) for r in hooks.recommendation_rows(graded).collect()] == [(1, "c", 1.0, 1.0)]


def test_cosines_in_numpy_equal_those_of_joined_arrays(spark):
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (2, [4.0, 3.0]), (5, [0.0, 0.0])], "vec_id long, embedding array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 1), (1, 5), (None, 2), (9, 1)], "a_vec long, q_vec long")
    for held in (1 << 20, 0):
        got = {(r.a_vec, r.q_vec): round(r.cosine, 9) for r in cd.with_cosines(pairs, vectors, held).collect()}
        assert got == {(1, 2): 0.96, (1, 1): 1.0, (1, 5): 0.0, (None, 2): 0.0, (9, 1): 0.0}
    assert cd.with_cosines(pairs, vectors.limit(0)).where("cosine != 0").count() == 0


def test_best_items_in_blocks_equal_native_vectors(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "blue sky"), (3, None), (4, "pie pie apple")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "apple pie"), (8, "sky so blue"), (9, "apple pie"), (None, "x")], "item_id long, text string")
    a, b = (sorted(map(tuple, cd.best_items(docs, items, "doc_id", "item_id", block=n).collect())) for n in (10, 1))
    assert a == b and [x[1] for x in a if x[0] in (1, 2, 4)] == [7, 8, 7]
    v = {r.doc_id: np.array(r.vector) for r in cd.hashed_vectors(docs, "doc_id", "text").collect()}
    assert all(np.allclose(cd.word_counts(t or "", 64, {}), v[i]) for i, t in ((1, "red apple pie"), (3, None)))
    assert cd.best_items(docs, items.limit(0), "doc_id", "item_id").count() == 0
