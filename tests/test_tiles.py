"""Scoring over rows of tiles: rounding, cosines by both ways, and pairs that are not shuffled however many vectors there are."""

import re

import numpy as np
from pyspark.sql import functions as F

from quillmark.functions import signals as s
from quillmark.operators import candidates as cd
from quillmark.operators import grading as gr
from quillmark.operators import labels as lo
from quillmark.plans import queries as plans
from quillmark.sources import fixtures as fx

DATA = "/root/testdata/sf0.001"


def test_six_decimals_are_those_of_round(spark):
    values = [0.0, 1.0, 0.1234565, 0.1234575, 0.12345649999, 0.0000005, 0.00000049, 2 / 3, 1 / 3, 0.5, 0.7000005, None] + np.random.default_rng(1).random(2000).tolist()
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select("x", F.round("x", 6).alias("want"), s.decimals6(F.col("x")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)
    both = [(r.x, r.want) for r in rows if r.x is not None]
    assert cd.rounded6(np.array([x for x, _ in both])).tolist() == [w for _, w in both]
    assert cd.rounded6(np.array([-0.1234565, -1e-9, -0.25])).tolist() == [-0.123457, 0.0, -0.25]


def test_cosines_of_tiles_by_both_ways(spark):
    vectors = spark.createDataFrame([(3, [1.0, 0.0]), (5, [1.0, 1.0]), (9, [0.0, 0.0]), (7, [-2.0, 0.1])], "vec_id long, embedding array<double>")
    tile = "assessment_id long, __row int, __column int, own array<struct<a_vec:long>>, asked array<struct<q_vec:long>>"
    ids = lambda *x: [(i,) for i in x]
    tiles = spark.createDataFrame([(1, 0, 0, ids(3, 5), ids(3, None, 7)), (2, 0, 0, ids(9), ids(3)), (3, 0, 0, ids(None, 7, 4), ids(5, 7))], tile)
    got = [{r.assessment_id: r.cosines for r in cd.with_cosine_lists(tiles, vectors, held).collect()} for held in (1 << 20, 0)]
    assert got[0] == got[1]
    assert got[0] == {1: [1.0, 0.0, -0.998752, 0.707107, 0.0, -0.670913], 2: [0.0], 3: [0.0, 0.0, -0.670913, 1.0, 0.0, 0.0]}
    assert all(set(r.cosines) == {0.0} for r in cd.with_cosine_lists(tiles, vectors.limit(0)).collect())


def test_pairs_are_not_shuffled_beyond_a_table_of_cosines(spark):
    vectors = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    a, q = fx.answers(spark, DATA).withColumn("vec_id", F.col("vec_id") * 7), plans.resolved(spark, DATA)
    best = cd.best_candidates(a, q, vectors)
    plan = best._jdf.queryExecution().executedPlan().toString()
    after_python = plan[: plan.index("ArrowEvalPython")]
    assert re.findall(r"Exchange hashpartitioning\((\w+)", after_python) == ["assessment_id"]
    assert "answer_id" not in "".join(re.findall(r"Exchange hashpartitioning\(.*", after_python))
    columns = ["assessment_id", "answer_id", "question_id", "rank", "candidate_score"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(best) == rows(cd.top_k_candidates(cd.score_pairs(a, q, vectors)))


def test_labels_are_looked_up(spark):
    df = spark.createDataFrame([(1, "Q1"), (2, None), (3, "Q1"), (4, "2 (a)"), (5, "")], "id long, label_raw string")
    got = lo.with_parsed(df, "label_raw", "p", long=F.length("label"))
    assert got.columns == ["id", "label_raw", "p", "long"]
    assert {r.id: (r.p.normalized if r.p else None, r.long) for r in got.collect()} == {1: ("1", 2), 2: (None, None), 3: ("1", 2), 4: ("2-a", 5), 5: ("unlabelled", 0)}


def test_rubrics_are_judged_once(spark):
    _, left = gr.resolve_rubrics(plans.resolved(spark, DATA), gr.provided_rubrics(fx.rubrics(spark, DATA)))
    assert "Window" not in left._jdf.queryExecution().optimizedPlan().toString()
    assert not left.isEmpty()
