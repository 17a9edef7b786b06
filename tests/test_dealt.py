"""Tables dealt by assessment: no shuffle within assessments, none left behind, and the same rows where they are not dealt."""

import numpy as np
from pyspark.sql import functions as F

from quillmark.operators import candidates as cd
from quillmark.operators import decide as dc
from quillmark.operators import merge as mg
from quillmark.operators import scan
from quillmark.plans import queries as plans
from quillmark.plans import reading_queries, review_queries, surface_queries  # noqa: F401  registers more
from quillmark.sources import fixtures as fx
from quillmark.sources import scratch

DATA = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_a_written_table_leaves_no_shuffle_behind(spark):
    before = shuffle_files(spark)
    out = scratch.stash(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not shuffle_files(spark) - before and out.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_decisions_stay_in_their_buckets(spark):
    dealt = fx.dealing(spark, DATA)
    assert dealt[0] == "assessment_id"
    top = plans.shortlist(spark, DATA, "semantic", "position", "structure")
    again = scratch.stash(dc.final_confidence(top, plans.verdicts_of(spark, DATA, top)), dealt)
    with scratch.settings(spark, scratch.in_place(dealt)):
        joined = dc.final_confidence(top, plans.verdicts_of(spark, DATA, top))
        requests = dc.build_verdict_requests(top, fx.answers(spark, DATA), plans.resolved(spark, DATA))
        maps = dc.build_mappings(fx.answers(spark, DATA), again, again.where("final_rank = 1"), dc.decisive_gate(again))
        order = cd.reading_order(fx.answers(spark, DATA))
        for df in (joined, requests, maps, order):
            assert "Exchange hashpartitioning" not in physical(df)
    scratch.discard(top)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_tables_with_a_large_assessment_are_not_dealt(spark):
    other = f"{DATA}/."
    assert fx._base(spark, other, whole_rows=1)[1] is None and fx.dealing(spark, DATA) is not None
    queries = {**plans.QUERIES}
    for name in ("review_item_list", "merge_questions_by_tokens"):
        assert rows(queries[name](spark, DATA)) == rows(queries[name](spark, other)), name


def test_fullest_part(spark):
    df = spark.createDataFrame([(k,) for k in (1, 1, 1, 2, None)], "k long")
    assert scan.fullest_part(df, "k") == (3, 5)
    assert scan.fullest_part(df.where("false"), "k") == (0, 0)


def test_vectors_are_held_once_and_in_single_precision(spark, monkeypatch):
    held = []
    monkeypatch.setattr(cd, "_held_vectors", lambda v, own=cd._held_vectors: held.append(1) or own(v))
    a, q, v = fx.answers(spark, DATA), plans.resolved(spark, DATA), fx.embeddings(spark, DATA)
    best = cd.best_candidates(a, q, v, side=2)
    assert len(held) == 1  # for whole assessments and for those in tiles
    assert rows(best) == rows(cd.best_candidates(a, q, v))
    dealt = fx.dealing(spark, DATA)
    assert rows(best) == rows(scratch.stash(cd.best_candidates(a, q, v, side=2, together=True, dealt=dealt), dealt))
    assert rows(cd.score_pairs(a, q, v)) == rows(cd.score_pairs(a, q, v, side=3, dealt=dealt))


def test_tiles_are_not_shuffled_and_their_large_assessments_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(cd, "LISTED", 10)
    best = plans.QUERIES["link_tiled_candidates"](spark, DATA)
    assert "Exchange hashpartitioning" not in physical(best) and len(best.inputFiles()) > 0
    written, stash = [], scratch.stash
    monkeypatch.setattr(cd, "stash", lambda df, *x, **y: written.append(physical(df)) or stash(df, *x, **y))
    plans.QUERIES["link_tiled_candidates"](spark, DATA)
    # without the hint the tables of these would be broadcast: they are small here
    assert [p.count("SortMergeJoin") >= 2 for p in written if "ArrowEvalPython" in p] == [True, True]


def test_held_vectors_of_both_precisions(spark):
    for value, kind in ((0.5, np.float32), (0.1, np.float64)):
        table = spark.createDataFrame([(9, [3.0, 4.0]), (2, [value]), (9, [7.0, 7.0]), (None, [1.0]), (5, None), (4, [])], "vec_id long, embedding array<double>").coalesce(1)
        ids, matrix, length = cd._held_vectors(table)
        assert ids.tolist() == [2, 4, 9] and matrix.dtype == kind
        assert matrix.tolist() == [[value, 0.0], [0.0, 0.0], [3.0, 4.0], [0.0, 0.0]]
        assert length[[0, 2]].tolist() == [value, 5.0] and length[1] > 0
    ids, matrix, length = cd._held_vectors(table.limit(0))
    assert len(ids) == 0 and matrix.shape == (1, 1) and len(length) == 1


def test_token_pairs_of_rows_without_a_column_key(spark):
    r = spark.createDataFrame([(1, 1, k, k % 2, ["same", "words"]) for k in range(2)], "assessment_id long, page long, reading_id long, chunk long, tokens array<string>")
    assert mg._text_pairs(r, 0.7).count() == 1
