"""Assessments that hold a third of all rows: the same rows as by the plain plan, and no large group in one task."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.operators import candidates as cd
from quillmark.operators import labels as lo
from quillmark.operators import matching as mt
from quillmark.operators import merge as mg
from quillmark.operators import review as rv
from quillmark.operators import scan
from quillmark.plans import queries as plans
from quillmark.sources import fixtures as fx

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """The tables with a third of some lines in one order."""
    folder = str(tmp_path_factory.mktemp("hot"))
    for name in ("part", "embeddings"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_orderkey % 5 = 0")
    lines.withColumn("l_orderkey", F.when(F.col("l_partkey") % 3 == 0, F.lit(5).cast("long")).otherwise(F.col("l_orderkey"))).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_scan_of_large_keys_equals_windows(spark):
    data = [(k, i * 7 % 100, i, None if i % 9 else f"v{i}") for k, n in ((1, 100), (2, 3), (None, 40), (3, 26)) for i in range(n)]
    df = spark.createDataFrame(data, "k long, place long, id long, v string").repartition(5)
    order = [F.col("place").desc_nulls_last(), "id"]
    more = {"at": "at", "count": "n", "carried": {"last": F.col("v"), "big": F.when(F.col("id") > 50, F.col("id"))}}
    want = scan.in_order(df, "k", order, **more)
    one = Window.partitionBy("k")
    plain = df.withColumn("at", F.row_number().over(one.orderBy(*order)) - 1).withColumn("n", F.count("*").over(one))
    assert rows(want.drop("last", "big")) == rows(plain)
    for size in (1, 10, 25, 60):
        got = scan.in_order(df, "k", order, whole_rows=size, **more)
        assert got.dtypes == want.dtypes
        assert rows(got) == rows(want)
    assert scan.in_order(df.where("false"), "k", order, whole_rows=1, **more).count() == 0


def test_orders_and_labels_of_a_large_assessment(spark, hot):
    q, a = fx.questions(spark, hot), fx.answers(spark, hot)
    res = lo.resolve_orphans(q)
    assert res.groupBy("assessment_id").count().agg(F.max("count")).first()[0] > 300
    assert rows(lo.resolve_orphans(q, 50)) == rows(res)
    assert rows(lo.with_question_index(res, 50)) == rows(lo.with_question_index(res))
    assert rows(lo.display_numbers(res, 50)) == rows(lo.display_numbers(res))
    assert rows(cd.reading_order(a, 50)) == rows(cd.reading_order(a))


def test_tiles_of_a_large_assessment(spark, hot):
    a, q, v = fx.answers(spark, hot), plans.resolved(spark, hot), fx.embeddings(spark, hot)
    want = cd.score_pairs(a, q, v)
    got = cd.score_pairs(a, q, v, side=32)
    assert got.dtypes == want.dtypes
    assert want.count() > 100_000
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
    pick = lambda df: rows(cd.top_k_candidates(df).select("assessment_id", "answer_id", "question_id", "rank"))
    assert pick(got) == pick(want)
    n = a.groupBy("assessment_id").count().toDF("assessment_id", "__answers").join(q.groupBy("assessment_id").count().toDF("assessment_id", "__questions"), "assessment_id")
    tiles = cd.tiled(cd.reading_order(a).join(n, "assessment_id"), lo.with_question_index(q).join(n, "assessment_id").select("assessment_id", "question_id", "question_at", "__answers", "__questions"), 32)
    per = tiles.groupBy("assessment_id", (F.col("answer_at") / 32).cast("int"), (F.col("question_at") / 32).cast("int")).count()
    assert per.agg(F.max("count")).first()[0] == 32 * 32  # the hot assessment is as many keys as it has tiles
    assert tiles.count() == want.count()


def page_readings(spark, n=90):
    """Readings of one large page and of small ones, with equal, near and far rectangles and texts, by three chunks."""
    words = [f"w{k}" for k in range(12)]
    data = []
    for i in range(n):
        page = 1 if i % 5 else 2 + i % 7
        k = i * 7919 % 1000
        text = None if i % 17 == 0 else "" if i % 19 == 0 else " ".join(w for j, w in enumerate(words) if (k >> (j % 10)) & 1 or j > 8)
        box = [float("nan"), 0.1, 0.1, 0.1] if i % 29 == 0 else [None, 0.1, 0.1, 0.1] if i % 31 == 0 else [k % 7 / 10, k % 11 / 10, (1 + i % 4) / 10, (1 + i % 3) / 20] if i % 23 else [-0.5, -0.5, 3.0, 3.0]
        data.append((1 + i % 2, i, i % 3, page, *box, text, f"Q{i % 6}" if i % 3 == 1 else None))
    return spark.createDataFrame(data, "assessment_id long, reading_id long, chunk long, page long, x double, y double, width double, height double, text string, label_raw string").repartition(4)


def test_pairs_of_large_pages(spark):
    r = page_readings(spark, 300)
    for pairs in (mg.same_answer_pairs, mg.same_question_pairs):
        want = rows(pairs(r, 1_000_000))
        assert len(want) > 20
        for size in (0, 10):
            assert rows(pairs(r, size)) == want
        assert pairs(r.where("false"), 0).count() == 0


def test_a_grid_compares_what_overlaps(spark):
    data = [(1, 2 * i + c, c, 1, i % 40 / 40, i // 40 / 40, 0.02, 0.02, f"t{i}", None) for i in range(1600) for c in (0, 1)]
    r = spark.createDataFrame(data, page_readings(spark, 5).schema)
    assert mg._place_pairs(r.withColumn("tokens", F.array("text"))).count() < 4 * 1600  # of 2.56 million
    assert mg.same_answer_pairs(r).count() == 1600
    assert mg._text_pairs(r.withColumn("tokens", F.array("text")), 0.7).count() == 1600


def test_groups_equal_the_fold(spark):
    r = page_readings(spark, 120).where("text is not null")
    pairs = spark.createDataFrame([(1 + i % 2, i, j) for i in range(120) for j in range(i + 2, 120, 2) if i % 3 != j % 3 and (i * 31 + j * 17) % 23 == 0], "assessment_id long, first long, second long")
    got = {(x.assessment_id, x.reading_id): x.group_id for x in mg.group_readings(r.drop("text"), pairs).collect()}
    near, want = {}, {}
    for p in pairs.collect():
        near.setdefault((p.assessment_id, p.first), set()).add(p.second)
        near.setdefault((p.assessment_id, p.second), set()).add(p.first)
    order = {}
    for x in sorted(r.collect(), key=lambda x: (x.assessment_id, x.chunk, x.reading_id)):
        key = (x.assessment_id, x.reading_id)
        fits = [want[x.assessment_id, y] for y in near.get(key, ()) if (x.assessment_id, y) in want and y % 3 != x.chunk]
        want[key] = min(fits, key=lambda g: order[x.assessment_id, g]) if fits else x.reading_id
        order.setdefault((x.assessment_id, want[key]), len(order))
    assert got == want
    assert len(set(want.values())) < 100


def test_greedy_rounds_equal_the_loop(spark, monkeypatch):
    monkeypatch.setattr(mt, "ROUNDS_READ", 3)
    data = [(a, i, j, 0.3 + (i * 37 + j * 11 + a) % 60 / 100) for a in (1, 2) for i in range(25) for j in range(20) if (i * j + a) % 4 == 0]
    data += [(3, k, k // 2 + k % 2, 1.0 - k / 100) for k in range(1, 40)]  # a chain: each edge waits for the one before
    data += [(3, None, 1, 0.9), (3, 1, None, 0.9), (3, 1, 1, None), data[5]]
    edges = spark.createDataFrame(data, "assessment_id long, answer_id long, question_id long, confidence double").repartition(3)
    left, right, want = set(), set(), []
    for a, i, j, w in sorted({d for d in data if None not in d and d[3] >= 0.35}, key=lambda d: (d[0], -d[3], d[1], d[2])):
        if (a, i) not in left and (a, j) not in right:
            left.add((a, i))
            right.add((a, j))
            want.append((a, i, j, w))
    assert sorted(map(tuple, mt.greedy_assignment(edges).collect())) == sorted(want)
    assert mt.greedy_assignment(edges.where("false")).count() == 0


def test_actions_judged_in_rounds_equal_the_fold(spark):
    import random

    rng = random.Random(2)
    reviews = spark.createDataFrame([(a, 100 * a + k, None if k % 7 == 0 else 100 * a + k % 12) for a in range(1, 7) for k in range(15)], "assessment_id long, answer_id long, original_question_id long")
    questions = spark.createDataFrame([(a, 100 * a + k) for a in range(1, 7) for k in range(20)], "assessment_id long, question_id long")
    kinds = ["ACCEPT", "REMAP", "REMAP", "REMAP", "REMAP", "REJECT", "SKIP"]
    log = []
    for e in range(900):
        a = rng.choice([1, 1, 1, 2, 3, 4, 5, 6])
        action = rng.choice(kinds)
        log.append((a, 100 * a + rng.randrange(16), e, 1000 - e % 97, action, 100 * a + rng.randrange(23) if action == "REMAP" and e % 11 else None, "x" * 1001 if e % 13 == 0 else None))
    actions = spark.createDataFrame(log, "assessment_id long, answer_id long, event_id long, s long, action string, target long, reason string").withColumn("ts", F.timestamp_seconds("s")).drop("s").repartition(3)
    want = rv.apply_review_actions(reviews, questions, actions)
    outcomes = {r.outcome for r in want.select("outcome").distinct().collect()}
    assert outcomes == {"APPLIED", "REPEAT", "CONFLICT_SETTLED", "INVALID_TARGET", "UNKNOWN_QUESTION", "QUESTION_ALREADY_ASSIGNED", "NOT_FOUND", "REASON_TOO_LONG"}
    for least, size in ((0, 1_000_000), (200, 40)):
        assert rows(rv.apply_review_actions(reviews, questions, actions, least, size)) == rows(want)


def test_running_sums_of_large_keys(spark):
    data = [(k, i, None if i % 5 == 0 else i % 7 - 3) for k, n in ((1, 90), (2, 4)) for i in range(n)]
    df = spark.createDataFrame(data, "k long, id long, v int").repartition(3)
    want = scan.in_order(df, "k", ["id"], summed={"s": F.col("v")})
    got = scan.in_order(df, "k", ["id"], summed={"s": F.col("v")}, whole_rows=13)
    assert rows(got) == rows(want) and got.dtypes == want.dtypes


def test_best_items_block_by_block(spark):
    words = [f"word{k}" for k in range(30)]
    text = lambda k: " ".join(words[(k * j) % 30] for j in range(1, 4 + k % 5))
    docs = spark.createDataFrame([(k, text(k)) for k in range(40)] + [(None, None), (3, text(5))], "doc_id long, text string")
    items = spark.createDataFrame([(k, text(3 * k + 1)) for k in range(17)] + [(None, "x"), (50, None)], "item_id long, text string")
    want = rows(cd.best_items(docs, items, "doc_id", "item_id"))
    assert len(want) == 42
    got = cd.best_items(docs.where("doc_id is not null and not (doc_id = 3 and text != '%s')" % text(3)), items, "doc_id", "item_id", block=4)
    assert set(rows(got)) <= set(want) and got.count() == 40
