import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import vectors as vs


def brute(rows, threshold=0.95):
    unit = {k: vs.unit(v, 8) if i is not None else None for k, (i, v) in enumerate(rows)}
    near = {k: [j for j in unit if j != k and unit[k] is not None and unit[j] is not None and float(unit[k] @ unit[j]) >= threshold] for k in unit}
    label = {k: rows[k][0] for k in unit}
    for _ in unit:
        for k in unit:
            for j in near[k]:
                label[k] = min(label[k], label[j])
    return sorted(((rows[k][0], len(near[k]), label[k], rows[k][0] is None or label[k] == rows[k][0]) for k in unit), key=str)


def made(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        centre = rng.normal(size=8)
        for _ in range(rng.integers(1, 30)):
            rows.append((centre + rng.normal(0, 0.12, 8)).tolist())
    rows += [rows[3]] * 40 + rng.normal(size=(60, 8)).tolist()
    rows += [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] * 8, [], [1.0, 2.0], [2 * x for x in rows[5]]]
    order = rng.permutation(len(rows))
    return [(int(k), rows[i]) for k, i in enumerate(order)] + [(None, rows[0]), (3, rows[order[3]]), (4, rows[order[5]]), (4, rows[order[9]]), (2, rows[order[9]])]


def test_equals_brute_force_over_shards_and_blocks(spark):
    rows = made()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("kept", F.lit("clash")).withColumn("node", F.lit(0)).repartition(3)
    want = brute(rows)
    for more in ({}, {"shard_rows": 60, "block_rows": 25}):
        got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vs.near_vectors(df, **more).collect()), key=str)
        if not more:
            assert got == want
        true, found = sum(r[1] for r in want), sum(min(a[1], b[1]) for a, b in zip(got, want, strict=True))
        assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True)) and found >= 0.9 * true


def test_empty_and_useless(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vs.near_vectors(none).count() == 0
    df = spark.createDataFrame([(4, None), (5, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vs.near_vectors(df).collect())) == [(4, 0, 4, True), (5, 0, 5, True)]


def test_search_finds_all_of_a_dense_group():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 32))
    x[:400] = x[0] + rng.normal(0, 0.1, (400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = vs.greedy_range_search(x, vs.robust_graph(x), 0.95)
    exact = x @ x.T >= 0.95
    np.fill_diagonal(exact, False)
    assert (found <= exact).all() and found.sum() >= 0.99 * exact.sum()


def test_too_low_a_recall_is_an_error(spark):
    df = spark.createDataFrame(made(), "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError):
        vs.near_vectors(df, recall=1.01)


def test_the_audit_measures_rare_links(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 16))
    for k in range(3):  # three links among 200 million pairs
        x[2 * k + 1] = x[2 * k] + rng.normal(0, 0.02, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = [(i, j) for i in range(0, 6) for j in range(6) if i != j and x[i] @ x[j] >= 0.95]
    rows = [(i, 1, bytearray(v.tobytes())) for i, v in enumerate(x)]
    classes = spark.createDataFrame(rows, "node long, size int, vector binary").repartition(4)
    found = lambda rows: spark.createDataFrame(rows, "node long, links long, hub long")
    assert vs.audit_recall(classes, found([]), 20_000, 0.95) == 0
    assert vs.audit_recall(classes, found([(i, 1, j) for i, j in true]), 20_000, 0.95) >= 0.99
    assert vs.audit_recall(classes.where("node > 6 and node < 500"), found([]), 500, 0.9999) is None


def test_unrelated_vectors_have_no_links(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(k, rng.normal(size=32).tolist()) for k in range(120)], "vec_id long, embedding array<double>")
    assert all(r.n_links == 0 and r.kept for r in vs.near_vectors(df).collect())
