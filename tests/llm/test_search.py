import math
import random
import re
from collections import Counter

import pytest

from quillmark.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        asked, found = Counter(words(text)), []
        for i, c, size in held:
            m = 25 + 75 * size * n // total
            score = sum(q * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return out


def corpus(seed, n, items):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    some = lambda low, high: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(low, high)))
    topics = [some(20, 40) for _ in range(8)]
    docs = [(k, f"{some(1, 60)} {rng.choice(topics) if rng.random() < 0.4 else ''}") for k in range(n)]
    docs += [(7, docs[3][1]), (None, docs[3][1]), (n + 1, None), (n + 2, ""), (n + 3, "--- !"), (n + 4, "ÄÖ Straße " + "X1 " * 4000)]
    asked = [(f"i{k}", rng.choice(topics) if k % 3 == 0 else some(1, 30)) for k in range(items)]
    return docs, [*asked, ("null", None), ("none", "?"), ("unknown", "qqqq"), ("same", asked[0][1]), ("same", asked[1][1]), (None, "x1 ÄÖ straße")]


def run(spark, docs, items, k=10, **more):
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, query int").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id string, text string, rank int")
    return sorted(map(tuple, search.rank_documents(d, i, k, **more).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(search, "SEGMENT_DOCS", 150)
    monkeypatch.setattr(search, "READ_DOCS", 60)
    docs, items = corpus(seed, 700, 25)
    assert run(spark, docs, items) == sorted(brute(docs, items), key=str)
    assert run(spark, docs, items, k=3, block_bytes=700) == sorted(brute(docs, items, 3), key=str)


def test_many_equal_scores_rank_by_id(spark):
    docs = [(1000 - k, "alpha beta gamma") for k in range(300)] + [(k, f"other words {k}") for k in range(2000, 2400)]
    items = [("a", "beta gamma"), ("b", "other alpha")]
    assert run(spark, docs, items) == sorted(brute(docs, items), key=str)


def test_blocks_are_skipped_and_bounds_hold():
    import numpy as np

    rng = random.Random(5)
    rows = [[rng.randrange(40) if rng.random() < 0.3 else 40 + k % 6 * 10 + rng.randrange(10) for _ in range(30)] for k in range(600)]
    counts = [sorted(Counter(r).items()) for r in rows]
    flat = lambda k: np.array([x[k] for c in counts for x in c], np.int32)
    starts = np.cumsum([0, *map(len, counts)])
    row = {"ids": np.arange(600).tobytes(), "nulls": np.zeros(600, np.int8).tobytes(), "lengths": np.full(600, 30).tobytes(), "starts": starts.tobytes(), "terms": flat(0).tobytes(), "tfs": flat(1).tobytes()}
    weights = search.term_weights(600, np.bincount(flat(0), minlength=100))
    query = search.Query([*range(40, 50), 3], 5)
    segment = search.Segment(row, weights, 600, 18000, lambda t: query.terms)
    times = np.bincount(query.terms, query.times, minlength=100).astype(np.int64)
    every = segment.scores(np.arange(600), times)
    for t in query.terms.tolist():
        b = segment.blocks(t)
        for bound, low, high in zip(b.bounds(query), b.starts, b.starts[1:], strict=False):
            assert bound >= every[b.docs[low:high]].max()
    scored = []
    real = segment.scores
    segment.scores = lambda docs, times: scored.extend(docs.tolist()) or real(docs, times)
    segment.search(query)
    assert query.best[:, 0].tolist() == sorted(every.tolist(), reverse=True)[:5]
    assert len(scored) == len(set(scored)) < (every > 0).sum()


def test_summaries_that_do_not_fit_are_built_again(spark, monkeypatch):
    monkeypatch.setattr(search, "SUMMARY_BYTES", 1000)
    docs, items = corpus(4, 200, 8)
    assert run(spark, docs, items) == sorted(brute(docs, items), key=str)


def test_empty_tables(spark):
    assert run(spark, [], [("a", "b")]) == []
    assert run(spark, [(1, "b")], []) == []
    assert run(spark, [(1, None)], [("a", "b")]) == []


def test_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    got = search.rank_documents(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(search.oracle_sql()).fetchall())
    assert len(got) > 100
