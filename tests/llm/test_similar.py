import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import similar


def brute(docs):
    """Smallest position of each row's group, by exact Jaccard similarity of all pairs."""
    sets = [set(similar.shingle_set(t.encode(), 5).tolist()) for _, t in docs]
    group = list(range(len(docs)))
    links = [(i, j) for j in range(len(docs)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if group[i] != group[j]:
                group[i] = group[j] = min(group[i], group[j])
                changed = True
    return group


def test_similar_components_against_exact_similarity(spark):
    rng = random.Random(9)
    docs, origin = [], {}
    for g in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(200)]
        for _ in range(rng.choice([1, 2, 3, 24])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                words[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
            origin[len(docs)] = g
            docs.append((len(docs), " ".join(words)))
    more = [(900, None), (901, " "), (902, "Two words"), (903, "two  WORDS"), (None, docs[0][1]), (0, docs[0][1]), (904, "a " * 30000)]
    df = spark.createDataFrame(docs + more, "doc_id long, text string").withColumn("prints", F.lit("clash"))
    got = similar.similar_components(df).collect()
    label = {r.id: r.component for r in got}
    assert len(got) == len(docs) + len(more) - 2 and sum(r.copies for r in got) == len(docs) + len(more) - 1
    assert (label[901], label[903], label[904]) == (900, 902, 904)
    sets = {i: set(similar.shingle_set(t.encode(), 5).tolist()) for i, t in docs}
    true = [(a, b) for a in sets for b in sets if a < b and origin[a] == origin[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert true and all(label[a] == label[b] for a, b in true)
    assert all(origin[i] == origin[c] for i, c in label.items() if i in origin)
    assert similar.similar_components(df.limit(0)).count() == 0


def test_large_buckets_lose_no_link_when_the_smallest_id_stands_apart(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for n in range(40):  # the first is about 0.7 to the base and most others, the rest 0.78 to 0.95
        words = list(base)
        for at in rng.sample(range(200), 7 if n == 0 else rng.choice([1, 2, 3, 4, 5])):
            words[at] = f"new{n}x{at}"
        docs.append((n, " ".join(words)))
    sets = {i: set(similar.shingle_set(t.encode(), 5).tolist()) for i, t in docs}
    want = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    want[a] = want[b] = min(want[a], want[b])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: r.component for r in similar.similar_components(df, small_run=2).collect()}
    assert got == want
    assert len(set(want.values())) > 1


def test_truncated_and_extended_copies_at_the_threshold_are_all_found(spark):
    rng = random.Random(12)
    docs = []
    for g in range(300):  # pairs of 0.80 to 0.85 whose lengths differ: one is the other cut short or carried on
        n = rng.randint(60, 500)
        words = [f"w{min(int(rng.paretovariate(0.6)), 5000)}g{g if rng.random() < 0.5 else 0}" for _ in range(n)]
        whole = set(similar.shingle_set(" ".join(words).encode(), 5).tolist())
        kept = next(m for m in range(n // 2, n) if len(set(similar.shingle_set(" ".join(words[:m]).encode(), 5).tolist())) >= rng.choice([0.8, 0.82, 0.85]) * len(whole))
        docs += [(2 * g, " ".join(words[:kept] if g % 2 else words)), (2 * g + 1, " ".join(words if g % 2 else words[:kept]))]
    sets = {i: set(similar.shingle_set(t.encode(), 5).tolist()) for i, t in docs}
    assert all(0.8 * len(sets[i] | sets[i + 1]) <= len(sets[i] & sets[i + 1]) for i in range(0, len(docs), 2))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: r.component for r in similar.similar_components(df).collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, len(docs), 2)) == 300
    assert all(c in (i, i - 1) for i, c in got.items())


@pytest.mark.parametrize("small_run,salt_rows", [(2, 1 << 12), (16, 3)])
def test_equals_brute_force_in_runs_of_all_kinds(spark, small_run, salt_rows):
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for n in range(50):  # mostly the common passage: runs of its shingles are large and mostly not similar
        own = [f"o{n}x{i}" for i in range(rng.choice([2, 10, 14, 20]))]
        texts.append(" ".join(passage + own if n % 2 else own + passage))
    for n in range(60):  # near copies of one text, in a chain
        words = [f"c{i}" for i in range(120)]
        for at in range(n // 6):
            words[at * 11] = f"new{at}"
        texts.append(" ".join(words[: 120 - n % 5]))
    texts += [texts[3], texts[60], "", " "]
    docs = [(rng.randrange(10**6), t) for t in texts]
    docs += [(docs[0][0], docs[70][1]), (docs[0][0], docs[0][1])]  # one id with two texts, and a repeated row
    got = similar.similar_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), small_run=small_run, salt_rows=salt_rows).collect()
    group = brute(docs)
    lowest = {}
    for k, (i, _) in enumerate(docs):
        lowest[group[k]] = min(i, lowest.get(group[k], i))
    want = {(i, md5(t.encode()).digest()): lowest[group[k]] for k, (i, t) in enumerate(docs)}
    assert {(r.id, bytes(r.text_key)): r.component for r in got} == want
    assert sum(r.copies for r in got) == len(docs) and sum(r.kept for r in got) == len(lowest)


def test_streamed_runs_do_not_depend_on_batches(spark):
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 40, 200)
    rows = [(int(k), 0, int(v), (100 << 32) + int(rng.integers(0, 9))) for k, n in enumerate(sizes) for v in rng.choice(10**6, n, replace=False)]
    df = spark.createDataFrame(rows, "key long, salt int, node long, at long").repartition("key", "salt").sortWithinPartitions("key", "salt", "node")
    found = []
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append(sorted(map(tuple, similar._meet(df, 0.8, 16, np.ones(similar.CELLS, np.int64)).collect()), key=str))
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1]
    assert sum(r[0] is None for r in found[0]) > 1000 and {r[0] for r in found[0]} - {None} == {k for k, n in enumerate(sizes) if n > 16}
