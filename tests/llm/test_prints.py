import random

from quillmark.llm import similar, simhash


def differ(a, b):
    return bin(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).count("1")


def alike(a, b):
    x, y = (set(similar.shingle_set(t.encode(), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def edited(words, seed):
    out = list(words)
    for at in random.Random(seed).sample(range(len(words)), 10):
        out[at] = f"x{at}"
    return " ".join(out)


def test_components_link_near_fingerprints_that_shingles_miss(spark):
    words = [f"w{i}" for i in range(400)]
    base = " ".join(words)
    near = next(t for t in (edited(words, k) for k in range(2000)) if 0 < differ(base, t) <= 2 and alike(base, t) < 0.8)
    far = next(t for t in (edited(words, k) for k in range(2000)) if min(differ(base, t), differ(near, t)) > 2 and max(alike(base, t), alike(near, t)) < 0.8)
    docs = spark.createDataFrame([(1, base), (2, near), (3, far), (4, base.upper()), (5, None), (6, " ")], "doc_id long, text string")
    rows = {r.id: r.component for r in similar.similar_components(docs, prints=True).collect()}
    assert rows == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 5}
    assert {r.id: r.component for r in similar.similar_components(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5, 6: 5}
