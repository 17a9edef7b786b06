import random

from pyspark.sql import functions as F

from quillmark.llm import decontaminate as d
from quillmark.llm.common import alnum_words


def brute(docs, items, size):
    out = []
    for i, text in docs:
        words = alnum_words((text or "").encode())
        hit, found = set(), set()
        for item, body in items:
            if item is None:
                continue
            w = alnum_words((body or "").encode())
            n = min(size, len(w))
            windows = {tuple(w[s : s + n]) for s in range(len(w) - n + 1)} if n else set()
            for s in range(len(words)):
                if tuple(words[s : s + n]) in windows and n:
                    hit |= set(range(s, s + n))
                    found.add(str(item))
        out.append((i, len(words), len(hit), sorted(found)))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    words = ["the", "of", "and", "Alpha", "beta", "é", "x1"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 12])))) for k in range(8)]
    items += [(90, ""), (91, None), (None, "the of"), (92, items[0][1])]
    docs = []
    for k in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        docs.append((k, text + (", " + items[k % 8][1].upper() + "! the" if k % 3 == 0 else "")))
    return [*docs, (200, None), (201, ""), (0, docs[0][1]), (None, docs[3][1])], items


def test_equals_brute_force_in_one_and_in_several_blocks(spark):
    docs, items = made(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash")).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for more in ({}, {"block_bytes": 60}, {"vocabulary_bytes": 10}, {"block_bytes": 60, "vocabulary_bytes": 10}):
        got = d.benchmark_hits(df, bench, size=4, **more).collect()
        assert sorted(((r.id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == brute(docs, items, 4)


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in d.contamination(docs, none).collect()] == [(3, 0, False)]
    assert d.contamination(docs.limit(0), none).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two x three"), (2, "three two one"), (3, "one two a b c d e three"), (4, "one"), (5, "three")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    near = {r.id for r in d.benchmark_hits(docs.coalesce(1), bench, size=3, slop=3).where("n_hit > 0").collect()}
    assert near == {1, 2}
    assert d.benchmark_hits(docs, bench, size=3).where("n_hit > 0").count() == 0


def test_long_text_and_hot_passage(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i, passage) for i in range(300)] + [(999, "the " * 50000 + passage)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage + " tail")], "item_id long, text string")
    assert {(r.id, r.n_hit) for r in d.benchmark_hits(docs, bench).collect()} == {(i, 30) for i in [*range(300), 999]}


def test_proximity_equals_brute_force_however_documents_are_dealt(spark):
    docs, items = made(3)
    windows = {}
    for item, body in items:
        w = alnum_words((body or "").encode())
        n = min(3, len(w))
        for s in range(len(w) - n + 1 if n and item is not None else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    want = []
    for i, text in docs:
        words = alnum_words((text or "").encode())
        near = lambda p, w: all(x in words[max(0, p - 4) : p + 5] for x in w[1:])  # noqa: E731, B023
        hits = [(p, w) for p, x in enumerate(words) for w in windows if x == w[0] and near(p, w)]
        want.append((i, len({p for p, _ in hits}), sorted({k for _, w in hits for k in windows[w]})))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for more, parts in (({}, 1), ({}, 5), ({"vocabulary_bytes": 10}, 3)):
        got = d.benchmark_hits(df.repartition(parts), bench, size=3, slop=4, **more).collect()
        assert sorted(((r.id, r.n_hit, list(r["items"])) for r in got), key=str) == sorted(want, key=str)
