import math
import os
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import lm
from quillmark.llm.common import fold_of, space_words

DATA = "/root/testdata/sf0.01/documents.parquet"


def made():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        n, at, out = rng.randint(0, 60), rng.randrange(60), []
        for _ in range(n):
            at = (at + 1) % 60 if rng.random() < 0.8 else rng.randrange(60)
            out.append(words[at] if rng.random() < 0.95 else f"rare{rng.randrange(500)}")
        rows.append((i, " ".join(out)))
    long = "x" * 200
    return [*rows, (200, None), (201, ""), (7, rows[7][1]), (None, "w1 w2"), (202, "W1 " * 20000), (203, f"{long} w1 {long}"), (204, f"{long} y")]


def brute_base(rows):
    counts, ends = Counter(), 0
    for i, t in rows:
        if i is None or fold_of(i, 7) != 2:
            counts.update(space_words((t or "").encode()))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for i, t in rows:
        c = [counts[w] for w in space_words((t or "").encode())] + [ends]
        out.append((i, i is not None and fold_of(i, 7) == 2, len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c)))
    return sorted(out, key=str)


def test_base_scores_equal_brute_force_with_a_small_head(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("word", F.lit(1)).repartition(3)
    for head in (20, 10_000):
        got = sorted(((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score_texts(docs, head=head, classes=15).collect()), key=str)
        for a, b in zip(got, brute_base(rows), strict=True):
            assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))


def test_scores_do_not_depend_on_partitions_and_beat_unigrams_on_held_out_texts(spark):
    """At the shipped setting, on made texts and on the test table."""
    tables = [spark.createDataFrame([(i, t) for i, t in made() if i is not None and i < 200], "doc_id long, text string")]
    if os.path.exists(DATA):
        tables.append(spark.read.parquet(DATA))
    for docs in tables:
        one, many = ({(r.id, r.n_tokens): r for r in lm.score_texts(docs.repartition(n)).collect()} for n in (1, 32))
        assert all(abs(one[k].score - many[k].score) < 1e-6 * max(1, abs(one[k].score)) for k in one)
        out = [r for r in one.values() if r.held_out]
        gain = 1 - sum(r.score for r in out) / sum(r.base_score for r in out)
        print("held-out gain over unigrams", round(100 * gain, 2), "%")
        assert gain > 0.01


def test_probabilities_are_normalised_over_the_open_vocabulary():
    rng = np.random.default_rng(3)
    words = [b"w%d" % i for i in range(40)]
    voc = lm.Vocabulary(words, np.sort(rng.integers(2, 50, 40))[::-1], 9, 2000, 60, 12)
    voc.group = rng.integers(0, lm.GROUPS, 40)
    k = voc.classes
    codes = np.arange(0, (lm.GROUPS + 2) ** (lm.HISTORY + 1), 97)
    groups = lm.train_groups(codes, rng.random(len(codes)), steps=3)
    model = lm.Words(np.concatenate([voc.group[:k], np.arange(lm.GROUPS)]), rng.random(k + lm.GROUPS), k + lm.GROUPS + 2)
    model.near += rng.normal(size=model.near.shape)
    scores = lm.Scores(voc, groups, model)
    for before in ([], [3], [3, 39], [-1, 5], [39, -1, 2, 7, 1]):
        total = 0.0
        for x in [*range(40), 40, -1]:  # words, the end, and all words outside together
            total += 10 ** scores.log10(voc, np.array([*before, x]), np.array([0]))[-1]
        # groups whose rest has no word keep the share that their rest was given
        empty = [g for g in range(lm.GROUPS) if not (voc.group[k:] == g).any()]
        history, _, v, _ = voc.symbols(np.array([*before, 40]), np.array([0]))
        for g in empty:
            total += np.exp(groups[history[-1], g] + model.near[v[-1]] @ model.target[k + g] + model.bias[k + g] - scores.norms[v[-1], g])
        assert abs(total - 1) < 1e-9


def test_gradient_equals_differences():
    rng = np.random.default_rng(4)
    model = lm.Words(np.array([0, 0, 1, 1, 0]), rng.random(5), 3)
    v, w, c = np.array([0, 0, 2, 1]), np.array([1, 2, 4, 3]), np.array([3.0, 1.0, 2.0, 5.0])

    def objective():
        s = model.near @ model.target.T + model.bias - np.log(lm.NOISE * model.noise)
        total = 0.0
        for a, b, n in zip(v, w, c, strict=True):
            same = model.group_of == model.group_of[b]
            total += n * (-np.log1p(np.exp(-s[a, b])) - lm.NOISE * (model.noise[same] * np.log1p(np.exp(s[a, same]))).sum())
        return total

    grads = model.gradient(v, w, c)
    for part, grad in zip(model.parts(), grads, strict=True):
        for at in np.ndindex(part.shape):
            before = part[at]
            part[at] = before + 1e-5
            up = objective()
            part[at] = before - 1e-5
            assert abs((up - objective()) / 2e-5 - grad[at]) < 1e-5
            part[at] = before


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score_texts(docs, train=docs.limit(0)).collect()
    assert {(r.id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}
    assert all(np.isfinite(r.score) for r in got)
    assert lm.score_texts(docs.limit(0)).count() == 0
