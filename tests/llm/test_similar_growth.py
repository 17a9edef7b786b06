import random

import numpy as np

from quillmark.llm import similar


def copies(rng, groups, n):
    """Groups of n texts that differ in one word each."""
    out = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(120)]
        for k in range(n):
            words = list(base)
            words[rng.randrange(120)] = f"new{g}x{k}"
            out.append(" ".join(words))
    return out


def test_candidates_grow_with_documents_and_not_with_their_pairs(spark, monkeypatch):
    counted, verified = [], similar._verified
    monkeypatch.setattr(similar, "_verified", lambda whole, pairs, similarity: counted.append(pairs.count()) or verified(whole, pairs, similarity))
    texts = copies(random.Random(3), 6, 15)
    got = similar.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.id: r.component for r in got} == {i: i // 15 * 15 for i in range(len(texts))}
    assert sum(counted) <= 4 * len(texts)  # all pairs would be seven times the texts


def test_runs_without_a_stray_are_left_after_the_first_look(spark, monkeypatch):
    counted, strays = [], similar._strays
    monkeypatch.setattr(similar, "_strays", lambda members, parts: counted.append(members.count()) or strays(members, parts))
    passage = [f"p{i}" for i in range(60)]
    texts = copies(random.Random(5), 3, 20) + [" ".join(passage + [f"o{n}x{i}" for i in range(9)]) for n in range(20)]
    got = similar.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.id: r.component for r in got} == {i: i // 20 * 20 if i < 60 else i for i in range(len(texts))}
    assert len(counted) == 2 and 0 < counted[1] < counted[0]


def test_shared_shingles_are_told_from_others_that_fill_coarse_cells(spark):
    """90 documents share a passage in a corpus that fills every coarse cell 400 times: none of it is among the rarest."""
    rng = np.random.default_rng(7)
    passage = rng.integers(-(1 << 62), 1 << 62, 40)
    own = rng.integers(-(1 << 62), 1 << 62, 160)
    fine = np.bincount(rng.integers(0, similar.FINE, 25 * similar.FINE), minlength=similar.FINE).astype(np.uint32)
    np.add.at(fine, passage & (similar.FINE - 1), np.uint32(90))
    first = similar.rarest(np.concatenate([passage, own]), similar.steps_of(fine), 0.8)
    assert len(first) == 41 and not set(first.tolist()) & set(passage.tolist())


def test_cells_are_counted_over_all_tasks(spark):
    texts = [f"a b c d e f{k % 7} g" for k in range(50)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    got = similar._summed(similar._keys(rows, 5).where("cells is not null").select("node", "cells"))
    sets = np.concatenate([similar.shingle_set(t.encode(), 5) for t in texts])
    assert (got == np.bincount(sets & (similar.FINE - 1), minlength=similar.FINE)).all()
    assert similar.steps_of(np.array([0, 1, 3, 70000], np.uint32)).tolist() == [0, 16, 32, 255]
