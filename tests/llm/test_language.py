import math
import os

import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import language as lg
from quillmark.llm.common import fold_of

DATA = "/root/testdata/sf0.01/documents.parquet"


def segmentations(word, pieces):
    if not word:
        return 1.0
    return sum(p * segmentations(word[len(x) :], pieces) for x, p in pieces.items() if word.startswith(x))


def test_forward_sums_all_segmentations():
    probabilities = {b"a": 0.3, b"b": 0.2, b"ab": 0.1, b"aba": 0.25, b"ba": 0.15}
    pieces = lg.Pieces({x: i for i, x in enumerate(sorted(probabilities))})
    table = np.log(np.array([[probabilities[x]] for x in pieces]))
    scorer = lg.Scorer(pieces, table)
    for word in (b"abab", b"aaaa", b"babab"):
        want = math.log(segmentations(word, probabilities))
        assert abs(scorer.score([[word]])[0, 0] - want) < 1e-9


def test_long_pieces_and_long_words_count():
    probabilities = {bytes([c]): 0.01 for c in b" abcdefghijklmno"} | {b" abcdefghijkl": 0.3, b"bcdefghijklm": 0.2, b"abcdefghi": 0.1, b"abcdefghijkl": 0.05}
    pieces = lg.Pieces({x: i for i, x in enumerate(sorted(probabilities))})
    scorer = lg.Scorer(pieces, np.log(np.array([[probabilities[x]] for x in pieces])))
    words = [b" abcdefghijklmno", b" abcdefghijklaaa", b" bcdefghijklmabc"]
    got = scorer.score([[w] for w in words])[:, 0]
    assert np.allclose(got, [math.log(segmentations(w, probabilities)) for w in words])
    text = "漢字" * 40 + " ab"
    parts = lg.words_of(text)
    assert b"".join(parts).decode() == " " + text and max(map(len, parts)) <= lg.WORD_BYTES and all(p.decode() for p in parts)
    counts = {"x": {w: 3 for w in words}}
    likelihood = []
    for rounds in (1, 2, 4):
        _, table = lg.fit(counts, pieces, rounds)
        likelihood.append(lg.Scorer(pieces, table).score([[w] for w in words]).sum())
    assert likelihood == sorted(likelihood)


def test_scripts_without_spaces_are_learnt(spark):
    rows = [(i, "漢字仮名交じり文" * 12, "ja") for i in range(20)] + [(100 + i, "中文书写系统简体" * 12, "zh") for i in range(20)] + [(300, "漢字仮名" * 30, None), (301, "书写系统" * 30, None)]
    got = {r.doc_id: r.lang_pred for r in lg.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[300], got[301]) == ("ja", "zh")


def test_fitting_raises_the_likelihood():
    pieces = lg.Pieces({x: i for i, x in enumerate(sorted([b"a", b"b", b" ", b"ab", b" a"]))})
    counts = {"x": {b" abab": 5, b" ab": 9}}
    likelihood = []
    for rounds in (1, 2, 6):
        _, table = lg.fit(counts, pieces, rounds)
        scorer = lg.Scorer(pieces, table)
        likelihood.append(sum(n * scorer.score([[w]])[0, 0] for w, n in counts["x"].items()))
    assert likelihood == sorted(likelihood)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA) if os.path.exists(DATA) else spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    got = lg.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (fold_of(r.doc_id, 4) == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert not out or sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97


def test_edge_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)]
    rows += [(100, None, "en"), (101, "12 !!", "en"), (102, "", None), (103, "die Katze", None), (None, "the dog", None), (104, "der " * 30000 + "ß" * 5000, None), (103, "die Katze", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in lg.identify(docs).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 103, None, 104)] == ["und", "und", "und", "de", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert lg.identify(docs).count() == len(rows)
    assert lg.identify(docs.limit(0)).count() == 0
    unlabelled = lg.predict_languages(docs, docs.where("false").select("text", "lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
