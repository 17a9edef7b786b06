import pytest
from pyspark.sql import functions as F

from quillmark.config import Config, check_config
from quillmark.functions import geometry as geo
from quillmark.functions import labels as lb
from quillmark.functions import signals as s

LABELS = {
    "Q1": (1, None, None, "1"), "Q.4": (4, None, None, "4"), "Question 7": (7, None, None, "7"), "4.": (4, None, None, "4"), "12)": (12, None, None, "12"), "  3  ": (3, None, None, "3"),
    "4(a)": (4, "a", None, "4-a"), "4 (a)": (4, "a", None, "4-a"), "Q4a": (4, "a", None, "4-a"), "4.b": (4, "b", None, "4-b"), "11 (b)": (11, "b", None, "11-b"), "6(a)(ii)": (6, "a", "ii", "6-a-ii"),
    "4(i)": (4, "i", None, "4-i"), "(a)": (0, "a", None, "a"), "(iii)": (0, None, "iii", "iii"), "OR": (0, None, None, "or"), "A1": (1, None, None, "1"), "--": (0, None, None, "unlabelled"), "Ans 2(c)": (2, "c", None, "2-c"),
}


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in LABELS] + [(None,)], "label string")
    rows = df.select("label", lb.parse_label(F.col("label")).alias("p")).collect()
    got = {r.label: (r.p.major, r.p.minor, r.p.roman, r.p.normalized) for r in rows if r.label is not None}
    assert got == LABELS and [r.p for r in rows if r.label is None] == [None]
    assert {r.label for r in rows if r.p and r.p.is_orphan} == {"(a)", "(iii)"}


def test_roman(spark):
    values = {"i": 1, "iv": 4, "ix": 9, "xii": 12, "mcm": 1900, "a": None, "ib": None, "": None, "iiii": None}
    df = spark.createDataFrame([(x,) for x in values], "t string").select("t", F.when(lb.is_roman(F.col("t")), lb.roman_to_int(F.col("t"))).alias("v"))
    assert {r.t: r.v for r in df.collect()} == values


def test_geometry(spark):
    rows = [(0.1, 0.1, 0.9, 0.9, True), (0.5, 0.5, 0.6, 0.1, False), (float("nan"), 0.1, 0.1, 0.1, False), (-0.1, 0.1, 0.1, 0.1, False), (0.0, 0.0, 1.0, 1.0, True)]
    df = spark.createDataFrame(rows, "x double, y double, w double, h double, good boolean")
    assert df.where(geo.valid_rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")) != F.col("good")).count() == 0
    one = spark.range(1).select(geo.iou(tuple(map(F.lit, (0.0, 0.0, 0.5, 0.5))), tuple(map(F.lit, (0.25, 0.0, 0.5, 0.5)))).alias("i"), geo.to_normalized_rect(*map(F.lit, (10, 20, 200, 30, 100, 100))).alias("n"), geo.page_geometry(F.lit(4000), F.lit(2000), F.lit(6), 2000).alias("p")).first()
    assert abs(one.i - 1 / 3) < 1e-9
    assert (one.n.x, one.n.y, one.n.width) == (0.1, 0.2, 0.9) and abs(one.n.height - 0.3) < 1e-9
    assert (one.p.width, one.p.height, one.p.scale, one.p.rotation) == (1000, 2000, 0.5, 90)


def test_signals(spark):
    c = Config()
    v = lambda *x: spark.range(1).select(s.candidate_score(*map(F.lit, map(float, x)), c).alias("v")).first().v
    assert v(1, 1, 1, 1) == 1 and v(0, 0, 0, 0) == 0 and v(0.5, 0.5, 0.5, 0.5) == 0.5 and v(1, 0.5, 0.5, 0.5) == 1
    t = spark.createDataFrame([("a b C", "c  b a!"), ("", "!!"), ("a", "")], "x string, y string")
    assert [r.j for r in t.select(s.jaccard(s.text_tokens(F.col("x")), s.text_tokens(F.col("y"))).alias("j")).collect()] == [1.0, 1.0, 0.0]
    w = spark.range(1).select(s.cosine_similarity(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(6.0), F.lit(8.0))).alias("c"), s.cosine_similarity(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z")).first()
    assert abs(w.c - 1) < 1e-12 and w.z == 0
    with pytest.raises(Exception):  # noqa: B017
        spark.range(1).select(s.cosine_similarity(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()


def test_config():
    assert check_config(Config()) == []
    for bad in ({"weight_label": 0.5}, {"band_medium": 0.95}, {"answer_chunk_overlap": 4}, {"grade_weight_model": 0.1}, {"granularity": "THIRD"}):
        with pytest.raises(ValueError):
            Config(**bad)
