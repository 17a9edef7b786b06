import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quillmark.llm import licenses as lic

DATA = "/root/testdata/sf0.001/documents.parquet"


def least_edits(notice: str, text: str) -> int:
    """Fewest edits that turn the notice into whole words of the padded text; starred words and spaces beside them stay."""
    chars = [(c, free) for part, free in lic.parts_of(notice) for c in part]
    n, none = len(chars), 10**6
    # an extra character of the text may stand before, in or after a free part, but not inside a fixed one
    gap = [(i > 0 and chars[i - 1][1]) or (i < n and chars[i][1]) for i in range(n + 1)]
    row, best = [none] * (n + 1), none
    for t, c in enumerate(text):
        if t and text[t - 1] == " ":
            row = [min(row[0], 0), *row[1:]]
            for i in range(1, n + 1):
                row[i] = min(row[i], row[i - 1] + 1 if chars[i - 1][1] else none)
        if c == " ":
            best = min(best, row[n])
        new = [row[i] + 1 if gap[i] else none for i in range(n + 1)]
        for i in range(1, n + 1):
            p, free = chars[i - 1]
            new[i] = min(new[i], row[i - 1] + (p != c) if free or p == c else none, new[i - 1] + 1 if free else none)
        row = new
    return best


def edited(rng, phrase, n):
    s = list(phrase)
    for _ in range(n):
        at = rng.randrange(len(s))
        kind = rng.choice("ids")
        if kind == "i":
            s.insert(at, rng.choice("abe "))
        elif kind == "d":
            del s[at]
        else:
            s[at] = rng.choice("abez")
    return "".join(s)


def test_fuzzy_labels_equal_brute_force():
    rng, scanner = random.Random(8), lic.Scanner()
    hits = 0
    for _ in range(300):
        notice, _, k = rng.choice(lic.NOTICES)
        words = "".join(rng.choice("abcdel ") for _ in range(30)) + " " + edited(rng, notice.replace("*", ""), rng.randint(0, k + 1)) + " tail of the license"
        text = " " + " ".join(words.split()) + " "
        want = {n for n, (p, _, e) in enumerate(lic.NOTICES) if least_edits(p, text) <= e}
        assert {x["label"] for x in scanner.fuzzy(text)} == {lic.NOTICES[n][1] for n in want}, text
        hits += bool(want)
    assert 100 < hits < 280


def test_versions_and_names_are_not_edited_away():
    scanner = lic.Scanner()
    said = lambda t: {x["label"] for x in scanner.fuzzy(f" {t} ")}
    assert said("gnu general public license version 2") == {"gpl-2"} and said("gnu general publik license version 3") == {"gpl-3"}
    for text in ("gnu general public license version 1", "apache license version 1 1", "licensed under the apache license version 1 1", "mozilla public license version 1 1", "tall rights reserved", "licensed under cc by 4 0", "released under the mid license"):
        assert said(text) == set(), text
    assert said("licensed under cc by sa 4 0") == {"cc-by-sa"} and said("licenced under cc by nc 4 0") == {"cc-by-nc"}
    assert said("all rights reservd") == {"all-rights-reserved"}


def test_base_columns_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    words = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    base = " UNION ALL ".join(f"SELECT '{p}' AS p, '{x}' AS label, {len(p.split())} AS n" for p, x in lic.BASE)
    sql = f"""WITH d AS (SELECT doc_id, regexp_extract_all({words}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM '{DATA}'),
      s AS (SELECT doc_id, label, s FROM (SELECT doc_id, w, p, label, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS s FROM d, ({base})) WHERE array_to_string(w[s + 1:s + n], ' ') = p)
      SELECT d.doc_id, len(w), count(s), min(s), max(s), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id, w"""
    if not os.path.exists(DATA):
        pytest.skip("no test data")
    want = sorted(duckdb.sql(sql).fetchall())
    got = lic.license_summary(spark.read.parquet(DATA)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got)) == want and any(r[2] for r in want)


def test_many_hits_in_one_text_take_linear_time():
    scanner, took = lic.Scanner(), []
    for n in (4000, 16000):
        text = " " + "cc by nc all rights reserved " * n
        began = time.perf_counter()
        assert len(scanner.exact(text)) == n and len(scanner.fuzzy(text)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


def test_summary(spark):
    rows = [
        (1, "Released Under the MIT License. See apache-license, version 2"),
        (2, "cc by nc cc by nc"),
        (3, None),
        (4, ""),
        (5, "Relesed under the MIT licence"),
        (6, "nothing " * 40000 + "CC-BY-NC"),
        (7, "undermine the mit licenses"),
        (1, "Released Under the MIT License. See apache-license, version 2"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("clash")).withColumn("id", F.lit(1))
    got = {r.doc_id: r for r in lic.license_summary(docs).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (10, 2, 1, 6, "apache-2,mit", "apache-2,mit")
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].score) == (2, 0, 3, 1.0)
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].labels, got[3].score) == (0, 0, None, "", 0.0)
    assert tuple(got[4])[1:] == tuple(got[3])[1:]
    assert (got[5].n_base, got[5].base_labels, got[5].labels) == (0, "", "mit") and 0.9 < got[5].score < 1
    assert got[6].first_word == 40000
    assert got[7].n_base == 0
    assert lic.license_summary(docs.limit(0)).count() == 0 and lic.license_summary(docs).count() == len(rows)


def test_spans(spark):
    docs = spark.createDataFrame([(5, "so: Relesed under the MIT license, ok")], "doc_id long, text string")
    (note,) = lic.scan_licenses(docs).first().notices
    assert (note.label, note.first_word, note.last_word, note.edits) == ("mit", 1, 5, 1)
    assert "so relesed under the mit license ok"[note.first : note.last + 1] == "relesed under the mit license"
