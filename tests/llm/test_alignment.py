import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from quillmark.llm import alignment

WORDS = ["the", "naïve", "Übung", "tokenizer", "한국어", "👩‍👩‍👧", "x=1", "\n\n", "  ", "<|endoftext|>", "<s>", "▁", "qzqzqzqz", "1234567", "l'été", "\x00", "ﬁ", "֏", "不"]


@pytest.fixture(scope="module")
def libraries():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def encoded(libraries, text):
    """(a ids with bytes, b ids with bytes), empty if they do not give back space+text."""
    t, s = libraries
    letters = {c: b for b, c in enumerate(alignment.byte_letters())}
    a = [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids] if text else []
    b = []
    for i in s.encode(text) if text else []:
        p = s.id_to_piece(i)
        b.append((i, bytes([int(p[3:-1], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode()))
    want = b" " + (text or "").encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def brute(libraries, rows):
    docs = []
    for _, text in rows:
        a, b = encoded(libraries, text)
        groups, ga, gb, ea, eb = [], [], [], 0, 0
        a, b = list(a), list(b)
        while a or b:
            if ea <= eb and (a and (ea < eb or not ga)):
                ga.append(a[0][0])
                ea += len(a.pop(0)[1])
            else:
                gb.append(b[0][0])
                eb += len(b.pop(0)[1])
            if ea == eb and ga and gb:
                groups.append((ga, gb))
                ga, gb = [], []
        docs.append(groups)
    held = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for g in docs]
    count = Counter(p for h in held for p in h)
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for (i, _), groups, h in zip(rows, docs, held, strict=True):
        told = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(h.values()), sum(k for p, k in h.items() if count[p] == top[p[0]]), sum(k * count[p] for p, k in h.items()), hashlib.sha256(told.encode()).hexdigest() if told else ""))
    return out


def texts():
    rng = random.Random(3)
    made = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    return [None, "", " ", "a", "ab", "zq" * 300, "的" * 50, *made, made[0], made[0]]


def check(spark, libraries, rows):
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id long, text string, row string, n_a int, pair int").repartition(3)
    got = sorted(map(tuple, alignment.alignment(docs).collect()), key=str)
    assert got == sorted(brute(libraries, rows), key=str)


def test_equals_brute_force(spark, libraries):
    check(spark, libraries, [(k % 50 or None, t) for k, t in enumerate(texts())])


def test_small_blocks_and_rare_pairs_give_the_same(spark, libraries, monkeypatch):
    rows = list(enumerate(texts()))
    left, right = alignment.sides(*alignment.default_files())
    full = [t for t in texts() if t]
    want = [x.tolist() for x in alignment.Slice(left, right, full).links()]
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 7)
    assert [x.tolist() for x in alignment.Slice(left, right, full).links()] == want
    monkeypatch.undo()
    monkeypatch.setattr(alignment, "HOT_PAIRS", 40)
    check(spark, libraries, rows)
    monkeypatch.setattr(alignment, "HOT_PAIRS", 0)
    check(spark, libraries, rows)


def test_rows_of_many_parts(spark, libraries, monkeypatch):
    for name, value in (("ROW_PAIRS", 5), ("TASK_PAIRS", 10), ("SLICE_BYTES", 100)):
        monkeypatch.setattr(alignment, name, value)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert alignment.align_texts(docs).where("part > 0").count() > 0
    check(spark, libraries, rows)


def test_large_groups_are_folded():
    one = alignment.Slice(*alignment.sides(*alignment.default_files()), ["abc abd " * 200])
    n_a, n_b = len(one.a.ids), len(one.b.ids)
    one.group_doc, one.sizes_a, one.sizes_b = one.group_doc[:1], np.array([n_a]), np.array([n_b])  # as if no inner ends met
    _, pair, times = one.links()
    want = Counter(x * len(one.b.strings) + y for x in one.a.ids.to_pylist() for y in one.b.ids.to_pylist())
    assert dict(zip(pair.tolist(), times.tolist(), strict=True)) == want


def test_empty_table(spark):
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert alignment.alignment(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()["n_links"] == 0
