import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quillmark.llm import bpe

PARTS = ["a", "b", "é", "ß", " ", "  ", "\n", "\t", "'s", "'l", "'", "1", "٣", "²", "!", "$$$", "的", "한국", "👩‍👩‍👧", "\u00a0", "\x1c", "\x85", "\u200b", "\x00", "ing", "the", " th"]


@pytest.fixture(scope="module")
def pair():
    path, pattern = bpe.default_vocabulary()
    ranks = bpe.read_ranks(path)
    return bpe.codec(path, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ids(c, text):
    return np.frombuffer(c.encode(text), dtype="<u4").tolist()


def test_equals_the_library_on_mixed_and_on_long_matches(pair):
    c, want = pair
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += ["".join(rng.choice("abcdeitnsothgr") for _ in range(n)) for n in (9, 60, 700, 5000)]
    texts += [x * 3000 for x in ("a", "ab", " ", "\n ", "的", "!?")]
    for t in texts:
        assert ids(c, t) == want.encode_ordinary(t)
        assert c.decode(ids(c, t)) == t.encode()


def test_halved_texts_split_like_whole_ones(pair, monkeypatch):
    c, want = pair
    monkeypatch.setattr(bpe, "LEAF_CHARS", 6)
    rng = random.Random(6)
    for _ in range(600):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 80)))
        assert c.matches(t) == c.split.findall(t)
        assert ids(c, t) == want.encode_ordinary(t)


def test_round_trip_of_a_table(spark, pair):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (1, "Hello wörld"), (None, "x"), (5, "word and more " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("id", F.lit("clash"))
    got = bpe.digests(bpe.round_trip(docs)).collect()
    want = []
    for i, t in rows:
        tokens = np.array(pair[1].encode_ordinary(t or ""), dtype="<u4")
        want.append((i, len(tokens), hashlib.sha256(tokens.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    again = bpe.decode_ids(bpe.encode_texts(docs)).select("id", F.decode("data", "utf-8").alias("t")).collect()
    assert sorted((r.id or 0, r.t) for r in again) == sorted((i or 0, t or "") for i, t in rows)
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_path_is_a_parameter(spark):
    docs = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("b", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    row = bpe.encode_texts(docs, path=path).first()
    assert np.frombuffer(row["ids"], "<u4").tolist() == enc.encode_ordinary("abc def")
