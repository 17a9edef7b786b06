import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from quillmark.llm import heapbpe

PARTS = ["a", "b", "é", "ß", " ", "  ", "\n", "\t", "'s", "'l", "'", "1", "٣", "²", "!", "$$$", "的", "한국", "👩‍👩‍👧", " ", "\x1c", "\x85", "​", "\x00", "ing", "the", " th", "<|endoftext|>", "<|endof", "text|>"]


@pytest.fixture(scope="module")
def pair():
    path, pattern = heapbpe.default_file()
    return heapbpe.heap_codec(path, pattern), tokenizers.Tokenizer.from_file(path)


def ids(c, text):
    return np.frombuffer(c.encode(text), dtype="<u4").tolist()


def same(c, lib, text):
    want = lib.encode(text, add_special_tokens=False).ids
    assert ids(c, text) == want
    assert c.decode(c.encode(text)) == lib.decode(want, skip_special_tokens=False)


def test_equals_the_library_on_mixed_and_on_long_words(pair):
    c, lib = pair
    rng = random.Random(4)
    for _ in range(800):
        same(c, lib, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))))
    for n in (9, 60, 700, 20000):
        same(c, lib, "".join(rng.choice("abcdeitnsothgr") for _ in range(n)))
    for x in ("a", "ab", " ", "\n ", "的", "!?"):
        same(c, lib, x * 3000)


def test_parts_split_like_whole_texts(pair, monkeypatch):
    c, lib = pair
    monkeypatch.setattr(heapbpe, "CHUNK_CHARS", 5)
    rng = random.Random(6)
    for _ in range(400):
        same(c, lib, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 80))))


def test_every_character_splits_as_in_the_library(pair):
    c, lib = pair
    text = "".join(f"a{chr(i)}a" for i in (*range(0x3000), *range(0xA000, 0x20000, 7)) if not 0xD800 <= i < 0xE000)
    same(c, lib, text)


def test_table_with_nulls_repeats_and_clashing_columns(spark, pair):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (1, "Hello wörld"), (None, "x<|endoftext|>y"), (5, "word and more " * 20000)]
    docs = spark.createDataFrame([(a, b, "clash", 7) for a, b in rows], "doc_id long, text string, id string, ids int")
    got = heapbpe.heap_digests(heapbpe.heap_decode(heapbpe.heap_encode(docs))).collect()
    want = []
    for i, t in rows:
        tokens = np.array(pair[1].encode(t or "", add_special_tokens=False).ids, dtype="<u4")
        want.append((i, len(tokens), hashlib.sha256(tokens.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    once = heapbpe.heap_digests(heapbpe.heap_round_trip(docs)).collect()
    assert sorted(map(tuple, once), key=key) == sorted(want, key=key)
    assert heapbpe.heap_digests(heapbpe.heap_round_trip(docs.limit(0))).count() == 0
    nothing = spark.createDataFrame([(1, None)], "id long, ids binary")
    assert heapbpe.heap_digests(heapbpe.heap_decode(nothing)).first()["n_tokens"] == 0


def test_other_files(spark):
    with pytest.raises(ValueError):
        heapbpe.heap_codec(public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.PATTERN)
    docs = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    row = heapbpe.heap_encode(docs, path=path).first()
    assert np.frombuffer(row["ids"], "<u4").tolist() == tokenizers.Tokenizer.from_file(path).encode("abc def").ids
