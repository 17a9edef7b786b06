import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillmark.llm import simhash


def brute_components(prints: dict[int, int]) -> dict[int, int]:
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def test_fingerprint_counts_every_shingle():
    text = "A b c a B c a b c d é"
    words = "a b c a b c a b c d é".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"One  two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_every_pair_within_two_bits_shares_a_key():
    rng, tables = random.Random(3), simhash.golay_tables()
    for n in (0, 1, 2):
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), n):
                b ^= 1 << bit
            row, key = simhash.golay_keys(np.array([a, b], dtype=np.uint64), tables)
            assert set(key[row == 0]) & set(key[row == 1])


def test_links_equal_brute_force_for_small_and_large_buckets(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(63) for _ in range(20)]
    base = rng.getrandbits(63)
    prints += [base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = brute_components(dict(enumerate(prints)))
    for size in (4, 1000):
        links = [(r.src, r.dst) for r in simhash.fingerprint_links(df, small_bucket=size).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in links)
        label = {p: p for p in prints}
        for _ in prints:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        assert {p: prints[want[i]] for i, p in enumerate(prints)} == label


def test_nulls_ties_repeats_and_clashing_columns(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "x"), (2, text, "y"), (3, None, None), (4, "", "z"), (None, text, "n"), (2, text, "y"), (5, "word " * 30000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component", F.lit("clash"))
    got = {(r.id, r.component) for r in simhash.simhash_components(docs).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (3, 3), (4, 3), (5, 5)}
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_large_star_small_star_on_paths(spark):
    from quillmark.llm.components import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
