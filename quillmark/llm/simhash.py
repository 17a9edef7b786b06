"""SimHash near-duplicates found with Golay-code fuzzy keys.

A fingerprint has 64 bits in three segments (23, 23 and 18 bits). Two fingerprints that differ in at most two bits
agree wholly in one segment (pigeonhole), and differ in at most two bits in the segment after it. The binary Golay
code (23, 12) is perfect: each 23-bit word has one codeword within distance 3. Decoding a segment and its 23 one-bit
neighbours gives one to six codeword indices, and two segments at distance 2 or less share one of them: the word
half way between them decodes to it. A key is thus (segment, its exact bits, codeword index of the next segment).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, space_words, stash, utf8
from .components import connected_components

SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: Buckets up to this many distinct fingerprints are joined and verified; larger ones go by midpoints, exactly.
SMALL_BUCKET = 16


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY << (bit - 11)
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits, and the error pattern of weight 3 or less for each of the 2,048 remainders."""
    upper = np.array([_remainder(x << 11) for x in range(4096)], dtype=np.int64)
    errors = np.zeros(2048, dtype=np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            pattern = sum(1 << b for b in bits)
            errors[_remainder(pattern)] = pattern
    return upper, errors


def golay_indices(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(n,) 23-bit words -> (n, 24) codeword indices: of the word and of each one-bit neighbour."""
    upper, errors = tables
    near = words[:, None] ^ np.concatenate([[0], 1 << np.arange(23, dtype=np.int64)])[None, :]
    return (near ^ errors[upper[near >> 11] ^ (near & 2047)]) >> 11


def golay_keys(prints: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of all keys of the fingerprints (uint64)."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        index = np.sort(golay_indices(parts[(i + 1) % 3], tables), axis=1)
        fresh = np.ones(index.shape, dtype=bool)
        fresh[:, 1:] = index[:, 1:] != index[:, :-1]
        row, at = np.nonzero(fresh)
        rows.append(row)
        keys.append((np.int64(i) << 35) | (parts[i][row] << 12) | index[row, at])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles; 0 if it has no word."""
    words = space_words(text)
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    shingles = [joined[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))
    counts = np.zeros(64, dtype=np.uint64)
    for at in range(0, len(hashes), 255):  # a byte holds the sum of 255 bits
        bits = np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return sum(1 << i for i in np.flatnonzero(2 * counts.astype(np.int64) > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp long): fingerprints as signed longs. Null text counts as empty; an id that is null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.fromiter((fingerprint(t, size) for t in utf8(batch, "text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _keyed(prints: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            rows, keys = golay_keys(fp.view(np.uint64), tables)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], names=["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key long, fp long")


def fingerprint_links(prints: DataFrame, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) -> links (src, dst) that connect exactly those at 2 or fewer differing bits.

    In buckets of up to small_bucket fingerprints all partners are verified. The fingerprints of larger buckets are
    sent to the 65 words at distance 1 or less; those that meet at a word are within two bits of each other, so
    linking each to the smallest is exact and never lists the pairs of a group.
    """
    keyed = stash(_keyed(prints))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = stash(keyed.join(sizes, "key"))
    few = live.where(F.col("n") <= small_bucket)
    pairs = few.select("key", F.col("fp").alias("src")).join(few.select("key", F.col("fp").alias("dst")), "key")
    pairs = pairs.where((F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= 2)).select("src", "dst")
    many = live.where(F.col("n") > small_bucket).select("fp").distinct()
    flips = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    middle = many.select("fp", F.explode(flips).alias("middle"))
    hubs = middle.groupBy("middle").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).where("n > 1")
    stars = middle.join(hubs, "middle").where("fp != dst").select(F.col("fp").alias("src"), "dst")
    return pairs.unionAll(stars).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """One row per document: (id, fp long, component long): the smallest id reachable by links of near fingerprints.

    Documents without words have fingerprint zero and are linked like others. Rows with the same id share that id's
    component; rows whose id is null keep a fingerprint and take their fingerprint's component. An empty table gives
    an empty result; other columns of docs are not read. Copies meet in one fingerprint before any search.
    """
    prints = stash(fingerprints(docs, id_col, text_col, size))
    classes = stash(prints.groupBy("fp").agg(F.min("id").alias("low")))
    groups = connected_components(fingerprint_links(classes))
    labelled = classes.join(groups, classes.fp == groups.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("group"))
    lowest = labelled.groupBy("group").agg(F.min("low").alias("component"))
    by_print = labelled.join(lowest, "group").select("fp", "component")
    return prints.join(by_print, "fp").select("id", "fp", "component")
