"""Near-duplicates by Jaccard similarity of word shingles, none lost: prefix and position filters, then exact sets.

Two sets of Jaccard similarity s share, in any one order of all shingles, a shingle among the first (1 - s) n + 1 of
either. Documents are dealt by these keys, rarest shingles first, and documents that meet at a key are candidates if
their sizes and the key's positions still allow s. Candidates are verified on their whole shingle sets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, slices, space_words, stash, utf8
from .components import connected_components
from .simhash import fingerprint, fingerprint_links

#: Cells by which keys are salted, and the multiplier of shingle hashes.
CELLS, MULTIPLIER = 1 << 18, np.uint64(0x9E3779B97F4A7C15)
#: Finer cells that tell about how often a shingle occurs, counted in parts. A shingle that n documents share stands out
#: once n passes a few roots of a cell's mean, so runs of documents that are not alike grow with that root only.
FINE, PART = 1 << 22, 1 << 16
#: Runs (documents that share a key) of up to SMALL_RUN are paired; a key is salted so that about SALT_ROWS stay together.
SMALL_RUN, SALT_ROWS = 4, 1 << 12
#: Longs of parities, and documents ahead in a run that those outside its largest part meet before they meet all.
WORDS, AHEAD = 8, 8
PARITIES = [f"p{i}" for i in range(WORDS)]
#: Bits of the filter that tells which documents verification asks for. It only saves work: where it is full, all pass.
FILTER_BITS = 1 << 25


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles; fewer words than size are one shingle, none are no shingle."""
    return _shingles(space_words(text), size)


def _shingles(words: list[bytes], size: int) -> np.ndarray:
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64).view(np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled = rolled * MULTIPLIER + hashes[k : k + n]
    return np.unique(rolled.view(np.int64))


def rarest(shingles: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """So many of the rarest shingles of a set that any two sets of that Jaccard similarity share one (prefix filter).

    Similar sets share similarity * n of the n shingles of either, so among any more than the rest one is shared, if
    all sets go by one order. That is by the count of a shingle's cell, then by hash; cells only make it cheap.
    """
    n = len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1
    return shingles[np.argsort(counts[shingles & (len(counts) - 1)], kind="stable")[:n]]


def content_key(words: list[bytes]) -> bytes:
    """16 bytes that all texts of the same words share."""
    return xxhash.xxh128_digest(b" ".join(words))


def node_of(key: bytes) -> int:
    """The first eight bytes of a content key as a signed long: what candidates carry."""
    return int.from_bytes(key[:8], "big", signed=True)


def _summed(parts: DataFrame) -> np.ndarray:
    """The tasks' compressed counts of the fine cells (node: number of the part, cells) added up, part by part."""
    names = ["node", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for node, cells in zip(batch.column("node").to_pylist(), batch.column("cells"), strict=True):
                sums[node] = sums.get(node, np.uint32(0)) + np.frombuffer(zlib.decompress(cells.as_buffer()), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([zlib.compress(c.tobytes(), 1) for c in sums.values()], pa.binary())], names=names)

    total = np.zeros(FINE, np.uint32)
    for r in parts.repartition("node").mapInArrow(run, "node long, cells binary").collect():
        total[r["node"] * PART : (r["node"] + 1) * PART] = np.frombuffer(zlib.decompress(r["cells"]), np.uint32)
    return total


def steps_of(fine: np.ndarray) -> np.ndarray:
    """A byte for each count, 16 steps for each doubling: all that the order of shingles needs."""
    return np.minimum(16 * np.log2(1 + fine.astype(np.float32)), 255).astype(np.uint8)


def _keys(rows: DataFrame, size: int, prints: bool = False) -> DataFrame:
    """(id, text_key, key, node, fp, cells): MD5 of the text, content key and its start, SimHash fingerprint if prints;
    rows of each task at the end have its cells instead, with the number of the part as node."""
    names = ["id", "text_key", "key", "node", "fp", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(FINE, np.uint32)
        for batch in slices(batches):
            texts = utf8(batch, "text")
            words = [space_words(t) for t in texts]
            keys = [content_key(w) for w in words]
            sets = [_shingles(w, size) for w in words]
            np.add.at(cells, np.concatenate(sets) & (FINE - 1), np.uint32(1))
            none = pa.nulls(len(keys), pa.binary())
            fps = pa.array(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)) if prints else pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([md5(t).digest() for t in texts], pa.binary()), pa.array(keys, pa.binary()), pa.array(map(node_of, keys), pa.int64()), fps, none], names=names)
        parts = [zlib.compress(c.tobytes(), 1) for c in cells.reshape(-1, PART)]
        n = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int64()), pa.nulls(n, pa.int64()), pa.array(parts, pa.binary())], names=names)

    return rows.mapInArrow(run, "id long, text_key binary, key binary, node long, fp long, cells binary")


def salts_of(counts: np.ndarray, salt_rows: int) -> np.ndarray:
    """Parts that the keys of each cell are dealt to: more than one where a cell stands out among all."""
    return np.maximum(counts - 4 * int(counts.mean()), 0) // salt_rows + 1


def _entries(rows: DataFrame, size: int, similarity: float, steps: np.ndarray, salts: np.ndarray) -> DataFrame:
    """(key, salt, node, at): the prefix of each text; at has the size of its set above and the key's position below
    the 32nd bit. Keys of frequent cells are salted by node. Copies within a task are taken once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            keys, nodes, ats = [], [], []
            for t in utf8(batch, "text"):
                words = space_words(t)
                node = node_of(content_key(words))
                if node in seen:
                    continue
                seen.add(node)
                shingles = _shingles(words, size)
                first = rarest(shingles, steps, similarity)
                keys.append(first)
                nodes.append(np.full(len(first), node, np.int64))
                ats.append((len(shingles) << 32) + np.arange(len(first), dtype=np.int64))
            if keys:
                key, node = np.concatenate(keys), np.concatenate(nodes)
                salt = (node & 0x7FFFFFFF) % salts[key & (CELLS - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(salt.astype(np.int32)), pa.array(node), pa.array(np.concatenate(ats))], names=["key", "salt", "node", "at"])

    return rows.mapInArrow(run, "key long, salt int, node long, at long")


def _fits(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets that first meet at one key can be similar: by sizes, and by what is left after the key's position."""
    n, m = a >> 32, b >> 32
    left = np.minimum(n - (a & 0xFFFFFFFF), m - (b & 0xFFFFFFFF))
    return (left >= similarity / (1 + similarity) * (n + m) - 1e-6) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6)


def _fits_sql(a: str, b: str, similarity: float) -> Column:
    n, m = F.shiftright(a, 32), F.shiftright(b, 32)
    left = F.least(n - F.col(a).bitwiseAND(0xFFFFFFFF), m - F.col(b).bitwiseAND(0xFFFFFFFF))
    return (left >= similarity / (1 + similarity) * (n + m) - 1e-6) & (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6)


def _meet(entries: DataFrame, similarity: float, small_run: int, salts: np.ndarray) -> DataFrame:
    """(key, a, b, at, fit): with a null key, a candidate pair (a < b); else document a of a large run, of which b is
    the smallest, and whether the two may be similar. Tasks stream through their sorted keys and hold the last rows."""
    names = ["key", "a", "b", "at", "fit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4  # key, salt, node, at of the run that may go on
        open_run: tuple[int, int, int, int] | None = None  # a large run that goes on: key, salt and its smallest node

        def settle(rows: list[np.ndarray], going_on: bool) -> Iterator[pa.RecordBatch]:
            """Whole runs, but for the last one if it may go on and is large already."""
            nonlocal open_run
            key, salt, node, at = rows
            edge = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1
            starts = np.concatenate([[0], edge])
            sizes = np.diff(np.append(starts, len(key)))
            low, low_at, n = np.repeat(node[starts], sizes), np.repeat(at[starts], sizes), np.repeat(sizes, sizes)
            if open_run is not None:
                if open_run[:2] == (key[0], salt[0]):
                    low[: sizes[0]], low_at[: sizes[0]] = open_run[2:]
                    n[: sizes[0]] = small_run + 1  # it was large before
                open_run = None
            large = (n > small_run) | (salts[key & (CELLS - 1)] > 1)
            if going_on:
                open_run = (int(key[-1]), int(salt[-1]), int(low[-1]), int(low_at[-1]))
            if large.any():
                fit = _fits(at[large], low_at[large], similarity)
                yield pa.RecordBatch.from_arrays([pa.array(x[large]) for x in (key, node, low, at)] + [pa.array(fit)], names=names)
            some = (n > 1) & ~large
            key, salt, node, at = key[some], salt[some], node[some], at[some]
            for d in range(1, small_run):
                if len(key) <= d:
                    break
                i = np.flatnonzero((key[d:] == key[:-d]) & (node[d:] != node[:-d]))
                i = i[_fits(at[i], at[i + d], similarity)]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(i), pa.int64()), pa.array(node[i]), pa.array(node[i + d]), pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.bool_())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([h, batch.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, ("key", "salt", "node", "at"), strict=True)]
            key, salt = rows[:2]
            last = int(np.flatnonzero((key != key[-1]) | (salt != salt[-1])).max(initial=-1)) + 1
            if len(key) - last > small_run:  # large for certain: no need to wait for its end
                yield from settle(rows, True)
                held = [x[:0] for x in rows]
                continue
            if last:
                yield from settle([x[:last] for x in rows], False)
            if last or open_run is None or open_run[:2] != (key[0], salt[0]):
                held = [x[last:] for x in rows]
            else:  # few more rows of a run that is large already
                yield from settle(rows, True)
                held = [x[:0] for x in rows]
        if len(held[0]):
            yield from settle(held, False)

    return entries.mapInArrow(run, "key long, a long, b long, at long, fit boolean")


def _asked_filter(nodes: DataFrame) -> np.ndarray:
    """Bits of the nodes asked for, in a filter of one bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[batch.column("node").to_numpy() & (FILTER_BITS - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["cells"])

    one = lambda total, row: total | np.frombuffer(zlib.decompress(row["cells"]), np.uint8)
    return nodes.mapInArrow(run, "cells binary").rdd.treeAggregate(np.zeros(FILTER_BITS // 8, np.uint8), one, lambda a, b: a | b)


def parities(shingles: np.ndarray) -> np.ndarray:
    """WORDS longs: for each of their bits, whether an odd number of the shingles fall on it. Where those of two sets
    differ, some shingle is in one set only, so the bits that differ are at most as many as such shingles."""
    return np.packbits(np.bincount((shingles >> 20) & (64 * WORDS - 1), minlength=64 * WORDS) & 1).view(np.int64)


def _whole_sets(rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, key, shingles, p0, p1, ...): whole shingle sets and their parities of the nodes asked for."""
    asked = stash(nodes.distinct())
    held = rows.sparkSession.sparkContext.broadcast(_asked_filter(asked))
    names = ["node", "key", "shingles", *PARITIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = held.value, set()
        for batch in slices(batches):
            nodes, keys, found, odd = [], [], [], [np.zeros((0, WORDS), np.int64)]
            for t in utf8(batch, "text"):
                words = space_words(t)
                key = content_key(words)
                node = node_of(key)
                at = node & (FILTER_BITS - 1)
                if bits[at >> 3] >> (7 - (at & 7)) & 1 and key not in seen:
                    seen.add(key)
                    shingles = _shingles(words, size)
                    nodes.append(node)
                    keys.append(key)
                    found.append(shingles.tobytes())
                    odd.append(parities(shingles)[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.binary()), *(pa.array(c) for c in np.concatenate(odd).T)], names=names)

    fields = ", ".join(f"{c} long" for c in PARITIES)
    whole = rows.mapInArrow(run, f"node long, key binary, shingles binary, {fields}").join(asked, "node", "left_semi").dropDuplicates(["node", "key"])
    whole = stash(whole)
    discard(asked)
    return whole


def _verified(whole: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs of nodes -> (src, dst) content keys whose whole shingle sets have the similarity."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield batch.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))

    sets = whole.select("node", "key", "shingles")
    both = pairs.join(sets.toDF("a", "src", "x"), "a").select("b", "src", "x").join(sets.toDF("b", "dst", "y"), "b")
    return stash(both.select("src", "x", "dst", "y").mapInArrow(similar, "src binary, dst binary"))


def _may_be(a: str, b: str, similarity: float) -> Column:
    """_fits, and no more parities differ than shingles of similar sets may. Columns of b have the suffix b."""
    n, m = F.shiftright(a, 32), F.shiftright(b, 32)
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}b"))) for c in PARITIES[1:]), F.bit_count(F.col(PARITIES[0]).bitwiseXOR(F.col(f"{PARITIES[0]}b"))))
    return _fits_sql(a, b, similarity) & (differ <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-6)


def _strays(members: DataFrame, parts: DataFrame) -> DataFrame:
    """members with part and stray, of the keys that have a stray: a document outside the largest part of its key."""
    own = stash(members.join(parts.toDF("a", "part"), "a"))
    main = own.groupBy("key", "part").count().groupBy("key").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.count("*").alias("n")).where("n > 1").select("key", "main")
    known = stash(own.join(main, "key").withColumn("stray", F.col("part") != F.col("main")).drop("main"))
    discard(own)
    return known


def _neighbours(known: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b): each document and the next AHEAD of its run in an order by hash, if one is a stray."""
    run = Window.partitionBy("key", "b").orderBy(F.xxhash64("a", "key"), "a")
    own = ("a", "at", "part", "stray", *PARITIES)
    ahead = F.array_compact(F.array(*(F.lead(F.struct(*own), n).over(run) for n in range(1, AHEAD + 1))))
    both = known.select(*own, ahead.alias("x")).select(*own, F.explode("x").alias("x")).select(*own, *(F.col(f"x.{c}").alias(f"{c}b") for c in own))
    good = both.where((F.col("part") != F.col("partb")) & (F.col("stray") | F.col("strayb")) & _may_be("at", "atb", similarity))
    return good.select(F.least("a", "ab").alias("a"), F.greatest("a", "ab").alias("b")).distinct()


def _left_over(known: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b): each stray and the documents of its keys in other parts that sizes, positions and parities allow.

    Documents in the largest part of their key need no more links among themselves.
    """
    own = ("a", "at", "part", *PARITIES)
    strays = known.where("stray").select("key", *(F.col(c).alias(f"{c}b") for c in own))
    met = strays.join(known.select("key", *own), "key").where((F.col("part") != F.col("partb")) & _may_be("at", "atb", similarity))
    return met.select(F.least("a", "ab").alias("a"), F.greatest("a", "ab").alias("b")).distinct()


def _print_links(first: DataFrame) -> DataFrame:
    """(src, dst): content keys whose SimHash fingerprints are equal or linked, each fingerprint by its smallest key."""
    prints = stash(first.where("key is not null").select("fp", "key").distinct())
    lows = stash(prints.groupBy("fp").agg(F.min("key").alias("low")))
    equal = prints.join(lows, "fp").where("key != low").select(F.col("key").alias("src"), F.col("low").alias("dst"))
    near = fingerprint_links(lows).join(lows.toDF("src", "a"), "src").join(lows.toDF("dst", "b"), "dst")
    return equal.unionAll(near.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, small_run: int = SMALL_RUN, salt_rows: int = SALT_ROWS, prints: bool = False) -> DataFrame:
    """(id, text_key, copies, component, kept), one row for each id and different text.

    Documents whose size-word shingles have a Jaccard similarity of at least similarity are linked, and, with prints, also
    those whose SimHash fingerprints differ in at most two bits (simhash.fingerprint_links); component is the
    smallest id reachable by links, text_key the MD5 of the text, copies how many rows the id has with that text, and
    kept tells the one row of smallest id, then text_key, of each component. Runs over small_run go by their smallest
    document first; what stays outside the largest component then meets a few others, and what is still outside is compared with the
    whole run, so no link is lost and a group's pairs are not listed. Documents with the same words are one class from the start; those without words are
    one class too, and null counts as empty. Different texts of one id are linked each on their own. Rows whose id is
    null are passed over; an empty table gives an empty result; other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    first = stash(_keys(rows, size, prints))
    print_links = stash(_print_links(first)) if prints else None
    fine = _summed(first.where("cells is not null").select("node", "cells"))
    salts = salts_of(fine.reshape(-1, CELLS).sum(axis=0, dtype=np.int64), salt_rows)
    keyed = first.where("id is not null").groupBy("id", "text_key").agg(F.first("key").alias("key"), F.first("node").alias("node"), F.count("*").alias("copies"))
    entries = _entries(rows, size, similarity, steps_of(fine), salts).repartition("key", "salt").sortWithinPartitions("key", "salt", "node")
    live = stash(_meet(entries, similarity, small_run, salts))
    members = live.where("key is not null")
    tops = members.groupBy("key", "b").count().groupBy("key").agg(F.min("b").alias("top"), F.count("*").alias("n")).where("n > 1").select("key", "top")
    hubs = members.select("key", "b").distinct().join(tops, "key").select(F.col("top").alias("a"), "b")
    pairs = live.where("key is null").select("a", "b").unionAll(members.where("fit").select(F.col("b").alias("a"), F.col("a").alias("b"))).unionAll(hubs)
    pairs = stash(pairs.where("a < b").distinct())
    whole = _whole_sets(rows, pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).unionAll(members.select("a")), size)
    verified = _verified(whole, pairs, similarity)
    groups = connected_components(verified.unionAll(print_links) if prints else verified)
    classes = stash(keyed.groupBy("key").agg(F.first("node").alias("node"), F.min(F.struct("id", "text_key")).alias("low")))
    # two classes may start alike: such a node is in no part, so all that it meets is compared
    part = F.when(F.count("*") == 1, F.min(F.coalesce("component", "key"))).otherwise(F.first("key"))
    done = [live, pairs, whole]
    marked, odd = members.select("key", "b", "a", "at"), whole.select(F.col("node").alias("a"), *PARITIES)
    for propose in (_neighbours, _left_over):
        parts = classes.join(groups.toDF("key", "component"), "key", "left").groupBy("node").agg(part.alias("part"))
        known = _strays(marked, parts)
        if known.isEmpty():
            break
        if propose is _neighbours:  # parts only grow together, so no other key can have a stray later
            done.append(known)
            known = stash(known.join(odd, "a"))
            marked = known.drop("part", "stray")
        done.append(known)
        more = _verified(whole, propose(known, similarity), similarity)
        if not more.isEmpty():
            groups = connected_components(groups.toDF("src", "dst").unionAll(more))
    for table in done:
        discard(table)
    labelled = classes.join(groups.toDF("key", "component"), "key", "left").select("key", "low", F.coalesce("component", "key").alias("group"))
    lowest = labelled.groupBy("group").agg(F.min("low").alias("first"))
    of_class = labelled.join(lowest, "group").select("key", "first")
    out = keyed.join(of_class, "key")
    return out.select("id", "text_key", "copies", F.col("first.id").alias("component"), ((F.col("id") == F.col("first.id")) & (F.col("text_key") == F.col("first.text_key"))).alias("kept"))
