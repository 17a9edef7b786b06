"""Embedding near-duplicates with a robust-pruned flat graph.

Equal vectors meet in one class. Each class goes to the shards of its nearest centres, so shards overlap. Tasks build
a robust-pruned graph (Vamana style) on each shard; the adjacency lists of a class are united over its shards; tasks
then search for every class, greedily from the shard's medoid and its own node, and go on from everything in range to
its neighbours. What the search meets is verified by the cosine in double precision. A sample is compared with brute
force, and the search is widened if it finds too little.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash
from .components import connected_components

#: Rows of a shard aimed at; rows of one block of a larger shard; vectors that centres are fitted on; most centres.
SHARD, BLOCK, SAMPLE, CENTRES = 1500, 2048, 20_000, 4096
#: The graph: out-degree, candidates by nearness and by chance, how much nearer an occluding neighbour has to be.
DEGREE, NEAR, CHANCE, ALPHA = 24, 48, 24, 1.2
#: The search: beam, shards of a vector, cosine below the threshold that is still gone through.
BEAM, OVERLAP, SLACK = 24, 2, 0.02
#: Audited vectors (about), and the recall that must be reached.
AUDITED, RECALL = 256, 0.9
#: The coarse hash of the audit: sets of planes, vectors of a bucket at most, rows of all buckets compared (about).
HASHES, BUCKET, BUCKET_ROWS = 8, 1000, 200_000


def unit(vector: list | None, width: int | None = None) -> np.ndarray | None:
    """The vector at length one in double precision, or None: null, zero, another width, or with a null or non-finite part."""
    if not vector or any(x is None for x in vector) or width not in (None, len(vector)):
        return None
    v = np.array(vector, dtype=np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def centres_of(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    rng = np.random.default_rng(1)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds if k > 1 else 1):
        own = np.concatenate([(sample[at : at + 4096] @ centres.T).argmax(axis=1) for at in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def robust_graph(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """(n, DEGREE) neighbours, -1 where there are fewer. Candidates are the nearest rows and some by chance; the
    closest is taken and removes candidates that are ALPHA times nearer to it than to the row, and so on. Reverse
    edges join the candidates of a second round."""
    n, rng = len(x), np.random.default_rng(seed)
    if n == 1:
        return np.full((1, DEGREE), -1, dtype=np.int32)
    near = min(NEAR, n - 1)
    lists = []
    for at in range(0, n, 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -9
        lists.append(np.argpartition(-s, near - 1, axis=1)[:, :near])
    candidates = np.concatenate([np.concatenate(lists), rng.integers(0, n, (n, CHANCE))], axis=1)
    graph = prune(x, candidates)
    source, place = np.nonzero(graph >= 0)
    target = graph[source, place]
    order = rng.permutation(len(source))
    source, target = source[order], target[order]
    by = np.argsort(target, kind="stable")
    target, source = target[by], source[by]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((n, DEGREE), -1, dtype=np.int64)
    some = rank < DEGREE
    back[target[some], rank[some]] = source[some]
    return prune(x, np.concatenate([graph, back], axis=1))


def prune(x: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    n = len(x)
    out = np.full((n, DEGREE), -1, dtype=np.int32)
    for at in range(0, n, 256):
        c = np.sort(candidates[at : at + 256], axis=1)
        rows = np.arange(at, at + len(c))
        live = (c >= 0) & (c != rows[:, None])
        live[:, 1:] &= c[:, 1:] != c[:, :-1]
        y = x[np.maximum(c, 0)]
        d = np.where(live, 1 - np.einsum("ij,ikj->ik", x[rows], y), np.inf)
        between = 1 - np.einsum("ikj,ilj->ikl", y, y)
        for k in range(DEGREE):
            best = d.argmin(axis=1)
            good = np.isfinite(d[np.arange(len(c)), best])
            if not good.any():
                break
            out[rows[good], k] = c[np.arange(len(c)), best][good]
            hidden = ALPHA * between[np.arange(len(c)), best] <= d
            hidden[np.arange(len(c)), best] = True
            d = np.where(hidden, np.inf, d)
    return out


def greedy_range_search(x: np.ndarray, graph: np.ndarray, threshold: float, beam: int = BEAM) -> np.ndarray:
    """(n, n) booleans: what the search from the medoid and from its own node finds in range for each row."""
    n = len(x)
    medoid = int((x @ x.mean(axis=0)).argmax())
    found = np.zeros((n, n), dtype=bool)
    padded = np.concatenate([x, np.zeros((1, x.shape[1]))])
    source, place = np.nonzero(graph >= 0)
    edges = np.unique(np.concatenate([source * n + graph[source, place], graph[source, place].astype(np.int64) * n + source]))
    other, first = edges % n, np.searchsorted(edges // n, np.arange(n + 1))
    for at in range(0, n, 128):
        q = np.arange(at, min(n, at + 128))
        met = np.zeros((len(q), n + 1), dtype=bool)
        met[:, n] = True
        i = np.arange(len(q))
        ids = np.full((len(q), beam), n)
        ids[:, 0], ids[:, 1] = q, medoid
        ids[:, 1][q == medoid] = n
        met[i, q] = met[:, medoid] = True
        near = np.where(ids < n, np.einsum("ij,ikj->ik", x[q], padded[ids]), -9.0)
        done = ids == n
        while not done.all():
            at_best = np.where(done, -9.0, near).argmax(axis=1)
            busy = np.flatnonzero(~done[i, at_best])
            done[busy, at_best[busy]] = True
            step = graph[ids[busy, at_best[busy]]].astype(np.int64)
            step[step < 0] = n
            step[met[busy[:, None], step]] = n
            met[busy[:, None], step] = True
            score = np.where(step < n, np.einsum("ij,ikj->ik", x[q[busy]], padded[step]), -9.0)
            all_ids, all_near = np.concatenate([ids[busy], step], axis=1), np.concatenate([near[busy], score], axis=1)
            all_done = np.concatenate([done[busy], step == n], axis=1)
            top = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
            ids[busy], near[busy], done[busy] = (np.take_along_axis(z, top, axis=1) for z in (all_ids, all_near, all_done))
        # go on from all in range, along edges in both directions
        met[:, :n] = False
        front_q, k = np.nonzero((near >= threshold - SLACK) & (ids < n))
        front = ids[front_q, k]
        met[front_q, front] = True
        while len(front):
            many = first[front + 1] - first[front]
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            key = np.unique(np.repeat(front_q, many) * (n + 1) + other[np.repeat(first[front], many) + within])
            who, to = key // (n + 1), key % (n + 1)
            new = ~met[who, to]
            who, to = who[new], to[new]
            close = np.einsum("ij,ij->i", x[q[who]], x[to]) >= threshold - SLACK
            front_q, front = who[close], to[close]
            met[front_q, front] = True
        who, to = np.nonzero(met[:, :n])
        exact = np.einsum("ij,ij->i", x[q[who]], x[to]) >= threshold
        found[q[who[exact]], to[exact]] = True
    found |= found.T
    np.fill_diagonal(found, False)
    return found


def _classes(rows: DataFrame) -> DataFrame:
    """(id, key, vector): key of equal vectors, unit vector as bytes; both null where the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [unit(v) for v in batch.column("vector").to_pylist()]
            data = [None if v is None else v.tobytes() for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([None if d is None else md5(d).digest() for d in data], pa.binary()), pa.array(data, pa.binary())], names=["id", "key", "vector"])

    return rows.mapInArrow(run, "id long, key binary, vector binary")


def _sharded(classes: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    held = classes.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            x = np.array([np.frombuffer(v) for v in batch.column("vector").to_pylist()]).reshape(batch.num_rows, -1)
            r = min(overlap, len(c))
            shards = np.argpartition(-(x @ c.T), r - 1, axis=1)[:, :r] if batch.num_rows else np.zeros((0, r), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("size"), batch.column("vector"), pa.array(np.sort(shards, axis=1).tolist(), pa.list_(pa.int32()))], names=["node", "size", "vector", "shards"])

    return classes.select("node", "size", "vector").mapInArrow(run, "node long, size long, vector binary, shards array<int>")


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("node").to_numpy(), np.array([np.frombuffer(v) for v in table.column("vector").to_pylist()])


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("vector")  # an order that does not depend on how classes are numbered
    node, x = _read(table)
    graph = robust_graph(x)
    return pa.table({"node": pa.array(node), "near": pa.array([node[g[g >= 0]].tolist() for g in graph], pa.list_(pa.int64()))})


def _search(threshold: float, beam: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard, first, second = (k.as_py() for k in key)
        table = table.sort_by("node")
        node, x = _read(table)
        lists = [np.array(g, dtype=np.int64) for g in table.column("near").to_pylist()]
        graph = np.full((len(node), max(1, max(map(len, lists), default=1))), -1, dtype=np.int32)
        for i, g in enumerate(lists):
            at = np.minimum(np.searchsorted(node, g), len(node) - 1)
            at = at[node[at] == g]
            graph[i, : len(at)] = at
        u, v = np.nonzero(greedy_range_search(x, graph, threshold, beam))
        shards, block = np.array(table.column("shards").to_pylist()).reshape(len(node), -1), table.column("block").to_numpy()
        common = np.where((shards[u][:, :, None] == shards[v][:, None, :]).any(axis=2), shards[u], 1 << 30).min(axis=1) if len(u) else u
        own = common == shard  # a pair counts in the first shard that both are in, and in one pair of blocks
        if first != second:
            own &= block[u] != block[v]
        u, v = u[own], v[own]
        links = np.bincount(v, weights=table.column("size").to_numpy()[u], minlength=len(node)).astype(np.int64)
        label = np.arange(len(node))
        while len(u):
            before = label.copy()
            np.minimum.at(label, v, label[u])
            label = label[label]
            if (before == label).all():
                break
        some = links > 0
        return pa.table({"node": pa.array(node[some]), "links": pa.array(links[some]), "hub": pa.array(node[label[some]])})

    return run


def _found(classes: DataFrame, n: int, threshold: float, overlap: int, beam: int, shard_rows: int, block_rows: int) -> DataFrame:
    """(node, links, hub) by class: other vectors linked (size by size), and links that connect what is connected."""
    share = min(1.0, SAMPLE / max(1, n))
    sample = [np.frombuffer(r.vector) for r in classes.where(F.pmod(F.xxhash64("vector"), F.lit(1_000_000)) < share * 1_000_000).select("vector").toLocalIterator()]
    if not sample:
        sample = [np.frombuffer(r.vector) for r in classes.select("vector").limit(1).collect()]
    centres = centres_of(np.array(sample), min(CENTRES, -(-n // shard_rows)))
    sharded = stash(_sharded(classes, centres, overlap))
    placed = sharded.select("*", F.explode("shards").alias("shard"))
    blocks = placed.groupBy("shard").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    placed = placed.join(F.broadcast(blocks), "shard")  # a row for each of CENTRES centres at most
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, "block").alias("first"), F.greatest(b, "block").alias("second")))
    tasks = placed.withColumn("pair", F.explode(both)).select("node", "size", "vector", "shards", "shard", "block", "pair.first", "pair.second")
    lists = tasks.select("node", "vector", "shard", "first", "second").groupBy("shard", "first", "second").applyInArrow(_build, "node long, near array<long>")
    united = stash(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    searched = tasks.join(united, "node").groupBy("shard", "first", "second").applyInArrow(_search(threshold, beam), "node long, links long, hub long")
    return stash(searched)


def coarse_links(classes: DataFrame, n: int, threshold: float, wanted: int) -> DataFrame:
    """(node): about so many classes, or as many as show, that have a link by a coarse hash, whatever the search found.

    Vectors on the same side of a few random planes share a bucket; some buckets, of at most BUCKET vectors, are compared
    all with all. With HASHES sets of planes nearly every link shows in one; if links are many, few buckets do.
    """
    width = classes.agg(F.max(F.octet_length("vector"))).first()[0] // 8
    bits = max(1, math.ceil(math.log2(max(2, n / 16))))
    planes = np.random.default_rng(11).normal(size=(HASHES, width, bits))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.array([np.frombuffer(v) for v in batch.column("vector").to_pylist()])
                for h in range(HASHES):
                    yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(((x @ planes[h] > 0) @ powers) * HASHES + h)], names=["node", "bucket"])

    keyed = classes.select("node", "vector").mapInArrow(hashed, "node long, bucket long")
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size").between(2, BUCKET))
    share = min(1.0, BUCKET_ROWS / max(1, n * HASHES))
    chosen = keyed.join(sizes.where(F.pmod(F.xxhash64("bucket"), F.lit(1_000_000)) < share * 1_000_000), "bucket")

    def linked(table: pa.Table) -> pa.Table:
        x = np.array([np.frombuffer(v) for v in table.column("vector").to_pylist()])
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        return pa.table({"node": pa.array(table.column("node").to_numpy()[near.any(axis=1)], pa.int64())})

    found = chosen.join(classes.select("node", "vector"), "node").select("bucket", "node", "vector").groupBy("bucket").applyInArrow(linked, "node long")
    found = stash(found.distinct())
    share = wanted / max(1, found.count())
    return found.where(F.pmod(F.xxhash64("node", F.lit(13)), F.lit(1_000_000)) < share * 1_000_000)


def audit_recall(classes: DataFrame, found: DataFrame, n: int, threshold: float, audited: int = AUDITED) -> float | None:
    """Share of the links of audited classes that the search found; brute force has them all. None if there was no link.

    Audited are about so many of all classes, chosen by hash, and about so many of those that have a link by a coarse
    hash (coarse_links), so that links are measured also where they are rare.
    """
    share = audited / max(1, n)
    some = classes.where(F.pmod(F.xxhash64("vector", F.lit(7)), F.lit(1_000_000)) < share * 1_000_000).select("node")
    asked = classes.join(some.unionAll(coarse_links(classes, n, threshold, audited)).distinct(), "node").select("node", "vector").collect()
    if not asked:
        return None
    held = classes.sparkSession.sparkContext.broadcast((np.array([r.node for r in asked]), np.array([np.frombuffer(r.vector) for r in asked])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, q = held.value
        for batch in batches:
            if batch.num_rows:
                x = np.array([np.frombuffer(v) for v in batch.column("vector").to_pylist()])
                hit = (q @ x.T >= threshold) & (node[:, None] != batch.column("node").to_numpy()[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array((hit * batch.column("size").to_numpy()).sum(axis=1))], names=["node", "links"])

    exact = classes.select("node", "size", "vector").mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("exact")).where("exact > 0")
    got = exact.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").agg(F.sum("exact").alias("exact"), F.coalesce(F.sum(F.least("exact", F.coalesce("links", F.lit(0)))), F.lit(0)).alias("got")).first()
    return got["got"] / got["exact"] if got["exact"] else None


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, shard_rows: int = SHARD, block_rows: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of df.

    n_links: other vectors at a cosine of threshold or more; component_id: the smallest id reachable by links.
    Vectors that are null, empty, zero, of another width than most, or have null or non-finite parts, link with
    nothing; so do rows whose id is null. Equal rows are linked with each other. An empty table gives none; columns
    besides the two are not read. Rows that share an id are vectors of their own. If the audit on a sample finds less
    than recall, shards overlap more and the beam is wider in a second and third try; less after those is an error. If
    the audit sees no link at all, neither in its sample nor by its coarse hash, there is nothing to measure: the result
    of the last and widest try counts then.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    keyed = stash(_classes(rows))
    usable = keyed.where("id is not null and key is not null")
    common = usable.groupBy(F.octet_length("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if common is None:
        return keyed.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    usable = usable.where(F.octet_length("vector") == common.w)
    # numbered by what is written once: an id may stand for several vectors, so it cannot name a class
    classes = stash(usable.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("size"), F.first("vector").alias("vector")).withColumn("node", F.monotonically_increasing_id()))
    n = classes.count()
    best, best_recall = None, -2.0
    for more in (1, 2, 4):
        found = _found(classes, n, threshold, OVERLAP * more, BEAM * more, shard_rows, block_rows)
        measured = audit_recall(classes, found, n, threshold)
        got = -1.0 if measured is None else measured
        if got > best_recall or measured is None:
            best, best_recall = found, got
        if got >= recall:
            break
        if found is not best:
            discard(found)
    if 0 <= best_recall < recall:
        raise RuntimeError(f"the search found {best_recall:.3f} of the links of the audited vectors, {recall} are asked for")
    links = best.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(best.select(F.col("node").alias("src"), F.col("hub").alias("dst")))
    labelled = classes.join(links, "node", "left").join(groups, "node", "left")
    labelled = labelled.select(F.col("key").alias("of"), "low", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("component", "node").alias("group"))
    lowest = labelled.groupBy("group").agg(F.min("low").alias("c"))
    labelled = labelled.join(lowest, "group").select("of", "n", "c")
    out = keyed.select("id", F.when(F.col("id").isNotNull() & (F.octet_length("vector") == common.w), F.col("key")).alias("key")).join(labelled, F.col("key") == F.col("of"), "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
