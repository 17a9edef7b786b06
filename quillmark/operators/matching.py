"""One-to-one assignment of answers to questions within each assessment."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..sources.scratch import Dealing, discard, stash
from .components import connected_components


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Consecutive rows of one key, from batches sorted by it; one key is held at a time."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = batch.column(key).to_pylist()
        start = 0
        for i, k in enumerate(keys):
            if held and k != current and i == start:
                yield current, pa.Table.from_batches(held)
                held = []
            elif i > start and k != current:
                held.append(batch.slice(start, i - start))
                yield current, pa.Table.from_batches(held)
                held, start = [], i
            current = k
        if start < len(keys):
            held.append(batch.slice(start))
    if held:
        yield current, pa.Table.from_batches(held)


def fold_blocks(df: DataFrame, key: str, order: list[str], fold: Callable[[object, list[dict]], list[dict]], schema: str) -> DataFrame:
    """Run an order-dependent fold over the rows of each key.

    Rows are dealt and sorted by key, and a task streams through its keys one after another, so many small blocks cost
    one task and nothing but one block is in memory.
    """
    sample = df.sparkSession.createDataFrame([], schema).schema
    names = sample.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(sample)
        out: list[dict] = []
        for k, block in by_key(batches, key):
            out += fold(k, block.to_pylist())
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema).select(*names)


def best_assignment(options: list[list[tuple[int, int]]], columns: int) -> list[int]:
    """For each row the column it is given, or -1, so that the total weight is largest.

    options: (column, weight > 0) of each row; integers, so that no rounding decides. Shortest augmenting paths over
    the edges there are, with potentials on the negated weights; each row also has a free place of its own.
    """
    row_of: dict[int, int] = {}
    u, v = [0] * len(options), {}
    for start in range(len(options)):
        reach: dict[int, int] = {}
        via: dict[int, int] = {}
        done: list[int] = []
        heap: list[tuple[int, int]] = []
        row, at, far = start, -1, 0
        while True:
            for j, w in (*options[row], (columns + row, 0)):
                step = far - w - u[row] - v.get(j, 0)
                if step < reach.get(j, step + 1):
                    reach[j], via[j] = step, at
                    heappush(heap, (step, j))
            far, at = heappop(heap)
            while far > reach[at] or at in done:
                far, at = heappop(heap)
            done.append(at)
            if at not in row_of:
                break
            row = row_of[at]
        u[start] += far
        for j in done[:-1]:
            u[row_of[j]] += far - reach[j]
            v[j] = v.get(j, 0) - (far - reach[j])
        while at >= 0:
            before = via[at]
            row_of[at] = start if before < 0 else row_of[before]
            at = before
    out = [-1] * len(options)
    for j, i in row_of.items():
        if j < columns:
            out[i] = j
    return out


#: Confidences count in millionths; equal totals are told apart by TIE_PRIME, up to TIE_RANGE an edge.
MICRO, TIE_PRIME, TIE_RANGE = 1_000_000, 1_073_741_789, 1 << 20
#: Edges of an assessment from which on it is split on Spark before it is solved.
WHOLE_EDGES = 20_000


def tie_breaker(answer_id: int, question_id: int) -> int:
    """Fixed number of an edge; among assignments of the same total the largest sum of these wins."""
    return answer_id % TIE_PRIME * (question_id % TIE_PRIME) % TIE_PRIME % TIE_RANGE


def solve(key: dict, rows: list[dict]) -> list[dict]:
    """Best assignment of the edges of one block: connected parts are solved one by one."""
    part: dict[tuple[str, int], tuple[str, int]] = {}

    def root(x: tuple[str, int]) -> tuple[str, int]:
        while (up := part.setdefault(x, x)) != x:
            part[x] = part[up]
            x = part[x]
        return x

    for r in rows:
        part[root(("a", r["answer_id"]))] = root(("q", r["question_id"]))
    groups: dict[tuple[str, int], list[dict]] = {}
    for r in rows:
        groups.setdefault(root(("a", r["answer_id"])), []).append(r)
    out = []
    for edges in groups.values():
        left, right = sorted({r["answer_id"] for r in edges}), sorted({r["question_id"] for r in edges})
        at, to = {x: i for i, x in enumerate(left)}, {x: i for i, x in enumerate(right)}
        options: list[list[tuple[int, int]]] = [[] for _ in left]
        by = {(r["answer_id"], r["question_id"]): r["confidence"] for r in edges}
        for (a, q), c in by.items():
            options[at[a]].append((to[q], round(c * MICRO) * TIE_RANGE * (len(left) + 1) + tie_breaker(a, q)))
        for i, j in enumerate(best_assignment(options, len(right))):
            if j >= 0:
                out.append({**key, "answer_id": left[i], "question_id": right[j], "confidence": by[left[i], right[j]]})
    return out


ASSIGNED = "assessment_id long, answer_id long, question_id long, confidence double"


def settle_safe_edges(edges: DataFrame, dealt: Dealing | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges that some best assignment has for certain, edges still open without the ends of those).

    An edge is safe if it weighs at least as much as the best other edges of both its ends together: any assignment
    without it can trade those two for it. The comparison is strict, so which of equal assignments is best stays open.
    Edges are judged once and written, since both results read them.
    """
    own, other = Window.partitionBy("assessment_id", "answer_id"), Window.partitionBy("assessment_id", "question_id")

    def rival(one: Window, by: str) -> F.Column:
        order = one.orderBy(F.desc("confidence"), by)
        first = F.row_number().over(order) == 1
        return F.coalesce(F.when(first, F.lead("confidence").over(order)).otherwise(F.max("confidence").over(one)), F.lit(0.0))

    judged = edges.withColumn("safe", F.col("confidence") > rival(own, "question_id") + rival(other, "answer_id") + 0.5 / MICRO)
    judged = stash(judged.withColumn("gone", F.bool_or("safe").over(own) | F.bool_or("safe").over(other)), dealt)
    return judged.where("safe").select(*edges.columns), judged.where("not gone").select(*edges.columns)


def assign_one_to_one(edges: DataFrame, c: Config = DEFAULT, whole_edges: int = WHOLE_EDGES, dealt: Dealing | None = None) -> DataFrame:
    """(assessment_id, answer_id, question_id, confidence): the assignment of largest total per assessment.

    edges: the same columns; null ids or confidences and edges under the floor are dropped first; either side may stay
    free; a repeated edge counts once. Confidences count to the millionth, and among equal totals tie_breaker decides,
    so the result depends on neither order nor partitions. Safe edges (settle_safe_edges) are taken natively. What is
    open is solved by assessment, or, where an assessment has more than whole_edges of it, by connected part.
    dealt: how edges are dealt, by assessment.
    """
    good = edges.where((F.col("confidence") >= c.min_assignment) & F.col("answer_id").isNotNull() & F.col("question_id").isNotNull())
    good = good.groupBy("assessment_id", "answer_id", "question_id").agg(F.max("confidence").alias("confidence"))
    safe, rest = settle_safe_edges(good, dealt)
    large = stash(rest.groupBy("assessment_id").count().where(F.col("count") > whole_edges).select("assessment_id"))
    split = not large.isEmpty()
    one = lambda key, rows: solve({"assessment_id": key}, rows)
    solved = fold_blocks(rest.join(large, "assessment_id", "left_anti") if split else rest, "assessment_id", ["answer_id", "question_id"], one, ASSIGNED)
    if split:
        large = rest.join(large, "assessment_id", "left_semi")
        node = lambda kind, id_col: F.struct("assessment_id", F.lit(kind).alias("kind"), F.col(id_col).alias("id"))
        nodes = connected_components(large.select(node(0, "answer_id").alias("src"), node(1, "question_id").alias("dst")))
        parted = large.join(nodes.select("node", F.to_json("component").alias("part")), node(0, "answer_id") == F.col("node")).drop("node")
        by_part = lambda key, rows: solve({"assessment_id": rows[0]["assessment_id"]}, rows)
        solved = solved.unionByName(fold_blocks(parted, "part", ["answer_id", "question_id"], by_part, ASSIGNED))
    return safe.select(*solved.columns).unionByName(solved)


def mutual_best(edges: DataFrame) -> DataFrame:
    """Edges that are the best of both their answer and their question; ties go to the smaller id."""
    best = lambda own, other: F.row_number().over(Window.partitionBy("assessment_id", own).orderBy(F.desc("confidence"), other))
    return edges.withColumn("a", best("answer_id", "question_id")).withColumn("q", best("question_id", "answer_id")).where("a = 1 and q = 1").select(*edges.columns)


#: Rounds whose results are read together before they are written as one table.
ROUNDS_READ = 16


def greedy_assignment(edges: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Baseline: the heaviest edge whose ends are free is taken, again and again; ties go to the smaller ids.

    In rounds: an edge that comes first, in this order, at both its ends is taken whatever the others do, so all of
    these are taken at once, and the next round sees the edges that have both ends free. Edges without ids or confidence
    are dropped first; a repeated edge counts once. Rounds are as many as the longest chain of edges that wait for one
    another; each is written, so no lineage builds up.
    """
    keys = ["assessment_id", "answer_id", "question_id"]
    good = edges.where((F.col("confidence") >= c.min_assignment) & F.col("assessment_id").isNotNull() & F.col("answer_id").isNotNull() & F.col("question_id").isNotNull())
    left = stash(good.groupBy(*keys).agg(F.max("confidence").alias("confidence")))
    first = F.min(F.struct((-F.col("confidence")).alias("w"), "answer_id", "question_id")).alias("e")
    rounds: list[DataFrame] = []
    while True:
        best = lambda end: left.groupBy("assessment_id", F.col(end).alias("__end")).agg(first).select("assessment_id", "e.*")  # noqa: B023, E731
        won = stash(best("answer_id").join(best("question_id").drop("w"), keys).select(*keys, (-F.col("w")).alias("confidence")))
        if won.isEmpty():
            break
        free = left
        for end in ("answer_id", "question_id"):
            free = free.join(won.select("assessment_id", end), ["assessment_id", end], "left_anti")
        after = stash(free.select(*left.columns))
        discard(left)
        left = after
        rounds.append(won)
        if len(rounds) == ROUNDS_READ:
            rounds = [stash(reduce(DataFrame.unionByName, rounds))]
    return reduce(DataFrame.unionByName, rounds) if rounds else won
