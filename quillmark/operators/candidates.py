"""Candidate generation: all questions of an assessment scored for each of its answers, and the best few kept."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from ..config import DEFAULT, Config
from ..functions import signals as s
from ..sources.scratch import Dealing, stash
from .labels import with_parsed, with_question_index
from .scan import WHOLE_ROWS, in_order

#: Bytes of vectors that every task may hold.
VECTOR_BYTES = 64 << 20
#: The same for lists of questions, whose vectors are held in single precision where that loses nothing; pairs at once.
LIST_VECTOR_BYTES, PAIRS_AT_ONCE = 192 << 20, 4096
#: Answers, and questions, of a tile of an assessment that has more pairs than one tile. A tile is one row to Python.
TILE_SIDE = 32
#: Assessments in tiles that may be broadcast.
LISTED = 100_000
SIGNALS = ("label_kind", "label", "semantic_cosine", "semantic", "position", "structure")


def reading_order(answers: DataFrame, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """Adds answer_at (from 0) and answer_count: by page, top, left, text and id within the assessment."""
    return in_order(answers, "assessment_id", ["page", "y", "x", "text", "answer_id"], at="answer_at", count="answer_count", whole_rows=whole_rows)


def question_features(questions: DataFrame) -> DataFrame:
    """What pairs need of a question (resolved labels, page order, id of its vector): computed once, before the join."""
    indexed = with_question_index(questions)
    return indexed.select(
        "assessment_id", "question_id", "question_at", "question_count", F.col("normalized_label").alias("q_key"), F.col("major").alias("q_major"), F.coalesce("minor", "roman").alias("q_sub"),
        F.col("is_sub").alias("q_is_sub"), F.col("marks").alias("q_marks"), F.col("text").rlike(s.ASKS_DIAGRAM).alias("q_asks"), F.col("vec_id").alias("q_vec"),
    )


def answer_features(answers: DataFrame) -> DataFrame:
    parsed = with_parsed(answers, "claimed_label_raw", "parsed", a_sub=F.col("label").rlike(s.SUB_SPELLING))
    return reading_order(parsed).select("assessment_id", "answer_id", "answer_at", "answer_count", F.col("claimed_label_raw").alias("claim"), "parsed", "a_sub", F.length("text").alias("a_length"), F.col("diagram").alias("drawn"), F.col("vec_id").alias("a_vec"))


def with_cosines(pairs: DataFrame, vectors: DataFrame, held_bytes: int = VECTOR_BYTES) -> DataFrame:
    """pairs (a_vec, q_vec: ids) with cosine: of the two vectors, 0 where one is missing or zero.

    While the cosines of all vectors with all fit held_bytes, they are a broadcast table with a row for each vector, and a
    pair looks its cosine up: it stays where it is, and no Python worker sees it. While the vectors themselves fit, tasks
    hold them as a matrix, and a batch of pairs is one product in numpy; only ids cross to Python, but what follows has to
    be shuffled again. Beyond that, vectors are joined to the pairs and multiplied as arrays.
    """
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    if size.n * max(1, size.dims or 1) * 8 > held_bytes:
        unit = vectors.select("vec_id", s.l2_normalize(F.col("embedding")).alias("v"))
        joined = pairs.join(unit.toDF("a_vec", "va"), "a_vec", "left").join(unit.toDF("q_vec", "vq"), "q_vec", "left")
        return joined.withColumn("cosine", F.coalesce(s.dot(F.col("va"), F.col("vq")), F.lit(0.0))).drop("va", "vq")
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null").toPandas()
    matrix = np.zeros((len(rows) + 1, size.dims or 1))  # the last row stands for a missing vector
    for i, v in enumerate(rows.embedding):
        matrix[i] = v
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    order = np.argsort(rows.vec_id.to_numpy(dtype=np.int64), kind="stable")
    if len(rows) and len(rows) ** 2 * 8 <= held_bytes:
        ids, first = np.unique(rows.vec_id.to_numpy(dtype=np.int64), return_index=True)
        unit = matrix[first]
        table = pa.table({"__vec": ids, "__at": np.arange(len(ids), dtype=np.int32), "__cosines": pa.array(list(unit @ unit.T), pa.list_(pa.float64()))})
        known = pairs.sparkSession.createDataFrame(table)
        places, cosines = known.select(F.col("__vec").alias("q_vec"), "__at"), known.select(F.col("__vec").alias("a_vec"), "__cosines")
        joined = pairs.join(F.broadcast(cosines), "a_vec", "left").join(F.broadcast(places), "q_vec", "left")
        return joined.withColumn("cosine", F.coalesce(F.get("__cosines", "__at"), F.lit(0.0))).drop("__cosines", "__at")
    held = pairs.sparkSession.sparkContext.broadcast((rows.vec_id.to_numpy(dtype=np.int64)[order], np.append(order, len(rows)), matrix))

    @pandas_udf("double")
    def cosine(a: pd.Series, q: pd.Series) -> pd.Series:
        ids, order, matrix = held.value

        def place(x: pd.Series) -> np.ndarray:
            wanted = x.fillna(-1).to_numpy(dtype=np.int64)
            at = np.minimum(np.searchsorted(ids, wanted), max(0, len(ids) - 1))
            known = x.notna().to_numpy() & (ids[at] == wanted) if len(ids) else np.zeros(len(x), bool)
            return order[np.where(known, at, len(ids))]

        return pd.Series(np.einsum("ij,ij->i", matrix[place(a)], matrix[place(q)]))

    return pairs.withColumn("cosine", cosine("a_vec", "q_vec"))


def tiled(answers: DataFrame, questions: DataFrame, side: int) -> DataFrame:
    """The join of both on the assessment, in tiles of side x side: each answer goes to the tiles of its row of tiles,
    each question to those of its column, and a tile is a join key of its own. Needs answer_at, question_at and counts."""
    tiles = lambda n: F.explode(F.sequence(F.lit(0), ((n - 1) / side).cast("int")))
    own = answers.withColumn("__row", (F.col("answer_at") / side).cast("int")).withColumn("__column", tiles(F.col("__questions")))
    other = questions.withColumn("__column", (F.col("question_at") / side).cast("int")).withColumn("__row", tiles(F.col("__answers")))
    return own.drop("__answers", "__questions").join(other.drop("__answers", "__questions"), ["assessment_id", "__row", "__column"]).drop("__row", "__column")


def rounded6(x: np.ndarray) -> np.ndarray:
    """Six decimals, halves of the decimal number away from zero: what F.round gives."""
    scaled = np.abs(x) * 1e6
    out = np.copysign(np.floor(scaled + 0.5) / 1e6, x) + 0.0
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0
    return out


def _held_vectors(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids in order, their vectors and last a zero one, lengths); single precision if no number needs more.

    In single precision they also come to the driver, which has them twice at most: as they come, and as one matrix."""
    known = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    needs = known.agg(F.coalesce(F.bool_and(F.forall("embedding", lambda x: x.eqNullSafe(x.cast("float").cast("double")))), F.lit(True))).first()[0]
    kind = np.float32 if needs else np.float64
    rows = known.withColumn("embedding", F.col("embedding").cast("array<float>" if needs else "array<double>")).toArrow()
    ids, first = np.unique(rows["vec_id"].to_numpy().astype(np.int64), return_index=True)
    sizes = pa.chunked_array([pc.list_value_length(x) for x in rows["embedding"].chunks], pa.int32()).to_numpy()
    matrix = np.zeros((len(ids) + 1, int(sizes.max(initial=1)) or 1), kind)
    to = np.full(len(rows), -1)
    to[first] = np.arange(len(ids))
    at = 0
    for chunk in rows["embedding"].chunks:  # what repeats an id before it goes nowhere
        size, row = sizes[at : at + len(chunk)], to[at : at + len(chunk)]
        line = np.repeat(row, size)
        place = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
        matrix[line[line >= 0], place[line >= 0]] = chunk.flatten().to_numpy(zero_copy_only=False)[line >= 0]
        at += len(chunk)
    length = np.concatenate([np.linalg.norm(matrix[k : k + PAIRS_AT_ONCE].astype(np.float64, copy=False), axis=1) for k in range(0, len(matrix), PAIRS_AT_ONCE)])
    return ids, matrix, np.maximum(length, 1e-300)


def held_vectors(vectors: DataFrame, held_bytes: int = LIST_VECTOR_BYTES) -> Broadcast | None:
    """What with_cosine_lists lets tasks hold of the vectors; None if they do not fit held_bytes."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    if size.n * max(1, size.dims or 1) * 4 > held_bytes:
        return None
    return vectors.sparkSession.sparkContext.broadcast(_held_vectors(vectors))


def with_cosine_lists(tiles: DataFrame, vectors: DataFrame, held_bytes: int = LIST_VECTOR_BYTES, held: Broadcast | None = None) -> DataFrame:
    """tiles (assessment_id, __row, __column; own, asked: arrays of structs with a_vec, and with q_vec) with cosines: those
    of each answer with all questions, answer by answer, to six decimals, 0 where a vector is missing or zero.

    While the vectors fit held_bytes, tasks hold them, and only ids cross to Python, a tile in one row. Beyond that,
    vectors are joined to the pairs. held: held_vectors of the vectors, if they are held already.
    """
    held = held or held_vectors(vectors, held_bytes)
    if held is None:
        keys = ["assessment_id", "__row", "__column"]
        pairs = tiles.select(*keys, F.posexplode("own.a_vec").alias("__i", "a_vec"), "asked").select(*keys, "__i", "a_vec", F.posexplode("asked.q_vec").alias("__j", "q_vec"))
        found = with_cosines(pairs, vectors, 0).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "__j", F.round("cosine", 6).alias("cosine")))).alias("__found"))
        return tiles.join(found, keys).withColumn("cosines", F.col("__found.cosine")).drop("__found")
    @arrow_udf("array<double>")
    def cosines(a: pa.Array, q: pa.Array) -> pa.Array:
        ids, matrix, length = held.value

        def place(x: pa.Array) -> np.ndarray:
            if not len(ids):
                return np.zeros(len(x), np.int64)
            wanted = x.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
            return np.where((ids[at] == wanted) & x.is_valid().to_numpy(zero_copy_only=False), at, len(ids))

        n, m = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, q))
        left, right = place(a.flatten()), place(q.flatten())
        each = np.repeat(m, n)  # questions that each answer meets
        one = np.repeat(left, each)
        first = np.repeat(np.append(0, np.cumsum(m))[:-1], n)  # where the questions of its tile begin
        other = right[np.arange(len(one)) - np.repeat(np.cumsum(each) - each - first, each)]
        out = np.empty(len(one))
        for k in range(0, len(out), PAIRS_AT_ONCE):
            i, j = one[k : k + PAIRS_AT_ONCE], other[k : k + PAIRS_AT_ONCE]
            out[k : k + PAIRS_AT_ONCE] = np.einsum("ij,ij->i", matrix[i].astype(np.float64, copy=False), matrix[j].astype(np.float64, copy=False)) / length[i] / length[j]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n * m)), pa.int32()), pa.array(rounded6(out)))

    return tiles.withColumn("cosines", cosines("own.a_vec", "asked.q_vec"))


def _scored(pairs: DataFrame, c: Config) -> DataFrame:
    """Signals and candidate score of pairs with cosine and its range over the answer, low and high."""
    kind = s.label_match_kind(F.col("claim"), F.col("parsed"), F.col("parsed.normalized"), F.col("q_key"), F.col("q_major"), F.col("q_sub"), F.col("q_is_sub"))
    structure = s.structure_score(s.diagram_compatibility(F.col("q_asks"), F.col("drawn")), s.length_compatibility(F.col("a_length"), F.col("q_marks")), s.subquestion_compatibility(F.col("a_sub"), F.col("q_is_sub")))
    scored = pairs.select(
        "assessment_id", "__row", "answer_id", "question_id", kind.alias("label_kind"), F.col("cosine").alias("semantic_cosine"),
        s.position_score(F.col("answer_at"), F.col("answer_count"), F.col("question_at"), F.col("question_count")).alias("position"), structure.alias("structure"), "low", "high",
    )
    scored = scored.withColumn("label", s.label_score(F.col("label_kind"))).withColumn("semantic", s.semantic_score(F.col("semantic_cosine"), F.col("low"), F.col("high"), c.semantic_floor))
    scored = scored.withColumn("candidate_score", s.candidate_score(F.col("label"), F.col("semantic"), F.col("position"), F.col("structure"), c))
    fine = lambda n: s.decimals6(F.col(n)).alias(n) if n in ("semantic", "position", "structure") else F.col(n)
    return scored.select("assessment_id", "__row", "answer_id", "question_id", *map(fine, SIGNALS), s.decimals6(F.col("candidate_score")).alias("candidate_score"))


def _cosine_tiles(tiles: DataFrame, vectors: DataFrame, held: Broadcast | None, split: bool, dealt: Dealing | None) -> DataFrame:
    """with_cosine_lists, dealt by rows of tiles. split: an answer has several tiles. Tables that are dealt have their
    tiles where they belong, which only Python makes Spark forget: these are written as they are, and not shuffled."""
    found = with_cosine_lists(tiles, vectors, held=held).select("assessment_id", "__row", "own", "asked", "cosines")
    row = ("__row",) if split else ()
    return stash(found, dealt, more=row) if dealt else found.repartition("assessment_id", *row)


def _tile_pairs(tiles: DataFrame, split: bool) -> DataFrame:
    """Pairs of tiles with cosine, low and high. Tiles are dealt by rows of tiles, so all pairs of an answer are in one
    task, and what follows by answer needs no shuffle."""
    n = F.size("asked")
    mine = tiles.select("assessment_id", "__row", F.posexplode("own").alias("__i", "__a"), "asked", "cosines").withColumn("cosines", F.slice("cosines", F.col("__i") * n + 1, n))
    ends = {} if split else {"low": F.array_min("cosines"), "high": F.array_max("cosines")}
    mine = mine.withColumns(ends).select("assessment_id", "__row", "__a.*", *ends, F.posexplode("asked").alias("__j", "__q"), "cosines")
    pairs = mine.select(*(x for x in mine.columns if x not in ("__q", "cosines", "__j")), "__q.*", F.get("cosines", F.col("__j")).alias("cosine"))
    by_answer = Window.partitionBy("assessment_id", "__row", "answer_id")
    return pairs.withColumns({"low": F.min("cosine").over(by_answer), "high": F.max("cosine").over(by_answer)}) if split else pairs


def _scored_rows(answers: DataFrame, questions: DataFrame, vectors: DataFrame, c: Config, side: int, dealt: Dealing | None) -> tuple[list[DataFrame], list[DataFrame]]:
    """(score_pairs with __row, their tiles), in one or two parts: whole assessments, and such as are split. The pairs of
    an answer have one __row, and are dealt to tasks by assessment_id, or by assessment_id and __row. Vectors are held
    once. dealt: how both tables are dealt; then tiles are written."""
    count = lambda df, name: df.groupBy("assessment_id").agg(F.count("*").alias(name))
    sizes = count(answers, "__answers").join(count(questions, "__questions"), "assessment_id")
    large = stash(sizes.where(F.col("__answers") * F.col("__questions") > side * side), dealt)
    many = large.limit(LISTED + 1).count()
    split, held = many > 0, held_vectors(vectors)
    if many > LISTED:  # few bytes each on disk, so Spark would still broadcast them when the driver cannot hold them
        large = large.hint("merge")
    own, asked = answer_features(answers), question_features(questions)
    a_names, q_names = ([n for n in x.columns if n != "assessment_id"] for x in (own, asked))
    listed = lambda df, name, names, *by: df.groupBy("assessment_id", *by).agg(F.collect_list(F.struct(*names)).alias(name))
    rest = (lambda df: df.join(large, "assessment_id", "left_anti")) if split else (lambda df: df)
    whole = listed(rest(own), "own", a_names).join(listed(rest(asked), "asked", q_names), "assessment_id")
    tiles = [_cosine_tiles(whole.withColumns({"__row": F.lit(0), "__column": F.lit(0)}), vectors, held, False, dealt)]
    if split:  # dealt by tiles first, since the tables may be dealt by assessment
        at = lambda df, n, name: df.join(large, "assessment_id").withColumn(name, (F.col(n) / side).cast("int")).repartition("assessment_id", name)
        rows = listed(at(own, "answer_at", "__row"), "own", a_names, "__row")
        columns = listed(at(asked, "question_at", "__column"), "asked", q_names, "__column", "__answers")
        columns = columns.withColumn("__row", F.explode(F.sequence(F.lit(0), ((F.col("__answers") - 1) / side).cast("int")))).drop("__answers")
        tiles.append(_cosine_tiles(rows.join(columns, ["assessment_id", "__row"]), vectors, held, True, dealt))
    return [_scored(_tile_pairs(t, i > 0), c) for i, t in enumerate(tiles)], tiles


def score_pairs(answers: DataFrame, questions: DataFrame, vectors: DataFrame, c: Config = DEFAULT, side: int = TILE_SIDE, dealt: Dealing | None = None) -> DataFrame:
    """One row per answer and question of the same assessment, with its signals and candidate score.

    An assessment with both its lists is one row while cosines are found; only ids cross to Python, and texts and
    rectangles do not ride along. Sizes are counted first: an assessment of more than side * side pairs is as many rows as
    it has tiles of side answers by side questions. Rows are dealt by assessment and row of tiles before they become
    pairs, so pairs are never shuffled, and a task has side answers of a large assessment with all its questions.
    """
    return reduce(DataFrame.unionByName, _scored_rows(answers, questions, vectors, c, side, dealt)[0]).drop("__row")


def best_candidates(answers: DataFrame, questions: DataFrame, vectors: DataFrame, k: int = DEFAULT.top_k, c: Config = DEFAULT, side: int = TILE_SIDE, together: bool = False, dealt: Dealing | None = None) -> DataFrame:
    """top_k_candidates of score_pairs, by tasks that have all pairs of an answer.

    together: the rows of an assessment end in one task, also where it was split. dealt: how both tables are dealt; then
    tiles are written, and may be discarded (as _tiles of the result) once nothing reads the result any more."""
    parts, tiles = _scored_rows(answers, questions, vectors, c, side, dealt)
    out = reduce(DataFrame.unionByName, [top_k_candidates(part, k, ["__row"]).drop("__row") for part in parts])
    out = out.repartition("assessment_id") if together and len(parts) > 1 else out
    out._tiles = tiles
    return out


def top_k_candidates(pairs: DataFrame, k: int = DEFAULT.top_k, dealt: list[str] | None = None) -> DataFrame:
    """Adds rank and keeps the first max(1, k) of each answer: by score, label, cosine, then question id.

    dealt: further columns that are the same for all pairs of an answer."""
    order = Window.partitionBy("assessment_id", *(dealt or []), "answer_id").orderBy(F.desc("candidate_score"), F.desc("label"), F.desc("semantic"), "question_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, k))


def distinct_texts(texts: DataFrame, column: str, model: str = "hashed", dims: int = 64) -> DataFrame:
    """(embedding_key, text, n): each different text once, to be embedded once and joined back by its key."""
    return texts.groupBy(s.embedding_key(F.col(column), model, dims).alias("embedding_key")).agg(F.min(column).alias("text"), F.count("*").alias("n"))


def hashed_vectors(texts: DataFrame, id_col: str, text_col: str, dims: int = 64) -> DataFrame:
    """(id, vector): counts of the words over two letters by hashed bucket, plus a floor, at length one. All native."""
    cleaned = F.regexp_replace(F.lower(F.col(text_col)), r"[^a-z0-9\s]", " ")
    words = texts.select(id_col, F.explode(F.filter(F.split(cleaned, r"\s+"), lambda w: F.length(w) > 2)).alias("w"))
    counted = words.groupBy(id_col, "w").count()
    bucket = (F.conv(F.substring(F.sha2("w", 256), 1, 8), 16, 10).cast("long") % dims).cast("int")
    by_bucket = counted.groupBy(id_col, bucket.alias("b")).agg(F.sum("count").alias("n"))
    maps = by_bucket.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) + 0.05)
    return texts.select(id_col).join(maps, id_col, "left").select(id_col, s.l2_normalize(raw).alias("vector"))


#: Items that a task compares with at once, and words whose buckets it remembers.
ITEM_BLOCK, WORD_MEMO = 4096, 200_000


def word_counts(text: str, dims: int, memo: dict[str, int]) -> np.ndarray:
    """The vector of hashed_vectors in numpy. memo: buckets of words seen before."""
    if len(memo) > WORD_MEMO:
        memo.clear()
    out = np.full(dims, 0.05)
    for w, n in Counter(re.sub(r"[^a-z0-9\s]", " ", text.lower()).split()).items():
        if len(w) > 2:
            if (b := memo.get(w)) is None:
                b = memo[w] = int.from_bytes(sha256(w.encode()).digest()[:4], "big") % dims
            out[b] += n
    return out / np.linalg.norm(out)


def best_items(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text_col: str = "text", dims: int = 64, block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, cosine): for each document the item of largest cosine of hashed vectors, rounded to six
    decimals; ties go to the smallest item.

    Items are a query set: they are taken in blocks of at most block rows, so what a task holds is bounded, and each
    block is one matrix product with the documents of a batch. A null text counts as empty; items without an id are
    passed over; without items there is no row; an empty table of documents gives none.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = -(-texts.count() // block)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([word_counts(t or "", dims, memo).tobytes() for t in part.column("text").to_pylist()], pa.binary())], names=["doc_id", "vector"])

    def search(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = held.value
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    vectors = np.frombuffer(b"".join(part.column("vector").to_pylist())).reshape(-1, dims)
                    near = np.floor(vectors @ matrix.T * 1e6 + 0.5) / 1e6
                    best = near.argmax(axis=1)  # the first: ids ascend
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids[best]), pa.array(near[np.arange(len(best)), best])], names=["doc_id", "item", "cosine"])

        return run

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(hashed, f"doc_id {kind}, vector binary")
    if blocks > 1:  # hashed once for all blocks
        rows = stash(rows)
    found = None
    for b in range(blocks):
        part = sorted((r.item, r.text) for r in texts.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toLocalIterator())
        if part:
            memo: dict[str, int] = {}
            held = docs.sparkSession.sparkContext.broadcast((np.array([i for i, _ in part]), np.array([word_counts(t, dims, memo) for _, t in part])))
            one = rows.mapInArrow(search(held), f"doc_id {kind}, item long, cosine double")
            if blocks > 1:  # written, and its items let go, before the next block is read
                one = stash(one)
                held.destroy()
            found = one if found is None else found.unionAll(one)
    if found is None:
        return rows.where("false").select(F.col("doc_id").alias(doc_id), F.lit(None).cast("long").alias(item_id), F.lit(None).cast("double").alias("cosine"))
    if blocks > 1:
        found = found.groupBy("doc_id").agg(F.max(F.struct("cosine", (-F.col("item")).alias("i"))).alias("x")).select("doc_id", (-F.col("x.i")).alias("item"), F.col("x.cosine").alias("cosine"))
    return found.select(F.col("doc_id").alias(doc_id), F.col("item").alias(item_id), "cosine")
