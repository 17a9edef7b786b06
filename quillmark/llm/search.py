"""Ranked lexical search of a stated set of queries against all documents, exact, by geometric blocks of posting lists.

Documents are dealt in segments. A segment keeps, for the terms that queries ask for, the documents' rows of impacts
(what a term adds to a document's score) and each term's posting list. A list is clustered by the similarity of its
documents into blocks, and a block keeps a summary: the largest impact of each term over its documents, for the terms
that share a query with the list's own. A query takes its lists by the most they can add, and in a list opens the
blocks by the scores that their summaries allow. A block is skipped only if that score is below the k-th best found so
far, and lists end when all that are left together are below it. So nothing that could rank is left out.

Only the statistics and each task's best k of every query are shuffled: no term, however frequent, makes a task large.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import alnum_words, slices, stash, utf8

#: Bytes of query text searched at once, documents of a segment, documents whose words are held at once, and bytes of
#: summaries that a task keeps (beyond it they are built again).
BLOCK_BYTES, SEGMENT_DOCS, READ_DOCS, SUMMARY_BYTES = 4 << 20, 8192, 500, 64 << 20
#: Lengths of the vectors whose angles tell how similar documents are; they only choose blocks.
SKETCH = 16
#: Parts in which the best of all tasks are ranked before the parts' best are ranked together.
PARTS = 64
#: Constants of the score.
SCALE, HALF, LENGTH = 1_000_000_000, 8, 75

COUNTED = "ids binary, nulls binary, lengths binary, starts binary, terms binary, tfs binary"


def count_terms(docs: DataFrame, numbers: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of documents with their counts of the numbered terms and of all terms, packed."""
    held = docs.sparkSession.sparkContext.broadcast(numbers)

    def counted(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        number = held.value.get
        words = [alnum_words(t) for t in utf8(batch, "text")]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        term = np.array([number(w, -1) for own in words for w in own], np.int64)
        doc = np.repeat(np.arange(len(words)), lengths)[term >= 0]
        key, tf = np.unique(doc * len(held.value) + term[term >= 0], return_counts=True)
        ids = batch.column("id")
        return ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), lengths, np.bincount(key // max(len(held.value), 1), minlength=len(words)), key % max(len(held.value), 1), tf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            ids, nulls, lengths, sizes, terms, tfs = map(np.concatenate, zip(*parts, strict=True))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            columns = (ids, nulls.astype(np.int8), lengths, starts, terms.astype(np.int32), tfs.astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["ids", "nulls", "lengths", "starts", "terms", "tfs"])

        parts, n = [], 0
        for batch in slices(batches, READ_DOCS):
            parts.append(counted(batch))
            n += batch.num_rows
            if n >= SEGMENT_DOCS:
                yield packed()
                parts, n = [], 0
        if n:
            yield packed()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, COUNTED)


def statistics(segments: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each numbered term, over all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, words = np.zeros(n_terms, np.int64), 0, 0
        for batch in slices(batches, 1):
            lengths = np.frombuffer(batch.column("lengths")[0].as_py(), np.int64)
            df += np.bincount(np.frombuffer(batch.column("terms")[0].as_py(), np.int32), minlength=n_terms)
            n, words = n + int((lengths > 0).sum()), words + int(lengths.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[n, words], df[some]]))], names=["term", "n"])

    found = segments.select("lengths", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    by = dict(zip(found.column("term").to_pylist(), found.column("n").to_pylist(), strict=True))
    return by.get(-2, 0), by.get(-1, 0), np.array([by.get(t, 0) for t in range(n_terms)], np.int64)


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for k in df.tolist()], np.int64)


class Query:
    """A query's terms, ascending, and how often it has each; with the best documents found so far."""

    def __init__(self, words: list[int], k: int):
        counts = sorted(Counter(words).items())
        self.terms, self.times = np.array([t for t, _ in counts], np.int64), np.array([n for _, n in counts], np.int64)
        self.k = k
        self.best = np.zeros((0, 3), np.int64)  # score, id is null, id: best first

    @property
    def least(self) -> int:
        """What a document has to reach to rank: equal scores may, by their id."""
        return int(self.best[-1, 0]) if len(self.best) == self.k else 1

    def offer(self, scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> None:
        some = scores >= self.least
        if some.any():
            rows = np.concatenate([self.best, np.stack([scores[some], nulls[some], ids[some]], axis=1)])
            self.best = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]]


class Blocks:
    """One posting list in blocks: documents in the order of blocks, where blocks start, and the blocks' summaries."""

    def __init__(self, docs: np.ndarray, starts: np.ndarray, asked: np.ndarray, keys: np.ndarray, values: np.ndarray):
        self.docs, self.starts, self.asked, self.keys, self.values = docs, starts, asked, keys, values
        self.bytes = sum(x.nbytes for x in (docs, starts, asked, keys, values))

    def bounds(self, query: Query) -> np.ndarray:
        """The most that a document of each block can score for a query that has the list's term."""
        at = np.searchsorted(self.asked, query.terms)
        key = np.arange(len(self.starts) - 1)[:, None] * len(self.asked) + at
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.values[place], 0) @ query.times


class Segment:
    """A segment's documents with their impacts, ready to search."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_words: int, asked_with):
        read = lambda c, t: np.frombuffer(row[c], t)
        self.ids, self.nulls, lengths, self.starts = read("ids", np.int64), read("nulls", np.int8), read("lengths", np.int64), read("starts", np.int64)
        self.terms, tfs = read("terms", np.int32).astype(np.int64), read("tfs", np.int32).astype(np.int64)
        norm = 100 - LENGTH + (LENGTH * lengths * n_docs) // max(n_words, 1)
        doc = np.repeat(np.arange(len(lengths)), np.diff(self.starts))
        self.impacts = weights[self.terms] * ((SCALE * tfs) // (1000 * tfs + HALF * norm[doc]))
        self.n_terms, self.asked_with = len(weights), asked_with
        order = np.argsort(self.terms, kind="stable")
        self.postings = doc[order]
        self.lists = np.searchsorted(self.terms[order], np.arange(self.n_terms + 1))
        full = np.flatnonzero(np.diff(self.lists))
        self.most = np.zeros(self.n_terms, np.int64)  # the largest impact in each list
        if len(full):
            self.most[full] = np.maximum.reduceat(self.impacts[order], self.lists[full])
        self.sketches = self._sketches()
        self.held: dict[int, Blocks] = {}
        self.held_bytes = 0

    def _sketches(self) -> np.ndarray:
        """Random projections of the documents' impacts, of length one."""
        signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (self.n_terms, SKETCH))
        out = np.zeros((len(self.ids), SKETCH), np.float32)
        some = np.flatnonzero(np.diff(self.starts))
        if len(some):
            out[some] = np.add.reduceat(signs[self.terms] * self.impacts[:, None].astype(np.float32), self.starts[some])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def rows(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in docs, place) of all impacts of the documents."""
        n = self.starts[docs + 1] - self.starts[docs]
        return np.repeat(np.arange(len(docs)), n), np.repeat(self.starts[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def blocks(self, term: int) -> Blocks:
        """The term's list in about the root of its length of blocks, each around one of its documents."""
        if (known := self.held.get(term)) is not None:
            return known
        docs = self.postings[self.lists[term] : self.lists[term + 1]]
        n = max(1, math.isqrt(len(docs)) if len(docs) >= 8 else 1)
        centres = self.sketches[docs[np.arange(n) * len(docs) // n]]
        nearest = np.argmax(self.sketches[docs] @ centres.T, axis=1)
        order = np.argsort(nearest, kind="stable")
        docs, nearest = docs[order], nearest[order]
        first = np.flatnonzero(np.diff(nearest, prepend=-1))  # centres without documents have no block
        starts = np.append(first, len(docs))
        asked = self.asked_with(term)
        place = np.full(self.n_terms, -1)
        place[asked] = np.arange(len(asked))
        number, at = self.rows(docs)
        column = place[self.terms[at]]
        wanted = column >= 0
        key = np.repeat(np.arange(len(first)), np.diff(starts))[number[wanted]] * len(asked) + column[wanted]
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.diff(key, prepend=-1))
        out = Blocks(docs, starts, asked, key[head], np.maximum.reduceat(self.impacts[at[wanted]][order], head))
        if self.held_bytes + out.bytes > SUMMARY_BYTES:
            self.held.clear()
            self.held_bytes = 0
        self.held[term] = out
        self.held_bytes += out.bytes
        return out

    def scores(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Scores of documents from posting lists; times: how often the query has each term."""
        number, at = self.rows(docs)
        return np.add.reduceat(times[self.terms[at]] * self.impacts[at], np.searchsorted(number, np.arange(len(docs))))

    def search(self, query: Query) -> None:
        """Offer the query every document of the segment that may rank."""
        allowed = self.most[query.terms] * query.times
        order = np.argsort(-allowed, kind="stable")
        order = order[allowed[order] > 0]
        rest = np.cumsum(allowed[order][::-1])[::-1]
        times = np.zeros(self.n_terms, np.int64)
        times[query.terms] = query.times
        seen = np.zeros(len(self.ids), bool)
        for term, most in zip(query.terms[order].tolist(), rest.tolist(), strict=True):
            if most < query.least:
                break
            blocks = self.blocks(term)
            bounds = blocks.bounds(query)
            by_bound = np.argsort(-bounds, kind="stable")
            at, step = 0, 1
            while at < len(by_bound) and bounds[by_bound[at]] >= query.least:
                some = by_bound[at : at + step]
                some = some[bounds[some] >= query.least]
                docs = np.concatenate([blocks.docs[blocks.starts[b] : blocks.starts[b + 1]] for b in some.tolist()])
                docs = docs[~seen[docs]]
                seen[docs] = True
                if len(docs):
                    query.offer(self.scores(docs, times), self.nulls[docs], self.ids[docs])
                at, step = at + step, 2 * step


def _search_block(docs: DataFrame, queries: list[tuple[int, list[bytes]]], k: int, id_col: str, text_col: str) -> DataFrame:
    """(query, doc, score, part): each task's best k of every query."""
    spark = docs.sparkSession
    numbers: dict[bytes, int] = {}
    for _, words in queries:
        for w in words:
            numbers.setdefault(w, len(numbers))
    segments = stash(count_terms(docs, numbers, id_col, text_col))
    n_docs, n_words, df = statistics(segments, len(numbers))
    weights = term_weights(n_docs, df)
    held = spark.sparkContext.broadcast(([q for q, _ in queries], [[numbers[w] for w in words] for _, words in queries], weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words, weights = held.value
        own = [Query(w, k) for w in words]
        of_term: dict[int, list[int]] = {}
        for i, q in enumerate(own):
            for t in q.terms.tolist():
                of_term.setdefault(t, []).append(i)
        asked_with = lambda t: np.unique(np.concatenate([own[i].terms for i in of_term[t]]))
        for batch in slices(batches, 1):
            segment = Segment(batch.to_pylist()[0], weights, n_docs, n_words, asked_with)
            for q in own:
                segment.search(q)
        for name, q in zip(names, own, strict=True):
            if len(q.best):
                score, null, doc = q.best.T
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(score), pa.int64()), pa.array(doc, mask=null.astype(bool)), pa.array(score)], names=["query", "doc", "score"])

    return segments.mapInArrow(run, "query long, doc long, score long").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, doc, score): the k documents of highest score above 0 for each row of queries, fewer if fewer have it.

    Equal scores rank by ascending id, null ids last; repeated rows of documents are documents of their own, and so are
    repeated rows of queries. Null and wordless texts, on either side, match nothing; an empty table gives no rows.
    Columns besides those named are not read. Queries are searched in blocks of block_bytes of text, with the documents
    read once for each.
    """
    items = stash(queries.select(F.monotonically_increasing_id().alias("query"), F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")))
    asked = items.where("text is not null")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first().n
    blocks = -(-total // block_bytes) or 1
    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        best = _search_block(docs, [(r.query, w) for r in part.toLocalIterator() if (w := alnum_words(r.text.encode()))], k, id_col, text_col)
        if blocks > 1:
            best = stash(best)
        found = best if found is None else found.unionAll(best)
    order = (F.col("score").desc(), F.col("doc").asc_nulls_last())
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(items.select("query", "item"), "query").select("item", "rank", "doc", "score")


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def oracle_sql(k: int = 10) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {WORDS_SQL} AS words FROM documents),
i AS (SELECT row_number() OVER () AS ir, item_id, {WORDS_SQL} AS words FROM benchmark),
stats AS (SELECT count(*) AS docs, sum(len(words)) AS total FROM d WHERE len(words) > 0),
asked AS (SELECT ir, t, count(*) AS times FROM (SELECT ir, unnest(words) AS t FROM i) GROUP BY ir, t),
held AS (SELECT rn, t, count(*) AS tf FROM (SELECT rn, unnest(words) AS t FROM d) GROUP BY rn, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * (SELECT docs FROM stats) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM held GROUP BY t),
m AS (SELECT rn, doc_id, 100 - {LENGTH} + ({LENGTH} * len(words) * docs) // total AS m FROM d, stats WHERE len(words) > 0),
s AS (SELECT ir, rn, sum(times * w.w * (({SCALE} * tf) // (1000 * tf + {HALF} * m))) AS score
  FROM asked JOIN held USING (t) JOIN w USING (t) JOIN m USING (rn) GROUP BY ir, rn),
r AS (SELECT ir, doc_id, score, row_number() OVER (PARTITION BY ir ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s JOIN m USING (rn) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r JOIN i USING (ir) WHERE rank <= {k}"""
