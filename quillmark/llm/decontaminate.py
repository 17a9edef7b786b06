"""Benchmark decontamination with a distributed positional inverted index.

The index is split by documents: each segment holds the postings of some documents, term by term, positions ascending.
It is stored as a table in the shared folder. A search takes phrases (windows of benchmark words), starts at the
postings of a phrase's rarest term, subtracts the term's offset, and intersects with the other terms' postings from
rare to common. No key is shuffled, so no word, passage or source can make one task large.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, slices, stash, utf8

#: Bytes of query text in one block, and of the vocabulary that index tasks hold. A larger set of queries is searched
#: in several blocks, one after another; with a larger vocabulary all words are posted, each segment with its own list.
BLOCK_BYTES, VOCABULARY_BYTES = 16 << 20, 64 << 20
#: Candidate starts held at once.
CANDIDATES = 1 << 21

INDEX = "segment string, ids array<long>, lengths array<int>, words binary, terms binary, counts binary, positions binary"


def build_index(docs: DataFrame, numbers: dict[bytes, int] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of postings. numbers: the terms to post, or None for all, numbered by segment. Null text has no words."""
    held = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            words = [alnum_words(t) for t in utf8(batch, "text")]
            known = held.value if held.value is not None else {w: i for i, w in enumerate(sorted({x for own in words for x in own}))}
            number, lengths = known.get, np.fromiter(map(len, words), np.int64, len(words))
            starts = np.concatenate([[0], np.cumsum(lengths + 1)])  # one empty place between documents
            term = np.full(int(starts[-1]), -1, dtype=np.int64)
            for at, w in zip(starts.tolist(), words, strict=False):
                if w:
                    term[at : at + len(w)] = [number(x, -1) for x in w]
            position = np.flatnonzero(term >= 0)
            position = position[np.argsort(term[position], kind="stable")]
            terms, counts = np.unique(term[position], return_counts=True)
            row = {"segment": uuid.uuid4().hex, "ids": batch.column("id").to_pylist(), "lengths": lengths.tolist(), "words": b" ".join(known) if held.value is None else None, "terms": terms.tobytes(), "counts": counts.astype(np.int32).tobytes(), "positions": position.astype(np.int32).tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("segment", pa.string()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("words", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())]))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, INDEX)


class Segment:
    """One row of the index, ready to search."""

    def __init__(self, row: dict):
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.ids = row["ids"]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        self.terms = np.frombuffer(row["terms"], dtype=np.int64)
        self.counts = np.frombuffer(row["counts"], dtype=np.int32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.positions = np.frombuffer(row["positions"], dtype=np.int32).astype(np.int64)
        self.width = int(self.starts[-1]) + 1
        self.own = None if row["words"] is None else {w: i for i, w in enumerate(row["words"].split())}
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) * self.width + self.positions

    def numbered(self, windows: np.ndarray, vocabulary: list[bytes]) -> np.ndarray:
        """Windows of the query's word numbers in the numbers of this segment's postings."""
        if self.own is None:
            return windows
        return np.array([self.own.get(w, -1) for w in vocabulary], dtype=np.int64)[windows]

    def local(self, terms: np.ndarray) -> np.ndarray:
        """Places of terms in this segment, -1 where it has none."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1

    def postings(self, rows: np.ndarray, local: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, position) of every posting of each row's term, in blocks."""
        counts = self.counts[local]
        ends = np.cumsum(counts)
        at = 0
        while at < len(rows):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, side="right")))
            n = counts[at:stop]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(rows[at:stop], n), self.positions[np.repeat(self.first[local[at:stop]], n) + within]
            at = stop

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """windows: (n, length) terms -> (window, start) of all exact occurrences."""
        local = self.local(windows)
        live = np.flatnonzero((local >= 0).all(axis=1))
        if not len(live):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(self.counts[local[live]], axis=1, kind="stable")
        place = np.full(len(windows), -1)
        place[live] = np.arange(len(live))
        rarest = local[live, order[:, 0]]
        rows, starts = [], []
        for row, position in self.postings(live, rarest):
            offsets = order[place[row]]
            start = position - offsets[:, 0]
            for k in range(1, windows.shape[1]):
                key = local[row, offsets[:, k]] * self.width + start + offsets[:, k]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                good = self.keys[at] == key
                row, start, offsets = row[good], start[good], offsets[good]
            rows.append(row)
            starts.append(start)
        return np.concatenate(rows), np.concatenate(starts)

    def near(self, windows: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its first term) where each other term stands at most slop places away, in any order."""
        local = self.local(windows)
        live = np.flatnonzero((local >= 0).all(axis=1))
        if not len(live):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = 1 + np.argsort(self.counts[local[live, 1:]], axis=1, kind="stable")  # the others from rare to common
        order = np.concatenate([np.zeros((len(live), 1), np.int64), order], axis=1)
        place = np.full(len(windows), -1)
        place[live] = np.arange(len(live))
        rows, places = [], []
        for row, position in self.postings(live, local[live, 0]):
            offsets = order[place[row]]
            doc = self.doc_of(position)
            low, high = np.maximum(position - slop, self.starts[doc]), np.minimum(position + slop, self.starts[doc + 1] - 1)
            for k in range(1, windows.shape[1]):
                base = local[row, offsets[:, k]] * self.width
                at = np.minimum(np.searchsorted(self.keys, base + low), len(self.keys) - 1)
                good = (self.keys[at] >= base + low) & (self.keys[at] <= base + high)
                row, position, offsets, low, high = row[good], position[good], offsets[good], low[good], high[good]
            rows.append(row)
            places.append(position)
        return np.concatenate(rows), np.concatenate(places)


def windows_of(items: list[tuple[str, list[bytes]]], size: int, number) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: distinct windows, and (window, item) pairs as two arrays. An item of fewer words is one window."""
    by: dict[int, dict[tuple[int, ...], set[int]]] = {}
    for k, (_, words) in enumerate(items):
        ids = [number(w) for w in words]
        n = min(size, len(ids))
        for s in range(len(ids) - n + 1 if n else 0):
            by.setdefault(n, {}).setdefault(tuple(ids[s : s + n]), set()).add(k)
    out = {}
    for n, windows in by.items():
        pairs = [(w, k) for w, ks in enumerate(windows.values()) for k in sorted(ks)]
        out[n] = (np.array(list(windows), dtype=np.int64).reshape(-1, n), *np.array(pairs, dtype=np.int64).T)
    return out


HITS = "segment string, row int, id long, n_words long, spans array<struct<first: int, last: int>>, items array<string>"


def _search(index: DataFrame, items: list[tuple[str, list[bytes]]], numbers: dict[bytes, int] | None, size: int, slop: int | None) -> DataFrame:
    vocabulary: list[bytes] = []
    if numbers is None:  # the block's own numbers, which each segment turns into its own
        vocabulary = sorted({w for _, words in items for w in words})
        numbers = {w: i for i, w in enumerate(vocabulary)}
    windows = windows_of(items, size, numbers.__getitem__)
    held = index.sparkSession.sparkContext.broadcast((windows, [name for name, _ in items], vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, names, vocabulary = held.value
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                seg = Segment(row)
                own = {n: (seg.numbered(w, vocabulary), a, b) for n, (w, a, b) in windows.items()}
                yield _hits(seg, row["segment"], own, names, slop)

    return index.mapInArrow(run, HITS)


def _hits(seg: Segment, name: str, windows: dict, names: list[str], slop: int | None) -> pa.RecordBatch:
    change = np.zeros(seg.width + 1, dtype=np.int64)
    pairs = [np.zeros((0, 2), dtype=np.int64)]
    for n, (terms, window, item) in windows.items():
        row, start = seg.phrases(terms) if slop is None else seg.near(terms, slop)
        np.add.at(change, start, 1)
        np.add.at(change, start + (n if slop is None else 1), -1)
        first = np.searchsorted(window, np.arange(len(terms) + 1))
        many = (first[1:] - first[:-1])[row]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        items = item[np.repeat(first[row], many) + within]
        pairs.append(np.unique(np.stack([np.repeat(seg.doc_of(start), many), items], axis=1), axis=0))
    covered = np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8), [0]])
    edge = np.diff(covered)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    doc = seg.doc_of(begins)
    spans: list[list] = [[] for _ in seg.ids]
    for d, a, b in zip(doc.tolist(), begins.tolist(), ends.tolist(), strict=True):
        spans[d].append({"first": a - int(seg.starts[d]), "last": b - int(seg.starts[d])})
    found: list[list[str]] = [[] for _ in seg.ids]
    for d, k in np.unique(np.concatenate(pairs), axis=0).tolist():
        found[d].append(names[k])
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(seg.ids)), pa.array(range(len(seg.ids)), pa.int32()), pa.array(seg.ids, pa.int64()), pa.array(seg.lengths), pa.array(spans, span), pa.array([sorted(set(x)) for x in found], pa.list_(pa.string()))],
        names=["segment", "row", "id", "n_words", "spans", "items"],
    )


def covered_words(spans: Column) -> Column:
    """Words in the union of spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["last"] - F.greatest(s["first"] - 1, acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["last"]).alias("end"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"].cast("long"))


def benchmark_hits(docs: DataFrame, bench: DataFrame, size: int = 10, slop: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items, spans), one row per document.

    A window is size consecutive words of an item; an item of fewer words, but not none, is one window. Without slop a
    document word counts as hit inside any exact occurrence of a window; with slop, words at the first term of a window
    whose other terms all stand within slop places, in any order. items: ids, as strings in order, of items with a hit.
    Null or wordless texts have no words and no hits; repeated rows give repeated results; an empty table on either
    side gives no hits; items whose id is null are passed over. Columns besides those named are not read.
    """
    items = bench.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first().n
    blocks = -(-total // block_bytes) or 1
    parts = [items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) for b in range(blocks)]
    held = lambda part: [(r.item, alnum_words(r.text.encode())) for r in part.toLocalIterator()]
    numbers: dict[bytes, int] | None = {}
    used = 0
    for part in parts:  # one block at a time
        for _, words in held(part):
            for w in words:
                if numbers is not None and w not in numbers:
                    numbers[w] = len(numbers)
                    used += len(w) + 64
        if used > vocabulary_bytes:
            numbers = None
            break
    index = stash(build_index(docs, numbers, id_col, text_col))
    found = [_search(index, held(part), numbers, size, slop) for part in parts[:1]]
    if blocks > 1:  # one block is searched, and its windows let go, before the next one is read
        found = [stash(_search(index, held(part), numbers, size, slop)) for part in parts]
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionAll(more)
    if blocks > 1:
        hits = hits.groupBy("segment", "row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return hits.select("id", "n_words", covered_words(F.col("spans")).alias("n_hit"), "items", "spans")


def contamination(docs: DataFrame, bench: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per document; see benchmark_hits."""
    hits = benchmark_hits(docs, bench, size)
    return hits.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql(size: int = 10) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
il AS (SELECT item_id, w, least({size}, len(w)) AS l FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS p FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM il)),
ls AS (SELECT DISTINCT l FROM iw),
dw AS (SELECT rn, l, s, array_to_string(w[s:s + l - 1], ' ') AS p FROM (SELECT rn, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, ls WHERE len(w) >= l)),
h AS (SELECT rn, item_id, s, dw.l AS l FROM dw JOIN iw ON dw.l = iw.l AND dw.p = iw.p),
pos AS (SELECT rn, count(DISTINCT x) AS n_hit FROM (SELECT rn, unnest(range(s, s + l)) AS x FROM h) GROUP BY rn),
it AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rn) LEFT JOIN it USING (rn)"""
