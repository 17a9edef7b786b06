"""Alignment of two tokenizers over a corpus: which tokens of one stand where which tokens of the other stand.

Both tokenizers encode whole texts. In Arrow, the lists of ids are flattened with their parent indices, the lengths of
the tokens' bytes are summed up along each document, and a hash join on (document, byte end) finds the places where
tokens of both end. They cut a document into groups; all pairs of tokens of a group are linked.

How many documents hold a pair of ids linked is counted by Table.group_by within tasks and added up by Spark. The counts
go back to the documents in two parts: the most frequent pairs, HOT_PAIRS at most, are broadcast as sorted arrays; links
of all other pairs are joined in a shuffle, which has no hot key, since none of its pairs is frequent.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, stash
from .heapbpe import HeapCodec, byte_letters, newer_letters

#: Bytes of text encoded together (one text at least), links made at once, pairs in one row of the stored table, and
#: distinct pairs a task counts before it passes them on.
SLICE_BYTES, BLOCK_LINKS, ROW_PAIRS, TASK_PAIRS = 1 << 20, 1 << 21, 1 << 20, 1 << 20
#: Pairs whose counts are broadcast: 17 bytes each.
HOT_PAIRS = 1 << 20
LONG_SPACE = regex.compile(r"\s{1000}")
#: The mark that stands for a space in pieces.
PIECE_SPACE = "▁"


class SpacedBytes:
    """Side A: a byte-level BPE file, on a space and the text; strings of special tokens are plain text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.exact = HeapCodec(spec, pattern)
        if self.exact.made != sorted(self.exact.made):
            raise ValueError("merges have to be in the order of their ids")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items()}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.strings = pa.array([self.exact.strings.get(i, b"") for i in range(max(self.exact.strings) + 1)], pa.binary())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Texts with letters or runs of white space that the fast encoder cannot take go through the exact one."""
        newer = newer_letters()
        old = lambda t: (t.isascii() or newer.isdisjoint(t)) and not LONG_SPACE.search(t)
        return [np.array(self.fast.encode_ordinary(" " + t), np.int32) if old(t) else np.frombuffer(self.exact.plain(" " + t), "<u4").astype(np.int32) for t in texts]


class Pieces:
    """Side B: a piece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.strings = pa.array([bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(PIECE_SPACE, " ").encode() for i in range(m.vocab_size()) for p in [m.id_to_piece(i)]], pa.binary())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in self.model.encode(texts, num_threads=1)]


class Side:
    """The tokens of one side in a slice: ids and byte ends in flat arrays."""

    def __init__(self, coder: SpacedBytes | Pieces, texts: list[str]):
        self.strings = coder.strings
        ids = coder.encode(texts)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        self.lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))

    def joined(self) -> pa.Array:
        """The bytes of each document's tokens."""
        return pc.binary_join(pa.ListArray.from_arrays(self.lists.offsets, pc.take(self.strings, self.lists.values)), b"")

    def keep(self, good: pa.Array) -> None:
        """Documents that are not good lose their tokens, and keep their number."""
        self.lists = pc.if_else(good, self.lists, pa.scalar([], self.lists.type))

    def tokens(self) -> pa.Table:
        """(doc, end, n): a token's document, byte end in it and number in the slice."""
        self.ids = pc.list_flatten(self.lists)
        doc = pc.list_parent_indices(self.lists)
        self.doc = doc.to_numpy()
        through = pc.cumulative_sum(pc.take(pc.binary_length(self.strings).cast(pa.int64()), self.ids)).to_numpy()
        first = np.searchsorted(self.doc, np.arange(len(self.lists)))
        before = np.concatenate([[0], through])[first]
        return pa.table({"doc": doc, "end": through - before[self.doc], "n": np.arange(len(through), dtype=np.int64)})


@cache
def names(n: int) -> pa.Array:
    return pa.array(range(n)).cast(pa.string())


class Slice:
    """Groups, links and digests of the texts of one slice."""

    def __init__(self, left: SpacedBytes, right: Pieces, texts: list[str]):
        self.n, self.a, self.b = len(texts), Side(left, texts), Side(right, texts)
        wanted = pa.array([b" " + t.encode() for t in texts], pa.binary())
        good = pc.and_(pc.equal(self.a.joined(), wanted), pc.equal(self.b.joined(), wanted))
        if pc.sum(pc.invert(good).cast(pa.int64())).as_py():
            self.a.keep(good)
            self.b.keep(good)
        cuts = self.a.tokens().join(self.b.tokens(), keys=["doc", "end"], right_suffix="_b", join_type="inner", use_threads=False)
        for side, column in ((self.a, "n"), (self.b, "n_b")):
            at = np.sort(cuts.column(column).to_numpy())
            side.starts = np.concatenate([[0], at + 1])  # a group's first token; every document ends with a common end
        self.group_doc = self.a.doc[self.a.starts[:-1]]
        self.sizes_a, self.sizes_b = np.diff(self.a.starts), np.diff(self.b.starts)

    def totals(self) -> dict[str, np.ndarray]:
        by = lambda weight: np.bincount(self.group_doc, weights=weight, minlength=self.n).astype(np.int64)
        return {"n_a": by(self.sizes_a), "n_b": by(self.sizes_b), "n_groups": by(np.ones(len(self.group_doc))), "n_links": by(self.sizes_a * self.sizes_b)}

    def digests(self) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2,b3` for each document, '' without tokens."""
        sides = [pc.binary_join(pa.ListArray.from_arrays(s.starts.astype(np.int32), pc.take(names(len(s.strings)), s.ids)), ",") for s in (self.a, self.b)]
        groups = pc.binary_join_element_wise(*sides, "|")
        docs = np.searchsorted(self.group_doc, np.arange(self.n + 1))
        return [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in pc.binary_join(pa.ListArray.from_arrays(docs.astype(np.int32), groups), ";").to_pylist()]

    def entries(self, side: Side, sizes: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, id, times) of the tokens, in the order of groups; in large groups equal ids are one entry."""
        group, ids = np.repeat(np.arange(len(sizes)), sizes), side.ids.to_numpy()
        if not large.any():
            return group, ids, np.ones(len(ids), np.int64)
        of = large[group]
        folded = pa.table({"group": group[of], "id": ids[of]}).group_by(["group", "id"], use_threads=False).aggregate([([], "count_all")])
        group, ids, times = (np.concatenate([x, folded.column(c).to_numpy()]) for x, c in ((group[~of], "group"), (ids[~of], "id"), (np.ones((~of).sum(), np.int64), "count_all")))
        order = np.argsort(group, kind="stable")
        return group[order], ids[order], times[order]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, pair, times), distinct, ascending. pair: A's id times B's vocabulary, plus B's id."""
        wide = len(self.b.strings)
        span = len(self.a.strings) * wide  # documents of a slice times this fit 63 bits
        large = (self.sizes_a * self.sizes_b) > 4096
        group_a, id_a, times_a = self.entries(self.a, self.sizes_a, large)
        group_b, id_b, times_b = self.entries(self.b, self.sizes_b, large)
        first_b = np.searchsorted(group_b, np.arange(len(self.sizes_b) + 1))
        many = np.diff(first_b)[group_a]
        ends = np.cumsum(many)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = at = 0
        while at < len(many):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_LINKS, side="right")))
            n = many[at:stop]
            b = np.repeat(first_b[group_a[at:stop]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            code = self.group_doc[np.repeat(group_a[at:stop], n)] * span + np.repeat(id_a[at:stop].astype(np.int64) * wide, n) + id_b[b]
            found.append(_added(code, np.repeat(times_a[at:stop], n) * times_b[b]))
            held += len(found[-1][0])
            if held > 2 * BLOCK_LINKS and len(found) > 1:
                found = [_added(*map(np.concatenate, zip(*found, strict=True)))]
                held = len(found[0][0]) // 2  # what is distinct may grow before it is folded again
            at = stop
        code, times = _added(*map(np.concatenate, zip(*found, strict=True))) if len(found) > 1 else found[0] if found else (np.zeros(0, np.int64),) * 2
        return code // span, code % span, times


def _added(code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with their times added up."""
    if len(times) and times.max() == 1:
        return np.unique(code, return_counts=True)
    order = np.argsort(code)
    code, times = code[order], times[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(times, first) if len(first) else times


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    return zstandard.compress(np.diff(values, prepend=0).astype(np.int64).tobytes() if ascending else values.astype(np.int64).tobytes(), 1)


def unpack(data: bytes, ascending: bool = False) -> np.ndarray:
    values = np.frombuffer(zstandard.decompress(data), np.int64)
    return np.cumsum(values) if ascending else values


@cache
def sides(path_a: str, pattern: str, path_b: str) -> tuple[SpacedBytes, Pieces]:
    """The tokenizers, kept for the life of a Python worker."""
    return SpacedBytes(path_a, pattern), Pieces(path_b)


def default_files() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


def weighed(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most limit bytes of text, one row at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def align_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, str, str] | None = None) -> DataFrame:
    """(row, id, part, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): what is linked within each document.

    row numbers the rows of docs. pairs and times are packed: the distinct pairs of ids linked, ascending, and how many
    links have them. Part 0 has a row's numbers; more parts, where ROW_PAIRS are not enough, have pairs only. Null and
    empty texts, and those that a tokenizer does not give back byte for byte, have no tokens. Repeated rows are aligned
    each on their own; other columns are not read. files: A's JSON file, its pattern, and B's model.
    """
    path_a, pattern, path_b = files or default_files()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = sides(path_a, pattern, path_b)
        for batch in weighed(slices(batches), SLICE_BYTES):
            texts = batch.column("text").to_pylist()
            full = [k for k, t in enumerate(texts) if t]
            own = Slice(left, right, [texts[k] for k in full])
            numbers = {c: np.zeros(len(texts), np.int64) for c in NUMBERS}
            for c, v in own.totals().items():
                numbers[c][full] = v
            shas = [""] * len(texts)
            for k, sha in zip(full, own.digests(), strict=True):
                shas[k] = sha
            doc, pair, times = own.links()
            cut = np.searchsorted(doc, np.arange(len(full) + 1))
            at, part, pairs, counts = [], [], [], []
            spans = dict(zip(full, zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True), strict=True))
            for k in range(len(texts)):
                low, high = spans.get(k, (0, 0))
                for p, s in enumerate(range(low, max(high, low + 1), ROW_PAIRS)):
                    at.append(k)
                    part.append(p)
                    pairs.append(pack(pair[s : min(high, s + ROW_PAIRS)], True))
                    counts.append(pack(times[s : min(high, s + ROW_PAIRS)]))
            head = np.array(part) == 0
            col = lambda v, t: pa.array([x if h else None for x, h in zip(v, head, strict=True)], t)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(at)), batch.column("id").take(pa.array(at)), pa.array(part, pa.int32())]
                + [col(numbers[c][at].tolist(), pa.int64()) for c in NUMBERS]
                + [col([shas[k] for k in at], pa.string()), pa.array(pairs, pa.binary()), pa.array(counts, pa.binary())],
                names=["row", "id", "part", *NUMBERS, "groups_sha256", "pairs", "times"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"row long, id {kind}, part int, " + "".join(f"{c} long, " for c in NUMBERS) + "groups_sha256 string, pairs binary, times binary")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): in how many rows each pair of ids is linked. Tasks count with Table.group_by, Spark adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def counted() -> pa.Table:
            return pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

        for batch in slices(batches, 50):
            pair = np.concatenate([np.zeros(0, np.int64), *(unpack(p, True) for p in batch.column("pairs").to_pylist())])
            held.append(pa.table({"pair": pair, "n": np.ones(len(pair), np.int64)}))
            if sum(t.num_rows for t in held) > 2 * TASK_PAIRS:
                held = [counted()]
                if held[0].num_rows > TASK_PAIRS:
                    yield from held.pop().to_batches(max_chunksize=1 << 16)
        if held:
            yield from counted().to_batches(max_chunksize=1 << 16)

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def best_pairs(counts: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): best if no pair of the same A id (pair div width) is linked in more rows; ties are all best."""
    owned = counts.withColumn("a", F.expr(f"pair div {width}"))
    top = owned.groupBy("a").agg(F.max("n").alias("top"))  # as many rows as A has tokens, at most
    return owned.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def hot_threshold(pairs: DataFrame, most: int) -> int:
    """The smallest power-of-eighths count which at most `most` pairs reach; counts are gathered by size class only."""
    classes = pairs.groupBy(F.floor(8 * F.log2("n")).alias("c")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect()
    limit, total = 1 << 62, 0
    for r in sorted(classes, key=lambda r: -r.c):
        total += r.k
        if total > most:
            break
        limit = r.n
    return limit


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, str, str] | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of docs; see align_texts.

    A pair's count is the number of rows corpus-wide that hold it linked. n_best: links whose pair has the highest count
    of all pairs of its A id, ties included; count_sum: the counts of all links, added up. An empty table gives no rows.
    """
    import sentencepiece

    files = files or default_files()
    width = sentencepiece.SentencePieceProcessor(model_file=files[2]).vocab_size()
    aligned = stash(align_texts(docs, id_col, text_col, files))
    counts = stash(pair_counts(aligned))
    pairs = stash(best_pairs(counts, width))
    discard(counts)
    limit = hot_threshold(pairs, HOT_PAIRS)
    hot = pairs.where(F.col("n") >= limit).toArrow().sort_by("pair")
    held = docs.sparkSession.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, pair, times, place among the hot pairs, whether it is one) of the batches' pairs."""
        known = held.value[0]
        for batch in slices(batches, 50):
            pair = [unpack(p, True) for p in batch.column("pairs").to_pylist()]
            row = np.repeat(batch.column("row").to_numpy(), [len(p) for p in pair])
            times = np.concatenate([unpack(t) for t in batch.column("times").to_pylist()])
            pair = np.concatenate(pair)
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            yield row, pair, times, at, known[at] == pair if len(known) else np.zeros(len(pair), bool)

    def hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = held.value
        for row, _, times, at, found in links(batches):
            own = pa.table({"row": row[found], "n_best": times[found] * best[at[found]], "count_sum": times[found] * n[at[found]]})
            summed = own.group_by("row", use_threads=False).aggregate([("n_best", "sum"), ("count_sum", "sum")])
            yield from summed.select(["row", "n_best_sum", "count_sum_sum"]).rename_columns(["row", "n_best", "count_sum"]).to_batches()

    def rare_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, pair, times, _, found in links(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x[~found]) for x in (row, pair, times)], names=["row", "pair", "times"])

    packed = aligned.select("row", "pairs", "times")
    sums = packed.mapInArrow(hot_sums, "row long, n_best long, count_sum long")
    if limit > 1:  # with 1 all pairs are hot
        rare = packed.mapInArrow(rare_links, "row long, pair long, times long").join(pairs.where(F.col("n") < limit), "pair")
        sums = sums.unionAll(rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.where("part = 0").join(sums, "row", "left").select("id", *NUMBERS, zero("n_best"), zero("count_sum"), "groups_sha256")
