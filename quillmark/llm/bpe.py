"""Byte-level BPE as a tree reduction over a monoid of encoded stretches, and decoding up the same tree.

Two levels use the same idea. A text is halved down to leaves that are split into pattern matches; joining two
halves splits a growing window around the seam again until it meets, on both sides, match ends that the other side
cannot move. A long match is halved down to short byte strings; joining two encodings encodes a growing window of
tokens around the seam again until the tokens at both edges of the window are compatible with their outer
neighbours. A token sequence is the encoding of its bytes exactly if each two neighbours are their own joint
encoding, so tokens beyond a compatible edge cannot change any more.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: A text longer than this is halved; a match longer than LEAF_BYTES is halved.
LEAF_CHARS, LEAF_BYTES = 1 << 16, 8
#: Matches up to MEMO_BYTES are remembered, MEMO_SIZE of them at most.
MEMO_SIZE, MEMO_BYTES = 200_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes by a table of ranks; pattern splits a text before any merge."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.short: dict[bytes, list[int]] = {}

    # -- one match ------------------------------------------------------------------------------------------
    def merge(self, data: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until no neighbours form a token."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        get, none = ranks.get, 1 << 60
        costs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (best := min(costs)) < none:
            at = costs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(costs):
                costs[at] = get(parts[at] + parts[at + 1], none)
        return [ranks[p] for p in parts]

    def merged(self, data: bytes) -> list[int]:
        """merge(), remembered for short strings: leaves and windows around seams."""
        if len(data) > 16:
            return self.merge(data)
        ids = self.short.get(data)
        if ids is None:
            if len(self.short) >= MEMO_SIZE:
                self.short.clear()
            ids = self.short[data] = self.merge(data)
        return ids

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO_SIZE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the joined bytes: only a window around the seam is encoded again."""
        if not left or not right or self.compatible(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merged(b"".join([self.bytes_of[t] for t in left[-i:] + right[:j]]))
            grow_left = i < len(left) and not self.compatible(left[-i - 1], window[0])
            grow_right = j < len(right) and not self.compatible(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = min(len(left), 2 * i) if grow_left else i, min(len(right), 2 * j) if grow_right else j

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        half = len(data) // 2
        return self.join_tokens(self.tree(data[:half]), self.tree(data[half:]))

    def encode_match(self, match: str) -> bytes:
        """Ids of one match as little-endian 32-bit integers; a match that is a token is that token."""
        data = match.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.tree(data)
        return np.array(ids, dtype="<u4").tobytes()

    def encode_matches(self, matches: list[str]) -> list[bytes]:
        memo = self.memo
        out = []
        for m in matches:
            ids = memo.get(m)
            if ids is None:
                ids = self.encode_match(m)
                if len(m) <= MEMO_BYTES:
                    if len(memo) >= MEMO_SIZE:
                        memo.clear()
                    memo[m] = ids
            out.append(ids)
        return out

    # -- the split of a text ---------------------------------------------------------------------------------
    def join_matches(self, left: list[str], right: list[str]) -> list[str]:
        """Matches of the joined texts. Matches that end 3 or more characters before the seam looked at nothing
        behind it, so they stay; from a common match end on, the right half's matches stay."""
        if not left or not right:
            return left + right
        i, far = 0, 0
        while i < len(left) and (i == 0 or far < 3):
            i += 1
            far += len(left[-i])
        # left[-i] ends less than 3 before the seam or touches it: split again from its start
        head = "".join(left[len(left) - i :])
        j = 1
        while True:
            tail = "".join(right[:j])
            again = self.split.findall(head + tail)
            end, ends, at = len(head), set(), 0
            for m in right[:j]:
                ends.add(end := end + len(m))
            for k, m in enumerate(again):
                at += len(m)
                if at in ends and (j == len(right) or len(head) + len(tail) - at >= 3):
                    done = next(n for n in range(1, j + 1) if len(head) + sum(map(len, right[:n])) == at)
                    return left[: len(left) - i] + again[: k + 1] + right[done:]
            if j == len(right):
                return left[: len(left) - i] + again
            j = min(len(right), 2 * j)

    def matches(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.split.findall(text)
        half = len(text) // 2
        return self.join_matches(self.matches(text[:half]), self.matches(text[half:]))

    # -- texts -----------------------------------------------------------------------------------------------
    def encode(self, text: str) -> bytes:
        """Token ids of the text, packed as little-endian unsigned 32-bit integers."""
        return b"".join(self.encode_matches(self.matches(text)))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids: halves are decoded on their own and concatenated up the tree."""
        if len(ids) <= 1 << 14:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, kept for the life of a Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _vocabulary(path: str | None, pattern: str | None) -> tuple[str, str]:
    own = default_vocabulary() if path is None or pattern is None else ("", "")
    return path or own[0], pattern or own[1]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids binary): token ids of each whole text as little-endian unsigned 32-bit integers.

    Null counts as empty and gives no ids. Repeated rows give repeated results, an empty table none; columns besides
    the two are not read. The rank file is read on the executors from the tokenizers' installed package, or from path.
    """
    path, pattern = _vocabulary(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches):
            ids = [c.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary())], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids binary")


def decode_ids(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids) -> (id, data binary): the bytes of the ids; null ids count as none. An unknown id is an error."""
    path, pattern = _vocabulary(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches):
            data = [c.decode(np.frombuffer(b or b"", dtype="<u4").tolist()) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(data, pa.binary())], names=["id", "data"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ids, data, kept columns): encoding and then decoding of each text in one pass; see encode_texts.

    One row per row of docs, so ids that repeat with other texts are coded each on their own. A kept column may not have
    the name of a result."""
    if clash := {"id", "ids", "data"} & set(keep):
        raise ValueError(f"kept columns have names of results: {sorted(clash)}")
    path, pattern = _vocabulary(path, pattern)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`") for c in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches):
            ids = [c.encode(t or "") for t in batch.column("text").to_pylist()]
            data = [c.decode(np.frombuffer(b, dtype="<u4").tolist()) for b in ids]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary()), pa.array(data, pa.binary()), *(batch.column(k) for k in keep)], names=["id", "ids", "data", *keep])

    fields = "".join(f", `{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, data binary{fields}")


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of a round trip."""
    return coded.select(F.col("id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))

