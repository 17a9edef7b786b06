"""BPE by a priority queue of merge ranks over a doubly linked list of symbols, from a tokenizer's JSON file.

A word starts as one symbol for each byte. The queue holds (rank, place) of every pair of neighbours that a merge rule
knows; the lowest comes first, the leftmost among equals. A merge links the right symbol out of the list and enters the
two new pairs; entries of pairs that have changed meanwhile are stale, and are skipped when they come up. A word of n
bytes takes O(n log n), however long it is. Decoding concatenates the vocabulary's strings.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .common import slices

#: Texts are split from one white space to another, CHUNK_CHARS or more at a time; words of MEMO_CHARS or fewer are
#: remembered, MEMO_SIZE of them at most.
CHUNK_CHARS, MEMO_CHARS, MEMO_SIZE = 1 << 16, 64, 600_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@cache
def newer_letters() -> frozenset[str]:
    """Letters and numbers of newer Unicode versions, known to the regex library but not yet to the tokenizers library.

    Only characters that this Python's own, older Unicode data leave unassigned can be such; the tokenizers library's
    splitter is asked about each of them once.
    """
    known, split = regex.compile(r"[\p{L}\p{N}]"), ByteLevel(add_prefix_space=False)
    return frozenset(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn" and known.match(c) and len(split.pre_tokenize_str("!" + c)) == 1)


#: Stands in for newer letters while a text is split: a character of no class.
OTHER = "\uffff"


class _Words(dict):
    """Ids of words as packed integers, encoded when they are first met."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= MEMO_CHARS:
            self[word] = ids
        return ids


class HeapCodec:
    """Encodes and decodes by the vocabulary, merges and added tokens of a byte-level BPE file; pattern splits texts."""

    def __init__(self, spec: dict, pattern: str):
        model, before = spec["model"], spec["pre_tokenizer"]
        wanted = {"normalizer": None, "post_processor": None}
        odd = [k for k, v in wanted.items() if spec.get(k) != v] + [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        if odd or model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"]:
            raise ValueError(f"not a plain byte-level BPE file: {odd}")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens have to be plain strings")
        vocabulary = model["vocab"]
        letters = byte_letters()
        self.byte_ids = [vocabulary[c] for c in letters]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = 1 + max(vocabulary.values())
        #: Rank of each pair of ids (as left * width + right), and the id that each rank makes.
        self.ranks = {vocabulary[a] * self.width + vocabulary[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocabulary[a + b] for a, b in pairs]
        byte_of = {c: b for b, c in enumerate(letters)}
        as_bytes = lambda t: bytes(map(byte_of.__getitem__, t)) if all(c in byte_of for c in t) else t.encode()
        self.strings = {i: as_bytes(t) for t, i in vocabulary.items()} | {t["id"]: as_bytes(t["content"]) for t in spec["added_tokens"]}
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        longest_first = sorted(self.added, key=lambda t: (-len(t), t))
        self.stops = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.split, self.gap = regex.compile(pattern), regex.compile(r"(?<=\S)(?=\s)")
        self.words = _Words(self.encode_word)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one word. Symbol n, which is also the one before the first, is the end: it pairs with nothing, and
        neither does a symbol that has been merged into the one before it."""
        rank_of, made, width, n, none = self.ranks.get, self.made, self.width, len(data), -self.width * self.width
        ids = [self.byte_ids[b] for b in data]
        ids.append(none)
        before, after = list(range(-1, n)), list(range(1, n + 2))
        queue = [rank * n + i for i in range(n - 1) if (rank := rank_of(ids[i] * width + ids[i + 1])) is not None]
        heapify(queue)
        while queue:
            rank, at = divmod(heappop(queue), n)
            right = after[at]
            if rank_of(ids[at] * width + ids[right]) != rank:
                continue  # stale: one of the two has been merged since
            ids[at], ids[right] = new, none = made[rank], none
            after[at] = beyond = after[right]
            before[beyond] = at
            if (rank := rank_of(new * width + ids[beyond])) is not None:
                heappush(queue, rank * n + at)
            left = before[at]
            if (rank := rank_of(ids[left] * width + new)) is not None:
                heappush(queue, rank * n + left)
        return [i for i in ids if i >= 0]

    def encode_word(self, word: str) -> bytes:
        return np.array(self.merge(word.encode()), "<u4").tobytes()

    def chunks(self, text: str) -> Iterator[str]:
        """Parts that split as the whole text does: no match goes on from a non-space into a space, or looks back."""
        at = 0
        while len(text) - at > CHUNK_CHARS and (gap := self.gap.search(text, at + CHUNK_CHARS)):
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:]

    def plain(self, text: str) -> bytes:
        words = self.words
        if len(words) > MEMO_SIZE:
            words.clear()
        return b"".join([b"".join(map(words.__getitem__, self.matches(part))) for part in self.chunks(text)])

    def matches(self, text: str) -> list[str]:
        if text.isascii() or (newer := newer_letters()).isdisjoint(text):
            return self.split.findall(text)
        return [text[slice(*m.span())] for m in self.split.finditer("".join([OTHER if c in newer else c for c in text]))]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Strings of added tokens are those tokens, wherever they stand."""
        if self.stops is None or not self.stops.search(text):
            return self.plain(text)
        return b"".join([self.added[p] if p in self.added else self.plain(p) for p in self.stops.split(text)])

    def decode(self, ids: bytes) -> str:
        """The joined strings of the ids; bytes that are not UTF-8 become U+FFFD. An unknown id is an error."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict[tuple[str, str], HeapCodec] = {}


def heap_codec(path: str, pattern: str) -> HeapCodec:
    """The codec of a file, kept for the life of a Python worker."""
    if (path, pattern) not in _CODECS:
        with open(path, encoding="utf-8") as f:
            _CODECS[path, pattern] = HeapCodec(json.load(f), pattern)
    return _CODECS[path, pattern]


def default_file() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def _file(path: str | None, pattern: str | None) -> tuple[str, str]:
    own = default_file() if path is None or pattern is None else ("", "")
    return path or own[0], pattern or own[1]


def heap_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids binary): ids of each whole text as little-endian unsigned 32-bit integers.

    Null counts as empty and gives no ids. Repeated rows give repeated results, an empty table none; columns besides the
    two are not read. The file is read on the executors, from the tokenizers' installed package or from path.
    """
    path, pattern = _file(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = heap_codec(path, pattern)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.encode(t or "") for t in batch.column("text").to_pylist()], pa.binary())], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids binary")


def heap_decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids) -> (id, ids, decoded string); null ids count as none. An unknown id is an error."""
    path, pattern = _file(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = heap_codec(path, pattern)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("id", "ids")), pa.array([c.decode(b or b"") for b in batch.column("ids").to_pylist()], pa.string())], names=["id", "ids", "decoded"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, ids binary, decoded string")


def heap_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids, decoded): heap_encode and then heap_decode of its ids, in one pass over the texts."""
    path, pattern = _file(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = heap_codec(path, pattern)
        for batch in slices(batches):
            ids = [c.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.string())], names=["id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids binary, decoded string")


def heap_digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of heap_decode's rows."""
    size = (F.octet_length(F.coalesce("ids", F.unhex(F.lit("")))) / 4).cast("long")
    return decoded.select(F.col("id").alias(id_col), size.alias("n_tokens"), F.sha2(F.coalesce("ids", F.unhex(F.lit(""))), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
