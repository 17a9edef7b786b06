"""Language ID with unigram pieces whose segmentations are summed.

The pieces are a fixed public vocabulary of byte strings. Each language has a probability for each piece; a forward
algorithm adds up the probabilities of all ways to cut a word into pieces, and a text's score is the product over its
words. Probabilities come from expectation-maximisation over the words of a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .bpe import default_vocabulary, read_ranks
from .common import fold, slices

#: About so many labelled documents of each language are fitted, with all their words.
SAMPLE_DOCS = 1500
#: Bytes of pieces that are looked up for whole batches (longer ones are looked up where they can begin); rounds of
#: expectation-maximisation; count added to every piece.
PIECE_BYTES, ROUNDS, ADDED = 8, 3, 0.02
#: Frequent words whose scores every task holds; further words a task remembers; bytes from which on a word is cut.
HELD_WORDS, MEMO_SIZE, WORD_BYTES = 60_000, 150_000, 36
#: A document is rejected below this posterior.
MIN_SCORE = 0.5

LETTER = regex.compile(r"\p{L}")
#: ASCII characters other than letters separate words; bytes of other characters stay.
SEPARATE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case runs of letters and non-ASCII characters, each after a space, as UTF-8. Runs of over WORD_BYTES bytes
    (scripts without spaces) are cut between characters; only the first part has the space."""
    words = [b" " + w for w in text.lower().encode().translate(SEPARATE).split()]
    if words and max(map(len, words)) > WORD_BYTES:
        words = [part for w in words for part in cut_word(w)]
    return words


def cut_word(word: bytes) -> list[bytes]:
    out = []
    while len(word) > WORD_BYTES:
        at = WORD_BYTES
        while at > 1 and word[at] & 0xC0 == 0x80:
            at -= 1
        out.append(word[:at])
        word = word[at:]
    return [*out, word]


class Pieces(dict):
    """Numbers of pieces; those of up to PIECE_BYTES by length as sorted integers, for whole batches of words, longer ones
    by their first PIECE_BYTES bytes."""

    def __init__(self, numbers: dict[bytes, int]):
        super().__init__(numbers)
        self.tables = []
        for n in range(1, PIECE_BYTES + 1):
            some = sorted((int.from_bytes(p, "big"), i) for p, i in numbers.items() if len(p) == n)
            self.tables.append((np.array([k for k, _ in some], dtype=np.uint64), np.array([i for _, i in some], dtype=np.int32)))
        self.long: dict[int, list[tuple[bytes, int]]] = {}
        for p, i in sorted(numbers.items()):
            if len(p) > PIECE_BYTES:
                self.long.setdefault(int.from_bytes(p[:PIECE_BYTES], "big"), []).append((p, i))
        self.begins = np.array(sorted(self.long), dtype=np.uint64)


def read_pieces(path: str) -> Pieces:
    """All pieces of the vocabulary."""
    return Pieces({p: i for i, p in enumerate(sorted(read_ranks(path)))})


class Lattice:
    """Pieces in words of one length. edges: (words, length, PIECE_BYTES), number of the piece that ends before position
    j + 1 and has d + 1 bytes, else the count of pieces. long: by end, (words, bytes, numbers) of longer pieces."""

    def __init__(self, edges: np.ndarray, long: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.edges, self.long, self.shape = edges, long, edges.shape


def lattice(words: list[bytes], pieces: Pieces) -> Lattice:
    """All words have the same length."""
    n, none = len(words[0]), len(pieces)
    letters = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), n).astype(np.uint64)
    out = np.full((len(words), n, PIECE_BYTES), none, dtype=np.int32)
    key, found = letters, []
    for d, (keys, numbers) in enumerate(pieces.tables[:n]):
        if d:  # the byte d places before each end comes in front
            key = key[:, 1:] + (letters[:, : n - d] << np.uint64(8 * d))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out[:, d:, d] = np.where(keys[at] == key, numbers[at], none)
    if n > PIECE_BYTES and len(pieces.begins):  # key has the PIECE_BYTES bytes from each start on
        at = np.minimum(np.searchsorted(pieces.begins, key), len(pieces.begins) - 1)
        for i, s in np.argwhere(pieces.begins[at] == key).tolist():
            found += [(s + len(p), i, len(p), k) for p, k in pieces.long[int(key[i, s])] if words[i].startswith(p, s)]
    long: dict[int, list[tuple[int, int, int]]] = {}
    for j, *rest in found:
        long.setdefault(j, []).append(tuple(rest))
    return Lattice(out, {j: tuple(np.array(x).T) for j, x in long.items()})


def forward(graph: Lattice, p: np.ndarray) -> np.ndarray:
    """(words, length + 1, languages) sums over all segmentations of each prefix; p: (pieces + 1, languages)."""
    edges = graph.edges
    words, n, _ = edges.shape
    alpha = np.zeros((words, n + 1, p.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, n + 1):
        for d in range(1, min(j, PIECE_BYTES) + 1):
            alpha[:, j] += alpha[:, j - d] * p[edges[:, j - 1, d - 1]]
        if j in graph.long:
            i, d, k = graph.long[j]
            np.add.at(alpha, (i, j), alpha[i, j - d] * p[k])
    return alpha


def backward(graph: Lattice, p: np.ndarray) -> np.ndarray:
    edges = graph.edges
    words, n, _ = edges.shape
    beta = np.zeros((words, n + 1, p.shape[1]))
    beta[:, n] = 1
    for j in range(n, 0, -1):
        for d in range(1, min(j, PIECE_BYTES) + 1):
            beta[:, j - d] += beta[:, j] * p[edges[:, j - 1, d - 1]]
        if j in graph.long:
            i, d, k = graph.long[j]
            np.add.at(beta, (i, j - d), beta[i, j] * p[k])
    return beta


def by_length(words: list[bytes], block: int = 4096) -> Iterator[list[bytes]]:
    lengths: dict[int, list[bytes]] = {}
    for w in words:
        lengths.setdefault(len(w), []).append(w)
    for same in lengths.values():
        for at in range(0, len(same), block):
            yield same[at : at + block]


def fit(counts: dict[str, dict[bytes, int]], pieces: Pieces, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, log p (pieces, languages)) from word counts of each language."""
    langs, none = sorted(counts), len(pieces)
    table = np.zeros((none, len(langs)), dtype=np.float32)
    for k, lang in enumerate(langs):
        groups = [(lattice(same, pieces), np.array([counts[lang][w] for w in same], dtype=float)) for same in by_length(list(counts[lang]))]
        p = np.full(none, 1 / none)
        for _ in range(rounds):
            found = np.zeros(none + 1)
            q = np.append(p, 0)[:, None]
            for graph, weight in groups:
                edges, a, b = graph.edges, forward(graph, q)[:, :, 0], backward(graph, q)[:, :, 0]
                whole = a[:, -1]
                for j, (i, d, e) in graph.long.items():
                    found += np.bincount(e, weights=weight[i] * a[i, j - d] * q[e, 0] * b[i, j] / whole[i], minlength=none + 1)
                for j in range(1, edges.shape[1] + 1):
                    for d in range(1, min(j, PIECE_BYTES) + 1):
                        e = edges[:, j - 1, d - 1]
                        found += np.bincount(e, weights=weight * a[:, j - d] * q[e, 0] * b[:, j] / whole, minlength=none + 1)
            p = (found[:none] + ADDED) / (found[:none].sum() + ADDED * none)
        table[:, k] = np.log(p)
    return langs, table


class Scorer:
    """Log-likelihoods of words by language, which are remembered."""

    def __init__(self, pieces: Pieces, log_p: np.ndarray, known: tuple[list[bytes], np.ndarray] | None = None):
        """known: words whose scores are held from the start and never forgotten."""
        self.pieces, self.p = pieces, np.vstack([np.exp(log_p.astype(float)), np.zeros((1, log_p.shape[1]))])
        words, scores = known or ([], np.zeros((0, log_p.shape[1])))
        self.held = {w: i for i, w in enumerate(words)}
        self.at = dict(self.held)
        self.table = np.zeros((len(words) + 1024, log_p.shape[1]))
        self.table[: len(words)] = scores

    def learn(self, words: list[bytes]) -> None:
        for same in by_length(words):
            scores = np.log(forward(lattice(same, self.pieces), self.p)[:, -1])
            n = len(self.at)
            while n + len(same) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(same)] = scores
            self.at.update(zip(same, range(n, n + len(same)), strict=True))

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """(texts, languages) log-likelihoods."""
        if len(self.at) > len(self.held) + MEMO_SIZE:
            self.at = dict(self.held)
        known = self.at
        self.learn(list({w for words in texts for w in words if w not in known}))
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, words in enumerate(texts):
            if words:
                out[i] = self.table[[known[w] for w in words]].sum(axis=0)
        return out


def sample_counts(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, dict[bytes, int]]:
    """Word counts by language of about sample_docs documents each, chosen by a hash of the text; docs: text, lang."""
    labelled = docs.where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample_docs / n)))))
    chosen = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: dict[str, Counter] = {}
            for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words_of(t))
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    counted = chosen.select("text", "lang").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[bytes, int]] = {lang: {} for lang in sizes}
    for r in counted.orderBy("lang", F.desc("n"), "word").toLocalIterator():  # of the bounded sample
        counts[r.lang][bytes(r.word)] = r.n
    return counts


def predict_languages(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """(id, lang_pred, score, kept columns), one row per document; train: text, lang of the labelled documents.

    score is the posterior of lang_pred under equal priors. A text that is null or has no letter gives 'und' and 0,
    and so does every text when train has no labelled row. Ties go to the language first by name. Repeated rows give
    repeated results, an empty table none; texts are read whole. A kept column may not have the name of a result.
    """
    if clash := {"id", "lang_pred", "score"} & set(keep):
        raise ValueError(f"kept columns have names of results: {sorted(clash)}")
    path = path or default_vocabulary()[0]
    pieces = read_pieces(path)
    counts = sample_counts(train)
    langs, log_p = fit(counts, pieces)
    total = sum(map(Counter, counts.values()), Counter())
    frequent = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:HELD_WORDS]]
    first = Scorer(pieces, log_p)
    first.learn(frequent)
    known = (list(first.at), first.table[: len(first.at)].copy())
    held = docs.sparkSession.sparkContext.broadcast((log_p, known))

    @pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(read_pieces(path), *held.value)
        for column in batches:
            labels, scores = ["und"] * len(column), [0.0] * len(column)
            for at in range(0, len(column) if langs else 0, 500):  # few whole texts at a time
                texts = [t if t and LETTER.search(t) else None for t in column.iloc[at : at + 500]]
                found = scorer.score([words_of(t) if t else [] for t in texts])
                found = np.exp(found - found.max(axis=1, keepdims=True))
                found /= found.sum(axis=1, keepdims=True)
                best = found.argmax(axis=1)
                labels[at : at + 500] = [langs[k] if t else "und" for k, t in zip(best.tolist(), texts, strict=True)]
                scores[at : at + 500] = [s if t else 0.0 for s, t in zip(found.max(axis=1).tolist(), texts, strict=True)]
            yield pd.DataFrame({"lang_pred": labels, "score": scores})

    predict = predict.asNondeterministic()  # else a filter on the result runs it twice
    found = docs.select(F.col(id_col).alias("id"), predict(F.col(text_col).cast("string")).alias("__found"), *(F.col(f"`{c}`") for c in keep))
    return found.select("id", "__found.lang_pred", "__found.score", *(F.col(f"`{c}`") for c in keep))


def held_out(folds: int = 4, at: int = 2):
    """Whether a document is never learnt from: crc32 of doc_id as text, modulo folds."""
    return F.coalesce(fold(F.col("doc_id"), folds) == at, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of documents, fitted on those not held out; see predict_languages."""
    found = predict_languages(docs, docs.where(~held_out()).select("text", "lang"))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
