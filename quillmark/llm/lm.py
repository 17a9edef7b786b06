"""Language-model scoring: add-one unigrams, and a hierarchical log-bilinear model over the whole vocabulary.

Every word has a group, found without labels: frequent words that stand in the same documents form the groups, and any
other word goes with the documents it stands in. The model predicts a token's group from the groups of the tokens
before it, then, from the word before it, one of the classes of the group: its frequent words, each with a vector of its
own, or its rest, whose words follow their add-one counts. Both steps are log-bilinear (vectors of the context times
vectors of what is predicted), trained by noise-contrastive estimation and normalised exactly over a group.

All that is learnt comes from sums of counts over all training texts, so it does not depend on how texts are dealt. The
number of frequent words grows with the square root of the vocabulary. Training steps are synchronous: tasks hold parts
of the counts and add up gradients, and noise is not drawn but summed over its whole distribution.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, slices, space_words, stash, utf8

#: Words that every task holds with their counts; words longer than WORD_BYTES go by a digest.
HEAD, WORD_BYTES = 150_000, 48
#: Groups, words whose documents tell the groups, and tokens before that predict a group.
GROUPS, ANCHORS, HISTORY = 8, 96, 4
#: Frequent words with a vector, times the root of the vocabulary; width of vectors; noise for a token.
CLASS_RATE, WIDTH, NOISE = 2.0, 16, 10
#: Training steps of the two parts, their size, tokens that pull a vector of a word back to its start, and cells of counts
#: that a task holds.
GROUP_STEPS, WORD_STEPS, STEP, PRIOR, CELLS = 150, 24, 0.1, 20.0, 1_000_000
#: Words or cells counted by a task before it hands them on.
FLUSH = 400_000


def key_of(word: bytes) -> bytes:
    return word if len(word) <= WORD_BYTES else b" " + md5(word).digest()


def held_out(folds: int = 7, at: int = 2):
    """Whether a document is never learnt from: crc32 of doc_id as text, modulo folds."""
    return F.coalesce(fold(F.col("id"), folds) == at, F.lit(False))


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, c): how often each word occurs; words over WORD_BYTES bytes stand as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            whole: Counter[bytes] = Counter()
            for w, n in counts.items():
                whole[key_of(w)] += n
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(whole), pa.binary()), pa.array(list(whole.values()), pa.int64())], names=["word", "c"])

        for batch in slices(batches):
            for t in utf8(batch, "text"):
                counts.update(space_words(t))
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def group_anchors(together: np.ndarray, groups: int = GROUPS, rounds: int = 20) -> np.ndarray:
    """Groups of anchors by the documents they share: k-means on normalised rows, started from the farthest ones."""
    n = np.sqrt(np.maximum(np.diag(together), 1))
    x = together / n[:, None] / n[None, :]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[:1]
    while len(centres) < min(groups, len(x)):
        centres = np.concatenate([centres, x[[int((x @ centres.T).max(axis=1).argmin())]]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == g].sum(axis=0) if (own == g).any() else centres[g] for g in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return (x @ centres.T).argmax(axis=1) if len(x) else np.zeros(0, np.int64)


class Vocabulary:
    """The head words by falling count, with what all tokens need."""

    def __init__(self, words: list[bytes], counts: np.ndarray, ends: int, total: int, distinct: int, classes: int):
        self.number = {w: i for i, w in enumerate(words)}
        self.classes = min(classes, len(words))
        self.log_c = np.append(np.log10(counts + 1.0), np.log10(ends + 1.0))  # the end comes last
        self.known = np.append(counts > 0, ends > 0)
        self.counts, self.ends = counts, ends
        self.rest_tokens, self.rest_distinct = total - ends - int(counts.sum()), distinct - len(words) - (ends > 0)
        self.group = np.zeros(len(words), np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[Counter]]:
        """(head number of each token: -1 other, last the end), first token of each text, words outside the head."""
        get, end = self.number.get, len(self.number)
        ids, starts, rest = [], [], []
        for t in texts:
            words = space_words(t)
            own = [get(w, -1) for w in words]
            starts.append(len(ids))
            rest.append(Counter(key_of(w) for w, i in zip(words, own, strict=True) if i < 0) if -1 in own else Counter())
            for w in [x for x in rest[-1] if x[:1] == b" " and x in self.number]:  # a long word in the head, by its digest
                rest[-1].pop(w)
                own = [self.number[w] if i < 0 and key_of(x) == w else i for x, i in zip(words, own, strict=True)]
            ids += own
            ids.append(end)
        return np.array(ids, dtype=np.int64), np.array(starts, dtype=np.int64), rest

    def symbols(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(history, group, word before, word) of each token as numbers.

        Groups are followed by the end and by outside (words beyond the head); in a history, outside and before the text
        follow the groups. Words: the classes, the rest of each group, and, as contexts only, outside and before; the
        end and words outside are no word of a group (-1).
        """
        end, g, k = len(self.number), GROUPS, self.classes
        own = np.append(self.group, g)[np.minimum(ids, end)]
        target = np.where(ids < 0, g + 1, own)
        seen = np.where(ids < 0, g, own)
        word = np.where(ids < 0, k + g, np.where(ids < k, ids, k + own))
        place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
        history = np.zeros(len(ids), np.int64)
        for i in range(1, HISTORY + 1):
            history = history * (g + 2) + np.where(place < i, g + 1, np.roll(seen, i))
        before = np.where(place < 1, k + g + 1, np.roll(word, 1))
        return history, target, before, np.where((ids < 0) | (ids == end), -1, word)


def _adam(parts: list[np.ndarray], grads: list[np.ndarray], memory: list, t: int, size: float) -> None:
    """One step up the gradient."""
    for i, (p, g) in enumerate(zip(parts, grads, strict=True)):
        m, v = memory[i] if memory[i] is not None else (np.zeros_like(p), np.zeros_like(p))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        memory[i] = (m, v)
        p += size * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-12)


def train_groups(codes: np.ndarray, counts: np.ndarray, steps: int = GROUP_STEPS) -> np.ndarray:
    """(histories, GROUPS + 2) log-probabilities of the next group. codes: history * (GROUPS + 2) + group, with counts.

    s(g | h) = sum of the vectors of the history's symbols at their places, times the vector of g, and a bias. The table
    has (GROUPS + 2) ** HISTORY rows, a fixed number.
    """
    n, rng = GROUPS + 2, np.random.default_rng(1)
    tables = [rng.normal(0, 0.1, (n, WIDTH)) for _ in range(HISTORY)]
    target = rng.normal(0, 0.1, (n, WIDTH))
    history, own = codes // n, codes % n
    noise = np.bincount(own, counts, n) + 1.0
    noise /= noise.sum()
    bias = np.log(noise)
    rows, at = np.unique(history, return_inverse=True)
    digits = [rows // n ** (HISTORY - i) % n for i in range(1, HISTORY + 1)]
    table = np.zeros((len(rows), n))
    np.add.at(table, (at, own), counts)
    total, offset, memory = table.sum(axis=1, keepdims=True), np.log(NOISE * noise), [None] * (HISTORY + 2)
    for t in range(1, steps + 1):
        context = sum(c[d] for c, d in zip(tables, digits, strict=True))
        p = 1 / (1 + np.exp(-(context @ target.T + bias - offset)))
        up = (table * (1 - p) - NOISE * total * noise * p) / max(1.0, counts.sum())
        back, grads = up @ target, []
        for d in digits:
            g = np.zeros((n, WIDTH))
            np.add.at(g, d, back)
            grads.append(g)
        _adam([*tables, target, bias], [*grads, up.T @ context, up.sum(axis=0)], memory, t, STEP)
    every = np.arange(n**HISTORY)
    s = sum(c[every // n ** (HISTORY - i) % n] for i, c in enumerate(tables, 1)) @ target.T + bias
    top = s.max(axis=1, keepdims=True)
    return s - top - np.log(np.exp(s - top).sum(axis=1, keepdims=True))


class Words:
    """s(w | v) = near[v] * target[w] + bias[w], normalised over the classes of one group."""

    def __init__(self, group_of: np.ndarray, weights: np.ndarray, contexts: int):
        """group_of: group of each class; weights: its count."""
        rng = np.random.default_rng(2)
        self.group_of = group_of
        own = weights + 1.0
        self.noise = own / np.bincount(group_of, own, GROUPS)[group_of]  # within its group
        self.near = rng.normal(0, 0.1, (contexts, WIDTH))
        self.target = rng.normal(0, 0.1, (len(group_of), WIDTH))
        self.bias = np.log(self.noise)

    def parts(self) -> list[np.ndarray]:
        return [self.near, self.target, self.bias]

    def gradient(self, v: np.ndarray, w: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Of the noise-contrastive objective on these cells of counts, over the whole noise of each context."""
        out = [np.zeros_like(x) for x in self.parts()]
        offset = np.log(NOISE * self.noise)
        rows, at = np.unique(v, return_inverse=True)
        order = np.argsort(at, kind="stable")
        at, w, counts = at[order], w[order], counts[order]
        for first in range(0, len(rows), 512):
            low, high = np.searchsorted(at, [first, first + 512])
            some = rows[first : first + 512]
            p = 1 / (1 + np.exp(-(self.near[some] @ self.target.T + self.bias - offset)))
            mass = np.zeros((len(some), GROUPS))
            np.add.at(mass, (at[low:high] - first, self.group_of[w[low:high]]), counts[low:high])
            up = -NOISE * mass[:, self.group_of] * self.noise * p
            np.add.at(up, (at[low:high] - first, w[low:high]), counts[low:high] * (1 - p[at[low:high] - first, w[low:high]]))
            out[0][some] += up @ self.target
            out[1] += up.T @ self.near[some]
            out[2] += up.sum(axis=0)
        return out

    def log_norms(self) -> np.ndarray:
        """(contexts, GROUPS) logs of the sums over each group after each context."""
        member = (self.group_of[:, None] == np.arange(GROUPS)).astype(float)
        out = []
        for at in range(0, len(self.near), 1024):
            s = self.near[at : at + 1024] @ self.target.T + self.bias
            top = s.max(axis=1, keepdims=True)
            out.append(np.log(np.maximum(np.exp(s - top) @ member, 1e-300)) + top)
        return np.concatenate(out)


def _held(texts: DataFrame, value: object) -> Broadcast:
    return texts.sparkSession.sparkContext.broadcast(value)


def _added(packed: DataFrame, zero: list[np.ndarray], one) -> list[np.ndarray]:
    """Sum over rows of lists of arrays of bounded size, added up on the way to the driver."""
    both = lambda a, b: [x + y for x, y in zip(a, b, strict=True)]
    return packed.rdd.treeAggregate(zero, lambda total, row: both(total, one(row)), both)


def find_groups(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Group of each head word: by the anchors of the documents it stands in, relative to the group's size."""
    held, n = _held(texts, vocabulary), min(ANCHORS, len(vocabulary.number))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, found = held.value, np.zeros((n, n))
        for batch in slices(batches):
            ids, starts, _ = voc.encode(utf8(batch, "text"))
            doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
            some = (ids >= 0) & (ids < n)
            has = np.zeros((len(starts), n))
            has[doc[some], ids[some]] = 1
            found += has.T @ has
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(found.tobytes(), 1)], pa.binary())], names=["x"])

    add = lambda row: [np.frombuffer(zlib.decompress(row["x"])).reshape(n, n)]
    anchor = group_anchors(_added(texts.select("text").mapInArrow(together, "x binary"), [np.zeros((n, n))], add)[0])

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, head = held.value, len(held.value.number)
        found = np.zeros(head * GROUPS, np.int64)
        for batch in slices(batches):
            ids, starts, _ = voc.encode(utf8(batch, "text"))
            doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
            some = (ids >= 0) & (ids < n)
            votes = np.zeros((len(starts), GROUPS))
            np.add.at(votes, (doc[some], anchor[ids[some]]), 1)
            best = np.where(votes.any(axis=1), votes.argmax(axis=1), -1)[doc]
            some = (ids >= 0) & (ids < head) & (best >= 0)
            found += np.bincount(ids[some] * GROUPS + best[some], minlength=len(found))
        code = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(found[code])], names=["code", "c"])

    found = texts.select("text").mapInArrow(by_group, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))
    found = stash(found.select(F.floor(F.col("code") / GROUPS).alias("word"), (F.col("code") % GROUPS).alias("g"), "c"))
    sizes = {r.g: r.n for r in found.groupBy("g").agg(F.sum("c").alias("n")).collect()}
    share = sum((F.when(F.col("g") == g, F.col("c") / float(n)).otherwise(0.0) for g, n in sorted(sizes.items())), F.lit(0.0))
    rows = found.groupBy("word").agg(F.max(F.struct(share.alias("share"), (-F.col("g")).alias("g"))).alias("x")).select("word", (-F.col("x.g")).cast("int").alias("g")).toPandas()
    discard(found)
    out = np.zeros(len(vocabulary.number), np.int64)  # words that stand in no document of a group go with the first
    out[rows.word.to_numpy(dtype=np.int64)] = rows.g.to_numpy(dtype=np.int64)
    return out


def count_cells(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(kind, code, c): kind 0 counts histories with the group that follows, kind 1 words before with words."""
    held = _held(texts, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = held.value
        width, pending = voc.classes + GROUPS, [[], []]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, codes in enumerate(pending):
                code, c = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_counts=True)
                codes.clear()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), kind, np.int32)), pa.array(code), pa.array(c.astype(np.int64))], names=["kind", "code", "c"])

        size = 0
        for batch in slices(batches):
            ids, starts, _ = voc.encode(utf8(batch, "text"))
            if not len(ids):
                continue
            history, group, before, word = voc.symbols(ids, starts)
            pending[0].append(history * (GROUPS + 2) + group)
            pending[1].append((before * width + word)[word >= 0])
            size += len(ids)
            if size > 10 * FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    return texts.select("text").mapInArrow(run, "kind int, code long, c long").groupBy("kind", "code").agg(F.sum("c").alias("c"))


def train_words(cells: DataFrame, vocabulary: Vocabulary, steps: int = WORD_STEPS) -> Words:
    """Fit the vectors of words on cells (code, c): each step adds up the gradients of tasks that hold parts of them."""
    k = vocabulary.classes
    group_of = np.concatenate([vocabulary.group[:k], np.arange(GROUPS)])
    rest = np.bincount(vocabulary.group[k:], vocabulary.counts[k:], GROUPS)
    words = Words(group_of, np.concatenate([vocabulary.counts[:k], rest]), k + GROUPS + 2)
    width, n = k + GROUPS, cells.count()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            code.append(batch.column("code").to_numpy())
            c.append(batch.column("c").to_numpy())
        order = np.argsort(np.concatenate(code))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(x)[order].tobytes()], pa.binary()) for x in (code, c)], names=["code", "c"])

    packed = stash(cells.repartition(F.floor(F.col("code") / width)).coalesce(max(8, n // CELLS)).mapInArrow(pack, "code binary, c binary"))
    memory: list = [None] * 3
    start = [np.zeros_like(words.near), np.zeros_like(words.target), words.bias.copy()]
    for t in range(1, steps + 1 if n else 1):
        held = _held(packed, words)

        def one(row, held=held) -> list[np.ndarray]:
            code = np.frombuffer(row["code"], np.int64)
            return held.value.gradient(code // width, code % width, np.frombuffer(row["c"], np.int64).astype(float))

        grads = _added(packed, [np.zeros_like(x) for x in words.parts()], one)
        held.unpersist()
        scale = max(1.0, float(vocabulary.counts.sum()))
        _adam(words.parts(), [(g - PRIOR * (x - y)) / scale for g, x, y in zip(grads, words.parts(), start, strict=True)], memory, t, STEP)
    discard(packed)
    return words


class Scores:
    """Log10 probabilities of tokens."""

    def __init__(self, vocabulary: Vocabulary, groups: np.ndarray, words: Words):
        self.groups, self.words, self.norms = groups, words, words.log_norms()
        k = vocabulary.classes
        tokens = np.bincount(vocabulary.group[k:], vocabulary.counts[k:], GROUPS)
        self.rest = np.log10(np.maximum(tokens + np.bincount(vocabulary.group[k:], minlength=GROUPS), 1))  # of each group

    def log10(self, voc: Vocabulary, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each token; words outside the head still lack their own count."""
        history, group, before, word = voc.symbols(ids, starts)
        out = self.groups[history, group] / np.log(10)
        some = word >= 0
        v, w, g = before[some], word[some], group[some]
        m = self.words
        s = np.einsum("ij,ij->i", m.near[v], m.target[w]) + m.bias[w] - self.norms[v, g]
        out[some] += s / np.log(10) + np.where(w >= voc.classes, voc.log_c[ids[some]] - self.rest[g], 0.0)
        return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: DataFrame | None = None, head: int = HEAD, classes: int | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    Scores are log10 probabilities of the whole text with its end: add-one unigrams, and the neural model (see above). train: rows
    with the same columns to learn from; by default the documents that are not held out. Null counts as empty: one
    token, the end. Repeated rows give repeated results and count repeatedly; an empty table gives none; with nothing
    to learn from all words are unknown. Columns besides the two are not read.
    """
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = pick(docs)
    learn = rows.where(~held_out()) if train is None else pick(train)
    counts = stash(count_words(learn))
    ends = learn.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = total.n + ends, total.v + (ends > 0)
    # words seen once stay outside the head, so that the model learns how often an unknown word comes
    top = counts.where("c > 1").orderBy(F.desc("c"), "word").limit(head).toPandas().sort_values(["c", "word"], ascending=[False, True])
    classes = int(CLASS_RATE * np.sqrt(max(1, total.v))) if classes is None else classes
    vocabulary = Vocabulary([bytes(w) for w in top.word], top.c.to_numpy(dtype=np.int64), ends, tokens, distinct, classes)
    if len(vocabulary.number):
        vocabulary.group = find_groups(learn, vocabulary)
    cells = stash(count_cells(learn, vocabulary))
    histories = cells.where("kind = 0").toPandas()  # a fixed number at most
    groups = train_groups(histories.code.to_numpy(dtype=np.int64), histories.c.to_numpy(dtype=float))
    words = train_words(cells.where("kind = 1").select("code", "c"), vocabulary)
    discard(cells)
    held = _held(rows, (vocabulary, groups, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, groups, words = held.value
        probability = Scores(voc, groups, words)
        for batch in slices(batches):
            ids, starts, rest = voc.encode(utf8(batch, "text"))
            log_c = np.where(ids >= 0, voc.log_c[ids], 0.0)
            each = [(ids >= 0) & voc.known[ids], log_c, probability.log10(voc, ids, starts), ids < 0]
            sums = [np.add.reduceat(x.astype(float), starts) if len(starts) else np.zeros(0) for x in each]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(np.append(starts, len(ids)))), *(pa.array(x) for x in sums), pa.array([list(c) for c in rest], pa.list_(pa.binary())), pa.array([list(c.values()) for c in rest], pa.list_(pa.int64()))],
                names=["id", "n_tokens", "known", "log_c", "neural", "others", "words", "times"],
            )

    found = rows.mapInArrow(run, "id long, n_tokens long, known double, log_c double, neural double, others double, words array<binary>, times array<long>")
    found = stash(found.withColumn("row", F.monotonically_increasing_id()))
    tail = found.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    seen = tail.join(counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("times").alias("more_known"))
    out = found.drop("words", "times").join(seen, "row", "left")
    base = F.col("log_c") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(tokens + distinct + 1))
    score = F.col("neural") + F.coalesce("more", F.lit(0.0)) - F.col("others") * float(np.log10(vocabulary.rest_tokens + vocabulary.rest_distinct + 1))
    known = (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long")
    return out.select("id", held_out().alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
