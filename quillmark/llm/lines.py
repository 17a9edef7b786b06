"""Line dedup by content-defined chunks of lines, extended line by line.

A hash rolled over each two consecutive lines decides whether a chunk ends there, and a line of some words is a chunk of
its own, so boundaries depend on nearby lines only and an inserted line moves no boundary further on. Chunks are looked
up globally; where one repeats, the lines of it and of the chunks beside it are compared window by window, a window being
two consecutive lines or one of many words. So a passage is found up to its last line, though chunks at its edges are cut
differently in each document.

The first place of a window that repeats is kept in all its lines. Elsewhere windows in a row go, after their bytes have
been compared, if their first places stand in a row as well: what is removed stands whole at one earlier place, and
stays there.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import discard, slices, stash

#: A line ends a chunk once in so many times; the modulus of the rolled hash; words that make a line a chunk of its own.
EVERY, MODULUS, OWN_LINE = 2, 1_000_003, 12
#: Words that make a lone line a passage, and lines in a row; words of a chunk of one line that is looked up.
LONG_LINE, RUN_WORDS, SEED_WORDS = 50, 20, 5


def line_hash(line: bytes) -> int:
    return int.from_bytes(md5(line).digest()[:4], "big")


def chunk_bounds(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first, after last) line of each chunk."""
    out, start, before = [], 0, 0
    for i, line in enumerate(lines):
        h = line_hash(line)
        own = len(line) >= 2 * OWN_LINE - 1 and len(line.split()) >= OWN_LINE
        if own and start < i:
            out.append((start, i))
            start = i
        if own or (31 * before + h) % MODULUS % EVERY == 0:
            out.append((start, i + 1))
            start = i + 1
        before = h
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def seeds(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, bytes) of the chunks that are looked up: of two lines or more that are not blank, or of SEED_WORDS words."""
    lines = text.split(b"\n")
    for pos, (a, b) in enumerate(chunk_bounds(lines)):
        body = b"\n".join(lines[a:b])
        words = len(body.split())
        if words >= SEED_WORDS or words and b - a > 1:
            yield pos, body


def _keys(docs: DataFrame, id_type: str) -> DataFrame:
    names = ["id", "text_key", "pos", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[list] = [[] for _ in names]
            for i, w, t in zip(batch.column("id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for pos, body in seeds(t) if t else ():
                    for column, v in zip(rows, (i, w, pos, md5(body).digest()), strict=True):
                        column.append(v)
            types = (batch.schema.field("id").type, pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    return docs.mapInArrow(run, f"id {id_type}, text_key binary, pos int, key binary")


def _text_key(text: Column) -> Column:
    """128 bits that tell the texts of rows sharing an id apart."""
    return F.unhex(F.md5(text.cast("binary")))


def windows(text: bytes, marks: list[int]) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(line, lines, words of the first, words of the last, bytes) of all windows in and beside the marked chunks.

    A window has two lines, or one of LONG_LINE words or more.
    """
    lines = text.split(b"\n")
    bounds = chunk_bounds(lines)
    near = bytearray(len(lines))
    for pos in marks:
        low, high = bounds[max(0, pos - 1)][0], bounds[min(len(bounds), pos + 2) - 1][1]
        near[low:high] = b"\1" * (high - low)
    words = [len(x.split()) if wanted else 0 for x, wanted in zip(lines, near, strict=True)]
    for i, wanted in enumerate(near):
        if wanted and words[i] >= LONG_LINE:
            yield i, 1, words[i], words[i], lines[i]
        if wanted and i + 1 < len(near) and near[i + 1]:
            yield i, 2, words[i], words[i + 1], lines[i] + b"\n" + lines[i + 1]


WINDOW = ["id", "text_key", "line", "n", "words", "last_words", "key", "body"]


def _windows(marked: DataFrame, id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            rows: list[list] = [[] for _ in WINDOW]
            for i, w, t, marks in zip(batch.column("id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("marks").to_pylist(), strict=True):
                for line, n, first, last, body in windows(t or b"", marks):
                    for column, v in zip(rows, (i, w, line, n, first, last, md5(body).digest(), body), strict=True):
                        column.append(v)
            types = (batch.schema.field("id").type, pa.binary(), *[pa.int32()] * 4, pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=WINDOW)

    return marked.mapInArrow(run, f"id {id_type}, text_key binary, line int, n int, words int, last_words int, key binary, body binary")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, gone, kept): by document that loses lines, arrays of (first, last) line of what repeats an earlier
    place, and of the first places of windows that repeat, which stay."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), _text_key(F.col(text_col).cast("string")).alias("text_key"))
    id_type = rows.schema["id"].dataType.simpleString()
    keys = stash(_keys(rows, id_type))
    place = F.xxhash64("id", "text_key", "pos")  # only tells places apart
    again = keys.groupBy("key").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("key")
    marks = keys.join(again, "key", "left_semi").groupBy("id", "text_key").agg(F.collect_set("pos").alias("marks"))
    marked = rows.join(marks.toDF("marked", "marked_key", "marks"), F.col("id").eqNullSafe(F.col("marked")) & (F.col("text_key") == F.col("marked_key"))).select("id", "text_key", "text", "marks")
    found = stash(_windows(marked, id_type))
    discard(keys)

    # bytes are compared by grouping: a key that stands for different bytes would have several groups, and removes nothing
    at = F.struct("id", "text_key", "line", "n")
    bodies = found.groupBy("key", "body").agg(F.min(at).alias("low"), F.max(at).alias("high")).drop("body")
    places = bodies.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("bodies")).where("bodies = 1 and low < high").select("key", "low")
    judged = stash(found.drop("body").distinct().join(places, "key").drop("key").withColumn("first", at == F.col("low")))
    discard(found)
    firsts, copies = judged.where("first"), judged.where("not first")

    doc = Window.partitionBy("id", "text_key").orderBy("line")
    low = lambda c: F.col(f"low.{c}")
    follows = (F.lag("line").over(doc) == F.col("line") - 1) & (F.lag(low("line")).over(doc) == low("line") - 1) & F.lag(low("id")).over(doc).eqNullSafe(low("id")) & (F.lag(low("text_key")).over(doc) == low("text_key"))
    pairs = copies.where("n = 2").withColumn("starts", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("starts").over(doc))
    runs = pairs.groupBy("id", "text_key", "run").agg(F.min("line").alias("first"), (F.max("line") + 1).alias("last"), (F.sum("words") + F.max_by("last_words", "line")).alias("words")).where(F.col("words") >= RUN_WORDS)
    gone = runs.select("id", "text_key", "first", "last").unionAll(copies.where("n = 1").select("id", "text_key", "line", "line"))
    told = lambda df, name: df.groupBy("id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias(name))
    stays = told(firsts.select("id", "text_key", F.col("line").alias("first"), (F.col("line") + F.col("n") - 1).alias("last")), "kept").toDF("kept_id", "kept_key", "kept")
    lost = told(gone, "gone")
    return lost.join(stays, lost["id"].eqNullSafe(stays["kept_id"]) & (lost["text_key"] == stays["kept_key"]), "left").select("id", "text_key", "gone", "kept")


def lines_left(lines: list[bytes], gone: list[tuple[int, int]], kept: list[tuple[int, int]]) -> list[bytes]:
    """The lines without those of gone (first, last) that are not in kept."""
    mark = bytearray(len(lines))
    for spans, value in ((gone, 1), (kept, 0)):
        for first, last in spans:
            mark[first : last + 1] = bytes([value]) * (last + 1 - first)
    return [x for x, m in zip(lines, mark, strict=True) if not m]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text column cleaned, and n_lines and n_removed added (existing columns of these names go).

    The first place is that of the smallest id (nulls before all), then MD5 of the text, then the earliest line. Of
    passages that overlap, each window of two lines stays at its own first place, so documents A B, A B C and B C become
    A B, B C and nothing. Lines in a row of fewer than RUN_WORDS words stay, as do lone lines of fewer than LONG_LINE. Rows
    that repeat an id with the same text are one document and get the same result; rows with different texts are
    documents of their own. A null text stays null, with no lines; an empty
    text is one empty line. Text left without any line is empty. An empty table gives an empty one.
    """
    gone = repeated_lines(docs, id_col, text_col).toDF("__id", "__key", "__gone", "__kept")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (_text_key(F.col(f"`{text_col}`").cast("string")) == F.col("__key"))
    joined = docs.select(*kept).join(gone, same, "left")

    @pandas_udf("text string, n int")
    def without(texts: pd.Series, lost: pd.Series, firsts: pd.Series) -> pd.DataFrame:
        out = []
        spans = lambda x: [(r["first"], r["last"]) for r in x] if x is not None else []
        for t, gone, kept in zip(texts, lost, firsts, strict=True):
            if t is None or gone is None:
                out.append((None, 0))
                continue
            lines = t.encode().split(b"\n")
            left = lines_left(lines, spans(gone), spans(kept))
            out.append((b"\n".join(left).decode(), len(lines) - len(left)))
        return pd.DataFrame(out, columns=["text", "n"])

    without = without.asNondeterministic()  # else a filter on the result runs it twice
    # only texts that lose lines go through Python and back
    text = F.col(f"`{text_col}`")
    cut = joined.withColumn("__cut", without(F.when(F.col("__gone").isNotNull(), text), F.col("__gone"), F.col("__kept")))
    whole = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    columns = [F.coalesce(F.when(F.col("__gone").isNotNull(), F.col("__cut.text")), text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return cut.select(*columns, whole.cast("int").alias("n_lines"), F.when(F.col("__gone").isNotNull(), F.col("__cut.n")).otherwise(0).alias("n_removed"))


def oracle_sql() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, md5(text) AS text_key, text FROM documents),
l AS (SELECT rn, doc_id, text_key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {OWN_LINE} AS own FROM l),
b AS (SELECT *, (31 * lag(h, 1, 0) OVER (PARTITION BY rn ORDER BY i) + h) % {MODULUS} % {EVERY} = 0 OR own OR lead(own, 1, false) OVER (PARTITION BY rn ORDER BY i) AS cut FROM h),
c AS (SELECT *, coalesce(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY rn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM b),
k AS (SELECT rn, doc_id, text_key, pos, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n FROM c GROUP BY rn, doc_id, text_key, pos),
w AS (SELECT *, len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) AS words FROM k),
p AS (SELECT rn, doc_id, text_key, pos, body FROM w WHERE words >= {SEED_WORDS} OR words > 0 AND n > 1),
f AS (SELECT body FROM p GROUP BY body HAVING min(row(doc_id, text_key, pos)) < max(row(doc_id, text_key, pos))),
near AS (SELECT DISTINCT rn, unnest(range(CAST(pos AS BIGINT) - 1, CAST(pos AS BIGINT) + 2)) AS pos FROM p SEMI JOIN f USING (body)),
nl AS (SELECT c.rn, doc_id, text_key, i, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM c SEMI JOIN near ON c.rn = near.rn AND c.pos = near.pos),
nx AS (SELECT *, lead(i) OVER q AS next_i, lead(line) OVER q AS next_line, lead(words) OVER q AS next_words FROM nl WINDOW q AS (PARTITION BY rn ORDER BY i)),
v AS (SELECT rn, doc_id, text_key, i, 1 AS n, words, words AS last_words, line AS body FROM nx WHERE words >= {LONG_LINE}
  UNION ALL SELECT rn, doc_id, text_key, i, 2, words, next_words, line || chr(10) || next_line FROM nx WHERE next_i = i + 1),
r AS (SELECT body, min(row(doc_id, text_key, i, n)) AS low FROM v GROUP BY body HAVING min(row(doc_id, text_key, i, n)) < max(row(doc_id, text_key, i, n))),
j AS (SELECT v.*, (r.low)[1] AS low_id, (r.low)[2] AS low_key, (r.low)[3] AS low_i, row(doc_id, text_key, i, n) = r.low AS first FROM v JOIN r USING (body)),
s2 AS (SELECT *, CASE WHEN lag(i) OVER q = i - 1 AND lag(low_i) OVER q = low_i - 1 AND lag(low_id) OVER q IS NOT DISTINCT FROM low_id AND lag(low_key) OVER q = low_key THEN 0 ELSE 1 END AS starts FROM j WHERE NOT first AND n = 2 WINDOW q AS (PARTITION BY rn ORDER BY i)),
s3 AS (SELECT *, sum(starts) OVER (PARTITION BY rn ORDER BY i) AS run FROM s2),
runs AS (SELECT rn, min(i) AS a, max(i) + 1 AS b FROM s3 GROUP BY rn, run HAVING sum(words) + arg_max(last_words, i) >= {RUN_WORDS} UNION ALL SELECT rn, i, i FROM j WHERE NOT first AND n = 1),
g AS (SELECT DISTINCT rn, unnest(range(a, b + 1)) AS i FROM runs EXCEPT SELECT rn, unnest(range(i, i + n)) FROM j WHERE first),
o AS (SELECT c.rn, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY c.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM c LEFT JOIN g ON c.rn = g.rn AND c.i = g.i GROUP BY c.rn)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed, sha256(coalesce(o.text, '')) AS text_sha256
FROM d LEFT JOIN o USING (rn)"""
