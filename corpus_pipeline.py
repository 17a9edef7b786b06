"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. All but the last
return the columns of documents. A stage's result has to be written before the next stage is called, which deletes the
scratch tables behind it. All stages take empty tables and give none then; columns of docs besides those of documents
are dropped, so clashing names do no harm; what nulls, ties and repeated rows do is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import bpe, decontaminate, language, lines, similar
from quillmark.llm.common import discard, stage, stash, sweep, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: no letter, or a posterior under language.MIN_SCORE.

    Null and empty texts go; null ids, languages and sources stay; repeated rows are judged alike; a tie between two
    languages leaves each at half, which is MIN_SCORE and stays. Without a labelled row nothing can be told and all go.
    """
    found = language.predict_languages(docs, docs.select("text", "lang"), keep=COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= language.MIN_SCORE)).select(*COLUMNS)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages but for their first place; drops documents of which nothing but white space is left.

    Null texts stay as they are. Repeated rows of one id and text are one document and keep the same lines; different
    texts of one id lose only their own. Null ids come before all others.
    """
    cleaned = lines.dedup_lines(docs.select(*COLUMNS)).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of smallest id, then MD5 of its text.

    Linked are documents whose SimHash fingerprints differ in two bits or fewer, by the keys and midpoints of operator 1,
    and, since such fingerprints cannot promise to find copies that are cut short or carried on, also all documents of
    five-word similarity 0.8 or more.

    Of rows that repeat an id with the same text one stays; different texts of one id are judged each on their own.
    Null and wordless texts are one group. Rows whose id is null stay.
    """
    found = similar.similar_components(docs, prints=True)
    judged = stash(found.where("not kept or copies > 1").select(F.col("id").alias("__id"), F.col("text_key").alias("__key"), "kept"))
    rows = docs.select(*COLUMNS)
    own = (F.col("doc_id") == F.col("__id")) & (F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))) == F.col("__key"))
    out = rows.join(judged, own, "left_anti")
    repeated = judged.where("kept")
    if not repeated.isEmpty():
        out = out.unionAll(rows.join(repeated, own).dropDuplicates(["doc_id", "__key"]).select(*COLUMNS))
    return out


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item.

    A document is dropped with all rows of its id; null ids count as one document. Null texts hold nothing and stay; so
    does all where the benchmark is empty.
    """
    hits = decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    gone = hits.where("n_hit > 0").select("id").distinct()
    return docs.select(*COLUMNS).join(gone, docs["doc_id"].eqNullSafe(gone["id"]), "left_anti")


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256): ids as little-endian unsigned 32-bit integers.

    One row per row of docs, repeated or not; a null text counts as empty and has no ids; null ids stay null.
    """
    coded = bpe.round_trip(docs, keep=("lang", "source"))
    return coded.select(F.col("id").alias("doc_id"), "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("byte_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written before the next one starts, and deleted after it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        before, docs = docs, step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
            sweep(spark)
            discard(before)
    return docs
