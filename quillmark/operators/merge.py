"""Chunks of pages, and double readings of overlapping chunks merged into one row per item."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..functions.labels import parse_label
from ..functions.signals import jaccard, text_tokens
from ..sources.scratch import Dealing, discard, stash
from .matching import ROUNDS_READ
from .validate import substantive

SAME_PLACE, WEAK_PLACE, WEAK_TEXT, SAME_QUESTION, NEAR = 0.5, 0.15, 0.6, 0.7, 0.02


def plan_chunks(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """(document_id, chunk, local_index, page): windows of size pages, each starting size - overlap after the last."""
    if overlap >= size:
        raise ValueError("chunks must overlap by less than their size")
    stride = size - overlap
    one = Window.partitionBy("document_id")
    at = pages.withColumn("i", F.row_number().over(one.orderBy("page")) - 1).withColumn("n", F.count("*").over(one))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / stride)).cast("int")
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / stride)).cast("int")
    rows = at.select("document_id", "page", "i", F.explode(F.sequence(first, F.least(last, F.floor(F.col("i") / stride).cast("int")))).alias("chunk"))
    return rows.select("document_id", "chunk", (F.col("i") - F.col("chunk") * stride).cast("int").alias("local_index"), "page")


def spanning_violations(pages: DataFrame, chunks: DataFrame, run: int) -> DataFrame:
    """Runs of consecutive pages of a document that no chunk holds whole; none if run <= overlap + 1."""
    one = Window.partitionBy("document_id").orderBy("page")
    runs = pages.withColumn("start", F.lag("page", run - 1).over(one)).where("start is not null").select("document_id", "start", F.col("page").alias("end"))
    held = chunks.groupBy("document_id", "chunk").agg(F.min("page").alias("low"), F.max("page").alias("high"))
    return runs.join(held, [runs.document_id == held.document_id, held.low <= runs.start, held.high >= runs.end], "left_anti")


def to_absolute_pages(readings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk-local page numbers to pages of the document; a reading with any unknown page is dropped whole."""
    known = chunks.select("document_id", "chunk", F.col("local_index").alias("local_page"), F.col("page").alias("absolute_page"))
    joined = readings.join(known, ["document_id", "chunk", "local_page"], "left")
    good = F.bool_and(F.col("absolute_page").isNotNull()).over(Window.partitionBy("document_id", "chunk", "ordinal"))
    return joined.withColumn("good", good).where("good").drop("good")


def _tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", text_tokens(F.col("text")))


#: Rows of a page from which on its pairs are found by keys of their own instead of by all pairs of the page.
PAGE_ROWS = 256
PAGE = ["assessment_id", "page"]
BOX = ["x", "y", "width", "height"]


def _pages(rows: DataFrame, page_rows: int, pairing: F.Column | None = None, dealt: Dealing | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of small pages, rows of large ones or None if there are none). pairing: aggregate of a page that tells
    whether it can have pairs at all; large pages of which it is not true are in neither."""
    sizes = rows.groupBy(*PAGE).agg(F.count("*").alias("__n"), (F.lit(True) if pairing is None else pairing).alias("__pairing"))
    large = stash(sizes.where(F.col("__n") > page_rows).select(*PAGE, "__pairing"), dealt)
    if large.isEmpty():
        return rows, None
    return rows.join(large, PAGE, "left_anti"), rows.join(large.where("__pairing").select(*PAGE), PAGE, "left_semi")


def _both(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rows of equal keys, of which the first is of an earlier chunk; columns of the second start with b_."""
    other = rows.select(*keys, *(F.col(c).alias(f"b_{c}") for c in rows.columns if c not in keys))
    return rows.join(other, keys).where("chunk < b_chunk")


def in_cells(rows: DataFrame) -> DataFrame:
    """Each rectangle once for each cell of its page's grid that it meets, with __column, __row and the cell's size.

    Cells are as wide and high as the page's rectangles on average, but no more than there are rectangles; so many small
    ones make a fine grid, and on average each meets a few cells.
    """
    extent = F.abs("width"), F.abs("height")
    span = lambda low, size: F.max(F.col(low) + F.col(size)) - F.min(low)
    grid = rows.groupBy(*PAGE).agg(
        F.greatest(F.avg(extent[0]), span("x", "width") / F.sqrt(F.count("*")), F.lit(1e-9)).alias("__cell_width"),
        F.greatest(F.avg(extent[1]), span("y", "height") / F.sqrt(F.count("*")), F.lit(1e-9)).alias("__cell_height"),
    )
    at = lambda edge, cell: F.floor(edge / F.col(cell))
    cells = lambda low, size, cell: F.explode(F.sequence(at(F.col(low), cell), at(F.col(low) + F.greatest(F.col(size), F.lit(0.0)), cell)))
    return rows.join(grid, PAGE).withColumn("__column", cells("x", "width", "__cell_width")).withColumn("__row", cells("y", "height", "__cell_height"))


def _place_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of rectangles of a page that overlap: those that meet in a cell, in the one cell that holds the upper left
    corner of what they share."""
    pairs = _both(in_cells(rows), [*PAGE, "__column", "__row"])
    own = (F.floor(F.greatest("x", "b_x") / F.col("__cell_width")) == F.col("__column")) & (F.floor(F.greatest("y", "b_y") / F.col("__cell_height")) == F.col("__row"))
    overlap = lambda low, size: F.greatest(low, f"b_{low}") < F.least(F.col(low) + F.col(size), F.col(f"b_{low}") + F.col(f"b_{size}"))
    return pairs.where(own & overlap("x", "width") & overlap("y", "height"))


def same_answer_pairs(readings: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """(assessment_id, first, second): readings of different chunks that share a page and a place, or weakly a place and the text.

    readings: one row per region with assessment_id, reading_id, chunk, page, x, y, width, height and the reading's text.
    Pages of up to page_rows regions are compared all with all. On larger ones only rectangles that overlap are, found by
    the cells of a grid, so what is compared grows with what matches and not with the square of the page. Rectangles
    that are null or not finite share no place with any.
    """
    finite = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < 1e9" for c in BOX)
    rows = _tokens(readings).select(*PAGE, "reading_id", "chunk", *BOX, "tokens").where(finite)
    small, large = _pages(rows, page_rows)
    columns = ["assessment_id", "reading_id", "b_reading_id", *BOX, *(f"b_{c}" for c in BOX), "tokens", "b_tokens"]
    pairs = _both(small, PAGE).select(*columns)
    if large is not None:
        pairs = pairs.unionByName(_place_pairs(large).select(*columns))
    place = iou(tuple(F.col(c) for c in BOX), tuple(F.col(f"b_{c}") for c in BOX))
    best = pairs.groupBy("assessment_id", F.col("reading_id").alias("first"), F.col("b_reading_id").alias("second")).agg(F.max(F.round(place, 6)).alias("place"), F.max(F.round(jaccard(F.col("tokens"), F.col("b_tokens")), 6)).alias("likeness"))
    return best.where((F.col("place") >= SAME_PLACE) | (F.col("place") >= WEAK_PLACE) & (F.col("likeness") >= WEAK_TEXT))


def _text_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Pairs of rows of a page, one of them without a key, whose token sets may have a Jaccard similarity of least: they
    share a token among the rarest of each, as many as the set can miss and one. Each such pair once. Sets without tokens
    meet one another.

    A token of a row is shuffled once to be counted on its page and once to be ranked within its row; only those among
    the rarest go on to be joined. Rows without a column key have none.
    """
    open_ = F.col("key").isNull() if "key" in rows.columns else F.lit(True)
    each = rows.select(*PAGE, "reading_id", "chunk", open_.alias("open"), F.size("tokens").alias("__size"), F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    held = each.withColumn("__held", F.count("*").over(Window.partitionBy(*PAGE, "token")))
    rank = F.row_number().over(Window.partitionBy(*PAGE, "reading_id", "chunk").orderBy("__held", "token"))
    heads = held.withColumn("__rank", rank).where(F.col("__rank") <= F.greatest(F.col("__size") - F.ceil(F.col("__size") * F.lit(least)) + 1, F.lit(1))).drop("__rank", "__held")
    met = _both(heads, [*PAGE, "token"]).where(F.col("open") | F.col("b_open")).where(F.least("__size", "b___size") >= F.lit(least) * F.greatest("__size", "b___size"))
    return met.select(*PAGE, "reading_id", "chunk", "b_reading_id", "b_chunk").distinct()


def same_question_pairs(readings: DataFrame, page_rows: int = PAGE_ROWS, dealt: Dealing | None = None) -> DataFrame:
    """(assessment_id, first, second): equal canonical labels if both have one; else the same page and similar text.

    Texts of pages of up to page_rows rows are compared all with all; on larger pages only those that share one of
    their rarest tokens, which all pairs of that similarity do. dealt: how readings are dealt, by assessment; what comes
    back is to be written with it.
    """
    key = F.when(F.length(F.trim(F.coalesce("label_raw", F.lit("")))) > 0, parse_label(F.col("label_raw"))["normalized"])
    # labels and texts are parsed once: what follows reads the rows up to eight times
    rows = stash(_tokens(readings).withColumn("key", key).select("assessment_id", "reading_id", "chunk", "page", "key", "tokens"), dealt)
    by_label = _both(rows.where("key is not null").drop("tokens", "page"), ["assessment_id", "key"])
    # labels have told what they can, so a page pairs by texts only if a row of it has none and chunks differ
    small, large = _pages(rows, page_rows, F.bool_or(F.col("key").isNull()) & (F.min("chunk") < F.max("chunk")), dealt)
    alike = F.round(jaccard(F.col("tokens"), F.col("b_tokens")), 6) >= SAME_QUESTION
    out = lambda df: df.select("assessment_id", F.col("reading_id").alias("first"), F.col("b_reading_id").alias("second"))
    found = out(by_label).unionByName(out(_both(small, PAGE).where("key is null or b_key is null").where(alike)))
    if large is not None:
        own = stash(large.select(*PAGE, "reading_id", "chunk", "key", "tokens"), dealt)
        sets = own.select(*PAGE, "reading_id", "chunk", "tokens")
        met = _text_pairs(own, SAME_QUESTION - 1e-6).join(sets, [*PAGE, "reading_id", "chunk"])
        met = met.join(sets.select(*PAGE, *(F.col(c).alias(f"b_{c}") for c in ("reading_id", "chunk", "tokens"))), [*PAGE, "b_reading_id", "b_chunk"])
        found = found.unionByName(out(met.where(alike)))
    return found.distinct()


def group_readings(readings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(assessment_id, reading_id, group_id): in order of chunk and id a reading joins the first group that has a match
    of it from another chunk, else starts its own. Groups are never joined later.

    A reading without text besides marks of unclear passages (if readings have text) is no duplicate of anything: it
    passes through as a group of its own, so that validation still sees it. Readings without any match need no round.

    In rounds: a reading is settled once all readings of earlier chunks that match it are, since nothing else decides
    its group; of their groups it takes the one whose founder comes first. Rounds are as many as the longest chain of
    matches through the chunks; each is written, and none holds an assessment in one task.
    """
    if "text" in readings.columns:
        real = readings.where(substantive(F.col("text"))).select("assessment_id", "reading_id")
        for end in ("first", "second"):
            pairs = pairs.join(real.select("assessment_id", F.col("reading_id").alias(end)), ["assessment_id", end], "left_semi")
    every = readings.groupBy("assessment_id", "reading_id").agg(F.min("chunk").alias("chunk"))
    place = lambda end: every.select("assessment_id", F.col("reading_id").alias(end), F.struct("chunk", "reading_id").alias(f"at_{end}"))
    links = pairs.select("assessment_id", "first", "second").unionByName(pairs.select("assessment_id", F.col("second").alias("first"), F.col("first").alias("second")))
    links = links.join(place("first"), ["assessment_id", "first"]).join(place("second"), ["assessment_id", "second"]).where("at_first.chunk < at_second.chunk")
    waits = stash(links.select("assessment_id", F.col("second").alias("reading_id"), F.col("first").alias("before")).distinct())
    settled = stash(every.join(waits, ["assessment_id", "reading_id"], "left_anti").select("assessment_id", "reading_id", F.struct("chunk", "reading_id").alias("founder")))
    rounds = [settled]
    while not waits.isEmpty():
        known = reduce(DataFrame.unionByName, rounds)
        asked = waits.join(known.select("assessment_id", F.col("reading_id").alias("before"), "founder"), ["assessment_id", "before"], "left")
        ready = asked.groupBy("assessment_id", "reading_id").agg(F.min("founder").alias("founder"), F.bool_and(F.col("founder").isNotNull()).alias("all"))
        new = stash(ready.where("all").drop("all"))
        after = stash(waits.join(new, ["assessment_id", "reading_id"], "left_anti"))
        discard(waits)
        waits = after
        rounds.append(new)
        if len(rounds) == ROUNDS_READ:
            rounds = [stash(reduce(DataFrame.unionByName, rounds))]
    return reduce(DataFrame.unionByName, rounds).select("assessment_id", "reading_id", F.col("founder.reading_id").alias("group_id"))


def fold_answer_group(members: DataFrame) -> DataFrame:
    """One row per group: the winner has most of its pages in its own chunk (n_seen), then most pages, then the longest
    text, then the lowest chunk; the label is the winner's, else the first there is. members: group columns with chunk,
    n_seen, n_pages, text, label_raw."""
    best = F.struct(F.col("n_seen"), F.col("n_pages"), F.length(F.trim("text")).alias("l"), (-F.col("chunk")).alias("c"), (-F.col("reading_id")).alias("i"))
    label = F.min_by("label_raw", F.when(F.col("label_raw").isNotNull(), F.struct("chunk", "reading_id")))
    out = members.groupBy("assessment_id", "group_id").agg(F.max_by(F.struct("reading_id", "text", "label_raw"), best).alias("w"), label.alias("l"), F.count("*").alias("n_readings"))
    return out.select("assessment_id", "group_id", F.col("w.reading_id").alias("winner"), F.col("w.text").alias("text"), F.coalesce("w.label_raw", "l").alias("label_raw"), "n_readings")


def fold_question_group(members: DataFrame) -> DataFrame:
    """One row per group: the longest text, then the lowest chunk wins; first marks there are, lowest page."""
    best = F.struct(F.length("text").alias("l"), (-F.col("chunk")).alias("c"), (-F.col("reading_id")).alias("i"))
    marks = F.min_by("marks", F.when(F.col("marks").isNotNull(), F.struct("chunk", "reading_id")))
    return members.groupBy("assessment_id", "group_id").agg(F.max_by("text", best).alias("text"), F.max_by("label_raw", best).alias("label_raw"), marks.alias("marks"), F.min("page").alias("page"))


def dedupe_regions(regions: F.Column, questions: bool = False) -> F.Column:
    """Regions in order without those that repeat an earlier one of the same page: by overlap for answers, by corner
    for questions; then by page, top and left. regions: array of struct(page, y, x, width, height)."""
    four = lambda r: (r["x"], r["y"], r["width"], r["height"])
    if questions:
        same = lambda a, b: (F.abs(a["x"] - b["x"]) < NEAR) & (F.abs(a["y"] - b["y"]) < NEAR)
    else:
        same = lambda a, b: iou(four(a), four(b)) >= SAME_PLACE
    none = F.slice(regions, 1, 0)
    kept = F.aggregate(regions, none, lambda acc, r: F.when(F.exists(acc, lambda k: (k["page"] == r["page"]) & same(k, r)), acc).otherwise(F.concat(acc, F.array(r))))
    return F.array_sort(kept)


def extraction_metrics(received: DataFrame, rejected: DataFrame, merged: DataFrame, failed_chunks: DataFrame | None = None, usage: DataFrame | None = None) -> DataFrame:
    """Per assessment: readings received, rejected, merged away, unlabelled, chunks, and whether a chunk is missing.

    usage: (assessment_id, prompt_tokens, response_tokens) of each call that reported them, one row a call; adds their
    sums and total_tokens, null for assessments of which no call did.
    """
    a = received.groupBy("assessment_id").agg(F.count("*").alias("received"), F.countDistinct("chunk").alias("chunks"))
    r = rejected.groupBy("assessment_id").agg(F.count("*").alias("rejected"))
    m = merged.groupBy("assessment_id").agg(F.sum(F.col("n_readings") - 1).alias("merged"), F.count_if(F.col("label_raw").isNull()).alias("unlabelled"))
    out = a.join(r, "assessment_id", "left").join(m, "assessment_id", "left")
    if failed_chunks is not None:
        out = out.join(failed_chunks.groupBy("assessment_id").agg(F.count("*").alias("failed_chunks")), "assessment_id", "left")
    else:
        out = out.withColumn("failed_chunks", F.lit(0).cast("long"))
    out = out.na.fill(0).withColumn("partial", F.col("failed_chunks") > 0)
    if usage is not None:
        told = usage.where("prompt_tokens is not null or response_tokens is not null").na.fill(0, ["prompt_tokens", "response_tokens"])
        sums = told.groupBy("assessment_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("response_tokens").alias("response_tokens"))
        out = out.join(sums.withColumn("total_tokens", F.col("prompt_tokens") + F.col("response_tokens")), "assessment_id", "left")
    return out
