"""License notices: exact phrases, and short notices with a bounded number of edits."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, slices, utf8

# Phrases (as words) and their labels that count wherever the words stand consecutively.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Short notices (as words), their labels, and the edits allowed in them, counted in characters. Names of licenses and
#: version numbers are marked with a star: they have to stand there as they are, as words of their own.
NOTICES = (
    ("released under the *mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("licensed under the *apache license version *2 0", "apache-2", 3),
    ("*gnu *general public license version *3", "gpl-3", 3),
    ("*gnu *general public license version *2", "gpl-2", 3),
    ("*gnu *lesser general public license", "lgpl", 3),
    ("*gnu *affero general public license", "agpl", 3),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("*mozilla public license version *2 0", "mpl-2", 3),
    ("*eclipse public license", "epl", 2),
    ("creative commons attribution *noncommercial", "cc-by-nc", 3),
    ("creative commons attribution *sharealike", "cc-by-sa", 3),
    ("licensed under *cc *by *nc *4 *0", "cc-by-nc", 2),
    ("licensed under *cc *by *sa *4 *0", "cc-by-sa", 2),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5),
    ("*all *rights reserved", "all-rights-reserved", 1),
)


def parts_of(notice: str) -> list[tuple[str, bool]]:
    """(text, may be edited) of a notice from its first to its last character. Spaces next to a starred word belong to
    it, so that an edit cannot make it a part of another word."""
    out: list[tuple[str, bool]] = []
    for n, w in enumerate(notice.split()):
        fixed = w.startswith("*")
        w = w.removeprefix("*")
        if n and out[-1][1] == (not fixed):
            out[-1] = (f"{out[-1][0]} {w}", not fixed)
        elif not n:
            out.append((w, not fixed))
        elif fixed:
            out.append((f" {w}", False))
        else:
            out[-1] = (f"{out[-1][0]} ", False)
            out.append((w, True))
    return out


def seeds(phrase: str, edits: int) -> list[tuple[str, int]]:
    """The phrase in edits + 1 pieces: an occurrence with that many edits holds one of them unchanged."""
    cuts = [round(i * len(phrase) / (edits + 1)) for i in range(edits + 2)]
    return [(phrase[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, base=BASE, notices=NOTICES):
        self.base = [(f" {p} ", label) for p, label in base]
        self.notices = [(p.replace("*", ""), label, k) for p, label, k in notices]
        loose = lambda text, k: f"(?:{regex.escape(text)}){{e<={k}}}"
        self.patterns = [regex.compile("(?b)(?<= )" + "".join(loose(text, k) if free else regex.escape(text) for text, free in parts_of(p)) + "(?= )") for p, _, k in notices]
        by: dict[str, list[tuple[int, int]]] = {}
        for n, (p, _, k) in enumerate(self.notices):
            for piece, at in seeds(p, k):
                by.setdefault(piece, []).append((n, at))
        self.machine = ahocorasick.Automaton()
        for piece, where in by.items():
            self.machine.add_word(piece, (len(piece), where))
        self.machine.make_automaton()

    def exact(self, text: str) -> list[tuple[int, str]]:
        """(word, label) of each place where a base phrase's words stand; text is padded with a space on each side."""
        places = []
        for phrase, label in self.base:
            at = text.find(phrase)
            while at >= 0:
                places.append((at, label))
                at = text.find(phrase, at + 1)
        found, word, before = [], 0, 0
        for at, label in sorted(places):  # spaces are counted once over the text
            word += text.count(" ", before, at)
            before = at
            found.append((word, label))
        return found

    def fuzzy(self, text: str) -> list[dict]:
        """Verified notices in order: label, first and last character and word of the padded text without its first
        space, edits, score. Windows around seeds that overlap are one."""
        windows: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.machine.iter(text):
            for n, at in where:
                phrase, _, k = self.notices[n]
                low = end - length - at - k
                spans = windows.setdefault(n, [])
                high = low + len(phrase) + 2 * k + 2
                if spans and low <= spans[-1][1] and low >= spans[-1][0]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([max(0, low), high])
        found = []
        for n, spans in windows.items():
            phrase, label, most = self.notices[n]
            for low, high in merged(spans):
                for m in self.patterns[n].finditer(text, low, min(high, len(text))):
                    if (edits := sum(m.fuzzy_counts)) <= most:
                        found.append({"first": m.start() - 1, "last": m.end() - 2, "label": label, "edits": edits, "score": 1 - edits / len(phrase)})
        found.sort(key=lambda x: (x["first"], x["last"], x["label"]))
        word = before = 0
        for x in found:
            word += text.count(" ", before, x["first"] + 1)
            before = x["first"] + 1
            x["first_word"] = word - 1
            x["last_word"] = word - 1 + text.count(" ", before, x["last"] + 1)
        return found


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


SPAN = "struct<label: string, first: int, last: int, first_word: int, last_word: int, edits: int, score: double>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """(id, n_words, places, notices), one row per document.

    Text is lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. places: word index and
    label of each base phrase. notices: label, span in the space-joined words (characters and words), edits and score
    of each fuzzy match. Null counts as empty: no words, no places. Repeated rows give repeated results, an empty
    table none; columns besides the two are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("edits", pa.int32()), ("score", pa.float64())]))
        for batch in slices(batches):
            n, places, notes = [], [], []
            for t in utf8(batch, "text"):
                words = alnum_words(t)
                text = f" {b' '.join(words).decode()} "
                n.append(len(words))
                places.append([{"word": w, "label": x} for w, x in scanner.exact(text)])
                notes.append(scanner.fuzzy(text))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(places, place), pa.array(notes, span)], names=["id", "n_words", "places", "notices"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, n_words long, places array<struct<word: long, label: string>>, notices array<{SPAN}>")


def license_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score); see scan_licenses."""
    found = scan_licenses(docs, id_col, text_col)
    words, own = F.col("places.word"), F.array_sort(F.array_distinct(F.col("places.label")))
    every = F.array_sort(F.array_union(F.col("places.label"), F.col("notices.label")))
    best = F.when(F.size("places") > 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.col("notices.score")), F.lit(0.0))))
    return found.select(F.col("id").alias(id_col), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"), F.array_join(own, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), best.alias("score"))
