"""URL filter: host and path rules first, else a weighted vocabulary counted with Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

# Fixed values: (host, path, verdict). The longest rule that fits decides.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# Terms in the order of the alphabet. A strict term rejects alone: its weight reaches the threshold.
STRICT_TERMS = (
    "bestiality", "bukkake", "camgirl", "camgirls", "casino", "casinos", "cialis", "creampie", "cumshot", "deepthroat", "erotica", "escort",
    "escorts", "gangbang", "hardcore-porn", "hentai", "incest", "jackpot-city", "keygen", "levitra", "malware", "milf", "onlyfans", "phishing",
    "porn", "pornhub", "porno", "pornstar", "redtube", "rolex-replica", "sexcam", "sexcams", "spam", "sportsbook", "threesome", "upskirt",
    "viagra", "warez", "webcamgirls", "xhamster", "xnxx", "xvideos", "xxx", "youporn",
)
#: A soft term says little alone; two different ones reject together.
SOFT_TERMS = (
    "adult", "adults", "amateur", "babes", "baccarat", "betting", "bingo", "blackjack", "blowjob", "bonus", "bonuses", "boobs", "cam", "cams",
    "cheap", "cheats", "coupon", "crack", "cracked", "dating", "discount", "erotic", "fetish", "gamble", "gambling", "gratis", "hookup", "hot",
    "jackpot", "kamagra", "lingerie", "loan", "loans", "lottery", "mature", "naked", "nsfw", "nude", "nudes", "nudity", "online-pharmacy",
    "payday", "pharmacy", "pill", "pills", "poker", "proxy", "replica", "replicas", "roulette", "seo", "serial", "sex", "sexy", "singles",
    "slot", "slots", "strip", "swingers", "teen", "teens", "tits", "torrent", "torrents", "tramadol", "valium", "voyeur", "wager", "winner", "xanax",
)
WEIGHTS = {**{t: 1.0 for t in STRICT_TERMS}, **{t: 0.5 for t in SOFT_TERMS}}
THRESHOLD = 1.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = "://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """Host with A-Z lower-cased; empty for null or where there is no '://'."""
    return F.coalesce(F.translate(F.regexp_extract(url, SPLIT, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """Path up to '?', '#' or the end; empty for null or where there is no '://'."""
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and starts the path; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for at, start, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule, verdict = F.when(fits, at + start).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def build_automaton(weights: dict[str, float]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for term in weights:
        machine.add_word(term, term)
    machine.make_automaton()
    return machine


def distinct_terms(url: str, machine: ahocorasick.Automaton) -> set[str]:
    """Terms in the URL, A-Z lower-cased, that no ASCII letter or digit touches."""
    text = url.translate({65 + i: 97 + i for i in range(26)})
    inside = lambda c: c.isascii() and c.isalnum()
    found = set()
    for end, term in machine.iter(text):
        start = end - len(term)
        if not (start >= 0 and inside(text[start]) or end + 1 < len(text) and inside(text[end + 1])):
            found.add(term)
    return found


def term_scores(df: DataFrame, id_col: str, url_col: str, weights: dict[str, float] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds n_strict and n_soft (distinct terms) and weight to id_col, url_col and the carried columns."""
    weights = WEIGHTS if weights is None else weights
    kept = df.select(id_col, url_col, *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = build_automaton(weights)
        for batch in slices(batches):
            hits = [distinct_terms(u or "", machine) for u in batch.column(url_col).to_pylist()]
            strict = [sum(weights[t] >= THRESHOLD for t in h) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(strict, pa.int32()), pa.array([len(h) - s for h, s in zip(hits, strict, strict=True)], pa.int32()), pa.array([float(sum(weights[t] for t in h)) for h in hits], pa.float64())],
                names=[*batch.schema.names, "n_strict", "n_soft", "weight"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, n_strict int, n_soft int, weight double")


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, n_strict, n_soft, weight), one row per input row.

    A null or empty URL has an empty host and path, no rule and no term, and is allowed; repeated rows and ids give
    repeated results; an empty table gives none. Columns besides the two are not read, so clashing names do no harm.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    scored = term_scores(rows, "id", "url", weights)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    scored = scored.withColumn("host", host).withColumn("path", path).withColumn("rule", rule)
    method = F.when(F.col("weight") >= THRESHOLD, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(verdict, method).alias("verdict"), "n_strict", "n_soft", "weight")


def oracle_sql() -> str:
    """The same in DuckDB: one row per page."""
    terms = ", ".join(f"('{t}', {w})" for t, w in WEIGHTS.items())
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    cases = lambda i: " ".join(f"WHEN {fits(r[0], r[1])} THEN '{(r[0] + r[1], r[2])[i]}'" for r in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    return f"""
WITH terms(term, w) AS (VALUES {terms}),
urls AS (SELECT row_number() OVER () AS n, page_id, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS low,
  coalesce(translate(regexp_extract(url, '{SPLIT}', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '{SPLIT}', 2), '') AS path FROM pages),
hits AS (SELECT n, CAST(sum(CASE WHEN w >= {THRESHOLD} THEN 1 ELSE 0 END) AS INTEGER) AS n_strict,
  CAST(sum(CASE WHEN w < {THRESHOLD} THEN 1 ELSE 0 END) AS INTEGER) AS n_soft, CAST(sum(w) AS DOUBLE) AS weight
  FROM urls JOIN terms ON contains(low, term) AND regexp_matches(low, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY n)
SELECT page_id, host, path, CASE {cases(0)} END AS rule,
  coalesce(CASE {cases(1)} END, CASE WHEN coalesce(weight, 0) >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft, coalesce(weight, 0.0) AS weight
FROM urls LEFT JOIN hits USING (n)"""
