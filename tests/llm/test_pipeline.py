import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as cp
from quillmark.llm import bpe, similar

from .test_decontaminate import brute as brute_hits
from .test_lines import brute as brute_lines


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    names = {"en": "the cat and dog of house with some thing here where there", "de": "der hund und die katze von haus mit einem ding hier wo dort"}
    texts = []
    for k in range(60):
        pool = [f"{w}{rng.choice('abcdef')}" for w in names["en" if k % 2 else "de"].split()] + names["en" if k % 2 else "de"].split()
        texts.append("\n".join(" ".join(rng.choice(pool) for _ in range(25)) for _ in range(rng.randint(2, 8))))
    shared = "\n".join(f"shared passage line {k} with words" for k in range(8))
    bench = [" ".join(f"bench{k}x{i}" for i in range(14)) for k in range(3)]
    rows = [(k, t, "en" if k % 2 else "de") for k, t in enumerate(texts)]
    rows += [(100 + k, f"{texts[k]}\n{shared}\nown words {k}", "en" if k % 2 else "de") for k in range(30, 40)]
    rows += [(200 + k, texts[k], "en" if k % 2 else "de") for k in range(3)]  # exact copies
    rows += [(210 + k, texts[k + 5].replace("\n", " ").replace(" the ", " a ", 1), None) for k in range(3)]  # near copies
    rows += [(220 + k, f"the cat and the dog {bench[k]} of the house", "en") for k in range(3)]
    rows += [(300, None, "en"), (301, "", "en"), (302, "12 34 !!", "de"), (5, texts[5], "en")]
    out = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, bench


def test_stages_equal_brute_force(spark, folder):
    path, rows, bench = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    before = sorted((i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t))
    for name, stage in cp.STAGES[:4]:
        docs = cp.stash(stage(spark, docs, path))
        assert docs.columns == list(cp.COLUMNS)
        kept[name] = sorted((r.doc_id, r.text) for r in docs.collect())
    assert kept["language_id"] == before
    assert kept["line_dedup"] == sorted((i, t) for i, t, n, gone in brute_lines(before) if not gone or t.strip())
    sets = {i: set(similar.shingle_set(t.encode(), 5).tolist()) for i, t in kept["line_dedup"]}
    lowest = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    lowest[a] = min(lowest[a], lowest[b])
    exact = [(i, t) for i, t in kept["line_dedup"] if lowest[i] == i]
    assert sorted(set(exact)) == kept["near_dedup"]
    hit = {i for i, _, n, _ in brute_hits(kept["near_dedup"], list(enumerate(bench)), 10) if n}
    assert hit == {220, 221, 222}
    assert kept["decontamination"] == [(i, t) for i, t in kept["near_dedup"] if i not in hit]


def test_run_gives_ids_that_decode_to_the_kept_texts(spark, folder):
    path, rows, _ = folder
    enc = tiktoken.Encoding("m", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_vocabulary()[0]), special_tokens={})
    got = {r.doc_id: enc.decode(np.frombuffer(r.ids, "<u4").tolist()) for r in cp.run(spark, path).collect()}
    texts = {i: t for i, t, _ in rows}
    assert set(range(60)) <= set(got) | {0, 1, 2} and not set(got) & {200, 201, 202, 220, 221, 222, 300, 301, 302}
    assert all(got[k] == texts[k] for k in range(30))


def test_empty_documents(spark, folder, tmp_path):
    path = folder[0]
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
