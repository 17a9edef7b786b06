import random
from collections import Counter
from hashlib import md5

from pyspark.sql import functions as F

from quillmark.llm import lines


def brute(rows):
    """Kept texts by id; rows of one id and text are one document. Written apart from the operator: over all windows of
    all documents that hold a repeated chunk, in the order of places."""
    own = lambda i, t: (i is not None, i or 0, md5(t.encode()).hexdigest())
    docs = {own(i, t): t.encode() for i, t in rows if t is not None}
    count = {}
    for d, t in docs.items():
        for pos, body in lines.seeds(t):
            count.setdefault(body, set()).add((d, pos))
    first, found = {}, []
    for d, t in sorted(docs.items()):
        ls = t.split(b"\n")
        bounds = lines.chunk_bounds(ls)
        near = set()
        for pos, body in lines.seeds(t):
            if len(count[body]) > 1:
                for a, b in bounds[max(0, pos - 1) : pos + 2]:
                    near |= set(range(a, b))
        for i in sorted(near):
            for n in (1, 2):
                if n == 1 and len(ls[i].split()) >= 50 or n == 2 and i + 1 in near:
                    body = b"\n".join(ls[i : i + n])
                    place = (d, i, n)
                    first.setdefault(body, place)
                    found.append((place, body))
    repeated = {}
    for place, body in found:
        repeated.setdefault(body, []).append(place)
    gone, kept = {}, {}
    for body, places in repeated.items():
        if len(places) > 1:
            d, i, n = first[body]
            kept.setdefault(d, set()).update(range(i, i + n))
    for d, t in docs.items():
        ls = t.split(b"\n")
        again = {i: first[body] for (e, i, n), body in found if e == d and n == 2 and first[body] != (d, i, 2)}
        i = 0
        while i < len(ls):
            j = i
            while j in again and (j == i or again[j][0] == again[j - 1][0] and again[j][1] == again[j - 1][1] + 1):
                j += 1
            if j > i and sum(len(x.split()) for x in ls[i : j + 1]) >= 20:
                gone.setdefault(d, set()).update(range(i, j + 1))
            i = max(j, i + 1)
        for (e, i, n), body in found:
            if e == d and n == 1 and first[body] != (d, i, 1):
                gone.setdefault(d, set()).add(i)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        d = own(i, t)
        ls = t.encode().split(b"\n")
        left = [x for k, x in enumerate(ls) if k not in gone.get(d, set()) - kept.get(d, set())]
        out.append((i, b"\n".join(left).decode(), len(ls), len(ls) - len(left)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    pool = [f"line {k} of the pool" for k in range(12)] + ["", " ".join(f"w{i}" for i in range(60))]
    passage = "\n".join(f"shared line {k}" for k in range(9))
    rows = [(k, "\n".join([*rng.choices(pool, k=rng.randint(1, 6)), *([passage] if k % 3 == 0 else []), f"own {k}"])) for k in range(60)]
    rows += [(100, None), (101, ""), (None, rows[0][1]), (5, rows[5][1]), (102, "x\n" * 20000 + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_removed", F.lit("clash")).withColumn("pos", F.lit(1)).repartition(3)
    got = lines.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "pos", "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str) == brute(rows)
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_boundaries_do_not_shift():
    rng = random.Random(4)
    body = [f"l{rng.random()}".encode() for _ in range(200)]
    whole = {tuple(body[a:b]) for a, b in lines.chunk_bounds(body)}
    moved = [b"new", *body]
    again = {tuple(moved[a:b]) for a, b in lines.chunk_bounds(moved)}
    assert len(whole - again) <= 2


def test_shared_passage_leaves_all_but_one(spark):
    passage = "\n".join(f"the shared passage line {k} has words" for k in range(12))
    docs = spark.createDataFrame([(k, f"start {k} a\n{passage}\nend {k}") for k in range(50)], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert got[0].n_removed == 0 and all(got[k].n_removed >= 6 for k in range(1, 50))
    assert all(f"start {k}" in got[k].text and f"end {k}" in got[k].text for k in got)


def test_rows_that_share_an_id_lose_only_their_own_chunks(spark):
    shared = "\n".join(f"the shared passage line {k} has words" for k in range(12))
    rows = [(0, f"start a\n{shared}\nend a")]
    rows += [(i, f"start {i} {k}\n{shared if k % 2 else other}\nend {i} {k}") for i in (7, 8) for k in range(4) for other in ["\n".join(f"own line {j} of {i} and {k}" for j in range(12))]]
    # ids that are null come first: the passage stays in the null row that has it earliest
    rows += [(None, f"null {k}\n" + "\n".join(f"own line {j} of null {k}" for j in range(12))) for k in range(3)] + [(None, "x\n" * 3 + shared), (None, "y\n" * 40 + shared)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=str) == brute(rows)
    lost = [r.text for r in got if "own line" in r.text and r.n_removed]
    assert not lost and any(r.n_removed for r in got if r.doc_id in (7, 8))


def test_blank_lines_are_no_passage_and_rows_of_one_id_are_documents(spark):
    shared = "\n".join(f"the shared passage line {k} has words" for k in range(12))
    rows = [(1, "\n\n\n\nhello"), (2, "\n\n\n\nworld\n\n\n\n"), (3, shared), (3, f"{shared}\nend"), (4, "x")]
    got = {r.text: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got["\n\n\n\nhello"] == 0 and got["\n\n\n\nworld\n\n\n\n"] == 0
    assert sum(len(t.split("\n")) for t in got) < sum(len(t.split("\n")) for _, t in rows) - 6  # one of the two rows of id 3 lost it


def test_share_of_short_passages_that_is_removed(spark):
    """Against runs of lines, not chunks: all words of the second place of each repeated passage should go."""
    rng = random.Random(6)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, words, kind = [], {}, {}
    shapes = [(2, 30), (3, 20), (4, 15), (5, 12), (8, 7), (12, 5)]  # lines, words of each
    for g in range(240):
        size, n = kind[g] = shapes[g % 6]
        passage = "\n".join(line(n) for _ in range(size))
        rows += [(2 * g + k, f"{line(8)}\n{line(9)}\n{passage}\n{line(8)}") for k in range(2)]
        words[g] = len(passage.split())
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * g] == rows[2 * g][1] for g in words)
    for shape, least in zip(shapes, (1, 1, 1, 1, 0.9, 0.9), strict=True):
        some = [g for g in words if kind[g] == shape]
        share = sum(len(rows[2 * g + 1][1].split()) - len(got[2 * g + 1].split()) for g in some) / sum(words[g] for g in some)
        print("lines and words of a line", shape, "share of words removed", round(share, 2))
        assert share >= least


def test_overlapping_passages_stay_at_one_place(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(12)) for x in "abc")
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\n{b}\n{c}"), (3, f"{b}\n{c}")]
    run = lambda rows: {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert run(rows) == {1: f"{a}\n{b}", 2: f"{b}\n{c}", 3: ""}
    rows = [(4, "\n".join([c, a, c, a, c])), (5, f"{a}\n{c}")]
    got = run(rows)
    assert got[5] == "" and f"{a}\n{c}" in got[4] and f"{c}\n{a}" in got[4]


def test_every_repeated_run_stays_somewhere(spark):
    rng = random.Random(9)
    pool = [" ".join(f"p{k}w{i}" for i in range(14)) for k in range(6)]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randint(2, 6)))) for k in range(80)]
    left = [r.text.split("\n") for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    pairs = lambda texts: Counter((x, y) for t in texts for x, y in zip(t, t[1:], strict=False))
    before = pairs({t: t.split("\n") for _, t in sorted(rows, reverse=True)}.values())
    assert {p for p, n in before.items() if n > 1} <= set(pairs(left))
    assert sum(map(len, left)) < sum(len(t.split("\n")) for _, t in rows) / 2
