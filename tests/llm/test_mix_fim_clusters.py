"""Source mixing, fill-in-middle and centroid clustering against plain re-statements, and the edge cases of their docstrings."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcweave.llm import centroid_clustering, fill_in_middle, queries, source_mix
from tests.llm.test_operators import CLASHING, prose

SF = "/root/testdata/sf0.001"


# --- 11 mixing sources


def shared(words, weights, limit):
    """Targets by the rule's own words: share, cut, share the excess among those not cut, again and again."""
    goal, cut, pool = [0.0] * len(words), set(), float(sum(words))
    while pool > 1e-9 and len(cut) < len(words):
        left = [k for k in range(len(words)) if k not in cut]
        whole = sum(weights[k % len(weights)] for k in left)
        for k in left:
            goal[k] += pool * weights[k % len(weights)] / whole
        pool = 0.0
        for k in left:
            if goal[k] >= limit * words[k]:
                pool += goal[k] - limit * words[k]
                goal[k] = float(limit * words[k])
                cut.add(k)
    return goal


def test_targets():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice([0, 1, 10, 1000, rng.randrange(5000)]) for _ in range(rng.randrange(1, 9))]
        assert source_mix.targets(words, [5, 2, 1], 3) == pytest.approx(shared(words, [5, 2, 1], 3))
    assert source_mix.targets([], [5, 2, 1], 3) == [] and source_mix.targets([0, 0], [5, 2, 1], 3) == [0, 0]


def mixture(rng):
    rows = [(i, prose(rng, rng.randrange(1, 90)), f"s{i % 4}") for i in range(300)]
    rows += [(400 + i, "copy of one text", "s1") for i in range(150)]
    rows += [(600, prose(rng, 3000), "s2"), (601, None, "s2"), (602, "", "s3"), (603, " \t\n", None), (604, "one\x1cword two words", None), (605, prose(rng, 40), None)]
    rows += [(606, prose(rng, 50), "é"), (607, prose(rng, 30), ""), (608, None, "void"), (None, prose(rng, 20), "s0"), (5, rows[5][1], "s1"), (5, rows[5][1], "s1")]
    return rows


def plain_rates(sizes, goal, limit):
    """The dual by bisection."""
    rate = lambda t: [1.0 if x == 0 else min(limit, math.exp(min(50.0, t * x))) for x in sizes]
    low, high = -60.0, 60.0
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(r * x for r, x in zip(rate(mid), sizes)) < goal else (low, mid)
    return rate(low)


def mixed(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    return source_mix.mix(df.withColumns({k: F.lit(v) for k, v in CLASHING.items() if k not in ("source", "size")}).withColumns({"key": F.lit(1), "rate": F.lit(2)}), [5, 2, 1], 3)


def test_mix(spark):
    rows = mixture(random.Random(5))
    got = mixed(spark, rows).collect()
    assert len(got) == len(rows)
    size = {(i, t, s): len(re.findall(r"[^ \t-\r]+", t or "")) for i, t, s in rows}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, size[i, t, s]) for i, t, s in rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    goals = shared([sum(r.size for r in by[s]) for s in names], [5, 2, 1], 3)
    for s, goal in zip(names, goals):
        mine = by[s]
        assert {r.source_size for r in mine} == {sum(r.size for r in mine)} and mine[0].target == pytest.approx(goal)
        assert all(r.taken == r.size * r.copies <= 3 * r.size and abs(r.copies - r.rate) < 2 for r in mine)
        least = min((r.size for r in mine if r.size and r.rate % 1), default=0)
        assert abs(sum(r.taken for r in mine) - goal) <= max(least, 0.02 * goal), (s, goal)
        if 0 < goal < 3 * mine[0].source_size:
            assert [r.rate for r in mine] == pytest.approx(plain_rates([r.size for r in mine], goal, 3), rel=1e-3, abs=1e-6)


def test_mix_is_the_same_in_each_run(spark):
    rows = mixture(random.Random(6))
    plan = lambda parts: sorted(str(tuple(r)) for r in mixed(spark, random.sample(rows, len(rows)), parts).collect())
    assert plan(2) == plan(7)
    assert mixed(spark, [], 1).count() == 0
    assert [(r.taken, r.target) for r in mixed(spark, [(1, None, "a"), (2, "", None)], 1).collect()] == [(0, 0.0), (0, 0.0)]


def test_parts_of_one_size(spark, monkeypatch):
    """A source of equal sizes over several parts: the copies meet the target but for less than one document."""
    monkeypatch.setattr(source_mix, "PART", 40)
    rows = [(i, "a b c", "hot") for i in range(1000)] + [(2000 + i, "a b c d", "s") for i in range(30)]
    got = mixed(spark, rows).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 2 and all(abs(r.taken - r.target) <= 4 for r in got)


def test_mix_query(spark):
    got = queries.op11_source_mix(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text"), "doc_id").collect()
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len(re.findall(r"[^ \t-\r]+", r.text or "")) and r.taken <= 3 * r["size"]
        by[r.source].append(r)
    names = sorted(by)
    for s, goal in zip(names, shared([sum(r["size"] for r in by[s]) for s in names], [5, 2, 1], 3)):
        assert by[s][0].target == pytest.approx(goal) and abs(sum(r.taken for r in by[s]) - goal) <= max(0.03 * goal, min(r["size"] for r in by[s]))


# --- 12 fill-in-middle


UNITS = {fill_in_middle.LINES: r"[^\n]*\n|[^\n]+", fill_in_middle.CHARACTERS: r"(?s).", fill_in_middle.WORDS: r"[^\t-\r ]+[\t-\r ]*|[\t-\r ]+"}


def texts(rng):
    odd = ["", None, "\n", "\n\n\n", "a", "a\n", "\na", "é\nü\n𝄞", "a<P>b", "x\n<S>\n", "<M>", "<", "<S", "S>\n<P\nM>", "\r\n\r", " ", "a b", "  a  b  ", "x" * 5000, "line\n" * 3000, "𝄞" * 2000 + "\n"]
    return odd + ["".join(rng.choice(["a", "\n", "é", " ", "<", ">", "P", "S", "word ", "𝄞\n"]) for _ in range(rng.randrange(300))) for _ in range(60)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 4096])
@pytest.mark.parametrize("border", list(UNITS))
def test_borders_of_chunks(chunk, border):
    held = [(t or "").encode() for t in texts(random.Random(2))[:40] if len(t or "") < 2500]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in held])])
    found = fill_in_middle.Borders(np.frombuffer(b"".join(held), np.uint8), starts, border, chunk)
    for k, t in enumerate(held):
        units = [u.encode() for u in re.findall(UNITS[border], t.decode())]
        assert found.units()[k] == len(units)
        for rank in {0, 1, len(units) // 2, len(units)} & set(range(len(units) + 1)):
            assert found.place(k, rank) == sum(map(len, units[:rank]))


def plain_cut(doc_id, text, rate=100, share=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < share else (len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate", [100, 60])
def test_fill_in_middle(spark, rate):
    rows = list(enumerate(texts(random.Random(8)))) + [(None, "a\nb\nc"), (3, "\n\n\n"), (3, "\n\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASHING.items()}).withColumns({"n": F.lit(1), "form": F.lit(2), "cut": F.lit(3), "a": F.lit(4)})
    got = fill_in_middle.fill_in_middle(docs, "7:", rate, 50, chunk=16)
    back = got.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in back) == sorted(str((i, *plain_cut(i, t, rate))) for i, t in rows)
    assert sorted(str((r.doc_id, r.back)) for r in back) == sorted(str((i, t or "")) for i, t in rows)
    assert {"psm", "spm", "plain"} == {r.form for r in back}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_query(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {r.doc_id: (plain_cut(r.doc_id, r.text), sha(r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op12_fill_in_middle(spark, SF).collect():
        (n, form, p, m, out), whole = want.pop(r.doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), whole)
    assert not want


# --- 13 centroid clustering


def plain_lloyd(vectors, k, rounds, scale=1024):
    """vectors: (id, components); Lloyd's rounds with Python integers."""
    kept = [(i, [math.floor(scale * x) if abs(x) < 2**53 else int(x) * scale for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    cent = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    best = lambda v: min((far(v, c), j) for j, c in enumerate(cent))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[best(v)[1]].append(v)
        cent = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if groups[j] else c for j, c in enumerate(cent)]
    return [(i, best(v)[1], best(v)[0]) for i, v in kept], cent


@pytest.mark.parametrize("span", [1.0, 3e4, 2e12, 1e290], ids=["float64", "64 bits", "integers", "overflow"])
def test_clustering(spark, monkeypatch, span):
    monkeypatch.setattr(centroid_clustering, "BLOCK", 16)
    rng = random.Random(7)
    vectors = [(i, [rng.choice([-1, 1]) * rng.random() * span for _ in range(64)]) for i in range(60)]
    vectors += [(100 + i, [float(i % 2)] * 64) for i in range(12)] + [(5, vectors[5][1]), (5, vectors[6][1]), (None, vectors[7][1])]
    vectors += [(200, None), (201, []), (202, [0.0] * 63), (203, [0.0] * 65), (204, [math.nan] + [0.0] * 63), (205, [math.inf] + [0.0] * 63), (206, [None] + [0.0] * 63), (207, [-0.0] * 64)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "x": F.lit(2), "cluster": F.lit(3)}).repartition(3)
    found = centroid_clustering.cluster(df, 8, 3)
    rows, cent = plain_lloyd(vectors, 8, 3)
    assert found.centroids == cent and sum(found.counts) == len(rows)
    assert found.inertia == [sum(d for _, j, d in rows if j == k) for k in range(8)]
    got = sorted(str((r.vec_id, r.cluster, r.distance)) for r in found.assigned("vec_id").collect())
    assert got == sorted(str((i, j, d if d < 2**63 else None)) for i, j, d in rows)


def test_few_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64), (3, None)], "vec_id long, embedding array<float>")
    found = centroid_clustering.cluster(df, 8, 2)
    assert found.counts == [2, 0] and found.inertia == [0, 0]  # equal distances go to the smaller number
    none = centroid_clustering.cluster(df.where("vec_id = 3"), 8, 2)
    assert none.centroids == [] and none.assigned("vec_id").count() == 0


def test_distances_are_exact_at_the_bound():
    rng = np.random.default_rng(1)
    for top in (2**22, 2**23 + 1, 2**28, 2**31, 2**40):
        x = rng.integers(-top, top, (50, 64))
        c = [list(map(int, row)) for row in rng.integers(-top, top, (3, 64))]
        want = [[sum((int(a) - b) ** 2 for a, b in zip(row, cent)) for cent in c] for row in x]
        assert centroid_clustering.distances(x, c).tolist() == want
