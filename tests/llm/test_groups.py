"""Operators on pairs and repeats against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from conftest import SMALL, rows_equal

from careerloom.llm import near_vectors, ngram_join, suffix_dedup
from careerloom.llm import queries as corpus_queries
from careerloom.llm.common import components


def union(n, pairs):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in pairs:
        up[find(a)] = find(b)
    return [find(k) for k in range(n)]


def least_ids(rows, roots):
    out = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            out[r] = min(out.get(r, i), i)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([3, 30, 120])
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)] + ([(k, k + 1) for k in range(n - 1)] if seed == 3 else [])
    roots = union(n, edges)
    least = {r: min(k for k in range(n) if roots[k] == r) for r in roots}
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {k: least[roots[k]] for e in edges if e[0] != e[1] for k in e}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def brute_join(rows, width, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    lists = collections.defaultdict(list)
    pairs = []
    for k, s in enumerate(sets):
        shared = collections.Counter(j for t in s for j in lists[t])
        pairs += [(k, j) for j, o in shared.items() if 100 * o >= percent * (len(s) + len(sets[j]) - o)]
        for t in s:
            lists[t].append(k)
    roots = union(len(rows), pairs)
    least = least_ids(rows, roots)
    return sorted(((i, len(sets[k]), least.get(roots[k]) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("width", "percent", "group", "short", "listed"), [(4, 85, 1600, 24, 2048), (5, 80, 120, 2, 64)])
def test_ngram_join(spark, monkeypatch, width, percent, group, short, listed):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "LIST", listed)
    rng = random.Random(2)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    source = (rows[1][1].split() * 3)[:150]
    long = [f"w{k}" for k in range(1400)]
    for k in range(400):
        w = list(source if k % 8 else long)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5, 6]) * (1 if k % 8 else 12)):
            w[rng.randrange(len(w))] = rng.choice(["foo", f"bar{k}", f"baz{rng.randrange(20)}"])
        rows.append((5000 + k, " ".join(w)))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "ONE two"), (9005, "one\ttwo"), (None, "one two"), (None, None), rows[0], (rows[3][0], "different text for the same id now"), (9007, "different text for the same id now")]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, node string, n int").repartition(3)
    assert sorted(map(tuple, ngram_join.ngram_join(df, width, percent).collect()), key=str) == brute_join(rows, width, percent)
    kept = ngram_join.keep_one(df, width, percent).collect()
    want = {c for _, n, c in brute_join(rows, width, percent)}
    assert {r.doc_id for r in kept} == want and kept[0].asDict().keys() == {"doc_id", "text", "node", "n"}
    assert len(kept) == len(set(brute_kept(rows, width, percent)))
    assert ngram_join.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_kept(rows, width, percent):
    """Each component once, and each row without words, repeated ones once."""
    named = brute_join([(k, t) for k, (_, t) in enumerate(rows)], width, percent)
    return [(c,) if n else (c, *rows[i]) for i, n, c in named if n or rows[i] not in rows[:i]]


def test_keep_one_of_odd_rows(spark):
    a, b = " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(58))
    rows = [(None, a), (None, b), (None, "x y z"), (7, "x y z"), (3, "p q r"), (3, "other text"), (4, "p q r"), (5, None), (5, None), (None, ""), (None, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3, "n") for r in rows], "doc_id long, text string, named_id int, _row int, text_hash int, own_doc string")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    got = sorted([(r.doc_id, r.text) for r in kept.collect()], key=str)
    near = [r for r in got if r[1] in (a, b)]
    assert len(near) == 1
    assert [r for r in got if r not in near] == sorted([(7, "x y z"), (3, "p q r"), (3, "other text"), (5, None), (None, ""), (None, None)], key=str)


def brute_repeats(rows, length):
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cut = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                cut[k : k + length] = b"\1" * length
        left = bytes(v for v, c in zip(b, cut, strict=True) if not c)
        out.append((i, len(b), sum(cut), sum(1 for k in range(len(b)) if cut[k] and (k == 0 or not cut[k - 1])), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("group", "run", "piece"), [(256, 2048, 1 << 20), (20, 300, 700)])
def test_suffix_dedup(spark, monkeypatch, group, run, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "RUN", run)
    rng = random.Random(1)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(80).collect()]
    passage = next(t for _, t in rows if len(t) > 1500)[:700]
    letters = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(0, 300)))
    rows += [(1000, None), (1001, ""), (1002, "ab" * 900), (1003, "x" * 1000), (1004, "x" * 399), rows[0], (rows[5][0], "other " + passage), (None, "null id " + passage[100:650]), (None, None)]
    rows += [(2000 + k, letters("abcdé ") + passage[rng.randint(0, 200) : rng.randint(400, 700)] + letters("xyzß ")) for k in range(150)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, start int, content string").repartition(3)
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(df).collect()), key=str) == brute_repeats(rows, 400)
    kept = suffix_dedup.suffix_dedup(df, keep=True)
    assert kept.columns == df.columns and kept.where("text is null").count() == 2
    clash = df.selectExpr("doc_id", "text", "1 as ranges", "2 as text_hash", "3 as of_doc", "4 as n_removed", "5 as `row`", "array(6) as kept_text")
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(clash).collect()), key=str) == brute_repeats(rows, 400)
    assert [tuple(r)[2:] for r in suffix_dedup.suffix_dedup(clash, keep=True).distinct().limit(3).collect()] == [(1, 2, 3, 4, 5, [6])] * 3
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array_finds_all_repeats(seed):
    rng = random.Random(seed)
    letters = rng.choice([b"ab", b"abc", bytes(range(256)), b"\x00\xff\xfe"])
    base = bytes(rng.choice(letters) for _ in range(60))
    strings = []
    for _ in range(rng.randint(1, 8)):
        s = bytearray(rng.choice([base, bytes(rng.choice(letters) for _ in range(rng.randint(0, 50))), b"a" * 48]))
        for _ in range(rng.randint(0, 2)):
            if s:
                s[rng.randrange(len(s))] = rng.choice(letters)
        strings.append(bytes(s))
    length = rng.choice([1, 3, 8, 20])
    labels = suffix_dedup.repeated(strings, length)
    flat = np.concatenate(labels)
    count = np.bincount(flat[flat >= 0], minlength=1)
    true = collections.Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    for s, own in zip(strings, labels, strict=True):
        assert [count[x] > 1 for x in own] == [true[s[i : i + length]] > 1 for i in range(len(own))]


def brute_vectors(rows, threshold):
    ok = [k for k, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.array([np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in ok])
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    roots = union(len(ok), zip(*np.nonzero(hit), strict=True))
    least = least_ids([rows[k] for k in ok], roots)
    found = {ok[k]: (int(hit[k].sum()), least.get(roots[k])) for k in range(len(ok))}
    return sorted(((i, *found.get(k, (0, i)), i is not None and i == found.get(k, (0, i))[1]) for k, (i, _) in enumerate(rows)), key=str)


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "GROUP", 100)
    rng = np.random.default_rng(1)
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    c = rng.standard_normal(64)
    rows += [(10000 + k, [float(x) for x in c + 0.12 * rng.standard_normal(64)]) for k in range(200)]
    rows += [(20000 + k, rows[7][1]) for k in range(60)] + [(30000, None), (30001, []), (30002, [0.0] * 64), (30003, [float("nan")] * 64), (None, rows[3][1]), (None, None), (30006, [None] + [1.0] * 63)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, node int").repartition(3)
    assert sorted(map(tuple, near_vectors.near_vectors(df).collect()), key=str) == brute_vectors(rows, 0.95)
    assert near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def two_groups(rng, each, across):
    """Vectors in two dense groups whose cosine is a little over the threshold for pairs across."""
    a, b = np.zeros(64), np.zeros(64)
    a[0], b[0], b[1] = 1, across, np.sqrt(1 - across**2)
    out = []
    for k in range(2 * each):
        x = np.concatenate([np.zeros(2), rng.standard_normal(62)])
        x = x / np.linalg.norm(x)
        out.append((k, [float(c) for c in (a, b)[k // each] + 0.07 * x]))
    return out


def test_links_across_dense_groups(spark, monkeypatch):
    rows = two_groups(np.random.default_rng(3), 150, 0.9576)
    monkeypatch.setattr(near_vectors, "GROUP", 64)
    want = brute_vectors(rows, 0.95)
    assert {r[2] for r in want} == {0} and min(r[1] for r in want) > 150
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, near_vectors.near_vectors(df).collect()), key=str) == want


def test_small_pairs_missed_beside_a_hot_group(spark, monkeypatch):
    rng = np.random.default_rng(4)
    c = rng.standard_normal(64)
    rows = [(k, [float(x) for x in c + 0.05 * rng.standard_normal(64)]) for k in range(120)]
    for k in range(60):
        x = rng.standard_normal(64)
        rows += [(1000 + 2 * k + m, [float(y) for y in x + m * 0.15 * rng.standard_normal(64)]) for m in range(2)]
    hot = {k for k, _ in rows[:120]}
    whole = near_vectors.descend

    def only_hot(nodes, n, threshold, tables, before=None):
        lists = whole(nodes, n, threshold, tables, before)
        return lists.join(nodes.where(nodes.least.isin(*hot)).select(nodes.node.alias("a")), "a", "left_semi")

    monkeypatch.setattr(near_vectors, "descend", only_hot)
    monkeypatch.setattr(near_vectors, "STARTS", 1, raising=False)
    want = brute_vectors(rows, 0.95)
    assert len({r[2] for r in want}) < 80
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, near_vectors.near_vectors(df).collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(corpus_queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = corpus_queries.queries()[name](spark, SMALL)
    rows_equal([tuple(r) for r in df.collect()], df.columns, duck.execute(corpus_queries.oracle_sql()[name]))


def test_audit_ends_where_nothing_links(spark, monkeypatch):
    """No more queries than ``ASKED`` are asked, and a table beyond them is never compared whole."""
    rng = np.random.default_rng(12)
    rows = [(k, [float(x) for x in rng.standard_normal(24)]) for k in range(400)]
    asked = []
    whole = near_vectors._asked
    monkeypatch.setattr(near_vectors, "_asked", lambda nodes, lo, hi: asked.append(hi - lo) or whole(nodes, lo, hi))
    monkeypatch.setattr(near_vectors, "ASKED", 100)
    monkeypatch.setattr(near_vectors, "QUERIES", 30)
    monkeypatch.setattr(near_vectors, "compared", None)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, near_vectors.near_vectors(df).collect()))
    assert got == [(k, 0, k, True) for k in range(400)] and abs(sum(asked) - 0.25) < 1e-9
