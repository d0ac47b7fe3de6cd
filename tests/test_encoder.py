"""The encoder against numpy's decomposition, synonym chains against a plain search, merged counts against whole ones."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from careerloom.operators import corpus, encoder, match, ml
from careerloom.sources import tables as S


def matrix(spark, n=40, width=25, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, 6)) @ rng.normal(size=(6, width)) + 0.05 * rng.normal(size=(n, width))
    a[rng.random(a.shape) < 0.4] = 0
    rows = [([int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for r in a]
    return a, spark.createDataFrame(rows, "at array<int>, x array<double>").repartition(3)


def test_singular_values_are_numpy_s(spark, monkeypatch):
    a, rows = matrix(spark)
    monkeypatch.setattr(encoder, "SPREAD", 17)
    values, basis = encoder.decomposed(rows, a.shape[1], 5, extra=10, passes=30, close=1e-10)
    _, want, turned = np.linalg.svd(a)
    assert np.allclose(values, want[:5], rtol=1e-6)
    # the directions are numpy's but for their signs
    assert np.allclose(abs(np.sum(basis * turned[:5].T, 0)), 1, atol=1e-4)


def test_sums_are_cut_into_blocks(spark, monkeypatch):
    from careerloom.operators import sums

    monkeypatch.setattr(sums, "BLOCK", 7)
    part = lambda batch: np.arange(20.0) * batch.num_rows
    assert sums.summed(spark.range(50).repartition(4), 20, part).tolist() == (np.arange(20.0) * 50).tolist()
    assert sums.summed(spark.range(0), 20, part).tolist() == [0.0] * 20


def test_rank_and_empty_rows(spark):
    rows = spark.createDataFrame([([0, 2], [3.0, 4.0]), ([], []), ([0, 2], [6.0, 8.0])], "at array<int>, x array<double>")
    values, basis = encoder.decomposed(rows, 4, 3)
    assert np.allclose(values, [np.sqrt(125), 0, 0]) and np.allclose(abs(basis[:, 0]), [0.6, 0, 0.8, 0]) and not basis[:, 1:].any()


def test_vectors_of_texts_reach_the_functions(spark, monkeypatch):
    rng = random.Random(4)
    sets = {"fruit": "apple pear plum sweet ripe", "ship": "sea sail mast port deck"}
    texts = [(k, " ".join(rng.choices(sets["fruit" if k % 2 else "ship"].split(), k=40))) for k in range(30)]
    docs = spark.createDataFrame([*texts, (98, None), (99, "unknown words here")], "doc long, text string").repartition(3)
    model = encoder.fit(docs, "text", size=2)
    got = {r.doc: np.array(r.v) for r in encoder.document_vectors(docs, model, width=50).collect()}
    assert set(got) == {k for k, _ in texts} | {98, 99} and not got[98].any() and not got[99].any()
    # chunks are encoded apart and averaged: by hand from the fitted weights of terms
    vocabulary = model.terms.stages[0].vocabulary
    idf = model.terms.stages[1].getScalingVec().toArray()

    def plain(text):
        v = np.array([text.split().count(t) for t in vocabulary]) * idf
        v = v / (np.linalg.norm(v) or 1) @ model.basis
        return v / (np.linalg.norm(v) or 1)

    for k, text in texts[:6]:
        chunks = [text[i : i + 50] for i in range(0, len(text), 50)]
        assert np.allclose(got[k], np.mean([plain(c) for c in chunks], 0))
    occupations = spark.createDataFrame([(1, "apple pear pear plum"), (2, "sail mast deck"), (3, "sweet apple")], "occ long, text string")
    functions = spark.createDataFrame([(1, "fruit"), (2, "ship"), (3, "unmapped")], "occ long, func string")
    p = {(r.doc, r.func): r.p for r in encoder.embedding_signal(docs, occupations, functions, model).collect()}
    assert all(p[k, "fruit"] > 0.7 if k % 2 else p[k, "ship"] > 0.7 for k, _ in texts) and p[98, "ship"] == p[98, "fruit"] == 0
    # the same when there are more occupations than one matrix holds
    monkeypatch.setattr(match, "QUERIES", 2)
    joined = {(r.doc, r.func): r.p for r in encoder.embedding_signal(docs, occupations, functions, model).collect()}
    assert joined.keys() == p.keys() and all(abs(joined[k] - p[k]) < 1e-9 for k in p)
    # a job title counts twice
    text = "Apple Ripe Picker at Port\nsea sail mast"
    (one,) = encoder.document_vectors(spark.createDataFrame([(1, text)], "doc long, text string"), model).collect()
    assert np.allclose(one.v, (plain(text.lower()) + 2 * plain("apple ripe picker")) / 3)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_are_all_that_can_be_reached(spark, seed):
    rng = random.Random(seed)
    edges = {(f"s{rng.randrange(12)}", f"s{rng.randrange(12)}") for _ in range(14)} | {("s1", "s2"), ("s2", "s1")}
    want = {}
    for alias in {a for _, a in edges}:
        reached, now, steps = {alias: 0}, {alias}, 0
        while now:
            steps += 1
            now = {c for c, a in edges if a in now} - set(reached)
            reached |= dict.fromkeys(now, steps)
        want |= {(c, alias): n for c, n in reached.items() if c != alias}
    df = spark.createDataFrame([*edges, ("s1", None), (None, "s1"), ("s1", "s2")], "canonical string, alias string")
    got = corpus.synonym_chains(df, S.stored)
    assert {(r.canonical, r.alias): r.steps for r in got.collect()} == want and got.count() == len(want)
    held = spark.createDataFrame([(1, "s2"), (1, "s5"), (2, "none"), (3, "s1")], "cand long, skill string")
    out = {(r.cand, r.skill): (r.weight, r.steps) for r in corpus.expand_chains(held, got).collect()}
    own = {(r.cand, r.skill) for r in held.collect()}
    for (cand, skill), (weight, steps) in out.items():
        ways = [want[skill, s] for c, s in own if c == cand and (skill, s) in want]
        assert (weight, steps) == ((1.0, 0) if (cand, skill) in own else (1.5, min(ways)))
    assert {k for k in out} == own | {(cand, c) for cand, s in own for c, a in want if a == s}
    assert corpus.synonym_chains(df.limit(0), S.stored).count() == 0


def test_merged_counts_are_those_of_all_postings(spark):
    rng = random.Random(7)
    listed = {(rng.choice("ab"), p, f"s{rng.randrange(9)}") for p in range(60) for _ in range(rng.randrange(6))}
    grp = {p: "ab"[p % 2] for p in range(60)}
    rows = sorted({(grp[p], p, s) for _, p, s in listed})
    sets = spark.createDataFrame(rows, "grp string, posting long, skill string")
    postings = spark.createDataFrame([(g, p) for p, g in grp.items()], "grp string, posting long")
    sizes = lambda df: df.groupBy("grp").agg(F.count("*").alias("n"))
    batches = [corpus.corpus_counts(sets.where(w), sizes(postings.where(w))) for w in ("posting < 20", "posting between 20 and 21", "posting > 21", "posting > 99")]
    got = corpus.merged_counts(*batches)
    key = lambda df: sorted(map(tuple, df.collect()))
    freq = corpus.document_frequency(sets, sizes(postings))
    assert key(corpus.counted_frequency(got)) == key(freq)
    assert key(corpus.counted_information(got, 2, -9.0)) == key(corpus.pair_information(sets, freq, 2, -9.0))


def test_similar_takes_vectors_of_an_encoder(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "sea sail"), (3, "apple sea")], "doc long, text string")
    model = encoder.fit(docs, "text", size=4, least_df=1)
    known = model.encode(docs, "text", "q").select("doc", "q")
    got = {(r.doc, r.occ): r.score for r in match.similar(known, known.select(F.col("doc").alias("occ"), F.col("q").alias("v"))).collect()}
    assert all(abs(got[k, k] - 1) < 1e-9 for k in (1, 2, 3)) and abs(got[1, 2]) < 1e-9
    assert ml.grams(docs, "text", 1).count() == 3
