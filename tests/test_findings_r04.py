"""What the fourth round's review found: disk and time that grow faster than the tables."""

from __future__ import annotations

import numpy as np


def test_blocks_get_few_postings_until_they_need_more(spark, monkeypatch):
    """the best postings as by all pairs, though most postings go to no block but those of candidates that need them."""
    from careerloom.operators import corpus

    rng = np.random.default_rng(3)
    listed = [("a", p, f"s{s}") for p in range(1500) for s in rng.integers(0, 40, 1 + p % 9)]
    held = [("a", c, s) for c in range(600) for s in rng.choice(40, 2 if c % 50 == 0 else 30, replace=False).tolist()]
    counts, own = np.zeros((1500, 40)), np.zeros((600, 40))
    for _, p, s in listed:
        counts[p, int(s[1:])] += 1
    idf = 1 + np.arange(40) / 16
    for _, c, s in held:
        own[c, s] = idf[s]
    score = own @ counts.T
    want = {(c, r + 1): (p, score[c, p]) for c in range(600) for r, p in enumerate(np.lexsort((np.arange(1500), -score[c]))[:10].tolist())}

    sent, real = [], corpus._sent
    monkeypatch.setattr(corpus, "_sent", lambda offers, blocks: (df := real(offers, blocks), sent.append((df.count(), blocks.agg({"blocks": "sum"}).first()[0])))[0])
    monkeypatch.setattr(corpus, "FIRST", 20)
    monkeypatch.setattr(corpus, "ALONE", 50)
    args = (
        spark.createDataFrame(listed, "grp string, posting long, skill string"),
        spark.createDataFrame([(c, g, f"s{s}", 1.0) for g, c, s in held], "cand long, grp string, skill string, weight double"),
        spark.createDataFrame([("a", f"s{s}", float(idf[s])) for s in range(40)], "grp string, skill string, idf double"),
        spark.createDataFrame([("a", p) for p in range(1500)], "grp string, posting long"),
    )
    got = corpus.rank_postings(*args, 10, 6).collect()
    assert {(r.cand, r["rank"]): (r.posting, r.score) for r in got} == want
    assert len(sent) > 1 and sum(n for n, _ in sent) < 1500 * sent[0][1] / 2


def test_ngrams_are_made_twice_whatever_the_folds(spark, monkeypatch):
    """F2: fits and scores of all folds share one table of counts, and come out as those of a fold's own vocabulary."""
    from careerloom.operators import linear, ml

    rng = np.random.default_rng(8)
    words = {"fruit": "apple pear plum sweet ripe".split(), "ship": "sea sail mast port deck".split()}
    rows = [(k, " ".join(rng.choice(words[c] + ["red", f"only{k % 6}"], 9)), c) for k in range(60) for c in [("fruit", "ship")[k % 2]]]
    df = spark.createDataFrame(rows, "id long, text string, category string")
    made, real = [], linear.grams
    monkeypatch.setattr(linear, "grams", lambda *args: (made.append(args[2]), real(*args))[1])
    monkeypatch.setattr(linear, "ROUNDS", 8)
    config = {"logistic-2": (2, 25, 1.0, 1.0, ("logistic",))}
    got = {r.fold: (r.n, r.top1, round(r.gap, 6)) for r in linear.cross_validate(df, "text", "category", "id", 3, config).collect()}
    assert made == [2, 2]
    parts = ml.balanced(ml.stratified(df, "category", "id", 3), "category")
    for k in range(3):
        model = linear.fit(parts.where(f"fold <> {k}").drop("fold"), "text", "category", "id", config)
        scored = [(r.category, r.probabilities["logistic-2"]) for r in model.transform(parts.where(f"fold = {k}"), "text").collect()]
        right = [model.labels[int(np.argmax(p))] == c for c, p in scored]
        bins = {}
        for hit, (_, p) in zip(right, scored, strict=True):
            bins.setdefault(min(int(max(p) * 10), 9), []).append((hit, max(p)))
        gap = sum(abs(sum(h for h, _ in b) - sum(p for _, p in b)) for b in bins.values()) / len(scored)
        assert got[k] == (len(scored), sum(right) / len(right), round(gap, 6))
