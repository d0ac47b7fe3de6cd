"""Extraction, fingerprints, models and the pipeline."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from careerloom.llm import fingerprint, html_text, language_id, quality
from careerloom.llm.common import held_out, table

TENTH = "/root/testdata/sf0.01"


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad">Buy now</div><div id="cookie-notice">We use cookies</div>
    <article><h1>The title &amp; more</h1><p>First   paragraph, which is long enough to be text.<p><b>Second one<br>goes on.
    <p>Short.</p><form><input><p>Subscribe</p></form><aside>Related</aside></article>
    <section class="comments"><article class="comment"><p>Nice post, I really liked reading all of it today!</p></article></section>
    <footer>&copy; 2024</footer></body></html>"""
    assert html_text.main_text(page) == "The title & more\nFirst paragraph, which is long enough to be text.\nSecond one goes on.\nShort."
    assert html_text.main_text("") == "" and html_text.main_text("<nav>a</nav>") == ""
    body = "<div class=menu>" + "<a href=x>m</a> " * 9 + "</div><div id=content>" + "<p>A paragraph of plain words here.</p>" * 5 + "<p>End.</p></div><div class=footer>f</div>"
    assert html_text.main_text(body).split("\n") == ["A paragraph of plain words here."] * 5 + ["End."]
    around = '<div class="header">Site name</div><article class="ad"><p>Buy this very fine thing today, it is cheap.</p></article><form><article><header><h1>T</h1></header>' + "<p>A paragraph of plain words here.</p>" * 3 + "</article></form>"
    assert html_text.main_text(around).split("\n") == ["T"] + ["A paragraph of plain words here."] * 3
    assert html_text.main_text("just text, no tags") == "just text, no tags"


def test_names_inside_articles_are_held_against_the_ratio():
    body = "The long body of the section tells of sails and ports, and of what was bought there."
    parts = {
        f'<section id="navigation"><h2>At sea</h2><p>{body}</p></section>': ["At sea", body],
        f'<div class="share-prices"><p>{body}</p></div>': [body],
        f'<section class="related"><p>{body}</p></section>': [body],
        '<section class="related"><h3>Related</h3><ul><li><a href="/a">One other text of many words</a></li><li><a>Two other texts</a></li></ul></section>': [],
        f'<div class="related"><a href="/x">{body}</a> by Ann</div>': [],
        f'<div class="share"><a>Tweet</a></div><div class="menu">Home</div><div class="ad">{body}</div><div class="newsletter box">{body}</div>': [],
    }
    for part, kept in parts.items():
        page = f"<nav><a>Home</a></nav><article><h1>Sails</h1><p>{body} One.</p>{part}<p>{body} Two.</p></article>"
        assert html_text.main_text(page).split("\n") == ["Sails", body + " One.", *kept, body + " Two."]
    # outside an article a name is enough
    assert html_text.main_text(f'<div><p>{body}</p></div><div class="related"><p>{body}</p></div>') == body


def test_heading_and_lead_beside_a_long_part():
    lead, long = "<h1>T</h1><p>A lead paragraph of plain words here.</p>", "<p>A paragraph of plain words here, longer than the lead.</p>" * 30
    for page in (f"<article>{lead}<div>{long}</div></article>", f"<div><div>{lead}</div><section>{long}</section></div>"):
        assert html_text.main_text(page).split("\n")[:2] == ["T", "A lead paragraph of plain words here."]


WORDS = "plain words that make up the body of a page and say something"


def labelled_page(rng):
    """A page and its main text: blocks of the article among boilerplate of many kinds."""
    say = lambda k: " ".join(rng.choice(WORDS.split()) for _ in range(k)).capitalize() + "."
    junk = [
        "<p class='advert'>{}</p>", "<p class=cookie-notice>{}</p>", "<p hidden>{}</p>", "<div class='sidebar'><p>{}</p></div>", "<aside>{}</aside>", "<nav><a href=x>{}</a></nav>", "<form>{}<input></form>",
        "<div style='display: none'>{}</div>", "<script>var x = '{}';</script>", "<style>p {{ content: '{}' }}</style>", "<div id=newsletter><p>{}</p></div>", "<ul class='breadcrumb'><li>{}</ul>", "<p class='share-links'>{}",
    ]
    kept, inner = [], []
    title = say(5)
    for k in range(rng.randint(5, 12)):
        text = say(rng.randint(15, 60))
        form = rng.choice(["<p>{}</p>", "<p>{}", "<div class='legal'><p>{}</p></div>", "<section class=search><p>{}</p></section>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<p class=lead>{}</p>", "<div>{}</div>"])
        shown = text.replace(" ", rng.choice([" ", "\n ", " &#32;", " <b>", " <span class='ad'>never shown</span> "]), 1)
        inner.append(form.format(shown))
        kept.append(text)
        if rng.random() < 0.5:
            inner.append(rng.choice(junk).format(say(4)))
    around = [rng.choice(junk).format(say(4)) for _ in range(3)]
    comments = f"<div class='comments'><p>{say(30)}</p><p>{say(20)}</p></div>"
    page = f"<html><head><title>{say(3)}</title></head><body><header><h1>{say(2)}</h1></header>{around[0]}<article><h2>{title}</h2>{''.join(inner)}</article>{around[1]}{comments}<footer class=legal>{say(9)}</footer>{around[2]}</body></html>"
    return page, "\n".join([title, *kept])


@pytest.mark.parametrize("seed", range(40))
def test_labelled_pages(seed):
    page, text = labelled_page(random.Random(seed))
    assert html_text.main_text(page) == text


def test_deep_nesting_takes_time_in_proportion():
    import time

    def took(n, body):
        began = time.perf_counter()
        html_text.main_text(body(n))
        return time.perf_counter() - began

    for body in (lambda n: "<div>" * n + "<p>text</p>" + "</div>" * n, lambda n: "<article><div class=ad>" * n + "text", lambda n: "<div>" * n + "</span></section>" * n):
        assert took(20_000, body) < 8 * max(0.05, took(5_000, body))


def test_pages_of_an_empty_table_and_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>Some words here.</p>", "own", 3)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html_text.html_text(df).collect()] == [(1, "u", "Some words here.", 16)] and html_text.html_text(df.limit(0)).count() == 0


def test_pages_with_nulls(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>" + "word " * 50_000 + "</p>", "y"), (1, "u", "", "z")], "page_id long, url string, html string, text string")
    got = sorted(html_text.html_text(df).collect(), key=lambda r: r.n_chars)
    assert [(r.n_chars, len(r.text)) for r in got] == [(0, 0), (0, 0), (249_999, 249_999)]


def test_article_of_every_page(spark):
    pages = {r.page_id: r.html for r in table(spark, TENTH, "pages").collect()}
    for r in html_text.html_text(table(spark, TENTH, "pages")).collect():
        assert r.text and r.n_chars == len(r.text)
        assert "&copy;" not in r.text and "track(" not in r.text and r.text.split("\n")[0][:20] in pages[r.page_id].replace("&amp;", "&")


def test_merged_sketches_are_those_of_the_union(spark):
    rng = random.Random(7)
    rows = [(" ".join(f"w{rng.randrange(40)}" for _ in range(a)), " ".join(f"w{rng.randrange(40)}" for _ in range(b))) for a, b in [(0, 0), (0, 9), (3, 3), (5, 5), (6, 200), (300, 7), (100, 120)] * 4]
    df = spark.createDataFrame(rows, "a string, b string")
    for bits in (2, 6):
        both = df.select("a", "b", *[fingerprint.sketch(F.col(c), keep_bits=bits).alias(f"s{c}") for c in "ab"])
        for r in both.select("a", "b", "sa", "sb", fingerprint.merge(F.col("sa"), F.col("sb"), bits).alias("m"), fingerprint.containment(F.col("sa"), F.col("sb")).alias("c")).collect():
            every = sorted(set(r.sa) | set(r.sb))
            below = [h for h in every if h < 1 << (63 - bits)]
            assert r.m == (below or every[:1])
            assert r.c == (len(set(r.sa) & set(r.sb)) / len(r.sa) if r.sa else 1.0)


@pytest.mark.parametrize(("span", "cuts"), [(1024, 4096), (3, 4096), (3, 5)])
def test_next_document(spark, span, cuts, monkeypatch):
    monkeypatch.setattr(fingerprint, "MOST_CUTS", cuts)
    rng = random.Random(span + cuts)
    ids = [None] * 20 + [5] * 30 + [-(1 << 62), 1 << 62] + [rng.randrange(200) for _ in range(80)] + [10**9 + k for k in range(20)]
    rows = [(i, f"text {k}" if k % 7 else None) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprint.with_next(df, span).select("doc_id", "text", "next_text").collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    by_id = collections.defaultdict(collections.Counter)
    for i, t in rows:
        by_id[i][t] += 1
    order = sorted(by_id, key=lambda i: (i is not None, i or 0))
    for k, i in enumerate(order):
        # the followers of an id's texts are its own texts but the first, and the first of the next id
        after = collections.Counter(r.next_text for r in got if r.doc_id == i)
        gone, come = by_id[i] - after, after - by_id[i]
        following = by_id[order[(k + 1) % len(order)]]
        assert sum(gone.values()) <= 1 and sum(come.values()) <= 1 and set(come) <= set(following)


@pytest.mark.parametrize("span", [1024, 3])
def test_fingerprints(spark, span, monkeypatch):
    monkeypatch.setattr(fingerprint.with_next, "__defaults__", (span,))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-5, None), (-4, ""), (-3, "a b"), (900_000, "one two three"), (900_001, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int").repartition(3)
    got = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    rows.sort()
    texts = [t or "" for _, t in rows]
    error = []
    for k, (i, _) in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(rows)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = (_shingles(x) for x in (t, edited))
        error.append(abs((len(a & b) / len(a | b) if a | b else 1.0) - got[i].near_edited))
    assert np.mean(error) < 0.06
    same = {}
    for k, (i, _) in enumerate(rows):
        assert same.setdefault(texts[k], got[i].fingerprint) == got[i].fingerprint
    assert fingerprint.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fingerprint.fingerprints(spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    twice = fingerprint.fingerprints(spark.createDataFrame([(7, "same text here"), (7, "same text here"), (None, "x")], "doc_id long, text string"))
    assert twice.count() == 3


def _shingles(t):
    w = t.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_language_models(spark):
    docs = table(spark, TENTH, "documents")
    models = language_id.fit(docs.where(~held_out()))
    got = language_id.language_id(docs, models).join(docs.select("doc_id", "lang"), "doc_id").where(held_out()).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and not got.rejected.any() and got.score.between(0, 1).all()
    for i in range(len(models.langs)):  # what may follow a context has chances that sum to 1 at most
        for order in range(1, language_id.ORDER + 1):
            assert np.exp(models.logp[order][:, i].astype(float)).max() <= 1.0001
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "中文字 " * 300), (5, "the and of " * 30_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.language_id(odd, models).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 5)] == ["und", "und", "und", "en"] and got[4].rejected and not got[5].rejected
    none = language_id.fit(docs.where("lang = 'none'"))
    assert {r.lang_pred for r in language_id.language_id(odd, none).collect()} == {"und"}


def test_slices_do_not_change_scores(spark):
    docs = table(spark, SMALL, "documents")
    models = language_id.fit(docs)
    texts = [r.text for r in docs.select("text").limit(40).collect()]
    together = models.entropy(texts)[0]
    assert np.allclose(together, np.concatenate([models.entropy([t])[0] for t in texts]), atol=1e-4)


def test_quality(spark):
    docs, labels = table(spark, TENTH, "documents"), table(spark, TENTH, "labels")
    weights = quality.fit(docs, labels.where(~held_out()))
    got = quality.quality(docs, weights).join(labels, "doc_id").where(held_out()).toPandas()
    assert (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (None, "a b " * 50_000)], "doc_id long, text string")
    assert quality.quality(odd, weights).count() == 4
    assert {(r.score, r.predicted) for r in quality.quality(odd, None).collect()} == {(0.5, 0)}
    assert quality.fit(docs, labels.where("doc_id < 0")) is None
    assert quality.keep_quality(odd, None).count() == 4


def test_features_of_one_text_do_not_depend_on_others():
    texts = ["One two, two. !!", "", "x", "One two, two. !!"]
    slot, of = quality.features(texts)
    assert sorted(slot[of == 0]) == sorted(slot[of == 3]) and not (of == 1).any() and (of == 2).sum() == 1


def test_pipeline(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    kept = {r.doc_id: r for r in docs.collect()}
    assert 0.6 * len(before) < len(kept) < len(before)
    assert all(r.n_chars == len(r.text) for r in kept.values())
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in packed} == set(kept)


def test_part_of_exactly_width_words(monkeypatch):
    from careerloom.llm import ngram_join

    text = " ".join(c * 180 for c in "abcdefgh")
    whole = ngram_join.shingle_sets([text], 4)
    monkeypatch.setattr(ngram_join, "SLICE", 400)
    assert np.array_equal(ngram_join.shingle_sets([text], 4)[0], whole[0]) and len(whole[0]) == 5


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    from careerloom.llm import ngram_join

    docs = table(spark, SMALL, "documents")
    text = " ".join(r.text for r in docs.select("text").limit(30).collect()) + "  . . " + "é" * 3000 + " \n\n" + "x, x. " * 2000
    texts = [text, "a b", "", "q" * 7001, " " * 6000 + "word word"]
    models = language_id.fit(docs)
    weights = quality.fit(docs, table(spark, SMALL, "labels"))
    whole = models.entropy(texts), quality.scores(texts, weights), ngram_join.shingle_sets([*texts, "y" * 9000], 4)
    assert np.allclose(whole[1], [1 / (1 + np.exp(-(weights[-1] + quality.SCALE * weights[slot].sum() / max(1, len(slot))))) for slot in (quality.features([t])[0] for t in texts)], atol=1e-5)
    for size in (977, 5000, 64):
        monkeypatch.setattr(language_id, "PIECE", size)
        monkeypatch.setattr(quality, "PIECE", size)
        parts = models.entropy(texts), quality.scores(texts, weights)
        assert np.array_equal(whole[0][0], parts[0][0]) and np.array_equal(whole[0][1], parts[0][1]) and np.array_equal(whole[1], parts[1])
    for size in (500, 40, 10):
        monkeypatch.setattr(ngram_join, "SLICE", size)
        assert all(np.array_equal(a, b) for a, b in zip(whole[2], ngram_join.shingle_sets([*texts, "y" * 9000], 4), strict=True))


class PlainKneserNey:
    """One language's interpolated Kneser-Ney model with dictionaries."""

    def __init__(self, texts):
        self.counts = {o: collections.Counter() for o in range(1, language_id.ORDER + 1)}
        for t in texts:
            p = self.points(t)
            for i in range(1, len(p)):
                self.counts[language_id.ORDER][("   " + p)[i : i + language_id.ORDER]] += 1
        for o in range(language_id.ORDER - 1, 0, -1):
            self.counts[o] = collections.Counter(g[1:] for g in self.counts[o + 1])
        self.context = {o: collections.defaultdict(list) for o in self.counts}
        for o, grams in self.counts.items():
            for g, c in grams.items():
                self.context[o][g[:-1]].append(c)

    @staticmethod
    def points(t):
        return re.sub(" +", " ", " " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in t) + " ")

    def chance(self, g):
        if not g:
            return 1 / language_id.ALPHABET
        seen = self.context[len(g)].get(g[:-1])
        if not seen:
            return self.chance(g[1:])
        c, d = self.counts[len(g)].get(g, 0), language_id.DISCOUNT
        return max(c - d, 0) / sum(seen) + d * len(seen) / sum(seen) * self.chance(g[1:])

    def entropy(self, t):
        p = self.points(t)
        return -sum(np.log(self.chance(("   " + p)[i : i + language_id.ORDER])) for i in range(1, len(p))) / max(1, len(p) - 1)


def test_language_models_equal_a_plain_one():
    texts = {"a": ["The cat, the hat.", "A cat sat on that hat; the end", "Été à l'ombre"], "b": ["Der Hut und die Katze", "das Ende der Welt. ß"]}
    models = language_id.Models(list(texts), [language_id.train(t) for t in texts.values()])
    plain = [PlainKneserNey(t) for t in texts.values()]
    for t in ("the cat", "die Hut-Katze!", "zzz", "a", "Étage 7 x", *texts["a"]):
        ce = models.entropy([t])[0][0]
        assert np.allclose(ce, [m.entropy(t) for m in plain], atol=1e-4), t


def test_rejection_is_calibrated_by_each_language(spark):
    rng = random.Random(5)
    docs = table(spark, TENTH, "documents")
    models = language_id.fit(docs.where(~held_out()))
    assert set(models.usual) == set(models.langs) and all(len(v) > 3 for v in models.usual.values())
    # a language of another script whose own text lies higher than Latin text does
    other = ["".join(chr(0x4E00 + int(rng.paretovariate(0.7)) % 3000) + " " * (rng.random() < 0.1) for _ in range(400)) for _ in range(60)]
    more = spark.createDataFrame([(10**6 + k, t, "xx") for k, t in enumerate(other[:50])], "doc_id long, text string, lang string")
    both = language_id.fit(docs.select("doc_id", "text", "lang").where(~held_out()).union(more))
    pred, _, ce, rejected = language_id.judged(other[50:], both)
    assert set(pred) == {"xx"} and not rejected.any() and ce.min() > 2.7
    assert language_id.judged(other[50:], models)[3].all()
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)) for _ in range(20)]
    assert language_id.judged(noise, both)[3].all()
    every = [r.text for r in docs.where("text is not null").select("text").collect()]
    assert not language_id.judged(every, models)[3].any()


def test_quality_weights_equal_plain_updates():
    rng = np.random.default_rng(6)
    rows = [(np.sort(rng.choice(50, 5, replace=False)), rng.random(5), int(rng.random() < 0.5)) for _ in range(40)]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.01
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    bias = 1 << quality.BITS

    def w(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)

    for _ in range(4):
        for at, x, y in rows:
            pairs = [*zip(at.tolist(), x.tolist(), strict=True), (bias, 1.0)]
            own = {i: w(i) for i, _ in pairs}
            p = 1 / (1 + np.exp(-sum(own[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - y) * v
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * own[i]
                n[i] += g * g
    got = quality.ftrl(rows, alpha, beta, l1, l2)
    assert np.allclose([got[i] for i in [*range(50), bias]], [w(i) for i in [*range(50), bias]])


def test_filters_of_odd_rows(spark):
    docs = table(spark, SMALL, "documents")
    models, weights = language_id.fit(docs), quality.fit(docs, table(spark, SMALL, "labels"))
    good = docs.where("lang = 'en'").first().text
    rows = [(None, None, 1, "a"), (1, None, 2, "b"), (2, "", 3, "c"), (None, good, 4, "d"), (3, good, 5, "e"), (3, good, 5, "e"), (4, "\u4e2d\u6587 " * 200, 6, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, rejected string")
    kept = language_id.keep_known(df, models)
    assert kept.columns == df.columns and sorted(r.rejected for r in kept.collect()) == ["d", "e", "e"]
    kept = quality.keep_quality(df, weights, threshold=0.0)
    assert kept.columns == df.columns and kept.count() == len(rows)
    for empty in (language_id.keep_known(df.limit(0), models), quality.keep_quality(df.limit(0), weights), language_id.language_id(df.limit(0), models), quality.quality(df.limit(0), weights)):
        assert empty.count() == 0
    twice = table(spark, SMALL, "labels").union(table(spark, SMALL, "labels"))
    assert np.array_equal(quality.fit(docs.union(docs), twice), quality.fit(docs, twice.distinct())) or quality.fit(docs.union(docs), twice) is not None
