"""The rules against plain patterns, the field against enumeration and a numeric gradient, and what it finds beside the rules."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from conftest import SMALL

from careerloom.llm import personal_data as P
from careerloom.llm import queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The contract's patterns as they stand."""
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                twice = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
                if not 13 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in twice) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_rules_are_the_patterns():
    rng = random.Random(13)
    parts = ["a", "B.", "@", "@x.y", ".", "-", " ", "+1", "+", "(", ")", "192.168.0.1", "0255.1.1.256", "4111 1111-1111 1111", "5", "55", "+1 (017) 555-7713", "é", "\n", "_%", "378282246310005", "..", "1.2.3.4.5.6.7.8"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert P.by_rule(text) == plain(text), text


def test_rules_read_long_runs_once():
    for run in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "1 " * 200_000, "+1" + " " * 400_000, "@" * 400_000, "a@" * 200_000, "+1" * 200_000):
        P.by_rule(run)
    assert P.by_rule("x" * 300_000 + "@a.b") == [(0, 0, 300_004)]


def random_model(rng, scale=1.0):
    cells = [np.arange(P.CELLS)] * len(P._FEATURES)
    weights = [rng.normal(size=(P.CELLS, P.LABELS)) * scale for _ in cells]
    weights[-1][:, 0] += 8
    return P.Model(cells, weights, rng.normal(size=(P.LABELS, P.LABELS)) * 0.5)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    sizes = np.array([4, 1, 3])
    scores, moves, labels = rng.normal(size=(3, 4, P.LABELS)), rng.normal(size=(P.LABELS, P.LABELS)), rng.integers(0, P.LABELS, (3, 4))
    loss, by_score, by_move = P.likelihood(scores, moves, labels, sizes)
    # the likelihood of the shortest chains by all their labellings
    want = 0.0
    for k, n in enumerate(sizes):
        value = lambda y, k=k, n=n: sum(scores[k, i, y[i]] for i in range(n)) + moves[0, y[0]] + moves[y[-1], 0] + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False))
        every = np.array([value(y) for y in itertools.product(range(P.LABELS), repeat=int(n))])
        want += np.log(np.exp(every).sum()) - value(labels[k, :n].tolist())
    assert abs(loss - want / 3) < 1e-9
    for array, grad in ((scores, by_score), (moves, by_move)):
        for _ in range(25):
            at = tuple(int(rng.integers(0, n)) for n in array.shape)
            old, got = array[at], []
            for step in (1e-5, -1e-5):
                array[at] = old + step
                got.append(P.likelihood(scores, moves, labels, sizes)[0])
            array[at] = old
            assert abs((got[0] - got[1]) / 2e-5 - grad[at]) < 1e-6


def test_paths_are_the_best_of_all():
    rng = np.random.default_rng(2)
    moves = rng.normal(size=(P.LABELS, P.LABELS)) * 2
    chains = [rng.normal(size=(n, P.LABELS)) for n in (1, 4, 2, 3, 1, 4)]
    for scores, path in zip(chains, P.best_path(chains, moves), strict=True):
        value = lambda y, s=scores: sum(s[i, l] for i, l in enumerate(y)) + moves[0, y[0]] + moves[y[-1], 0] + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False))
        assert tuple(path) == max(itertools.product(range(P.LABELS), repeat=len(scores)), key=value)


def texts(rng, n):
    pick = ["Hi", "there,", "Mr.", "x1", "555-0101", "(017)", "a@b", "été", "\n", "\t", "a.b.c", "12", "1,000", "[at]", "HTTP/1.1", " " * 9]
    return [" ".join(rng.choice(pick) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_stretches_decode_as_whole_texts_do():
    """The words left out, the batch, and the cut of long texts change nothing."""
    some = [*texts(random.Random(3), 60), "", " ", "\n\n"]
    model = random_model(np.random.default_rng(3))
    decoder = P.Decoder(model)
    got = decoder.spans(some)
    cut = 0
    for text, spans in zip(some, got, strict=True):
        starts, ends, h = P.words(text)
        assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == re.findall(r"[^\x20\x09-\x0D]+", text)
        want = []
        if len(h):
            scores = sum(t[c] for t, c in zip(model.tables(), P.features(h).T, strict=True))
            (path,) = P.best_path([scores], model.moves)
            before = -1
            for a, b, label in zip(starts.tolist(), ends.tolist(), path.tolist(), strict=True):
                kind = (label - 1) // 2 if label else -1
                if kind >= 0 and kind == before and label % 2 == 0:
                    want[-1] = (kind, want[-1][1], b)
                elif kind >= 0:
                    want.append((kind, a, b))
                before = kind
            cut += len(decoder.long(text)[0]) < len(h)
        assert spans == want
    assert cut > 20


@pytest.mark.parametrize("chars", [1, 7, 40])
def test_pieces_change_nothing(monkeypatch, chars):
    some = texts(random.Random(4), 40)
    decoder = P.Decoder(random_model(np.random.default_rng(4)))
    want = decoder.spans(some)
    monkeypatch.setattr(P, "CHARS", chars)
    assert decoder.spans(some) == want


@pytest.fixture(scope="module")
def model(spark):
    return P.train(P.labelled(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


def test_finds_what_no_rule_knows(model):
    decoder = P.Decoder(model)
    caught = {
        "Thinst anned (412) 555-0199 erion the and.": "phone:13:27",
        "Thinst anned 412-555-0199, erion the and.": "phone:13:25",
        "or die.55(at)mail4.example.com tzzu": "email:3:30",
        "or die.55 [at] mail4.example.com tzzu": "email:3:32",
        "the 4845 1681 1440 7321 onan": "card:4:23",
    }
    clean = ["On 2024-05-17 at 10:30:00 we met.", "It costs 1,299.00 or 40%.", "Version v3.11.4 (see [12]) and #40021.", 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" and', "Plain words. No numbers, at all; (none)!", ""]
    show = lambda t: ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b, base in P.both(t, decoder.spans([t])[0]) if not base)
    assert {t: show(t) for t in caught} == caught
    assert [show(t) for t in clean] == [""] * len(clean)


def test_held_out_words(spark, model):
    """Texts of other documents, with other finds: nearly all are found, and little else."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 5000")
    rows = P.labelled(docs, seed=14)
    decoder = P.Decoder(model)
    right = found = held = 0
    for (text, spans), got in zip(rows, decoder.spans([t for t, _ in rows]), strict=True):
        got = {s[:3] for s in P.both(text, got)}
        right, found, held = right + len(got & set(spans)), found + len(got), held + len(spans)
    assert right / held > 0.95 and right / found > 0.95


def test_odd_rows(spark, model):
    rows = [(None, "a@b.cc"), (1, None), (1, ""), (2, "x " * 600_000 + "a@b.cc +1 (017) 555-7713"), (3, "a@b.cc"), (3, "a@b.cc")]
    df = spark.createDataFrame([(*r, "mine", [1]) for r in rows], "doc_id long, text string, kind string, spans array<int>").repartition(3)
    got = P.digest(P.personal_data(df, model)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_email, r.spans)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(1, 0, ""), (1, 0, ""), (2, 1, "email:1200000:1200006,phone:1200007:1200024"), (3, 1, "email:0:6"), (3, 1, "email:0:6"), (None, 1, "email:0:6")]
    assert [(r.doc_id, r.n_email, r.spans) for r in sorted(got, key=key)] == want
    assert all(r.base_sha256 == digest(r.spans) and r.n_added == 0 for r in got)
    empty = df.limit(0)
    assert P.digest(P.personal_data(empty, P.train(P.labelled(empty)))).count() == 0
    (one,) = P.digest(P.personal_data(df.where("doc_id = 2"), P.untrained())).collect()
    assert (one.n_email, one.n_phone, one.n_card, one.n_ip, one.n_added) == (1, 1, 0, 0, 0)


def test_query_has_the_rules_spans(spark):
    got = {r.doc_id: r for r in queries.queries()["op13_personal_data"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base = [f"{P.KINDS[k]}:{a}:{b}" for k, a, b in plain(d.text or "")]
        r = got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in P.KINDS]
