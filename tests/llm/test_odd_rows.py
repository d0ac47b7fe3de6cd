"""Null ids, repeated rows, ties, empty tables and clashing columns of the operators that count, encode, compare and pack."""

from __future__ import annotations

import collections

import public_tokenizers
import pytest

from careerloom.llm import byte_bpe, near_vectors, packing, token_counts

ROWS = [(None, "a b  c"), (1, "a b  c"), (1, "a b  c"), (1, "other text"), (2, None), (2, ""), (None, None), (3, "été " * 6000)]


def frame(spark, rows=ROWS):
    df = spark.createDataFrame([(*r, "mine", 7, [1]) for r in rows], "doc_id long, text string, n_tokens string, length int, ids array<int>")
    return df.repartition(3)


def by_text(rows, value):
    """The values of equal texts are equal; null counts as empty."""
    out = collections.defaultdict(set)
    for r, t in rows:
        out[t or ""].add(value(r))
    return out


def test_counts(spark):
    df = frame(spark)
    got = token_counts.token_counts(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in ROWS)
    assert sorted((r.n_bytes, r.n_tokens) for r in got if r.doc_id == 2) == [(0, 0), (0, 0)]
    assert len({(r.n_bytes, r.n_tokens) for r in got if r.n_bytes == 6}) == 1 and sum(r.over_limit for r in got) == 1
    assert token_counts.token_counts(df.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_bytes(spark):
    df = frame(spark)
    codec = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    got = byte_bpe.byte_bpe(df, *codec).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in ROWS)
    assert len({r.ids_sha256 for r in got}) == 4 and len({r.decoded_sha256 for r in got}) == 4
    assert byte_bpe.byte_bpe(df.limit(0), *codec).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.Codec(codec[0], r".+")


def test_packing(spark):
    df = frame(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.best_fit_packing(df, path, capacity=64).collect()
    pieces = collections.Counter((r.doc_id, r.piece) for r in got)
    assert pieces[1, 0] == 3 and pieces[2, 0] == 2 and pieces[None, 0] == 2
    full = collections.defaultdict(list)
    for r in got:
        full[r.sequence_id].append((r.offset, r.length))
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.best_fit_packing(df.limit(0), path).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [4.0, 3.0]), (2, [8.0, 6.0]), (3, [1.0, 0.0, 0.0]), (4, [-1.0, 0.0]), (None, [-2.0, 0.0]), (5, None), (5, [float("inf"), 1.0]), (None, [0.0])]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "vec_id long, embedding array<double>, n_links int, kept boolean").repartition(2)
    got = sorted((tuple(r) for r in near_vectors.near_vectors(df, threshold=0.8).collect()), key=str)
    # (4, 3) and (8, 6) are one direction, at exactly 0.8 from (1, 0); vectors of other lengths link with nothing
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 1, 4, True), (None, 1, 4, False), (5, 0, 5, True), (5, 0, 5, True), (None, 0, None, False)]
    assert got == sorted(want, key=str)
