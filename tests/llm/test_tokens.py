"""Token operators against the libraries, on odd texts."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from careerloom.llm import packing
from careerloom.llm.byte_bpe import byte_bpe, read_ranks
from careerloom.llm.token_counts import token_counts

random.seed(5)
ODD = [
    None, "", " ", "  ", "a  b", "   x\n\n  y   \t z ", "▁a▁▁b ", " lead", "a" * 3000 + " " + "é̀" * 900 + "  '  's don't", "<s> </s> <unk> 　x 日本語 <|endoftext|>",
    "ab\n cd  \n e", "x \n\n y", "<|StartOfText|> x<|startoftext|>y\x1c\x85k Σ ΑΣ", "one two " * 6000, "same", "same",
]
ODD += ["".join(random.choice("aAbBéÉ' .,!?'sßİΣσ\n\t 1½²日é́ \x1c\x85’re") for _ in range(random.randint(0, 60))) for _ in range(400)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", -1) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens string, piece int").repartition(3)


def test_counts_equal_the_library(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, P.path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(ODD):
        n = len(model.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 4096), repr(t)[:80]


def test_byte_bpe_equals_the_library_and_round_trips(docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    for r in byte_bpe(docs, path, P.PATTERN, keep_ids=True).collect():
        t = ODD[r.doc_id] or ""
        ids = lib.encode_ordinary(t)
        assert (r.n_tokens, list(r.ids)) == (len(ids), ids), repr(t)[:80]
        assert bytes(r.decoded) == t.encode() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_packing_covers_every_token_once(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.best_fit_packing(docs, P.path("word_bpe_49k.json")).collect()
    have = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    for i, t in enumerate(ODD):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            cut = ids[k : k + 4096]
            assert have.pop((i, k // 4096)) == (k, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))
    assert not have
    at: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096


@pytest.mark.parametrize("seed", range(30))
def test_plan_gives_each_piece_a_slot(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 100])
    histogram = {n: rng.randint(1, 40) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(7, capacity)))}
    plan, used = packing.plan_slots(histogram, capacity), {}
    for length, n in histogram.items():
        rows = plan[length]
        for rank in range(n):
            first, sequence, each, offset = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
            place = (sequence + (rank - first) // each, offset + (rank - first) % each * length)
            used.setdefault(place[0], []).append((place[1], length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    sequences: list[int] = []  # best-fit decreasing over single pieces opens as many
    for length in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fits = [k for k, free in enumerate(sequences) if free >= length]
        if fits:
            sequences[min(fits, key=lambda k: sequences[k])] -= length
        else:
            sequences.append(capacity - length)
    assert len(used) == len(sequences)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(empty, P.path("piece_bpe_32k.model")).count() == 0
    assert byte_bpe(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert packing.best_fit_packing(empty, P.path("word_bpe_49k.json")).count() == 0
