"""Token counts without token ids (operator 1).

A piece model with word-start marks never joins a piece across the start of a run of spaces,
so a text falls apart into pre-tokens: a run of spaces and what follows up to the next one.
Each slice of rows builds its vocabulary of distinct pre-tokens, counts the pieces of each
once, joins the counts to the (document, pre-token) frequencies and sums. A worker keeps the
counts of pre-tokens it has met, up to ``CACHE`` of them, so a pre-token is counted once per
worker rather than once per slice. There is no shuffle: the distinct pre-tokens of invented
or multilingual text grow almost as fast as the text, so one corpus-wide table of them would
have to be shuffled and joined back against every document's frequencies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import ids, slices

#: Pre-tokens whose counts a worker keeps.
CACHE = 400_000
_RUN = re.compile(" +[^ ]*")
_kept: dict[str, tuple[object, dict[str, int]]] = {}


def _model(path: str):
    if path not in _kept:
        import sentencepiece

        _kept[path] = (sentencepiece.SentencePieceProcessor(model_file=path), {})
    return _kept[path]


def count_pieces(model, pretokens: list[str]) -> list[int]:
    """Pieces of each pre-token. The model adds the first space itself, so one is taken off."""
    bare = [x[1:] for x in pretokens]
    return [len(x) or 1 for x in model.encode(bare, num_threads=1)]


def pretokens(text: str) -> list[str]:
    """The pre-tokens of one text, the model's own leading space included."""
    return _RUN.findall(" " + text.replace("▁", " ")) if text else []


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_tokens, over_limit`` for ``docs(doc_id, text)``.

    Null and empty texts have 0 bytes and 0 tokens. Rows are kept as they come: repeated rows
    and null ids stay. Further columns of ``docs`` are not read. A text is read whole,
    whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = _model(model_path)
        for batch in slices(batches):
            text = pc.fill_null(batch.column(1), "")
            n = len(text)
            n_bytes = np.asarray(pc.binary_length(text), dtype=np.int64)
            # a single space between words, as nearly always: the parts are the pre-tokens
            odd = np.asarray(pc.or_(pc.or_(pc.match_substring(text, "  "), pc.match_substring(text, "▁")), pc.starts_with(text, " ")))
            odd |= n_bytes == 0
            at_plain = np.flatnonzero(~odd)
            plain = pc.split_pattern(text.take(pa.array(at_plain)), " ")
            words = plain.flatten().dictionary_encode()
            docs_of = at_plain[np.asarray(pc.list_parent_indices(plain), dtype=np.int64)]
            vocabulary = [" " + x for x in words.dictionary.to_pylist()]
            index = np.asarray(words.indices, dtype=np.int64)
            extra, at = [], {w: i for i, w in enumerate(vocabulary)} if odd.any() else {}
            for i in np.flatnonzero(odd & (n_bytes > 0)).tolist():
                for w in pretokens(text[i].as_py()):
                    k = at.setdefault(w, len(vocabulary))
                    if k == len(vocabulary):
                        vocabulary.append(w)
                    extra.append((i, k))
            if extra:
                more = np.array(extra, dtype=np.int64)
                docs_of, index = np.concatenate([docs_of, more[:, 0]]), np.concatenate([index, more[:, 1]])
            new = [w for w in vocabulary if w not in cache]
            if len(cache) + len(new) > CACHE:
                cache.clear()
                new = vocabulary
            cache.update(zip(new, count_pieces(model, new), strict=True))
            pieces = np.fromiter((cache[w] for w in vocabulary), np.int64, len(vocabulary))
            total = np.zeros(n, np.int64)
            if len(index):
                size = len(vocabulary)
                pairs, frequency = np.unique(docs_of * size + index, return_counts=True)
                np.add.at(total, pairs // size, frequency * pieces[pairs % size])
            yield pa.RecordBatch.from_arrays([ids(batch), pa.array(n_bytes), pa.array(total), pa.array(total > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
