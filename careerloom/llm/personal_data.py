"""Personal data: four rules, and what a linear-chain conditional random field finds beside them.

The field labels words by their shapes: the runs of lower case, upper case, digits (with how many) and single signs that a word is made of. It is trained from a small
table of labelled texts, which ``labelled`` makes of a bounded sample of documents: words around what the rules find, as they stand and with
the find written in a way that no rule knows. Viterbi runs in numpy over batches of stretches: a word whose
score for "nothing" is ahead of every label by more than its two transitions could make up is "nothing" in every best path,
so the stretches between such words are decoded apart, with the same result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids, slices, strings

KINDS = ("email", "ip", "card", "phone")
#: "Nothing", then the first and the further words of each kind.
LABELS = 1 + 2 * len(KINDS)
#: Characters of a text that are turned into words at once.
CHARS = 1 << 20
#: Cells of the table of each feature.
CELLS = 1 << 16

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IN_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])) % 10 == 0


def by_rule(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the rules find, by kind and start; each rule reads a text once, however long its runs are."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _IN_LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


# classes of characters: 0 white space, 1 digit, 2 lower case and all that is not ASCII, 3 upper case, signs their own
_CLASS = np.array([0 if c in range(9, 14) or c == 32 else 1 if 48 <= c < 58 else 2 if 97 <= c < 123 or c == 128 else 3 if 65 <= c < 91 else 4 + c for c in range(129)], np.int64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(16)], np.uint64)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64((salt + 1) * 0x632BE59BD9B4E019 % (1 << 64))) * _ODD
    return h ^ (h >> np.uint64(29))


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of a text's words, and ``[word, 4]``: hashes of the shape, its first and last run, its size, and one value for all."""
    kind = _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]
    cuts = np.flatnonzero(np.diff(kind, prepend=-1))
    runs, lengths = kind[cuts], np.diff(cuts, append=len(kind))
    real = runs > 0
    first = real & np.concatenate([[True], ~real[:-1]]) if len(real) else real
    cuts, runs, lengths, first = cuts[real], runs[real], lengths[real], np.flatnonzero(first[real])
    if not len(first):
        return first, first, np.zeros((0, 4), np.uint64)
    code = (runs * 32 + np.where(runs == 1, np.minimum(lengths, 24), 0) + 1).astype(np.uint64)
    size = np.diff(first, append=len(cuts))
    place = np.arange(len(cuts)) - np.repeat(first, size)
    last = first + size - 1
    # runs after the sixteenth count as being there
    shape = _mixed(np.add.reduceat(code * _POWERS[np.minimum(place, 15)], first), 0)
    digits = np.minimum(np.add.reduceat(np.where(runs == 1, lengths, 0), first), 24)
    ends = _mixed(code[first] * np.uint64(8192) + code[last], 1)
    bulk = _mixed((digits * 64 + np.minimum(size, 9) * 4 + np.minimum((cuts[last] + lengths[last] - cuts[first]) // 12, 3)).astype(np.uint64), 2)
    return cuts[first], cuts[last] + lengths[last], np.stack([shape, ends, bulk, np.full_like(shape, 7)], 1)


#: Features of a word: (offset, column) pairs that are hashed together.
_FEATURES = (((0, 0),), ((-1, 0),), ((1, 0),), ((-1, 0), (0, 0)), ((0, 0), (1, 0)), ((0, 1),), ((0, 2),), ((0, 3),))


def features(h: np.ndarray) -> np.ndarray:
    """``[word, feature]`` cells; beyond the ends, words are nothing."""
    padded = np.zeros((len(h) + 2, h.shape[1]), np.uint64)
    padded[1:-1] = h
    out = np.empty((len(h), len(_FEATURES)), np.int64)
    for k, parts in enumerate(_FEATURES):
        at = np.zeros(len(h), np.uint64)
        for offset, column in parts:
            at = _mixed(at + padded[1 + offset : len(h) + 1 + offset, column], 10 + k)
        out[:, k] = (at >> np.uint64(40)).astype(np.int64) % CELLS
    return out


@dataclass
class Model:
    """Weights of the cells that training has seen, ``cells[k]`` of feature k, and of transitions ``[from, to]``."""

    cells: list[np.ndarray]
    weights: list[np.ndarray]
    moves: np.ndarray

    def tables(self) -> list[np.ndarray]:
        out = []
        for at, w in zip(self.cells, self.weights, strict=True):
            table = np.zeros((CELLS, LABELS))
            table[at] = w
            out.append(table)
        return out


def untrained() -> Model:
    """Finds nothing."""
    return Model([np.zeros(0, np.int64)] * len(_FEATURES), [np.zeros((0, LABELS))] * len(_FEATURES), np.zeros((LABELS, LABELS)))


def likelihood(scores: np.ndarray, moves: np.ndarray, labels: np.ndarray, sizes: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of labelled chains, and its gradients by scores and by moves.

    ``scores[chain, place, label]`` and ``labels[chain, place]``; places from ``sizes`` on count for nothing. Chains begin and end in "nothing".
    """
    n, length, _ = scores.shape

    def summed(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)

    held = np.arange(length)[None, :] < sizes[:, None]
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = moves[0] + scores[:, 0]
    for i in range(1, length):
        ahead[:, i] = np.where(held[:, i, None], summed(ahead[:, i - 1, :, None] + moves, 1) + scores[:, i], ahead[:, i - 1])
    behind[:] = moves[:, 0]
    for i in range(length - 2, -1, -1):
        behind[:, i] = np.where(held[:, i + 1, None], summed(moves + (scores[:, i + 1] + behind[:, i + 1])[:, None, :], 2), moves[:, 0])
    rows = np.arange(n)
    total = summed(ahead[rows, sizes - 1] + moves[:, 0], 1)
    by_score = np.exp(ahead + behind - total[:, None, None]) * held[:, :, None]
    pair = held[:, 1:]
    by_move = np.zeros_like(moves)
    for i in range(1, length):
        p = np.exp(ahead[:, i - 1, :, None] + moves + (scores[:, i] + behind[:, i])[:, None, :] - total[:, None, None])
        by_move += (p * pair[:, i - 1, None, None]).sum(0)
    by_move[0] += by_score[:, 0].sum(0)
    by_move[:, 0] += by_score[rows, sizes - 1].sum(0)
    at = np.nonzero(held)
    truth = labels[at]
    loss = total.sum() - scores[(*at, truth)].sum()
    by_score[(*at, truth)] -= 1
    one, two = labels[:, :-1][pair], labels[:, 1:][pair]
    loss -= moves[one, two].sum() + moves[0, labels[:, 0]].sum() + moves[labels[rows, sizes - 1], 0].sum()
    np.subtract.at(by_move, (one, two), 1)
    np.subtract.at(by_move, (np.zeros(n, int), labels[:, 0]), 1)
    np.subtract.at(by_move, (labels[rows, sizes - 1], np.zeros(n, int)), 1)
    return loss / n, by_score / n, by_move / n


def labels_of(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The label of each word: that of the span it shares characters with."""
    out = np.zeros(len(starts), np.int64)
    for kind, a, b in spans:
        hit = np.flatnonzero((starts < b) & (ends > a))
        if len(hit):
            out[hit], out[hit[0]] = 2 + 2 * kind, 1 + 2 * kind
    return out


def train(table: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 120, rate: float = 0.2, penalty: float = 2e-4) -> Model:
    """A field fitted to labelled texts ``(text, [(kind, start, end)])`` by Adam steps over the whole small table."""
    rows = [(words(t), spans) for t, spans in table]
    rows = [(w, spans) for w, spans in rows if len(w[0])]
    if not rows:
        return untrained()
    sizes = np.array([len(w[0]) for w, _ in rows])
    labels = np.zeros((len(rows), sizes.max()), np.int64)
    for k, (w, spans) in enumerate(rows):
        labels[k, : sizes[k]] = labels_of(w[0], w[1], spans)
    held = np.arange(sizes.max())[None, :] < sizes[:, None]
    seen, where = zip(*[np.unique(c, return_inverse=True) for c in np.concatenate([features(w[2]) for w, _ in rows]).T], strict=True)
    sums = []
    for at in where:
        order = np.argsort(at, kind="stable")
        sums.append((order, np.flatnonzero(np.diff(at[order], prepend=-1))))
    params = [np.zeros((len(c), LABELS)) for c in seen] + [np.zeros((LABELS, LABELS))]
    one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        scores = np.zeros((*labels.shape, LABELS))
        scores[held] = sum(w[at] for w, at in zip(params, where, strict=False))
        _, by_score, by_move = likelihood(scores, params[-1], labels, sizes)
        flat = by_score[held]
        slopes = [np.add.reduceat(flat[order], starts) for order, starts in sums] + [by_move]
        for p, g, m, v in zip(params, slopes, one, two, strict=True):
            g = g + penalty * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(list(seen), params[:-1], params[-1])


def best_path(scores: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """The best labels of each chain, between "nothing" and "nothing"; the least label on a tie, from the end."""
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    sizes = np.array([len(scores[k]) for k in order])
    out: list = [None] * len(scores)
    group = 0
    while group < len(order):
        # chains of much the same length are padded together
        many = max(1, min(len(order) - group, (1 << 16) // max(1, int(sizes[group]))))
        mine, n = order[group : group + many], sizes[group : group + many]
        padded = np.zeros((len(mine), n[0], LABELS))
        for row, k in zip(padded, mine, strict=True):
            row[: len(scores[k])] = scores[k]
        now, back = moves[0] + padded[:, 0], []
        for i in range(1, n[0]):
            m = int(np.searchsorted(-n, -i, "left"))
            ways = now[:m, :, None] + moves
            best = ways.argmax(1)
            back.append(best.astype(np.int8))
            now = now.copy()
            now[:m] = np.take_along_axis(ways, best[:, None, :], 1)[:, 0] + padded[:m, i]
        state = (now + moves[:, 0]).argmax(1)
        path = np.zeros((len(mine), n[0]), np.int8)
        path[np.arange(len(mine)), n - 1] = state
        for i in range(len(back) - 1, -1, -1):
            m = len(back[i])
            state[:m] = back[i][np.arange(m), state[:m]]
            path[:m, i] = state[:m]
        for row, k in zip(path, mine, strict=True):
            out[k] = row[: len(scores[k])]
        group += many
    return out


_SPACE = re.compile(r"[ \t-\r]")


def _pieces(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``words`` of a long text, cut at white space about every ``CHARS`` characters; places are those of the text."""
    begin = 0
    while begin < len(text):
        m = _SPACE.search(text, begin + CHARS) if begin + CHARS < len(text) else None
        end = m.start() if m else len(text)
        starts, ends, h = words(text[begin:end])
        if len(h):
            yield starts + begin, ends + begin, h
        begin = end


class Decoder:
    def __init__(self, model: Model) -> None:
        self.tables, self.moves = model.tables(), model.moves
        # how much two transitions by way of a label can be ahead of those by way of "nothing"
        self.margin = (model.moves - model.moves[:, :1]).max(0) + (model.moves - model.moves[:1]).max(1)

    def open(self, starts: np.ndarray, ends: np.ndarray, cells: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Start, end and number of the words that may be more than nothing, and their scores."""
        total = np.zeros((len(starts), LABELS))
        for table, at in zip(self.tables, cells.T, strict=True):
            total += table[at]
        mine = np.flatnonzero((total[:, :1] - total <= self.margin)[:, 1:].any(1))
        return np.stack([starts[mine], ends[mine], mine + first], 1), total[mine]

    def short(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``open`` for each text, for all texts at once."""
        starts, ends, h = words("\n".join(texts))
        size = np.array([len(t) + 1 for t in texts], np.int64)
        base = np.cumsum(size) - size
        of = np.searchsorted(base, starts, "right") - 1
        # between texts lie words of nothing, so neighbours are of one text
        apart = np.arange(len(starts)) + 2 * of
        spread = np.zeros((len(starts) + 2 * len(texts), h.shape[1]), np.uint64)
        spread[apart] = h
        at, score = self.open(starts, ends, features(spread)[apart])
        bounds = np.searchsorted(of[at[:, 2]], np.arange(len(texts) + 1))
        return [(at[a:b] - [base[k], base[k], 0], score[a:b]) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]

    def long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """``open`` for a text that is read in pieces; each knows the word before and the word after it."""
        nothing = np.zeros((1, 4), np.uint64)
        parts, before, n = [], nothing, 0
        pieces = _pieces(text)
        now = next(pieces, None)
        while now is not None:
            after = next(pieces, None)
            starts, ends, h = now
            cells = features(np.concatenate([before, h, after[2][:1] if after else nothing]))[1:-1]
            parts.append(self.open(starts, ends, cells, n))
            before, n, now = h[-1:], n + len(h), after
        if not parts:
            return np.zeros((0, 3), np.int64), np.zeros((0, LABELS))
        at, score = zip(*parts, strict=True)
        return np.concatenate(at), np.concatenate(score)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) of the labelled stretches of each text."""
        quick = iter(self.short([t for t in texts if len(t) <= CHARS]))
        got = [next(quick) if len(t) <= CHARS else self.long(t) for t in texts]
        chains, where = [], []
        for k, (at, score) in enumerate(got):
            for mine in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at[:, 2]) > 1) + 1) if len(at) else ():
                chains.append(score[mine])
                where.append((k, at[mine]))
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for (k, at), path in zip(where, best_path(chains, self.moves), strict=True):
            kind, start, end = -1, 0, 0
            for (a, b, _), label in zip(at.tolist(), path.tolist(), strict=True):
                now = (label - 1) // 2 if label else -1
                if now != kind or (label and label % 2):
                    if kind >= 0:
                        out[k].append((kind, start, end))
                    kind, start = now, a
                end = b
            if kind >= 0:
                out[k].append((kind, start, end))
        return out


#: What a span of each kind begins and ends with.
_EDGES = (re.compile(r"[A-Za-z0-9].*[A-Za-z0-9]", re.DOTALL), re.compile(r"[0-9].*[0-9]", re.DOTALL), re.compile(r"[0-9].*[0-9]", re.DOTALL), re.compile(r"[+(0-9].*[0-9]", re.DOTALL))


def both(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """All of the rules' spans, and the found ones, trimmed to what their kind begins and ends with, that share no character with them."""
    base = by_rule(text)
    out = [(*s, True) for s in base]
    for kind, a, b in found:
        m = _EDGES[kind].search(text, a, b)
        if m and not any(x < m.end() and m.start() < y for _, x, y in base):
            out.append((kind, m.start(), m.end(), False))
    return sorted(out)


def personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, spans``: for each of ``docs(doc_id, text)`` an array of (kind, start, end, base), by kind in the order of ``KINDS``, then start.

    Places are in code points, the end exclusive; ``base`` tells what the rules find. Null texts count as empty and have no spans. Repeated rows and null ids have their own rows; other
    columns are left alone; an empty table gives no rows. Texts of any length are read whole, ``CHARS`` characters at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in slices(batches, limit=1 << 20):
            texts = strings(batch)
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in both(t, f)] for t, f in zip(texts, decoder.spans(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([ids(batch), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: string, start: bigint, end: bigint, base: boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of ``personal_data``'s rows; spans as ``kind:start:end``, comma-joined."""
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: lambda s: s["kind"] == kind
    count = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *count, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


def _other_ways(rng: random.Random, kind: int, found: str) -> list[str]:
    """The find with other digits, as it stands and in ways that no rule knows."""
    new = "".join(rng.choice("0123456789") if c.isdigit() else c for c in found)
    digits = [c for c in new if c.isdigit()]
    if kind == 0:
        name, _, host = new.partition("@")
        return [new, f"{name}(at){host}", f"{name}[at]{host}", f"{name} (at) {host}", f"{name} [at] {host}", f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name}[at]{host.replace('.', '[dot]')}"]
    if kind == 1:
        four = [str(rng.randrange(256)) for _ in range(4)]
        return [".".join(four), "[.]".join(four), "(.)".join(four)]
    if kind == 2:
        sixteen = [str(rng.randrange(10)) for _ in range(16)]
        four = ["".join(sixteen[k : k + 4]) for k in range(0, 16, 4)]
        return ["".join(sixteen), " ".join(four), "-".join(four)]
    area, three, last = "".join(digits[-10:-7]) or "200", "".join(digits[-7:-4]), "".join(digits[-4:])
    return [new, f"({area}) {three}-{last}", f"{area}-{three}-{last}", f"{area}.{three}.{last}", f"1-{area}-{three}-{last}", f"({area}){three}-{last}"]


def _no_find(rng: random.Random) -> str:
    """What looks like personal data and is none."""
    n = rng.randrange
    return rng.choice([f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2100)}", f"{n(24):02}:{n(60):02}:{n(60):02}", f"{n(1000):,}.{n(100):02}", f"{n(10**6):,}", f"v{n(9)}.{n(20)}.{n(30)}", f"{n(9)}.{n(20)}.{n(30)}", f"#{n(10**5)}", f"{n(10**6)}", f"{n(10**9)}", f"[{n(300)}]", f"({n(1900, 2100)})", f"{n(100)}%", f"{n(50)}-{n(50)}", f'"{n(16**15):x}{n(16**15):x}"', f"{n(10**3)} {n(10**3)}"])


def _seen(text: str) -> list[tuple[int, int, int]]:
    """The rules' spans, and numbers as long as a card's that have a wrong digit."""
    base = by_rule(text)
    wrong = [(2, *m.span()) for m in _CARD.finditer(text) if 13 <= sum(c.isdigit() for c in m.group()) <= 19]
    return sorted(base + [w for w in wrong if not any(a < w[2] and w[1] < b for _, a, b in base)])


def labelled(docs: DataFrame, most: int = 400, rows: int = 900, around: int = 6, seed: int = 13) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """A small labelled table ``(text, [(kind, start, end)])``: at most ``rows`` texts of some words around finds, from at most ``most`` documents.

    The sample holds documents with four digits in a row or ``@``, in the order of a hash of their texts, from a share of all documents that
    holds about 40 for each of ``most``; one text counts once, however many copies there are, and is read up to 65536 characters. A quarter of the rows hold no
    personal data, but things that look like it. A number as long as a card's counts as one, as a wrong digit does not make it less personal.
    """
    n = docs.count()
    share = min(1 << 30, -(-(most * 40) * (1 << 30) // max(1, n)))
    h = F.xxhash64("text", F.lit(seed))
    part = docs.select("text", h.alias("h")).where((F.pmod("h", F.lit(1 << 30)) < share) & F.col("text").rlike("@|[0-9]{4}"))
    texts = [r["text"] for r in part.dropDuplicates(["h"]).select(F.substring("text", 1, 1 << 16).alias("text"), "h").orderBy("h").limit(most).collect()]
    rng = random.Random(seed)
    near: dict[int, list[tuple[str, str, str]]] = {}
    plain: list[list[str]] = []
    for text in texts:
        finds = by_rule(text)
        for kind, a, b in finds:
            left, right = text[max(0, a - 200) : a].split()[-around:], text[b : b + 200].split()[:around]
            near.setdefault(kind, []).append((" ".join(left), text[a:b], " ".join(right)))
        every = text[:4000].split()
        if not finds and len(every) > 2 * around:
            k = rng.randrange(len(every) - around)
            plain.append(every[k : k + 2 * around])
    out = []
    each = rows * 3 // 4 // max(1, len(near))
    for kind, found in sorted(near.items()):
        for _ in range(each):
            left, find, right = rng.choice(found)
            find = rng.choice(_other_ways(rng, kind, find))
            tail = rng.choice(["", "", ".", ",", ";"])
            left, right = rng.choice([(left, right), (left, right), ("", right), (left, "")])
            lead = left + " " if left else ""
            text = f"{lead}{find}{tail} {right}"
            spans = [(kind, len(lead), len(lead) + len(find))]
            # what else there is nearby
            spans += [s for s in _seen(text) if s[2] <= len(lead) or s[1] >= len(lead) + len(find)]
            out.append((text, spans))
    for _ in range(rows // 4 if plain and near else 0):
        some = list(rng.choice(plain))
        some.insert(rng.randrange(len(some) + 1), _no_find(rng))
        text = " ".join(some)
        out.append((text, _seen(text)))
    return out
