"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers in their
strict forms. The CRF labels words by their shapes and those of their neighbours; it
is trained on a small labelled table (``labelled_rows``) by gradient ascent, decoded
by Viterbi in numpy batches, and adds what the patterns miss, such as phone numbers
without a plus sign or card numbers that fail their check digit.

Words without a digit, ``@`` or ``+`` are plain. The field is constrained: a plain word is
outside, in training and in decoding alike, and so are the places before the first and after
the last word. So the chain falls apart at plain words, and decoding the runs of other words
is decoding the whole. One pass over the whole texts, no shuffle; the model is a few
kilobytes, and decoding takes memory by the number of words in a run, not by the longest of many.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.tables import map_rows, table

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """From each @ outwards, which takes linear time where the pattern as such would not."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, end := m.end()))
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start; ends are exclusive."""
    out = _emails(text)
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if len(m[0]) <= 37 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


# --- features -------------------------------------------------------------------------------

_RUN = re.compile(r"(?<!\S)[^\s0-9@+]*+[0-9@+]\S*+(?:\s+[^\s0-9@+]*+[0-9@+]\S*+)*+")
_WORD = re.compile(r"\S+")
_ALPHA = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"[0-9]+")
_MARKED = re.compile(r"[0-9@+]")
_EDGE_L, _EDGE_R = re.compile(r"^[^\w+(@]*"), re.compile(r"[^\w)]*$")
#: Words that often stand before personal data.
CUES = frozenset("call phone tel fax mobile contact mail email e-mail card visa payment ip host server address from".split())
CELLS = 1 << 16  # words, with padding, that are decoded at once
MOST_WORDS = 8  # that an entity has: cards are written in four groups, phones in up to six
NEVER = -1e9  # the potential of what the constraint forbids


def core(word: str) -> tuple[int, int]:
    """Bounds of a word without the marks around it."""
    a = _EDGE_L.match(word).end()
    return a, max(a, len(word) - len(_EDGE_R.search(word, a)[0]))


def shape(word: str) -> str:
    return _known_shape(word) if len(word) <= 64 else _shape(word)


def _shape(word: str) -> str:
    a, b = core(word)
    return _NUMBER.sub("9", _ALPHA.sub("a", word[a:b]))


_known_shape = functools.lru_cache(1 << 13)(_shape)


def is_plain(word: str) -> bool:
    return not _MARKED.search(word)


def features(before: str, word: str, after: str) -> list[str]:
    a, b = core(word)
    inner = word[a:b]
    digits = len(_DIGIT.findall(inner))
    size = "0" if not digits else "1-6" if digits < 7 else "7-12" if digits < 13 else "13-19" if digits < 20 else "20+"
    own, left, right = shape(word), shape(before) or "-", shape(after) or "-"
    return [
        "shape=" + own, "runs=" + "-".join(str(min(len(r), 6)) for r in _NUMBER.findall(inner)), "digits=" + size,
        "at=" + str("@" in inner), "letters=" + str(bool(_ALPHA.search(inner))), "before=" + left, "after=" + right,
        "cue=" + str(before.strip(".,:;()").lower() in CUES), "both=" + own + "|" + left, "next=" + own + "|" + right,
    ]


# --- training -------------------------------------------------------------------------------


def labelled_rows(n: int = 320, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: sentences as words, with a label for each. Made by rule,
    so that no person's data is in the repository."""
    r = random.Random(seed)
    fill = "the of an order was sent to our shop and will be there when you ask for it le de la und der el los con".split()
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def entity() -> tuple[str, list[str]]:
        name = r.choice(fill) + r.choice(["", ".", "_"]) + r.choice(fill)
        return r.choice([
            ("email", [f"{name}{num(2)}@{r.choice(fill)}.example.com"]), ("email", [f"{name}@localhost"]), ("email", [f"{name}@{r.choice(fill)}{num(1)}.org"]),
            ("ip", [".".join(str(r.randrange(256)) for _ in range(4))]),
            ("card", [num(16)]), ("card", [num(r.choice([13, 15, 19]))]), ("card", [num(4) for _ in range(4)]), ("card", ["-".join(num(4) for _ in range(4))]),
            ("phone", ["+" + num(1), f"({num(3)})", f"{num(3)}-{num(4)}"]), ("phone", [f"({num(3)})", f"{num(3)}-{num(4)}"]), ("phone", [f"{num(3)}-{num(3)}-{num(4)}"]),
            ("phone", [f"+{num(2)}", num(3), num(7)]), ("phone", [f"({num(3)}){num(3)}-{num(4)}"]), ("phone", [f"+{num(11)}"]), ("phone", [f"{num(3)}.{num(3)}.{num(4)}"]),
        ])

    def other() -> list[str]:
        return r.choice([
            [num(r.randint(1, 6))], [f"20{num(2)}"], [f"{num(1)}.{num(1)}"], ["Version", f"{num(1)}.{num(1)}"], [f"{num(1)}.{num(1)}.{num(2)}"], [f"{num(2)}:{num(2)}"],
            [f"20{num(2)}-{num(2)}-{num(2)}"], [f"{num(2)}/{num(2)}/{num(4)}"], [f"{num(1)}-{num(1)}"], [f"{num(1)},{num(3)}"], [f"${num(2)}.{num(2)}"], [f"{num(2)}%"],
            [f"a{num(3)}f{num(2)}c{num(4)}"], [f"key{num(4)}b{num(8)}"], [f"{r.choice(fill)}{num(1)}"], [f"{num(2)}-{r.choice(fill)}"], ["+"], [f"{num(24)}"], [f"@{r.choice(fill)}"], ["C++"], [f"no.{num(3)}"],
            [f"x{num(2)}", f"{num(2)}"], [num(2), num(3)], [f"({num(1)})"], [f"({num(4)})"], [f"{num(3)}-{num(2)}"], ["12", "a1", "=", "b2"],
        ])

    rows = []
    for _ in range(n):
        words, labels = [], []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(1, 4)):
                words.append(r.choice(fill) if r.random() < 0.85 else r.choice(sorted(CUES)))
                labels.append("O")
            if r.random() < 0.6:
                kind, parts = entity()
                labels += [("B-" if i == 0 else "I-") + kind for i in range(len(parts))]
                parts[-1] += r.choice(["", "", "", ".", ",", "%%%", "!!"])
                words += parts
            else:
                extra = other()
                words += extra
                labels += ["O"] * len(extra)
        words.append(r.choice(fill) + ".")
        labels.append("O")
        rows.append((words, labels))
    return rows


@dataclass
class Model:
    names: dict[str, int]
    weights: np.ndarray  # features + 1 by labels; the last row, of unknown features, is 0
    steps: np.ndarray  # label to label

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        width, none = max(map(len, rows)), len(self.names)
        at = np.array([[self.names.get(f, none) for f in r] + [none] * (width - len(r)) for r in rows])
        return self.weights[at].sum(axis=1)

    def word_emissions(self, words: list[str], before: str = "", after: str = "") -> np.ndarray:
        """Of each word of a run: label scores, by its features, some words at a time."""
        around = [before, *words, after]
        parts = [
            self.emissions([features(*around[j : j + 3]) for j in range(at, min(at + 1024, len(words)))]) for at in range(0, len(words), 1024)]
        return np.concatenate(parts)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Likelihood:
    """Penalised log-likelihood of labelled rows under the constrained field, and its gradient."""

    def __init__(self, rows: list[tuple[list[str], list[str]]], penalty: float):
        feats = [[features(w[i - 1] if i else "", x, w[i + 1] if i + 1 < len(w) else "") for i, x in enumerate(w)] for w, _ in rows]
        self.names = {f: i for i, f in enumerate(sorted({f for s in feats for t in s for f in t}))}
        self.penalty, none = penalty, len(self.names)
        n, t, k = len(rows), max(len(w) for w, _ in rows), len(LABELS)
        self.width = max(len(f) for s in feats for f in s)
        self.at, gold = np.full((n, t, self.width), none), np.zeros((n, t), int)
        self.mask, self.forbid = np.zeros((n, t), bool), np.zeros((n, t, k))
        for i, (words, labels) in enumerate(rows):
            for j, label in enumerate(labels):
                self.at[i, j, : len(feats[i][j])] = [self.names[f] for f in feats[i][j]]
                gold[i, j], self.mask[i, j] = LABELS.index(label), True
                if is_plain(words[j]):
                    self.forbid[i, j, 1:] = NEVER
        self.gold = np.eye(k)[gold] * self.mask[..., None]
        # Places beyond a row are outside: the steps into the first and out of the last word count.
        self.pairs = np.zeros((k, k))
        for i, (words, _) in enumerate(rows):
            path = [0, *gold[i, : len(words)], 0]
            np.add.at(self.pairs, (path[:-1], path[1:]), 1)

    def value_and_slopes(self, weights: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        n, t, k = self.gold.shape
        e = weights[self.at].sum(axis=2) + self.forbid
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = e[:, 0] + steps[0]
        for j in range(1, t):
            alpha[:, j] = np.where(self.mask[:, j, None], _lse(alpha[:, j - 1, :, None] + steps, 1) + e[:, j], alpha[:, j - 1])
        beta[:, -1] = steps[:, 0]
        for j in range(t - 2, -1, -1):
            beta[:, j] = np.where(self.mask[:, j + 1, None], _lse(steps + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2), steps[:, 0])
        z = _lse(alpha[:, -1] + steps[:, 0], 1)
        own = np.exp(alpha + beta - z[:, None, None]) * self.mask[..., None]
        two = (np.exp(alpha[:, :-1, :, None] + steps + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * self.mask[:, 1:, None, None]).sum(axis=(0, 1))
        last = self.mask & ~np.concatenate([self.mask[:, 1:], np.zeros((n, 1), bool)], axis=1)
        two[0] += own[:, 0].sum(axis=0)
        two[:, 0] += own[last].sum(axis=0)
        value = float((e * self.gold).sum() + (self.pairs * steps).sum() - z.sum() - self.penalty / 2 * ((weights**2).sum() + (steps**2).sum()))
        gw = np.zeros_like(weights)
        flat, diff = self.at[self.mask].ravel(), np.repeat((self.gold - own)[self.mask], self.width, axis=0)
        for label in range(k):
            gw[:, label] = np.bincount(flat, diff[:, label], len(weights))
        gw -= self.penalty * weights
        gw[-1] = 0
        return value, gw, self.pairs - two - self.penalty * steps


def train(rows: list[tuple[list[str], list[str]]] | None = None, rounds: int = 120, penalty: float = 0.3) -> Model:
    """The CRF of highest penalised likelihood of the labelled rows, near enough."""
    goal = Likelihood(rows or labelled_rows(), penalty)
    model = Model(goal.names, np.zeros((len(goal.names) + 1, len(LABELS))), np.zeros((len(LABELS),) * 2))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.weights, model.steps)]
    for step in range(1, rounds + 1):
        _, *slopes = goal.value_and_slopes(model.weights, model.steps)
        for p, g, m in zip((model.weights, model.steps), slopes, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p += 0.2 * m[0] / (1 - 0.9**step) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return model


# --- decoding -------------------------------------------------------------------------------


def viterbi(model: Model, runs: list[np.ndarray]) -> list[np.ndarray]:
    """The best labels of each run of emissions, between words that are outside. Runs of
    like length go in one batch of at most ``CELLS`` words with their padding; a longer run goes
    alone, in memory by its own length."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
    order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
    groups: list[list[int]] = []
    for i in order:
        if groups and len(groups[-1]) < 512 and (len(groups[-1]) + 1) * len(runs[i]) <= CELLS:
            groups[-1].append(i)
        else:
            groups.append([i])
    for group in groups:
        lengths = np.array([len(runs[i]) for i in group])
        n, t, k = len(group), int(lengths.max()), len(LABELS)
        back = np.zeros((t, n, k), np.int8)
        ends, live = np.zeros((n, k)), n
        v = np.array([runs[i][0] for i in group]) + model.steps[0]
        ends[lengths == 1] = v[lengths == 1]
        for j in range(1, t):
            done = int(np.searchsorted(lengths, j, side="right"))  # runs are in order of length
            x = v[done - n + live :, :, None] + model.steps
            live = n - done
            back[j, done:] = x.argmax(axis=1)
            v = x.max(axis=1) + np.array([runs[i][j] for i in group[done:]])
            over = lengths[done:] == j + 1
            ends[done:][over] = v[over]
        state = (ends + model.steps[:, 0]).argmax(axis=1)
        path = np.zeros((n, t), np.int8)
        for j in range(t - 1, -1, -1):
            open_ = lengths > j
            path[open_, j] = state[open_]
            state = np.where(open_, back[j, np.arange(n), state], state)
        for a, i in enumerate(group):
            out[i] = path[a, : lengths[a]].astype(int)
    return out


def _plausible(kind: str, text: str) -> bool:
    digits = len(_DIGIT.findall(text))
    if kind == "phone":
        return 7 <= digits <= 15
    if kind == "card":
        return 13 <= digits <= 19
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return 0 < text.find("@") < len(text) - 1


def _neighbours(text: str, a: int, b: int) -> tuple[str, str]:
    """The whole words before ``a`` and after ``b``, however far; empty if there is none."""
    width = 64
    while True:
        part = text[max(0, a - width) : a]
        found = part.split()
        if width >= a or len(found) > 1 or (found and part[0].isspace()):
            break
        width *= 4
    before = found[-1] if found else ""
    width = 64
    while True:
        part = text[b : b + width]
        found = part.split()
        if b + width >= len(text) or len(found) > 1 or (found and part[-1].isspace()):
            break
        width *= 4
    return before, found[0] if found else ""


def crf_spans(text: str, words: list[tuple[int, int]], path: np.ndarray, free: Callable[[int, int], bool]) -> Iterator[Span]:
    """The spans that the labels of a run of words tell, where they are ``free``. Neighbours of one kind may have been
    labelled as one: of each label the longest span from its first word on that is plausible is taken, of up to
    ``MOST_WORDS`` words, and then the next one after it. As a word is taken once, no two spans overlap."""
    j = 0
    while j < len(path):
        if LABELS[path[j]][0] == "O":
            j += 1
            continue
        kind, first = LABELS[path[j]][2:], j
        j += 1
        while j < len(path) and LABELS[path[j]] == "I-" + kind:
            j += 1
        while first < j:
            a, b = words[first]
            start = a + core(text[a:b])[0]
            for last in range(min(j, first + MOST_WORDS), first, -1):
                c, d = words[last - 1]
                end = c + core(text[c:d])[1]
                if start < end and _plausible(kind, text[start:end]) and free(start, end):
                    yield kind, start, end
                    first = last
                    break
            else:
                first += 1


def all_spans(texts: list[str | None], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Of each whole text: the spans of the patterns, and all spans, by kind and start. The
    CRF's spans count where they overlap none of the patterns', which may overlap each other."""
    base = [base_spans(t or "") for t in texts]
    extra: list[list[Span]] = [[] for _ in texts]
    waiting: list[tuple[int, list[tuple[int, int]], np.ndarray]] = []

    def decode() -> None:
        for (i, words, _), path in zip(waiting, viterbi(model, [e for _, _, e in waiting]), strict=True):
            taken = sorted((s, e) for _, s, e in base[i])
            starts = [s for s, _ in taken]
            reach = list(itertools.accumulate((e for _, e in taken), max))

            def free(start: int, end: int, starts=starts, reach=reach) -> bool:
                """Whether no pattern's span that starts before the end reaches over the start."""
                n = bisect.bisect_left(starts, end)
                return not n or reach[n - 1] <= start

            extra[i] += crf_spans(texts[i], words, path, free)
        waiting.clear()

    pending = 0
    for i, t in enumerate(texts):
        for m in _RUN.finditer(t or ""):
            words = [(m.start() + w.start(), m.start() + w.end()) for w in _WORD.finditer(m[0])]
            waiting.append((i, words, model.word_emissions([t[a:b] for a, b in words], *_neighbours(t, *m.span()))))
            pending += len(words)
            if pending >= CELLS:
                decode()
                pending = 0
    decode()
    by = lambda s: (KINDS.index(s[0]), s[1])
    return [(sorted(b, key=by), sorted(b + x, key=by)) for b, x in zip(base, extra, strict=True)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping ones by the first's."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone and
    base_sha256 of the patterns' spans, and spans, all of them.

    Null texts are empty: counts 0, the digest of nothing, no spans. Offsets are code
    points of the whole text. Spans of the patterns may overlap across kinds and all stay; the
    CRF's overlap neither each other nor the patterns'. Runs of digits of any length are read in
    time by their length. Repeated rows each get a row; an empty table gives no rows; other columns
    are ignored.
    """
    model = model or train()

    def found(batches):
        for batch in batches:
            spans = all_spans(batch.column("text").to_pylist(), model)
            counts = [pa.array([sum(s[0] == k for s in b) for b, _ in spans], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in spans], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, digests, pa.array([joined(s) for _, s in spans], pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(found, f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def mask_personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns; in ``text``, personal data is masked,
    and ``n_chars``, if there is one, counts the new text. Null texts stay null."""
    model = model or train()

    def clean(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            texts = [t if t is None else masked(t, s) for t, (_, s) in zip(texts, all_spans(texts, model), strict=True)]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return map_rows(docs, clean)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
