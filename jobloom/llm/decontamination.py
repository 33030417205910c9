"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND,
then question and answer overlap.

Test items are indexed; training passages are the queries. An item's score for a passage is
its BM25 score over the score that the item has for itself, so one threshold serves items
of all lengths, and what must be found is fixed: all items at or above it. Block-max
WAND moves over the postings of a passage's terms and skips items whose upper bounds
stay below. A hit is verified on the text: enough of the item's word shingles, in the question
(all but its last sentence) and the answer (the last) alike.

Before the loop of pivots, the sums of block maxima are taken in numpy for all passages of a
text at once, over *strong* postings only: of each item, its least weights are weak as long as
they sum to at most ``WEAK``. A passage that reaches the threshold reaches the threshold
less ``WEAK`` on strong postings alone, so none is missed, and the common words of the items,
which are in all texts, are never summed.

Scale: one pass over the texts for up to ``PASS_BYTES`` of item text (some 60,000 items), with
the indexes of all those items in the task: arrays of a few times that size, broadcast once
and kept by a Python worker. More items make more passes within the same stage where documents
are filtered. Items are indexed with others of like length, as a passage is as long as
the longest of them twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.tables import map_rows, table

K1, B = 1.2, 0.75
THRESHOLD = 0.6  # of an item's score for itself
WEAK = 0.1  # of an item's score for itself, at most, that its weak postings have together
SHINGLE = 5
MIN_OVERLAP = 0.8  # of an item's word shingles
MIN_PART = 0.5  # of those of its question, and of the words of its answer
BLOCK = 4  # postings in a block, and items in a block of the strong maxima
PASS_BYTES = 32 << 20  # of item text that is indexed for one pass
MIN_PASSAGE, LENGTH_STEP = 128, 4  # words; items of up to 64, 256, 1024, … words have an index each
CHUNK_CELLS = 1 << 22  # passages times blocks summed at once for a long text

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: ASCII that is no letter or digit becomes a space; other bytes stay.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def shingles(tokens: list[bytes]) -> set[tuple[bytes, ...]]:
    """Runs of ``SHINGLE`` words; of fewer words, the whole sequence."""
    return {tuple(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))} if tokens else set()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of all sentences but the last, and of the last. Of one sentence, its
    last quarter is the answer."""
    parts = [w for w in map(words, _SENTENCE.split(text)) if w]
    if len(parts) == 1:
        cut = len(parts[0]) - max(1, len(parts[0]) // 4)
        return parts[0][:cut], parts[0][cut:]
    return [w for p in parts[:-1] for w in p], parts[-1] if parts else []


@dataclass
class Postings:
    """A term's items in order, their weights, the largest weight, and that of each block."""

    items: np.ndarray
    weights: np.ndarray
    block_bounds: np.ndarray

    @property
    def bound(self) -> float:
        return float(self.block_bounds.max())


class Index:
    """An inverted index of items (id, text); those without a word are left out. All arrays
    are flat, by term: postings of term ``t`` are those from ``start[t]`` to ``start[t + 1]``."""

    def __init__(self, items: list[tuple[object, str]]):
        kept = [(i, t, w) for i, t in items if (w := words(t))]
        self.ids = [i for i, _, _ in kept]
        self.tokens = [w for _, _, w in kept]
        self.texts = [t for _, t, _ in kept]
        self.passage = max([MIN_PASSAGE, *(2 * len(w) for w in self.tokens)])
        self.term: dict[bytes, int] = {}
        pairs = [self.term.setdefault(w, len(self.term)) * len(kept) + n for n, tokens in enumerate(self.tokens) for w in tokens]
        pair, tf = np.unique(np.array(pairs, np.int64), return_counts=True)
        term, item = np.divmod(pair, max(1, len(kept)))
        n_terms, lengths = len(self.term), np.array([len(w) for w in self.tokens])
        df = np.bincount(term, minlength=n_terms)
        idf = np.log(1 + (len(kept) - df + 0.5) / (df + 0.5))
        mean = lengths.mean() if len(kept) else 1.0
        raw = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))
        self.items = item.astype(np.int32)
        self.weights = raw / np.bincount(item, raw, len(kept))[item] if len(kept) else raw
        self.start = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
        # The largest weight of each block of a term's postings, flat by term.
        n_blocks = -(-df // BLOCK)
        self.block_start = np.concatenate([[0], np.cumsum(n_blocks)]).astype(np.int64)
        firsts = np.repeat(self.start[:-1] - BLOCK * self.block_start[:-1], n_blocks) + BLOCK * np.arange(int(n_blocks.sum()))
        self.block_bounds = np.maximum.reduceat(self.weights, firsts) if len(firsts) else np.zeros(0)
        self.n_blocks = max(1, -(-len(kept) // BLOCK))
        self.strong = self._maxima(term, item, self._is_strong(item))
        self.whole = self._maxima(term, item, np.ones(len(item), bool))

    def _is_strong(self, item: np.ndarray) -> np.ndarray:
        order = np.lexsort((self.weights, item))
        sums = np.cumsum(self.weights[order])
        first = np.searchsorted(item[order], np.arange(len(self.ids)))
        before = np.concatenate([[0.0], sums])[first]
        strong = np.zeros(len(item), bool)
        strong[order] = sums - before[item[order]] > WEAK
        return strong

    def _maxima(self, term: np.ndarray, item: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The largest weight of each term in each block of items, flat by term: where a term starts, blocks, weights."""
        cell, at = np.unique(term[of] * self.n_blocks + item[of] // BLOCK, return_inverse=True)
        most = np.zeros(len(cell), np.float32)
        np.maximum.at(most, at, self.weights[of].astype(np.float32))
        return np.searchsorted(cell // self.n_blocks, np.arange(len(self.term) + 1)), (cell % self.n_blocks).astype(np.int32), most

    def _sums(self, maxima: tuple[np.ndarray, np.ndarray, np.ndarray], row: np.ndarray, terms: np.ndarray, rows: int) -> np.ndarray:
        """For each row, the sums of block maxima over its terms, by block."""
        start, block, most = maxima
        n = start[terms + 1] - start[terms]
        # Places of all entries of these terms, one term after the other.
        at = np.repeat(start[terms] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(np.repeat(row, n) * self.n_blocks + block[at], most[at], rows * self.n_blocks).reshape(rows, self.n_blocks)

    def postings(self, t: int) -> Postings:
        a, b = self.start[t], self.start[t + 1]
        return Postings(self.items[a:b], self.weights[a:b], self.block_bounds[self.block_start[t] : self.block_start[t + 1]])

    def search(self, terms: list[int], least: float = THRESHOLD) -> dict[int, float]:
        """All items whose score for these different terms is at least ``least``."""
        lists = [self.postings(t) for t in terms]
        bounds = [x.bound for x in lists]
        at = [0] * len(lists)
        now = [int(x.items[0]) for x in lists]
        order = list(range(len(lists)))
        found: dict[int, float] = {}
        slack = least - 1e-9
        while order:
            order.sort(key=now.__getitem__)
            total, pivot = 0.0, -1
            for n, k in enumerate(order):
                total += bounds[k]
                if total >= slack:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = now[order[pivot]]
            while pivot + 1 < len(order) and now[order[pivot + 1]] == item:
                pivot += 1
            head = order[: pivot + 1]
            # The blocks in which the lists of the head would hold the pivot item.
            total, end = 0.0, None
            for k in head:
                x = lists[k].items
                b = (min(at[k] + int(np.searchsorted(x[at[k] :], item)), len(x) - 1)) // BLOCK
                total += float(lists[k].block_bounds[b])
                last = int(x[min((b + 1) * BLOCK, len(x)) - 1])
                if last >= item:
                    end = last if end is None else min(end, last)
            if total < slack:
                # No item up to the nearest block end, or the next list's item, can do.
                after = item + 1 if end is None else end + 1
                if pivot + 1 < len(order):
                    after = min(after, now[order[pivot + 1]])
                after = max(after, item + 1)
            elif now[order[0]] == item:
                score = sum(float(lists[k].weights[at[k]]) for k in head)
                if score >= slack:
                    found[item] = score
                after = item + 1
            else:
                after = item
            for k in head:
                if now[k] < after:
                    x = lists[k].items
                    at[k] += int(np.searchsorted(x[at[k] :], after))
                    now[k] = int(x[at[k]]) if at[k] < len(x) else -1
            order = [k for k in order if now[k] >= 0]
        return found

    def _candidates(self, terms: np.ndarray, step: int) -> list[int]:
        """Numbers of the passages (two neighbouring half passages of ``step`` words) in which some
        block of items has strong maxima that sum to the threshold less ``WEAK``. Terms count
        once in each half."""
        place = np.flatnonzero(terms < len(self.term))
        pair = np.unique(place // step * np.int64(len(self.term) + 1) + terms[place])
        half, t = np.divmod(pair, len(self.term) + 1)
        halves, out = -(-len(terms) // step), []
        chunk = max(1, CHUNK_CELLS // self.n_blocks)
        for a in range(0, max(1, halves - 1), chunk):
            i, j = np.searchsorted(half, [a, a + chunk + 1])
            if i < j:
                bound = self._sums(self.strong, half[i:j] - a, t[i:j], min(chunk, halves - a) + 1)
                found = np.flatnonzero((bound[:-1] + bound[1:]).max(axis=1) >= THRESHOLD - WEAK - 1e-4) + a
                out += found[found < max(1, halves - 1)].tolist()
        return out

    def hits(self, tokens: list[bytes]) -> Iterator[tuple[object, float, float, float, float]]:
        """Of the words of a whole text: (item id, score, overlap, question overlap, answer
        overlap) of each verified item, with its best passage."""
        if not tokens or not self.ids:
            return
        none = len(self.term)
        terms = np.fromiter(map(self.term.get, tokens, repeat(none)), np.int64, len(tokens))
        step = self.passage // 2
        best: dict[int, tuple[float, float, float, float]] = {}
        for n in self._candidates(terms, step):
            a, b = n * step, n * step + self.passage
            seen = np.unique(terms[a:b])
            seen = seen[seen < none]
            if self._sums(self.whole, np.zeros(len(seen), np.int64), seen, 1).max() < THRESHOLD - 1e-4:
                continue
            near = None
            for item, score in self.search(seen.tolist()).items():
                near = near or (shingles(tokens[a:b]), set(tokens[a:b]))
                own = self.tokens[item]
                question, answer = question_answer(self.texts[item])
                share = lambda x, y: len(x & y) / len(x) if x else 1.0
                whole = share(shingles(own), near[0]) if len(own) >= SHINGLE else float(_within(own, tokens[a:b]))
                asked = share(shingles(question), near[0]) if len(question) >= SHINGLE else float(not question or _within(question, tokens[a:b]))
                answered = share(set(answer), near[1])
                if whole >= MIN_OVERLAP and asked >= MIN_PART and answered >= MIN_PART:
                    best[item] = max(best.get(item, (0.0,) * 4), (score, whole, asked, answered))
        for i, x in sorted(best.items()):
            yield self.ids[i], *x


def _within(few: list[bytes], many: list[bytes]) -> bool:
    return any(many[i : i + len(few)] == few for i in range(len(many) - len(few) + 1))


def by_length(items: list[tuple[object, str]]) -> list[Index]:
    """An index for each class of lengths that occurs."""
    classes: dict[int, list[tuple[object, str]]] = {}
    for i, t in items:
        top = MIN_PASSAGE // 2
        while top < len(words(t)):
            top *= LENGTH_STEP
        classes.setdefault(top, []).append((i, t))
    return [Index(classes[c]) for c in sorted(classes)]


def indexes(benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> Iterator[list[Index]]:
    """The indexes of each pass over the texts: ``benchmark`` (item_id, text) in shards of at
    most about ``pass_bytes`` of text."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // pass_bytes))
    for s in range(shards):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s)
        yield by_length(sorted({(r["item_id"], r["text"]) for r in own.toLocalIterator()}))


def _all_hits(own: list[Index], text: str | None) -> Iterator[tuple[object, float, float, float, float]]:
    tokens = words(text)
    for index in own:
        yield from index.hits(tokens)


def contaminated(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap) of each row of
    ``docs`` (doc_id, text) and each item of ``benchmark`` (item_id, text) that it contains.

    Null texts contain nothing; items with null text or id, or without a word, are not
    sought. Ids may be of any type that sorts. Items of the same text are all reported. Rows that
    repeat are each reported. Texts are searched whole. BM25 counts its words over the items of like
    length of a pass. Empty tables give no rows; other columns are ignored.
    """
    rows, out = docs.select("doc_id", "text"), None
    names = ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"]
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, " + ", ".join(f"{n} double" for n in names[2:])
    item_type = benchmark.select("item_id").limit(0).toArrow().schema.field("item_id").type
    for own in indexes(benchmark, pass_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(own)  # a few times pass_bytes

        def found(batches, sent=sent):
            for batch in batches:
                at, hits = [], []
                for i, t in enumerate(batch.column("text").to_pylist()):
                    for h in _all_hits(sent.value, t):
                        at.append(i)
                        hits.append(h)
                columns = list(zip(*hits, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(columns[0], item_type), *[pa.array(c, pa.float64()) for c in columns[1:]]], names=names)

        part = rows.mapInArrow(found, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no item. A filter
    within the pass over the texts: nothing is joined or shuffled."""
    for own in indexes(benchmark, pass_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(own)

        def clean(batches, sent=sent):
            for batch in batches:
                yield batch.filter(pa.array([next(_all_hits(sent.value, t), None) is None for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = map_rows(docs, clean)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
