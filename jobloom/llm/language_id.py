"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams of 1 to 3 characters that
occur in both (blended spectrum, presence only), over the square root of the product of
their own numbers. N-grams are numbered by a hash of ``BITS`` bits; none is left out: an
n-gram that no landmark has adds nothing to a product and still counts in a text's own
number. A Nyström approximation with landmark texts gives features; one-versus-rest kernel
ridge regression on them gives a score for each language. A batch of texts is scored
as presence bits times landmark bits, then times weights.

Fitting sees at most ``PER_CLASS`` training rows of each language, and fewer of each (not
fewer than ``LEAST_PER_CLASS``) beyond ``SAMPLE`` rows in all; they are sent to the driver as lists of
n-gram numbers. Each language has ``LANDMARKS_PER_CLASS`` landmarks or more, so languages of
rare scripts keep their n-grams. The model has a few kilobytes a landmark. Scoring is
one pass over the whole texts, without a shuffle, in matrix products of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.sampling import held_out, per_class_sample
from jobloom.llm.tables import table

MODULUS, HELD_OUT = 4, 2
PER_CLASS = 400  # bound of the training sample, rows of each language
SAMPLE, LEAST_PER_CLASS = 40_000, 20  # of all languages together; but so many of each in any case
LANDMARKS, LANDMARKS_PER_CLASS = 128, 2
RIDGE = 1e-2
BITS = 18
CHUNK = 1 << 20  # characters taken at once of a very long text
CELLS = 1 << 24  # of a matrix
UNKNOWN = "und"

_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point to its lower-case letter, or to a space if it is no letter."""
    if not _FOLD:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(table)
    return _FOLD[0]


def _numbers(codes: np.ndarray) -> np.ndarray:
    """Numbers of the n-grams of 1 to 3 characters of a sequence."""
    one = codes * np.uint32(2654435761)
    two = one[:-1] * np.uint32(31) + codes[1:] * np.uint32(2246822519)
    three = two[:-1] * np.uint32(37) + codes[2:] * np.uint32(3266489917)
    grams = np.concatenate([one, two, three])
    grams ^= grams >> np.uint32(15)
    grams *= np.uint32(2246822519)
    return grams >> np.uint32(32 - BITS)


def ngram_chunks(text: str | None, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """Numbers of the n-grams of a whole text, with repeats, chunk by chunk; nothing without
    a letter. Runs of other characters than letters are one space, and so are the text's
    two ends. The last two characters of a chunk go before the next one, so that chunks
    neither add n-grams nor lose any."""
    carry = np.array([32], np.uint32)
    size = len(text or "")
    for at in range(0, size, chunk):
        codes = _fold()[np.frombuffer(text[at : at + chunk].encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes = np.concatenate([carry, codes, [np.uint32(32)] if at + chunk >= size else []]).astype(np.uint32, copy=False)
        letter = codes != 32
        keep = letter[1:] | letter[:-1]
        keep[: len(carry) - 1] = True
        codes = codes[np.concatenate([[True], keep])]
        if len(codes) == 1 and codes[0] == 32:
            continue
        yield _numbers(codes)
        carry = codes[-2:]


def ngrams(text: str | None) -> np.ndarray:
    """Numbers of the n-grams of a whole text, unique and sorted; empty without a letter."""
    return np.unique(np.concatenate([np.zeros(0, np.uint32), *map(np.unique, ngram_chunks(text))]))


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # n-gram number to its column among the landmarks' n-grams, ``width`` if none has it
    width: int
    marks: list[np.ndarray]  # of each landmark, the columns of its n-grams
    norms: np.ndarray  # of the landmarks
    weights: np.ndarray  # landmarks + 1 by languages

    def presence(self, texts: list[Iterable[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Bits by column of texts given by chunks of n-grams, and their numbers of n-grams."""
        bits, own = np.zeros((len(texts), self.width + 1), np.float32), np.zeros(len(texts), np.float32)
        seen = np.zeros(1 << BITS, bool)
        for i, chunks in enumerate(texts):
            for grams in chunks:
                seen[grams] = True
            found = np.flatnonzero(seen)
            own[i] = len(found)
            bits[i, self.column[found]] = 1
            seen[found] = False
        return bits[:, : self.width], own

    def _blocks(self) -> Iterator[np.ndarray]:
        """Landmark bits, some landmarks at a time; kept if they are one block."""
        if (kept := self.__dict__.get("_kept")) is not None:
            yield kept
            return
        step = max(1, CELLS // max(1, self.width))
        for at in range(0, len(self.marks), step):
            block = np.zeros((self.width, len(self.marks[at : at + step])), np.float32)
            for i, columns in enumerate(self.marks[at : at + step]):
                block[columns, i] = 1
            if step >= len(self.marks):
                self._kept = block
            yield block

    def features(self, bits: np.ndarray, own: np.ndarray) -> np.ndarray:
        products = np.hstack([bits @ block for block in self._blocks()])
        return products / np.sqrt(np.maximum(own, 1))[:, None] / self.norms[None, :]

    def scores(self, texts: list[Iterable[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language, and whether there was any n-gram."""
        bits, own = self.presence(texts)
        k = self.features(bits, own)
        return np.hstack([k, np.ones((len(k), 1), np.float32)]) @ self.weights, own > 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_kept"}


def fit(grams: list[np.ndarray], labels: list[str]) -> Model:
    """A model of texts given by their n-grams, and their languages."""
    languages = sorted(set(labels))
    # Landmarks: in turn from each language, texts with many n-grams first.
    rich = np.argsort([-min(len(g), 300) for g in grams], kind="stable")
    turns: dict[str, int] = dict.fromkeys(languages, 0)
    turn = []
    for i in rich:
        turn.append(turns[labels[i]])
        turns[labels[i]] += 1
    marks = rich[np.argsort(turn, kind="stable")][: max(LANDMARKS, LANDMARKS_PER_CLASS * len(languages))]
    used = np.unique(np.concatenate([grams[i] for i in marks]))
    column = np.full(1 << BITS, len(used), np.int32)
    column[used] = np.arange(len(used))
    norms = np.sqrt([max(1, len(grams[i])) for i in marks]).astype(np.float32)
    model = Model(languages, column, len(used), [column[grams[i]] for i in marks], norms, np.zeros((0, 0), np.float32))
    step = max(1, CELLS // max(1, len(used)))
    k = np.vstack([model.features(*model.presence([[g] for g in grams[at : at + step]])) for at in range(0, len(grams), step)]).astype(np.float64)
    values, vectors = np.linalg.eigh(k[marks])
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    z = np.hstack([k @ root, np.ones((len(k), 1))])
    class_of = np.searchsorted(languages, labels)
    y = np.where(class_of[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    w = (len(labels) / len(languages) / np.bincount(class_of)[class_of])[:, None]
    beta = np.linalg.solve(z.T @ (w * z) + RIDGE * np.eye(z.shape[1]), z.T @ (w * y))
    model.weights = np.vstack([root @ beta[:-1], beta[-1:]]).astype(np.float32)
    return model


def train(docs: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """A model from the rows of ``docs`` (doc_id, text, lang) that are not held out and
    have a language and a text; None if there are none."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), MODULUS, HELD_OUT))

    def counted(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([ngrams(t).astype(np.int32) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], names=["lang", "grams"])

    classes = rows.select("lang").distinct().count()
    per_class = min(per_class, max(LEAST_PER_CLASS, SAMPLE // max(1, classes)))
    sample = per_class_sample(rows, "lang", "doc_id", "text", per_class)
    found = sample.select("lang", "text").mapInArrow(counted, "lang string, grams array<int>").toArrow()
    own = [np.asarray(g.values, np.uint32) for g in found.column("grams")]
    pairs = sorted(((lang, g) for lang, g in zip(found.column("lang").to_pylist(), own, strict=True) if len(g)), key=lambda p: (p[0], len(p[1]), p[1].tobytes()))
    return fit([g for _, g in pairs], [lang for lang, _ in pairs]) if pairs else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred, score.

    ``und`` with score 0 if the text is null or has no letter, or if there was nothing to
    learn from. The score is the softmax share of the predicted language. Equal scores
    go to the first language by code point. Texts are read whole. Repeated rows are each
    predicted; an empty table gives no rows; other columns are ignored.
    """

    def scored(batches):
        for batch in batches:
            step = max(1, min(256, CELLS // max(1, model.width))) if model else 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = [ngram_chunks(t) for t in part.column("text").to_pylist()]
                if model:
                    f, known = model.scores(texts)
                    f = 4 * f.astype(np.float64)
                    p = np.exp(f - f.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                else:
                    known = [False] * part.num_rows
                lang = [model.languages[p[i].argmax()] if k else UNKNOWN for i, k in enumerate(known)]
                score = [float(p[i].max()) if k else 0.0 for i, k in enumerate(known)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id"), MODULUS, HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(scored, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
