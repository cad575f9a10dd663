"""Toxicity by compression distance: two zstandard dictionaries, of ordinary and of toxic text.

A window is a word between spaces; its gain is how much shorter it is with the toxic dictionary than with the ordinary one. The
dictionaries are separate, both trained by zstandard. Training takes turns, as toxic texts are mostly made of ordinary words:
words of ordinary texts that gain are false alarms and join the ordinary dictionary; what gains in toxic texts, each text's
together, is the text that the toxic dictionary is trained on next, and zstandard keeps of it what many texts share. How large
that dictionary is, thresholds and weights are calibrated on labelled documents kept out of both.
(Windows of two to four words, measured the same way, find fewer toxic documents; the README has the figures.)
"""

from __future__ import annotations

import functools
import math
import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import extended, in_arrow, slices, without
from tallyframe.llm.compression import lengths, letters

ADDED = {"score": "double", "predicted": "int"}
#: Gains, in bytes, from which a window counts, and from which it counts in training.
GAINS, LEAST_GAIN = (2, 3, 4), 2
#: Bounds of the training, which only shape the dictionaries: windows of 12 words that the ordinary dictionary is trained on,
#: and false alarms that each round adds to it, the most frequent first.
TRAINING_WINDOWS, ALARMS = 60_000, 6000
#: Sizes of the toxic dictionary, in bytes, among which calibration chooses.
TOXIC_SIZES = (1024, 2048, 3072, 4096, 6144)


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]  # of a document's features, the last the constant


#: How windows are compressed while the dictionaries are trained, closely, and afterwards.
_REACH = {"window_log": 19, "hash_log": 17, "chain_log": 19}
CLOSE = {"strategy": zstandard.STRATEGY_BTOPT, "min_match": 3, "search_log": 5, "target_length": 64, **_REACH}
QUICK = {"strategy": zstandard.STRATEGY_LAZY2, "min_match": 4, "search_log": 4, "target_length": 16, **_REACH}


class _Gains(dict):
    """word -> the gain of its window; forgets all when it holds too many."""

    def __init__(self, ordinary: bytes, toxic: bytes, how: dict = QUICK, keep: int = 200_000) -> None:
        self.measures, self.keep = (lengths(ordinary, **how), lengths(toxic, **how)), keep

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.keep:
            self.clear()
        a, b = self.measures
        window = b" " + word + b" "
        gain = a(window) - b(window)
        if len(word) <= 64:
            self[word] = gain
        return gain


def features(words: list[bytes], gains: _Gains) -> list[float]:
    g = np.fromiter(map(gains.__getitem__, words), np.int64, len(words))
    n = max(1, len(g))
    counts = [int((g >= x).sum()) for x in GAINS]
    top = np.sort(g)[-3:] if len(g) else np.zeros(1)
    return [*(100 * c / n for c in counts), *(math.log1p(c) for c in counts), float(top[-1]), float(top.mean()), math.log1p(len(g)), 1.0]


def _trained(samples: list[bytes], size: int, segment: int = 32) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:  # too few or too small
        return b"".join(samples)[-size:]


def _fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[-1] = 1.0
    z, w = x / scale, np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def train(toxic: list[bytes], ordinary: list[bytes], prior: float, ordinary_size: int = 128 << 10, toxic_sizes: tuple[int, ...] = TOXIC_SIZES, rounds: int = 5) -> Model:
    """From letters of labelled texts; prior: the share of toxic ones among all labelled texts. ordinary_size is that of the
    ordinary dictionary at first; false alarms enlarge it. Of toxic_sizes the one whose scores are likeliest on the labelled
    texts that are kept out of both dictionaries is taken."""
    toxic, ordinary = sorted(toxic), sorted(ordinary)
    shuffle = random.Random(0).shuffle
    shuffle(toxic)
    shuffle(ordinary)
    if not toxic or not ordinary:
        p = min(1 - 1e-3, max(1e-3, prior))
        return Model(b"", b"", (0.0,) * (2 * len(GAINS) + 3) + (math.log(p / (1 - p)),))
    held_t, held_o = toxic[::3] if len(toxic) > 5 else toxic, ordinary[::3] if len(ordinary) > 5 else ordinary
    own_t, own_o = [t for i, t in enumerate(toxic) if i % 3 or len(toxic) <= 5], [t for i, t in enumerate(ordinary) if i % 3 or len(ordinary) <= 5]
    of_words = Counter(w for t in own_o for w in set(t.split()))

    def runs(texts: list[bytes]) -> list[bytes]:
        out = []
        for t in texts:
            ws = t.split()
            out += [b" " + b" ".join(ws[i : i + 12]) for i in range(0, len(ws), 12)]
        shuffle(out)
        return out[:TRAINING_WINDOWS]

    def told(gains: _Gains) -> list[bytes]:
        """Of each toxic text the windows that gain."""
        kept = (b" ".join(w for w in t.split() if gains[w] >= LEAST_GAIN) for t in own_t)
        return [b" %b " % k for k in kept if k]

    base, false_alarms = _trained(runs(own_o), ordinary_size), b""
    samples, size = runs(own_t), max(toxic_sizes)
    for _ in range(rounds):
        loud = _trained(samples, size)
        gains = _Gains(base + false_alarms, loud, CLOSE)
        alarms = sorted((-n, w) for w, n in of_words.items() if gains[w] > LEAST_GAIN)[:ALARMS]
        false_alarms += b"".join(b" " + w for _, w in alarms)
        again = told(_Gains(base + false_alarms, loud, CLOSE))
        if not again:
            break
        samples = again
    y = np.array([1.0] * len(held_t) + [0.0] * len(held_o))
    weight = np.where(y == 1, prior / len(held_t), (1 - prior) / len(held_o)) * len(y)
    best = None
    for size in toxic_sizes:
        loud = _trained(samples, size)
        gains = _Gains(base + false_alarms, loud)
        x = np.array([features(t.split(), gains) for t in held_t + held_o])
        w = _fitted(x, y, weight)
        loss = float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * np.clip(x @ w, -30, 30))).sum())
        if best is None or loss < best[0]:
            best = loss, Model(base + false_alarms, loud, tuple(float(v) for v in w))
    return best[1]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", toxic_texts: int = 2000, ordinary_texts: int = 4000, most_bytes: int = 6000) -> Model:
    """Learn from a bounded sample of labelled rows: about toxic_texts keys with label 1 and ordinary_texts with label 0,
    chosen by a hash of the key; of a longer text, most_bytes of its letters from a place that depends on the text.
    Rows with another or no label, or without a text, teach nothing. The sample of labels is drawn before it meets the texts,
    so that they are scanned and not shuffled."""
    marks = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).where("label IN (0, 1)")
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    unit = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    # repeated and null keys share a hash: the limits bound the sample whatever the keys are
    drawn = [marks.where((F.col("label") == label) & (unit < size / max(1, n))).limit(2 * size) for label, size, n in ((1, toxic_texts, n1), (0, ordinary_texts, n0))]
    sample = drawn[0].union(drawn[1])
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(sample), "key").select("label", "text").limit(2 * (toxic_texts + ordinary_texts))  # of a bounded number of rows

    def pieces(batches):
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                b = letters(t)
                at = len(b) * (len(b) % 97) // 97 if len(b) > most_bytes else 0
                out.append(b[min(at, max(0, len(b) - most_bytes)) :][:most_bytes])
            yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), pa.array(out, pa.binary())], names=["label", "piece"])

    found = in_arrow(chosen, pieces, "label int, piece binary").collect()
    return train([bytes(r.piece) for r in found if r.label == 1], [bytes(r.piece) for r in found if r.label == 0], n1 / max(1, n1 + n0))


@functools.lru_cache(maxsize=2)
def _gains(ordinary: bytes, toxic: bytes) -> _Gains:
    return _Gains(ordinary, toxic)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: toxic is likelier) and predicted (1 from 0.5 on).

    Null and empty texts are scored as texts without words, very long ones whole; rows that repeat get the same score each,
    an empty table gives an empty one. Columns with the added names, in any letter case, are replaced, others stay.
    """
    base = without(docs, list(ADDED))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        gains, weights = _gains(m.ordinary, m.toxic), np.array(m.weights)
        for batch in (part for whole in batches for part in slices(whole, text)):
            x = [features(letters(t).split(), gains) for t in batch.column(text).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array(x).reshape(len(x), -1) @ weights, -30, 30))) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names, *ADDED])

    return in_arrow(base, run, extended(base, **ADDED))
