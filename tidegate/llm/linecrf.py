"""Document quality from line labels: a linear-chain conditional random field calls every line good
or bad, and forward-backward marginals, weighted by line length, make the document's quality.

A line is described by shares of byte classes, word lengths, repetition and how it ends; its own
features and those of the lines before and after it are the observations. Lines are not labelled,
documents are: training starts with every line bearing its document's label and then, for a few
turns, gives the lines of bad documents their own marginals as soft labels, held to the document's
label by a prior, so that clean lines of bad documents stop counting as bad. A logistic curve over
the weighted share of good lines is calibrated on the same sample.

The field is fitted on a sample bounded by MAX_EXAMPLES documents, MAX_BYTES of text and MAX_LINES
lines (the first by a hash of the id) and scores all of them. Only a line's three products with the
weights are kept, features live for SLICE_LINES lines at a time, and what a worker holds is bounded
by the lines of a chunk, or of one longer document.

Defined cases: null and empty texts are one empty line, which is scored like any other; a text has
as many lines as it has line feeds and one more, and texts of more than RUN lines get the same exact
marginals in blocks; rows that repeat are scored each; labels other than 0 and 1 count as none; of
labelled rows with the same id the smallest text is learnt from; without labels of both kinds every
score is the share of good labels (1 without any); an empty table gives no rows. Columns beside the
id and the text aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import common, crf, toxicity

#: What the field is fitted on at most. A longer document than RUN lines is fitted in runs of that many.
MAX_EXAMPLES, MAX_BYTES, MAX_LINES = 1500, 16 << 20, 200_000
RUN = 2000
CHUNK_BYTES = 4 << 20
#: Features are made for so many lines and bytes at a time (one line at least).
SLICE_LINES, SLICE_BYTES = 20_000, 1 << 20
THRESHOLD = 0.7
TURNS, ROUNDS = 2, 30

#: Byte classes: letters low, high, digit, blank, sentence marks, other marks, bytes of non-ASCII.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[128:] = 6
N_CLASSES = 7
N_FEATURES = 2 * (N_CLASSES + 8)


def _features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Features of lines that end at ``ends``, the last at the end of ``data``. Nothing outside a
    line changes its features."""
    starts = np.r_[0, ends[:-1] + 1]
    size = ends - starts + 1
    kind = _CLASS[data]
    counts = np.stack([np.add.reduceat((kind == c).view(np.uint8), starts, dtype=np.int32) for c in range(N_CLASSES)], axis=1).astype(float)
    counts[:, 5] -= 1  # the line end
    n = np.maximum(size - 1, 1)[:, None]
    share = counts / n
    # words: where a blank or the start stands before another byte
    blank = (kind == 3) | (data == 10)
    before = np.r_[True, blank[:-1]]
    word = before & ~blank
    words = np.add.reduceat(word.view(np.uint8), starts, dtype=np.int32)
    same = np.zeros(len(data), bool)
    at = np.flatnonzero(word)
    if len(at) > 1:
        # a word that begins like the word before it in its line, and is as long, is likely its repeat
        line = np.searchsorted(ends, at)
        stop = np.minimum(np.r_[at[1:], len(data)], ends[line])
        key = data[at].astype(np.int64) * 1000 + np.minimum(stop - at, 999)
        for j in (1, 2):
            key = key * 257 + data[np.minimum(at + j, ends[line])]
        same[at[1:][(key[1:] == key[:-1]) & (line[1:] == line[:-1])]] = True
    repeats = np.add.reduceat(same.view(np.uint8), starts, dtype=np.int32)
    marks_end = np.add.reduceat(((kind == 5) & (data != 10) & np.r_[blank[1:], True]).view(np.uint8), starts, dtype=np.int32)
    last = data[np.maximum(ends - 1, 0)]
    w = np.maximum(words, 1)
    extra = np.stack(
        [
            np.log1p(size - 1) / 8,
            words == 0,
            np.minimum(counts[:, [0, 1, 2, 4, 5, 6]].sum(1) / w, 30) / 10,
            repeats / w,
            marks_end / w,
            np.isin(last, [46, 33, 63]) & (size > 1),
            np.minimum(words, 3) / 3,
            np.ones(len(size)),
        ],
        axis=1,
    )
    x = np.concatenate([share, extra], axis=1)
    return np.concatenate([x, np.sqrt(np.abs(x))], axis=1)


def line_features(bodies: list[bytes], made: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``made`` returns of the features of each slice of lines, end to end; lines by document;
    line lengths (in bytes, with the line end)."""
    data = np.frombuffer(b"\n".join(bodies) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    doc_ends = np.cumsum([len(b) + 1 for b in bodies]) - 1
    per_doc = np.diff(np.r_[0, np.searchsorted(ends, doc_ends, side="right")])
    out, first, at = [], 0, 0
    while first < len(ends):
        last = min(first + SLICE_LINES, max(first + 1, int(np.searchsorted(ends, at + SLICE_BYTES, side="right"))), len(ends))
        stop = int(ends[last - 1]) + 1
        out.append(made(_features(data[at:stop], ends[first:last] - at)))
        first, at = last, stop
    return np.concatenate(out), per_doc, np.diff(np.r_[-1, ends])


def beside(products: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Scores from each line's products with the weights of a line itself, of one after it and of
    one before it: own + (of the line before) + (of the line after), nothing beyond a document's ends."""
    first = np.zeros(len(products), bool)
    first[np.cumsum(per_doc) - per_doc] = True
    last = np.r_[first[1:], True]
    up, down = np.r_[0.0, products[:-1, 1]], np.r_[products[1:, 2], 0.0]
    return products[:, 0] + np.where(first, 0, up) + np.where(last, 0, down)


class Field:
    """Weights for the label "good" against "bad", transitions and the curve over documents."""

    def __init__(self):
        #: Rows: of a line itself, for the line after it, for the line before it.
        self.weights, self.trans = np.zeros((3, N_FEATURES)), np.zeros((2, 2))
        self.slope, self.offset = 0.0, 0.0
        self.constant: float | None = 1.0

    def marginals(self, scores: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of "good" by line, and the summed transition marginals of the documents of up
        to RUN lines."""
        starts = np.cumsum(per_doc) - per_doc
        good, pairs = np.zeros(len(scores)), np.zeros((2, 2))
        for k in np.flatnonzero(per_doc > RUN).tolist():
            part = slice(starts[k], starts[k] + per_doc[k])
            good[part] = crf.long_marginals(np.stack([np.zeros(per_doc[k]), scores[part]], axis=1), self.trans)[:, 1]
        short = np.flatnonzero(per_doc <= RUN)
        two = np.stack([np.zeros(len(scores)), scores], axis=1)
        for g in crf.batches(per_doc[short], 50_000):
            g = short[g]
            e, mask = crf.padded(two, starts[g], per_doc[g])
            _, m, p = crf.forward_backward(e, mask, self.trans)
            pairs += p
            good[(starts[g][:, None] + np.arange(mask.shape[1]))[mask]] = m[:, :, 1][mask]
        return good, pairs

    def lines(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of "good" by line, lines by document, line lengths."""
        products, per_doc, size = line_features(bodies, lambda x: x @ self.weights.T)
        return self.marginals(beside(products, per_doc), per_doc)[0], per_doc, size

    def score(self, bodies: list[bytes]) -> np.ndarray:
        if self.constant is not None or not bodies:
            return np.full(len(bodies), self.constant if self.constant is not None else 0.0)
        q = share_good(*self.lines(bodies))
        return 1 / (1 + np.exp(-(self.slope * _logit(q) + self.offset)))


def share_good(good: np.ndarray, per_doc: np.ndarray, size: np.ndarray) -> np.ndarray:
    starts = np.cumsum(per_doc) - per_doc
    return np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts)


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def train(bodies: list[bytes], labels: list[int]) -> Field:
    field = Field()
    y = np.array(labels, float)
    field.constant = float(y.mean()) if len(y) else 1.0
    if not 0 < field.constant < 1:
        return field
    field.constant = None
    x, whole, size = line_features(bodies)
    doc = np.repeat(np.arange(len(y)), whole)
    # long documents are fitted in runs
    per_doc = np.concatenate([np.diff(np.r_[0 : n : max(RUN, 1), n]) for n in whole.tolist()])
    first = np.zeros(len(x), bool)
    first[np.cumsum(per_doc) - per_doc] = True
    last = np.r_[first[1:], True]
    # both kinds of documents weigh alike, and so do long and short ones
    weight = (size / np.bincount(doc, size)[doc]) * np.where(y[doc] == 1, 1 / (2 * y.sum()), 1 / (2 * (1 - y).sum()))
    target = y[doc].copy()

    def marginals(prior: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        return field.marginals(beside(x @ field.weights.T, per_doc) + prior, per_doc)

    for _ in range(TURNS):
        seen = np.zeros((2, 2))
        at = np.flatnonzero(~first)
        for a in range(2):
            for b in range(2):
                pa_, pb = (target[at - 1] if a else 1 - target[at - 1]), (target[at] if b else 1 - target[at])
                seen[a, b] = (pa_ * pb).sum()

        def gradient(target: np.ndarray = target, seen: np.ndarray = seen) -> list[np.ndarray]:
            good, pairs = marginals()
            g = (good - target) * weight
            # what a line adds to the line after it and before it
            three = np.stack([g, np.r_[np.where(first, 0, g)[1:], 0], np.r_[0, np.where(last, 0, g)[:-1]]])
            return [three @ x + 1e-5 * field.weights, (pairs - seen) / max(1, len(x)) * 0.1 + 1e-3 * field.trans]

        crf.adam(gradient, [field.weights, field.trans], ROUNDS, 0.2)
        good, _ = marginals(np.where(y[doc] == 1, 3.0, -1.5))
        target = np.where(y[doc] == 1, 1.0, good)
    q = _logit(share_good(marginals()[0], whole, size))
    curve = [np.array([1.0]), np.array([0.0])]

    def slope_gradient() -> list[np.ndarray]:
        p = 1 / (1 + np.exp(-(curve[0] * q + curve[1])))
        return [np.array([((p - y) * q).mean()]), np.array([(p - y).mean()])]

    crf.adam(slope_gradient, curve, 500, 0.05)
    field.slope, field.offset = float(curve[0][0]), float(curve[1][0])
    return field


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", seed: int = 2) -> Field:
    rows = toxicity.examples(docs, labels, label, seed, MAX_EXAMPLES, MAX_BYTES).collect()
    rows.sort(key=lambda r: (r.at, r.id))
    lines = np.cumsum([bytes(r.body).count(b"\n") + 1 for r in rows])
    rows = rows[: max(1, int(np.searchsorted(lines, MAX_LINES, side="right")))]
    return train([bytes(r.body) for r in rows], [r.y for r in rows])


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``score`` for every row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches, CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([common.ids(part), pa.array(field.score(common.bodies(part)), pa.float64())], names=["id", "score"])

    return common.texts(docs, id_col, text_col).mapInArrow(work, "id long, score double")


def line_marginals(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and, by line, the probability of "good"."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches, CHUNK_BYTES):
            good, per_doc, _ = field.lines(common.bodies(part))
            yield pa.RecordBatch.from_arrays([common.ids(part), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_doc)].astype(np.int32)), pa.array(good))], names=["id", "good"])

    return common.texts(docs, id_col, text_col).mapInArrow(work, "id long, good array<double>")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    field = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, field).select(
        F.col("id").alias("doc_id"),
        (common.fold("id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
