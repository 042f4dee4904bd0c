"""Toxicity by nearest labelled examples: exact TF-IDF cosine over whole texts.

A document is the TF-IDF vector of all its words and of the word beginnings that a bounded sample
of labelled documents ties to the toxic label; words and beginnings so tied weigh BOOST times as
much, the others as they are, so a copy of an example has cosine 1 with it whatever its words.
The labelled examples are searched by every text that has a word. Like examples lie in blocks of
BLOCK, and an inverted list has, for each term and block, the largest weight and then the examples.
The lists of the HEADS most common terms are dense rows, whose share of the cosines is one matrix
product. The largest weights of the other terms bound what they can add in a block; only blocks that
can reach the k-th best cosine are read. This is in single precision; the examples that can be among
the k nearest within its error are summed anew in double precision, so the neighbours are exact. Their votes, weighted by cosine, are
calibrated on the examples themselves (each left out of its own neighbours) and come with the
neighbours' ids as evidence.

The index is bounded by MAX_EXAMPLES and MAX_BYTES of their texts, which is what makes it safe to
send to every worker; every document is scored against all of it.

Defined cases: null and empty texts, and texts without a word of the examples, have no neighbours and
get the share of toxic labels of the empty examples (of all without any); long texts are one vector
of all their words; equal cosines are taken by the smaller example id; rows that repeat are scored
each; labels other than 0 and 1 count as none; a document with several label rows counts as toxic if
any row says so, and of labelled rows with the same id the smallest text is learnt from; without
labelled rows, or with labels of one kind only, every score is the share of toxic labels (0 without
any); an empty table gives no rows. Columns beside the id and the text aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import common

#: Labelled rows to learn from, bytes of their texts, and terms tied to the label: what bounds the model.
MAX_EXAMPLES, MAX_BYTES = 3000, 64 << 20
MAX_TIED = 4000
#: Neighbours that vote.
K = 15
#: A term is tied to the label when its toxic examples exceed their expected number by so many
#: deviations; it weighs so many times as much as another.
Z_LEAST = 5.0
BOOST = 6.0
PREFIXES = (4, 5, 6, 7, 8, 10)
#: Examples in a block; terms whose lists are dense rows.
BLOCK, HEADS = 64, 512
#: More than sums in single precision can move a cosine.
ROUGH = 1e-5
#: Bounds of a slice of texts searched at once, and of texts whose vectors are made at once.
QUERIES, POSTINGS, CHUNK_BYTES = 64, 1 << 20, 4 << 20
STRIP = ".,;:!?\"'()[]{}<>|#$%&*+-=/\\_~^`@"


def terms_of(word: bytes) -> list[bytes]:
    """A word without its punctuation, and its beginnings (marked by a trailing *)."""
    core = word.strip(STRIP.encode())
    if not core:
        return []
    return [core, *(core[:k] + b"*" for k in PREFIXES if len(core) >= k)]


class Vectors(NamedTuple):
    """Sparse rows, end to end."""

    start: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1


def stacked(rows: list[tuple[np.ndarray, np.ndarray]]) -> Vectors:
    lens = [len(t) for t, _ in rows]
    return Vectors(np.r_[0, np.cumsum(lens)].astype(np.int64), np.concatenate([np.zeros(0, np.int64), *(t for t, _ in rows)]), np.concatenate([np.zeros(0), *(w for _, w in rows)]))


class Bags(NamedTuple):
    """Terms and counts of documents, end to end; ``unseen``: of each document the sum of
    (1 + log count)^2 over its words that are in no example."""

    start: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    unseen: np.ndarray


class Words:
    """Numbers of words and of marked beginnings, as Arrow arrays that every worker holds once."""

    def __init__(self, terms: list[bytes]):
        marked = np.array([t.endswith(b"*") for t in terms], bool)
        self.words, self.word_numbers = pa.array([t for t, m in zip(terms, marked, strict=True) if not m], pa.binary()), np.flatnonzero(~marked)
        by_length: dict[int, list[int]] = {}
        for n in np.flatnonzero(marked).tolist():
            by_length.setdefault(len(terms[n]) - 1, []).append(n)
        self.beginnings = [(k, pa.array([terms[n][:-1] for n in found], pa.binary()), np.array(found)) for k, found in sorted(by_length.items())]

    def of(self, texts: pa.StringArray) -> Bags:
        """Words are what stands between ASCII blanks, in lower case and without punctuation at either end."""
        n = len(texts)
        parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        doc = np.repeat(np.arange(n), np.diff(parts.offsets.to_numpy()))
        raw = parts.flatten().dictionary_encode()
        core = pc.ascii_trim(raw.dictionary, STRIP).dictionary_encode()
        words = core.dictionary.cast(pa.binary())
        which = core.indices.to_numpy()[raw.indices.to_numpy()]
        # counts of each word in each document
        pair, count = np.unique(doc * (len(words) + 1) + which, return_counts=True)
        doc, which = pair // (len(words) + 1), pair % (len(words) + 1)
        real = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)[which]
        doc, which, count = doc[real], which[real], count[real]
        # a word is one of the terms or unseen
        at = pc.index_in(words, self.words)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        number = np.full(len(words), -1, np.int64)
        number[known] = self.word_numbers[at.drop_null().to_numpy()]
        term = number[which]
        seen = term >= 0
        unseen = np.bincount(doc[~seen], (1 + np.log(count[~seen])) ** 2, n) if n else np.zeros(0)
        # and brings its marked beginnings, which other words may bring too
        dims = len(self.word_numbers) + sum(len(found) for _, _, found in self.beginnings) + 1
        keys, times = [], []
        for k, value_set, found in self.beginnings:
            at = pc.index_in(pc.binary_slice(words, 0, k), value_set)
            has = at.is_valid().to_numpy(zero_copy_only=False)
            mark = np.full(len(words), -1, np.int64)
            mark[has] = found[at.drop_null().to_numpy()]
            of_pair = mark[which]
            on = of_pair >= 0
            keys.append(doc[on] * dims + of_pair[on])
            times.append(count[on])
        marks, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
        mark_counts = np.bincount(inverse, np.concatenate([np.zeros(0), *times]), len(marks))
        doc, term, count = np.r_[doc[seen], marks // dims], np.r_[term[seen], marks % dims], np.r_[count[seen], mark_counts].astype(float)
        by = np.argsort(doc, kind="stable")
        return Bags(np.searchsorted(doc[by], np.arange(n + 1)), term[by], count[by], unseen)


class Index:
    """Labelled examples as unit TF-IDF vectors in inverted lists, with their votes calibrated."""

    def __init__(self, terms: list[bytes], df: np.ndarray, n_docs: int, weighty: np.ndarray | None = None):
        self.words = Words(terms)
        #: Of each term, and last of a word in no example.
        self.idf = np.log((1 + n_docs) / (1 + np.r_[df, 0.0])) + 1
        if weighty is not None:
            self.idf[:-1][weighty] *= BOOST
        self.ids = np.zeros(0, np.int64)
        self.labels = np.zeros(0)
        self.empty_score = 0.0

    # ---- vectors

    def vectors(self, bags: Bags) -> Vectors:
        """Unit vectors over terms. Words in no example meet none, but are part of the length."""
        n = len(bags.unseen)
        doc = np.repeat(np.arange(n), np.diff(bags.start))
        w = (1 + np.log(bags.counts)) * self.idf[bags.terms]
        square = np.bincount(doc, w * w, n) + bags.unseen * self.idf[-1] ** 2
        return Vectors(bags.start, bags.terms, w / np.sqrt(square)[doc])

    def vector(self, terms: np.ndarray, counts: np.ndarray, unseen: float) -> tuple[np.ndarray, np.ndarray]:
        got = self.vectors(Bags(np.array([0, len(terms)]), terms, counts, np.array([float(unseen)])))
        return got.terms, got.weights

    def build(self, ids: np.ndarray, labels: np.ndarray, vectors: Vectors | list[tuple[np.ndarray, np.ndarray]]) -> None:
        """``ids``, ``labels`` and vectors of the examples, in any order."""
        v = stacked(vectors) if isinstance(vectors, list) else vectors
        n, dims = len(v), len(self.idf)
        lens = np.diff(v.start)
        self._lay(np.argsort(ids, kind="stable"), ids, labels, v, lens, n, dims, 1)
        if n > BLOCK:
            # like examples in like blocks: each goes to the nearest of some leaders
            leaders = np.linspace(0, n - 1, max(2, int(np.sqrt(n)))).astype(np.int64)
            best, whose = np.full(n, -1.0), np.zeros(n, np.int64)
            for j, k in enumerate(leaders.tolist()):
                t, w = self.term[self.first[k] : self.first[k + 1]], self.value[self.first[k] : self.first[k + 1]]
                length = self.start[t + 1] - self.start[t]
                p = common.ranges(self.start[t], length)
                score = np.bincount(self.doc[p], np.repeat(w, length) * self.weight[p], n)
                whose[score > best], best = j, np.maximum(best, score)
            order = np.argsort(ids, kind="stable")[np.lexsort((-best, whose))]
            self._lay(order, ids, labels, v, lens, n, dims, BLOCK)

    def _lay(self, order: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: Vectors, lens: np.ndarray, n: int, dims: int, block: int) -> None:
        self.ids, self.labels = ids[order], labels[order].astype(float)
        at = common.ranges(v.start[:-1][order], lens[order])
        #: The vectors themselves, end to end.
        self.first = np.r_[0, np.cumsum(lens[order])]
        self.term, self.value = v.terms[at].astype(np.int32), v.weights[at]
        doc = np.repeat(np.arange(n, dtype=np.int32), lens[order])
        #: Of each term its examples, by position and so by block.
        by = np.argsort(self.term, kind="stable")
        self.doc, self.weight, sorted_terms = doc[by], self.value[by].astype(np.float32), self.term[by]
        self.start = np.searchsorted(sorted_terms, np.arange(dims + 1)).astype(np.int64)
        #: The most common terms as dense rows; the place of each among them, or -1.
        held = np.diff(self.start)
        common_terms = np.sort(np.argsort(-held, kind="stable")[: min(HEADS, int((held > 1).sum()))])
        self.head = np.full(dims, -1, np.int64)
        self.head[common_terms] = np.arange(len(common_terms))
        self.dense = np.zeros((len(common_terms), n), np.float32)
        of_head = self.head[sorted_terms]
        self.dense[of_head[of_head >= 0], self.doc[of_head >= 0]] = self.weight[of_head >= 0]
        #: Of each term its blocks: where their examples begin, and their largest weight.
        self.edges = np.arange(0, max(n, 1), block)
        self.blocks = len(self.edges)
        self.block_of = (np.arange(n) // block).astype(np.int64)
        new = np.r_[True, (sorted_terms[1:] != sorted_terms[:-1]) | (self.doc[1:] // block != self.doc[:-1] // block)] if len(by) else np.zeros(0, bool)
        cell = np.flatnonzero(new)
        self.cell = np.r_[cell, len(by)].astype(np.int64)
        self.cell_block = self.doc[cell] // block
        self.cell_most = np.maximum.reduceat(self.weight, cell) if len(cell) else np.zeros(0, np.float32)
        self.cells = np.searchsorted(sorted_terms[cell], np.arange(dims + 1)).astype(np.int64)
        self.tail_cost = np.where(self.head >= 0, 0, held)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest examples, by cosine and then by id; ``without``: a position."""
        near, cos = next(self.search(stacked([(terms, weights)]), k, np.array([without])))
        return self.ids[near], cos

    def search(self, v: Vectors, k: int, without: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and cosines of the nearest of each vector, in slices of at most QUERIES vectors and POSTINGS list entries
        (or one vector)."""
        cost = np.zeros(len(v), np.int64)
        if len(self.ids) and len(v.terms):
            cost = np.diff(np.r_[0, np.cumsum(self.tail_cost[v.terms])][v.start])
        s = 0
        while s < len(v):
            e, held = s + 1, int(cost[s])
            while e < len(v) and e - s < QUERIES and held + cost[e] <= POSTINGS:
                held += int(cost[e])
                e += 1
            part = slice(v.start[s], v.start[e])
            yield from self._search(Vectors(v.start[s : e + 1] - v.start[s], v.terms[part], v.weights[part]), k, np.full(e - s, -1) if without is None else without[s:e])
            s = e

    def _search(self, v: Vectors, k: int, without: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, m = len(self.ids), len(v)
        if not n:
            yield from ((np.zeros(0, np.int64), np.zeros(0)) for _ in range(m))
            return
        who = np.repeat(np.arange(m), np.diff(v.start))
        place = self.head[v.terms]
        # the common terms' share of every cosine
        q = np.zeros((m, len(self.dense)), np.float32)
        q[who[place >= 0], place[place >= 0]] = v.weights[place >= 0]
        rough = q @ self.dense
        for i in np.flatnonzero(without >= 0).tolist():
            rough[i, without[i]] = -2
        # no weight is negative, so the k-th best cosine is no less than the k-th best share
        low = self._kth(rough, k)
        # a block is searched if its best share and the largest weights of the other terms reach that
        who, terms, weights = who[place < 0], v.terms[place < 0], v.weights[place < 0].astype(np.float32)
        length = self.cells[terms + 1] - self.cells[terms]
        cell = common.ranges(self.cells[terms], length)
        block = np.repeat(who * self.blocks, length) + self.cell_block[cell]
        weight = np.repeat(weights, length)
        bound = np.bincount(block, weight * self.cell_most[cell], m * self.blocks).reshape(m, -1) + np.maximum.reduceat(rough, self.edges, axis=1)
        use = (bound >= low[:, None]).ravel()[block]
        cell, who, weight = cell[use], np.repeat(who * n, length)[use], weight[use]
        size = self.cell[cell + 1] - self.cell[cell]
        p = common.ranges(self.cell[cell], size)
        rough = rough + np.bincount(np.repeat(who, size) + self.doc[p], np.repeat(weight, size) * self.weight[p], m * n).reshape(m, n)
        # whatever can be among the k nearest is summed anew
        low = self._kth(rough, k)
        full = np.zeros(len(self.idf))
        for i in range(m):
            docs = np.flatnonzero((rough[i] >= low[i]) & (rough[i] > 0))
            if not len(docs):
                yield docs, np.zeros(0)
                continue
            t = v.terms[v.start[i] : v.start[i + 1]]
            full[t] = v.weights[v.start[i] : v.start[i + 1]]
            lens = self.first[docs + 1] - self.first[docs]
            p = common.ranges(self.first[docs], lens)
            cos = np.round(np.add.reduceat(full[self.term[p]] * self.value[p], np.cumsum(lens) - lens), 12)
            full[t] = 0
            near = np.lexsort((self.ids[docs], -cos))[:k]
            yield docs[near], cos[near]

    def _kth(self, rough: np.ndarray, k: int) -> np.ndarray:
        n = rough.shape[1]
        return np.partition(rough, n - k, axis=1)[:, n - k] - ROUGH if n > k else np.full(len(rough), -1.0)

    # ---- votes

    def vote(self, near: np.ndarray, cos: np.ndarray) -> float:
        w = cos**4
        return float((w * self.labels[near]).sum() / w.sum()) if len(near) and w.sum() > 0 else 0.0

    def calibrate(self) -> None:
        """A monotone map from votes to shares of toxic labels (pool adjacent violators)."""
        lens = np.diff(self.first)
        bare = lens == 0
        votes = np.array([self.vote(*found) for found in self.search(Vectors(self.first, self.term.astype(np.int64), self.value), K, np.arange(len(lens)))])
        y = self.labels
        self.empty_score = float(y[bare].mean()) if bare.any() else (float(y.mean()) if len(y) else 0.0)
        x, t = votes[~bare], y[~bare]
        by = np.lexsort((self.ids[~bare], x))
        x, t = x[by], t[by]
        pools: list[list[float]] = []
        for a, b in zip(x.tolist(), t.tolist(), strict=True):
            pools.append([a, b, 1.0])
            while len(pools) > 1 and (pools[-2][1] >= pools[-1][1]):
                a2, b2, n2 = pools.pop()
                a1, b1, n1 = pools.pop()
                pools.append([(a1 * n1 + a2 * n2) / (n1 + n2), (b1 * n1 + b2 * n2) / (n1 + n2), n1 + n2])
        # each pool is drawn towards its vote a little, so small pools are not certain
        self.knots = np.array([p[0] for p in pools] or [0.0])
        self.shares = np.array([(p[1] * p[2] + p[0]) / (p[2] + 1) for p in pools] or [self.empty_score])

    def score(self, texts: pa.StringArray) -> Iterator[tuple[float, list[int], list[float]]]:
        """Score, neighbours' ids and cosines of each text."""
        for near, cos in self.search(self.vectors(self.words.of(texts)), K):
            if not len(near):
                yield self.empty_score, [], []
                continue
            out = float(np.clip(np.interp(self.vote(near, cos), self.knots, self.shares), 0, 1))
            yield out, self.ids[near].tolist(), cos.tolist()


# ---------------------------------------------------------------- learning


def examples(docs: DataFrame, labels: DataFrame, label: str, seed: int, most: int = MAX_EXAMPLES, most_bytes: int = MAX_BYTES) -> DataFrame:
    """At most ``most`` labelled documents outside the held-out fold (``crc32(doc_id) % 4 = seed``) with
    ``most_bytes`` of text (one document at least), the first by a hash of the id: ``id``, ``body``, ``y``
    and their order ``at``. Written out; only the sample's ids are broadcast."""
    chosen = (
        labels.where(F.col(label).cast("int").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(common.fold("doc_id", 4) != seed)
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .withColumn("at", F.xxhash64("id"))
        .orderBy("at", "id")
        .limit(most)
    )
    # a label's document may be there many times: one text of each id is learnt from
    one = common.texts(docs).join(F.broadcast(chosen), "id").groupBy("id", "y", "at").agg(F.min("body").alias("body"))
    sample = common.written(one, "examples")
    sizes = sample.select("at", "id", F.length("body").alias("n")).orderBy("at", "id").collect()
    held = np.cumsum([r.n for r in sizes])
    if len(sizes) and held[-1] > most_bytes:
        last = sizes[max(1, int(np.searchsorted(held, most_bytes, side="right"))) - 1]
        sample = sample.where((F.col("at") < last["at"]) | ((F.col("at") == last["at"]) & (F.col("id") <= last["id"])))
    return sample


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: list[Counter] = [Counter(), Counter()]
    for batch in batches:
        for body, y in zip(common.bodies(batch), batch.column("y").to_pylist(), strict=True):
            n[y].update({t for w in set(body.lower().split()) for t in terms_of(w)})
    both = list(n[0].keys() | n[1].keys())
    yield pa.RecordBatch.from_arrays(
        [pa.array(both, pa.binary()), pa.array([n[1][t] for t in both], pa.int64()), pa.array([n[0][t] for t in both], pa.int64())], names=["term", "n1", "n0"]
    )


def choose_terms(counts: DataFrame, n1: int, n0: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words of the examples and the beginnings most tied to label 1, their document
    frequencies, and which are tied to the label. ``n1``, ``n0``: examples of each label."""
    counts = counts.groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    p = n1 / (n1 + n0)
    n = F.col("n1") + F.col("n0")
    z = (F.col("n1") - n * p) / F.sqrt(n * p * (1 - p))
    tied = (F.col("n1") >= 4) & (z >= Z_LEAST)
    rows = counts.where(tied | ~F.endswith("term", F.lit(b"*"))).select("term", n.alias("n"), F.when(tied, z).alias("z")).toArrow()
    terms = rows.column("term").to_pylist()
    df, z = rows.column("n").to_numpy(), np.nan_to_num(rows.column("z").to_numpy().astype(float), nan=-1.0)
    order = sorted(range(len(terms)), key=lambda k: (-z[k], terms[k]))
    order = [k for at, k in enumerate(order) if at < MAX_TIED or not terms[k].endswith(b"*")]
    weighty = z[order] > 0
    weighty[MAX_TIED:] = False
    return [terms[k] for k in order], df[order].astype(float), weighty


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", seed: int = 2) -> Index:
    """The index over a bounded sample of labelled documents."""
    sample = examples(docs, labels, label, seed).repartition(12)
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        index = Index([], np.zeros(0), n1 + n0)
        index.empty_score = 1.0 if n1 else 0.0
        return index
    terms, df, weighty = choose_terms(sample.mapInArrow(_term_counts, "term binary, n1 long, n0 long"), n1, n0)
    index = Index(terms, df, n1 + n0, weighty)
    words = index.words

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches, CHUNK_BYTES):
            b = words.of(common.strings(part))
            start = pa.array(b.start, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [common.ids(part), common.ids(part, "y"), pa.ListArray.from_arrays(start, pa.array(b.terms, pa.int32())), pa.ListArray.from_arrays(start, pa.array(b.counts, pa.int32()))],
                names=["id", "y", "terms", "counts"],
            )

    rows = sample.mapInArrow(bags, "id long, y int, terms array<int>, counts array<int>").toArrow().combine_chunks()
    lists, ids = common.ids(rows, "terms"), rows.column("id").to_numpy()
    start = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())].astype(np.int64)
    found = Bags(start, lists.flatten().to_numpy().astype(np.int64), common.ids(rows, "counts").flatten().to_numpy().astype(float), np.zeros(len(ids)))
    index.build(ids, rows.column("y").to_numpy(), index.vectors(found))
    index.calibrate()
    del rows, lists, found, terms
    common.trimmed()
    return index


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``score``, ``neighbours`` and their ``cosines`` for every row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches, CHUNK_BYTES):
            got = list(index.score(common.strings(part)))
            yield pa.RecordBatch.from_arrays(
                [common.ids(part), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))],
                names=["id", "score", "neighbours", "cosines"],
            )

    return common.texts(docs, id_col, text_col).mapInArrow(work, "id long, score double, neighbours array<long>, cosines array<double>")


#: Documents from this score on count as toxic.
THRESHOLD = 0.3


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    index = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, index).select(
        F.col("id").alias("doc_id"),
        (common.fold("id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.slice("neighbours", 1, 3).alias("evidence"),
    )


def without_toxic(docs: DataFrame, index: Index, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""

    def clean(texts: pa.StringArray) -> np.ndarray:
        return np.array([g[0] < threshold for g in index.score(texts)], bool)

    return common.kept(docs, lambda: clean, text_col)
