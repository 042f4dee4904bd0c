"""Benchmark decontamination: every passage of every document queries a BM25 index of test items.

A document is read as overlapping windows twice as long as the longest item, so each occurrence
lies whole in one. The score of an item for a window is BM25 over their common words, as a share
of the item's score for its own text; all items at or above THRESHOLD are retrieved. The search is
block-max WAND over whole chunks of windows at once:

1. of each item the least weighty words, up to SLACK of its mass, are not essential; a window that
   reaches the threshold holds essential words of at least THRESHOLD - SLACK;
2. the lists of essential words are cut into blocks of items, each with its largest weight; the
   (window, block) pairs whose summed maxima can't reach that bound are dropped;
3. the items of what is left are scored exactly.

A hit is then verified: of the item's question and of its answer (its last sentence) the shares of
word n-grams found in the window must both reach LEAST_OVERLAP.

Items of fewer than LEAST_WORDS words have no sentences to compare; they are found where their words
stand in a text, all of them and in order.

The index holds at most about ITEMS_PER_SHARD items and SHARD_BYTES of their texts; more make more
shards, one after the other in the driver, and the documents are run against each, so none is left out.

Defined cases: null or empty texts, and texts of marks only, match nothing on either side; texts of
any length are read whole; rows that repeat are reported each; of equal scores in a document the
first window counts; of short items the first place; an empty table on either side gives no hits.
Columns beside the ids and the texts aren't read (``without_leaks`` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import common

K1, B = 1.2, 0.75
THRESHOLD, SLACK = 0.5, 0.2
LEAST_OVERLAP = 0.5
LEAST_WORDS = 5
NGRAM = 3
BLOCK = 8
ITEMS_PER_SHARD, SHARD_BYTES = 50_000, 64 << 20
CHUNK_BYTES = 8 << 20
CACHE_WORDS = 300_000
STRIP = b".,;:!?\"'()[]{}<>|#$%&*+-=/\\_~^`@"


def words_of(text: bytes) -> list[bytes]:
    return [w for w in (x.strip(STRIP) for x in text.lower().split()) if w]


def halves(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer: the last sentence, or, if there is but one, the
    last quarter of the words."""
    parts = [p for p in (words_of(s) for s in re.split(rb"[.!?\n]+(?=\s|$)", text)) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def grams(words: list) -> set:
    n = min(NGRAM, len(words))
    return set(zip(*(words[k:] for k in range(n)), strict=False)) if n else set()


class Sequences:
    """Short word sequences as a tree: from a node and a word to the next node, as one sorted array."""

    def __init__(self, items: list[tuple[object, list[int]]], n_terms: int):
        self.n_terms = n_terms
        nodes: dict[int, int] = {}
        self.held: dict[int, list] = {}
        for name, words in items:
            node = 0
            for w in words:
                node = nodes.setdefault(node * n_terms + w, len(nodes) + 1)
            self.held.setdefault(node, []).append(name)
        order = sorted(nodes)
        self.keys, self.next = np.array(order, np.int64), np.array([nodes[k] for k in order], np.int64)
        self.begins = np.zeros(n_terms, bool)
        self.begins[[w[0] for _, w in items]] = True

    def find(self, flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, object]]:
        """(place, item) of each sequence that stands in ``flat``; ``ends``: by place, where its text ends."""
        place = np.flatnonzero(self.begins[flat]) if self.held else np.zeros(0, np.int64)
        node, depth = np.zeros(len(place), np.int64), 0
        while len(place):
            inside = place + depth < ends[place]
            place, node = place[inside], node[inside]
            key = node * self.n_terms + flat[place + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            place, node = place[ok], self.next[at[ok]]
            for p, n in zip(place.tolist(), node.tolist(), strict=True):
                yield from ((p, name) for name in self.held.get(n, ()))
            depth += 1


@dataclass
class Index:
    vocab: dict[bytes, int]  # from 1
    items: list  # ids
    window: int
    parts: list[tuple[list[int], list[int]]]  # question and answer, as term numbers
    # essential lists by (term, block): first posting; of the postings: item and weight
    term_block_start: np.ndarray
    term_first: np.ndarray
    block_of: np.ndarray
    block_max: np.ndarray
    post_item: np.ndarray
    post_weight: np.ndarray
    need: np.ndarray  # least essential mass by block
    need_item: np.ndarray
    rest: list[dict[int, float]]  # words that are not essential, by item
    own: np.ndarray  # BM25 of an item for itself
    short: Sequences  # of the items of few words


def build(items: list[tuple[object, bytes]]) -> Index:
    """The index of (id, text) items."""
    seqs = [words_of(t or b"") for _, t in items]
    keep = [k for k, s in enumerate(seqs) if len(s) >= LEAST_WORDS]
    keep.sort(key=lambda k: (len(seqs[k]), seqs[k]))  # like items share blocks
    few = [(items[k][0], s) for k, s in enumerate(seqs) if 0 < len(s) < LEAST_WORDS]
    seqs, kept = [seqs[k] for k in keep], [items[k] for k in keep]
    vocab: dict[bytes, int] = {}
    for s in [*seqs, *(s for _, s in few)]:
        for w in s:
            vocab.setdefault(w, len(vocab) + 1)
    df = np.zeros(len(vocab) + 1)
    for s in seqs:
        df[[vocab[w] for w in set(s)]] += 1
    n = len(seqs)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    mean = np.mean([len(s) for s in seqs]) if n else 1.0
    posts: list[tuple[int, int, float]] = []
    rest: list[dict[int, float]] = []
    need, own = np.zeros(n), np.zeros(n)
    for k, s in enumerate(seqs):
        terms, tf = np.unique([vocab[w] for w in s], return_counts=True)
        w = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(s) / mean))
        own[k] = w.sum()
        w = w / own[k]
        order = np.lexsort((terms, w))
        light = order[np.cumsum(w[order]) <= SLACK]
        heavy = order[len(light) :]
        rest.append(dict(zip(terms[light].tolist(), w[light].tolist(), strict=True)))
        need[k] = THRESHOLD - w[light].sum()
        posts += [(int(terms[j]), k, float(w[j])) for j in heavy]
    posts.sort()
    term = np.array([p[0] for p in posts], np.int64)
    item = np.array([p[1] for p in posts], np.int64)
    weight = np.array([p[2] for p in posts])
    blocks = -(-n // BLOCK)
    key = term * max(blocks, 1) + item // BLOCK
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    top = np.maximum.reduceat(weight, starts) if len(starts) else np.zeros(0)
    term_first = np.searchsorted(term[starts], np.arange(len(vocab) + 2))
    need_block = np.full(max(blocks, 1), np.inf)
    np.minimum.at(need_block, np.arange(n) // BLOCK, need)
    parts = [tuple([vocab[w] for w in h] for h in halves(t)) for _, t in kept]
    return Index(
        vocab, [i for i, _ in kept], 2 * max(map(len, seqs), default=1), parts, np.r_[starts, len(posts)], term_first,
        item[starts] // BLOCK, top, item, weight, need_block, need, rest, own, Sequences([(i, [vocab[w] for w in s]) for i, s in few], len(vocab) + 1),
    )


class Terms(dict):
    """Word as it stands in the text -> its number in the vocabulary, 0 for others, -1 if it is
    punctuation only and no word at all."""

    def __init__(self, vocab: dict[bytes, int]):
        self.vocab = vocab

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        core = word.strip(STRIP)
        n = self[word] = self.vocab.get(core, 0) if core else -1
        return n


def search(index: Index, terms: Terms, texts: list[bytes]) -> list[tuple[int, object, float, float, float, int]]:
    """(text, item's id, score, question overlap, answer overlap, first word) of each verified hit."""
    seqs = []
    for t in texts:
        found = t.lower().split()
        s = np.fromiter(map(terms.__getitem__, found), np.int32, len(found))
        seqs.append(s[s >= 0])
    lens = np.array([len(s) for s in seqs])
    flat = np.concatenate(seqs) if seqs else np.zeros(0, np.int32)
    base = np.cumsum(lens) - lens
    firsts: dict[tuple[int, object], int] = {}
    for place, name in index.short.find(flat, np.repeat(base + lens, lens)):
        d = int(np.searchsorted(base, place, side="right") - 1)
        firsts[d, name] = min(place - int(base[d]), firsts.get((d, name), place))
    short = [(d, name, 1.0, 1.0, 1.0, at) for (d, name), at in sorted(firsts.items(), key=lambda x: x[0][0])]
    return short + (long_hits(index, seqs, flat, lens, base) if index.items else [])


def long_hits(index: Index, seqs: list[np.ndarray], flat: np.ndarray, lens: np.ndarray, base: np.ndarray) -> list[tuple[int, object, float, float, float, int]]:
    step = index.window // 2
    # windows begin at every multiple of step within a text; a word lies in two of them
    per_text = np.maximum(1, -(-lens // step))
    first_window = np.cumsum(per_text) - per_text
    essential = index.term_first[1:] > index.term_first[:-1]
    at = np.flatnonzero(essential[flat])
    if not len(at):
        return []
    doc = np.searchsorted(base, at, side="right") - 1
    place = at - base[doc]
    later = first_window[doc] + place // step
    both = np.concatenate([later, later[place >= step] - 1])
    term = np.concatenate([flat[at], flat[at][place >= step]]).astype(np.int64)
    pair = np.unique(both * (len(index.vocab) + 1) + term)
    window, term = pair // (len(index.vocab) + 1), pair % (len(index.vocab) + 1)
    # (window, block): summed block maxima
    first = index.term_first[term]
    count = index.term_first[term + 1] - first
    entry = common.ranges(first, count)
    wb = np.repeat(window, count) * len(index.need) + index.block_of[entry]
    order = np.argsort(wb, kind="stable")
    wb, entry = wb[order], entry[order]
    starts = np.flatnonzero(np.r_[True, wb[1:] != wb[:-1]])
    bound = np.add.reduceat(index.block_max[entry], starts)
    ends = np.r_[starts[1:], len(wb)]
    open_ = bound >= index.need[wb[starts] % len(index.need)] - 1e-9
    entry = entry[common.ranges(starts[open_], (ends - starts)[open_])]
    win = np.repeat(wb[starts][open_] // len(index.need), (ends - starts)[open_])
    # items of the open blocks: essential mass
    p0 = index.term_block_start[entry]
    n = index.term_block_start[entry + 1] - p0
    post = common.ranges(p0, n)
    wi = np.repeat(win, n) * len(index.items) + index.post_item[post]
    keys, inverse = np.unique(wi, return_inverse=True)
    mass = np.bincount(inverse, weights=index.post_weight[post], minlength=len(keys)) if len(keys) else np.zeros(0)
    good = mass >= index.need_item[keys % len(index.items)] - 1e-9
    best: dict[tuple[int, int], tuple] = {}
    memo: dict[int, tuple[set, set]] = {}
    for key, m in zip(keys[good].tolist(), mass[good].tolist(), strict=True):
        w, k = divmod(key, len(index.items))
        d = int(np.searchsorted(first_window, w, side="right") - 1)
        begin = (w - int(first_window[d])) * step
        if w not in memo:
            span = seqs[d][begin : begin + index.window].tolist()
            memo[w] = (set(span), {n: set(zip(*(span[j:] for j in range(n)), strict=False)) for n in range(1, NGRAM + 1)})
        have, by_n = memo[w]
        score = m + sum(v for t, v in index.rest[k].items() if t in have)
        if score < THRESHOLD - 1e-9:  # sums of shares come out a bit low
            continue
        shares = []
        for half in index.parts[k]:
            g = grams(half)
            shares.append(len(g & by_n[min(NGRAM, len(half))]) / len(g) if g else 1.0)
        if min(shares) >= LEAST_OVERLAP:
            old = best.get((d, k))
            if old is None or (-score, begin) < (-old[0], old[3]):
                best[(d, k)] = (score, shares[0], shares[1], begin)
    return [(d, index.items[k], *v) for (d, k), v in sorted(best.items())]


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[Index, bool]]:
    """The items in shards of bounded size, by a hash of their ids and texts, one after the other;
    with each, whether there are more than one."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body")).where("body is not null")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("body")), F.lit(0))).first()
    shards = max(-(-n // ITEMS_PER_SHARD), -(-size // SHARD_BYTES))
    for k in range(shards):
        part = rows.where(F.pmod(F.xxhash64("id", "body"), F.lit(shards)) == k).collect()
        index = build(sorted(((r.id, bytes(r.body)) for r in part), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        if index.vocab:
            yield index, shards > 1


HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item it holds."""
    spark = docs.sparkSession
    # with several shards each is run before the next one is made, so one index is held at a time
    found = []
    for index, several in indexes(benchmark):
        hits = _leaks(docs, index, id_col, text_col)
        found.append(common.written(hits, "hits") if several else hits)
    if not found:
        return spark.createDataFrame([], HITS)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _leaks(docs: DataFrame, index: Index, id_col: str, text_col: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(index.vocab)
        for part in common.chunks(batches, CHUNK_BYTES):
            hits = search(index, terms, common.bodies(part))
            who = common.ids(part)
            columns = list(zip(*hits, strict=True)) if hits else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    who.take(pa.array(columns[0], pa.int64())),
                    pa.array(columns[1], pa.int64()),
                    *(pa.array(columns[j], pa.float64()) for j in (2, 3, 4)),
                    pa.array(columns[5], pa.int64()),
                ],
                names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"],
            )

    return common.texts(docs, id_col, text_col).mapInArrow(work, HITS)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a test item."""
    for index, several in indexes(benchmark):

        def judge(index: Index = index):
            terms = Terms(index.vocab)

            def held(texts: pa.StringArray) -> np.ndarray:
                keep = np.ones(len(texts), bool)
                keep[[h[0] for h in search(index, terms, texts.cast(pa.binary()).to_pylist())]] = False
                return keep

            return held

        docs = common.kept(docs, judge, text_col)
        docs = common.written(docs, "without-leaks") if several else docs
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
