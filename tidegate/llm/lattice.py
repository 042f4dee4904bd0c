"""Language-model scores from a subword lattice.

A word's probability under the vocabulary is the sum over all its segmentations into pieces, found
by a forward recursion in log space over the lattice of pieces that match in it. A piece's weight
comes from its existing score in the vocabulary file, read as its rank: Zipf's law, normalised
over the file; characters without a piece are spelled in byte pieces, and a word ends after each piece
with a fixed chance, so that all words' probabilities sum to at most one. The lattice model is
interpolated with the words counted in the training documents (Witten-Bell): what was seen often
is predicted by its count, what was not by its spelling. A document's score is the log10
probability of its words and one end; ``lattice_score`` is the log10 probability that the vocabulary's
lattice alone gives it, without any count of the corpus.

Counting and scoring follow the corpus: word counts are summed in chunks, then by word. The
most frequent words, FREQUENT at most, go to the workers as a table; every other (document, word) pair meets
the word's count in a shuffled join, in which no word is frequent, and sums return to the
documents. No words are left out and the table's size only moves work between the two ways.

Defined cases: null and empty texts have one token, the end; words of any length are scored; rows
that repeat are scored each; without training documents all counts are 0, N is 0 and the
lattice alone scores; an empty table gives no rows. Columns beside the id and the text aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import common

#: Words that are looked up on the workers.
FREQUENT = 100_000
CHUNK_BYTES = 4 << 20
SLICE = 1 << 18
#: Chance that a word ends after a piece; shift of the ranks in Zipf's law.
STOP = 0.3
SHIFT = 10.0
END = b"\n"  # no word holds it


class Pieces:
    """The pieces of a sentencepiece file as a hashed prefix table with log weights."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [k for k in range(n) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
        scores = np.array([sp.get_score(k) for k in normal])
        byte = np.array([sp.is_byte(k) for k in normal])
        # bytes have no score of their own: they come after all others
        rank = np.where(byte, n, -scores)
        weight = -np.log(rank + SHIFT)
        weight -= np.log(np.exp(weight).sum())
        self.byte = np.full(256, -50.0)
        prefixes: dict[str, float] = {}
        for k, w, b in zip(normal, weight.tolist(), byte.tolist(), strict=True):
            piece = sp.id_to_piece(k)
            if b:
                self.byte[int(piece[1:-1], 16)] = w
                continue
            for j in range(1, len(piece)):
                prefixes.setdefault(piece[:j], -np.inf)
            prefixes[piece] = w
        self.longest = max(map(len, prefixes))
        hashes = np.array([self.hash_of(p) for p in prefixes], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.weights = hashes[order], np.array(list(prefixes.values()))[order]
        assert (self.keys[1:] != self.keys[:-1]).all()

    @staticmethod
    def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        x = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    @classmethod
    def hash_of(cls, piece: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = cls.step(h, np.array([ord(c) + 1], np.uint64))
        return int(h[0])

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return self.keys[at] == h, self.weights[at]

    def log_probs(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability; words go in slices of about SLICE
        characters, which bounds the lattice that is held."""
        ends = np.cumsum([len(w) for w in words]) // SLICE
        cuts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1], True]) if len(words) else np.zeros(0, np.int64)
        parts = [self._log_probs(words[s:e]) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _log_probs(self, words: list[bytes]) -> np.ndarray:
        texts = ["▁" + w.decode("utf-8", "replace") for w in words]
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        starts = np.cumsum(lens) - lens
        place = np.arange(len(chars)) - np.repeat(starts, lens)
        left = np.repeat(lens, lens) - place  # characters from here to the word's end
        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, self.longest + 1):
            ok = left[at] >= n
            at, h = at[ok], h[ok]
            h = self.step(h, chars[at + n - 1] + np.uint64(1))
            known, w = self.look(h)
            if n == 1:
                bare = ~known | np.isneginf(w)
                spelled = self.spell(chars[at[bare]])
                arcs.append((at[bare], at[bare] + 1, spelled))
            at, h, w = at[known], h[known], w[known]
            real = ~np.isneginf(w)
            arcs.append((at[real], at[real] + n, w[real]))
            if not len(at):
                break
        a, b, w = (np.concatenate(x) for x in zip(*arcs, strict=True))
        # nodes: a word of n characters has n + 1
        word = np.repeat(np.arange(len(texts)), lens)[a]
        first = starts + np.arange(len(texts))
        frm, to = a + word, b + word
        depth = b - starts[word]
        order = np.lexsort((to, depth))
        frm, to, w, depth = frm[order], to[order], w[order] + math.log(1 - STOP), depth[order]
        alpha = np.full(len(chars) + len(texts), -np.inf)
        alpha[first] = 0.0
        cuts = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1]])
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(depth)], strict=True):
            vals, ends = alpha[frm[s:e]] + w[s:e], to[s:e]
            heads = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
            alpha[ends[heads]] = np.logaddexp.reduceat(vals, heads)
        return alpha[first + lens] + math.log(STOP / (1 - STOP))

    def spell(self, chars: np.ndarray) -> np.ndarray:
        """Log weight of characters written in byte pieces."""
        if not len(chars):
            return np.zeros(0)
        kinds, back = np.unique(chars, return_inverse=True)
        each = [sum(self.byte[b] + math.log(1 - STOP) for b in chr(int(c)).encode("utf-8", "replace")) - math.log(1 - STOP) for c in kinds]
        return np.array(each)[back]


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def brute_force(p: Pieces, word: bytes) -> float:
    """The marginal by the plain recursion; for tests."""
    text = "▁" + word.decode("utf-8", "replace")
    alpha = [1.0] + [0.0] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - p.longest), j):
            known, w = p.look(np.array([p.hash_of(text[i:j])], np.uint64))
            if known[0] and not np.isneginf(w[0]):
                alpha[j] += alpha[i] * math.exp(w[0]) * (1 - STOP)
            elif j == i + 1:
                alpha[j] += alpha[i] * math.exp(p.spell(np.array([ord(text[i])], np.uint64))[0]) * (1 - STOP)
    return math.log(alpha[-1] * STOP / (1 - STOP))


# ---------------------------------------------------------------- counts


def word_counts(bodies: DataFrame) -> DataFrame:
    """``word`` and ``c`` over all texts, each with one END."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches, CHUNK_BYTES):
            count: Counter = Counter()
            for b in common.bodies(part):
                count.update(b.lower().split())
            count[END] += part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(count.keys()), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "c"])

    return bodies.select("body").mapInArrow(work, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The words above a count that at most ``most`` words reach, told from a histogram over powers
    of two, so neither a sort nor more than those words reach the driver."""
    step = F.floor(F.log2("c") * 8)
    hist = sorted(((r.b, r.n) for r in counts.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = None, 0
    for b, n in hist:
        total += n
        if total > most:
            break
        least = b
    return counts.where(F.lit(False)) if least is None else counts.where(step >= least)


class Model:
    """Totals of the counts, and how a token's two log10 probabilities come from its count."""

    def __init__(self, path: str, n: int, v: int):
        self.path, self.n, self.v = path, n, v

    def base(self, c):
        return np.log10((c + 1) / (self.n + self.v + 1))

    def mixed(self, c, lattice):
        """log10 of c/(N+V) + V/(N+V) * lattice, from the lattice's natural log."""
        if not self.n:
            return lattice / math.log(10)
        share = np.log(self.v / (self.n + self.v))
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(c / (self.n + self.v)), share + lattice) / math.log(10)


def score(docs: DataFrame, counts: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and
    ``lattice_score`` by row, from a written table of counts."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    model = Model(path, int(total.n), int(total.v))
    top = frequent(counts).collect()
    words = [bytes(r.word) for r in top]
    c = np.array([r.c for r in top], float)
    own = _lattice(pieces(path), words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = pieces(path)
        known = {w: k for k, w in enumerate(words)}
        base, mixed = model.base(c), model.mixed(c, own)
        end = (known[END], 0.0) if END in known else (-1, float(model.mixed(np.zeros(1), np.array([math.log(STOP)]))[0]))
        for part in common.chunks(batches, CHUNK_BYTES):
            yield _sums(part, known, base, mixed, own, lattice, end, float(model.base(0.0)))

    rows = common.texts(docs, id_col, text_col).mapInArrow(
        work, "id long, h int, word binary, copies long, tokens long, known long, base double, score double, tf long, lattice double"
    )
    # a document's own row has the sum over its frequent words in ``lattice``
    met = rows.join(counts, "word", "left")
    seen = F.coalesce("c", F.lit(0))
    n, v = F.lit(float(model.n)), F.lit(float(model.v))
    if model.n:
        rare = F.log10(seen / (n + v) + v / (n + v) * F.exp("lattice"))
        # far below what a double holds only the lattice counts, and its log is at hand
        deep = F.when((F.col("lattice") < -600) & (seen == 0), (F.col("lattice") + F.log(v / (n + v))) / math.log(10)).otherwise(rare)
    else:
        deep = F.col("lattice") / math.log(10)
    sums = met.groupBy("id", "h").agg(
        F.sum("copies").alias("copies"),
        F.sum(F.col("tokens") + F.col("tf")).alias("tokens"),
        F.sum(F.col("known") + F.when(seen > 0, F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("base") + F.when(F.col("tf") > 0, F.col("tf") * F.log10((seen + 1) / (n + v + 1))).otherwise(0.0)).alias("base"),
        F.sum(F.col("score") + F.when(F.col("tf") > 0, F.col("tf") * deep).otherwise(0.0)).alias("score"),
        F.sum(F.col("lattice") * F.when(F.col("tf") > 0, F.col("tf")).otherwise(1)).alias("lattice"),
    )
    one = sums.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return one.select(
        "id",
        (F.col("tokens") / F.col("copies")).cast("long").alias("n_tokens"),
        (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
        (F.col("lattice") / F.col("copies") / math.log(10)).alias("lattice_score"),
    )


def _lattice(lattice: Pieces, words: list[bytes]) -> np.ndarray:
    """Log probabilities; the end is a word of its own that stops at once."""
    out = lattice.log_probs(words)
    for k, w in enumerate(words):
        if w == END:
            out[k] = math.log(STOP)
    return out


def _sums(part: pa.Table, known: dict, base: np.ndarray, mixed: np.ndarray, own: np.ndarray, lattice: Pieces, end: tuple[int, float], unseen: float) -> pa.RecordBatch:
    """A row with the sums over frequent words for each document, and one row for each document
    and other word. Documents' rows bear a word that no table holds, different for each."""
    bodies = common.bodies(part)
    local = common.Interner()
    each = []
    for b in bodies:
        found = b.lower().split()
        each.append(np.fromiter(map(local.__getitem__, found), np.int64, len(found)))
    rank = np.array([known.get(w, -1) for w in local.items_], np.int64) if local.items_ else np.zeros(0, np.int64)
    lens = np.array([len(e) for e in each])
    flat = np.concatenate(each) if each else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(bodies)), lens)
    k = rank[flat]
    often = k >= 0
    n = len(bodies)
    tokens = np.bincount(doc[often], minlength=n) + 1
    base_sum = np.bincount(doc[often], weights=base[k[often]], minlength=n) + (base[end[0]] if end[0] >= 0 else unseen)
    score_sum = np.bincount(doc[often], weights=mixed[k[often]], minlength=n) + (mixed[end[0]] if end[0] >= 0 else end[1])
    lattice_sum = np.bincount(doc[often], weights=own[k[often]], minlength=n) + math.log(STOP)
    n_known = np.bincount(doc[often], minlength=n) + (end[0] >= 0)
    width = max(1, len(local.items_))
    pair, tf = np.unique(doc[~often] * width + flat[~often], return_counts=True)
    d, w = pair // width, pair % width
    kinds, back = np.unique(w, return_inverse=True)
    rare = [local.items_[j] for j in kinds.tolist()]
    lat = lattice.log_probs(rare)[back] if len(rare) else np.zeros(0)
    ids = common.ids(part)
    h = np.array([xxhash.xxh32_intdigest(b) for b in bodies], np.uint32).view(np.int32)
    zero_i, zero_f = np.zeros(len(d), np.int64), np.zeros(len(d))
    rare_words = pa.array(rare, pa.binary()).take(pa.array(back)) if rare else pa.array([], pa.binary())
    marks = pa.array([b"\n%d-%d" % (j, x) for j, x in enumerate(h.tolist())], pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([ids, ids.take(pa.array(d))]),
            pa.array(np.r_[h, h[d]].astype(np.int32)),
            pa.concat_arrays([marks, rare_words]),
            pa.array(np.r_[np.ones(n, np.int64), zero_i]),
            pa.array(np.r_[tokens, zero_i]),
            pa.array(np.r_[n_known, zero_i].astype(np.int64)),
            pa.array(np.r_[base_sum, zero_f]),
            pa.array(np.r_[score_sum, zero_f]),
            pa.array(np.r_[np.zeros(n, np.int64), tf]),
            pa.array(np.r_[lattice_sum, lat]),
        ],
        names=["id", "h", "word", "copies", "tokens", "known", "base", "score", "tf", "lattice"],
    )


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    training = common.texts(docs).where(common.fold("id", 7) != 2)
    counts = common.written(word_counts(training), "counts")
    return score(docs, counts, public_tokenizers.path("piece_bpe_32k.model")).select(
        F.col("id").alias("doc_id"), (common.fold("id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"
    )
