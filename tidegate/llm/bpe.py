"""Byte-level BPE encoding and decoding by a pair occurrence index.

Texts are cut into pieces as the vocabulary file asks (special tokens first, then the byte-level
pattern). All pieces of a chunk that were not met before lie end to end in one symbol array. An
index maps each mergeable pair to all its positions in that array; active ranks are applied in
ascending order, each to all positions of its pair at once, and the lists of the pairs next to a
merge are updated. So one merge rule is one vector operation, whatever the number of texts.

Defined cases: a null text counts as empty and has no tokens; repeated rows are each returned;
texts of any length are encoded whole. What is kept between chunks is a cache of pieces, emptied
when it holds ``CACHE_PIECES``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidegate.llm import common

#: Bytes of text encoded together; pieces kept between chunks.
CHUNK_BYTES = 4 << 20
CACHE_PIECES = 200_000

# The pattern of the byte-level format, and the code points below U+10000 on which
# the regex module and the tokenizers library have different Unicode tables. Texts that hold one of
# them, or any code point from U+10000 on, are cut by the library's own pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DOUBTFUL = "՘֋֌࢏౜೜₏₝₞₟꟎꟏꟒꟔꟝꟢꟱꭬"


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE file: token bytes, merge table and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        ids = model["vocab"]
        self.size = 1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes: list[bytes] = [b""] * self.size
        for token, n in ids.items():
            self.bytes[n] = bytes(back[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, n in self.special.items():
            self.bytes[n] = token.encode()
        self.of_byte = np.array([ids[c] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.left, self.right = left, right
        self.pattern = regex.compile(PATTERN)
        self.doubtful = regex.compile(f"[{DOUBTFUL}\U00010000-\U0010ffff]")
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.path = path

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it doesn't merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    @property
    def slow_cut(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """Positions of every mergeable pair in an array of symbols. Lists may hold positions whose
    pair has since changed; these are dropped when the list is read."""

    def __init__(self, vocab: Vocabulary, symbols: np.ndarray, ends: np.ndarray):
        """``ends``: True at the last symbol of each piece."""
        n = len(symbols)
        self.v, self.sym = vocab, symbols
        self.next = np.where(ends, n, np.arange(1, n + 1))
        self.prev = np.full(n + 1, n)
        self.prev[self.next[~ends]] = np.flatnonzero(~ends)
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        at = np.flatnonzero(~ends)
        self.add(at)

    def add(self, at: np.ndarray) -> None:
        rank = self.v.rank(self.sym[at], self.sym[self.next[at]])
        good = rank >= 0
        at, rank = at[good], rank[good]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        first = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
        for r, s, e in zip(rank[first].tolist(), first.tolist(), [*first[1:].tolist(), len(rank)], strict=True):
            if r not in self.lists:
                self.lists[r] = []
                heapq.heappush(self.active, r)
            self.lists[r].append(at[s:e])

    def merge_all(self) -> np.ndarray:
        """The symbols that remain, as a mask over positions."""
        n = len(self.sym)
        alive = np.ones(n, bool)
        sym, nxt, prev = self.sym, self.next, self.prev
        while self.active:
            r = heapq.heappop(self.active)
            parts = self.lists.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b = self.v.left[r], self.v.right[r]
            after = nxt[at]
            ok = alive[at] & (sym[at] == a) & (after < n)
            at, after = at[ok], after[ok]
            ok = sym[after] == b
            at, after = at[ok], after[ok]
            if a == b and len(at) > 1:  # runs: the leftmost pair first, none overlapping
                at = np.sort(at)
                taken, keep = -1, []
                for p, q in zip(at.tolist(), nxt[at].tolist(), strict=True):
                    if p != taken:
                        keep.append(p)
                        taken = q
                at = np.array(keep)
                after = nxt[at]
            if not len(at):
                continue
            sym[at] = self.v.made[r]
            alive[after] = False
            beyond = nxt[after]
            nxt[at] = beyond
            prev[beyond[beyond < n]] = at[beyond < n]
            before = prev[at]
            right = at[beyond < n]
            left = before[before < n]
            self.add(np.concatenate([left, right]) if len(left) else right)
        return alive


class Encoder:
    """Encodes lists of texts; keeps the ids of pieces in a cache that is emptied when full."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.slow = None
        self.reset()

    def reset(self) -> None:
        self.pieces = common.Interner()
        self.starts, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def cut(self, text: str, raw: bytes) -> list[str]:
        if raw.isascii() or not self.v.doubtful.search(text):
            return self.v.pattern.findall(text)
        self.slow = self.slow or self.v.slow_cut
        return [text[s:e] for _, (s, e) in self.slow(text)]

    def numbers(self, raw: bytes) -> np.ndarray:
        """A text's pieces by number; special token t is -1 - id."""
        text = raw.decode("utf-8", "replace")
        look = self.pieces.__getitem__
        if self.v.cut_special and any(s in text for s in self.v.special):
            out: list[int] = []
            for part in self.v.cut_special.split(text):
                if part in self.v.special:
                    out.append(-1 - self.v.special[part])
                elif part:
                    out.extend(map(look, self.cut(part, part.encode())))
            return np.array(out, np.int64)
        found = self.cut(text, raw)
        return np.fromiter(map(look, found), np.int64, len(found))

    def learn(self) -> None:
        """Encode the pieces that are new."""
        new = [p.encode() for p in self.pieces.items_[len(self.starts) :]]
        if not new:
            return
        lens = np.fromiter(map(len, new), np.int64, len(new))
        symbols = self.v.of_byte[np.frombuffer(b"".join(new), np.uint8)]
        ends = np.zeros(len(symbols), bool)
        ends[np.cumsum(lens) - 1] = True
        index = PairIndex(self.v, symbols, ends)
        alive = index.merge_all()
        owner = np.repeat(np.arange(len(new)), lens)[alive]
        count = np.bincount(owner, minlength=len(new))
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(count) - count]
        self.lens = np.r_[self.lens, count]
        self.flat = np.r_[self.flat, index.sym[alive].astype(np.uint32)]

    def encode(self, raws: list[bytes]) -> list[np.ndarray]:
        if len(self.pieces.items_) > CACHE_PIECES:
            self.reset()
        each = [self.numbers(r) for r in raws]
        self.learn()
        n = np.array([len(x) for x in each], np.int64)
        words = np.concatenate(each) if each else np.zeros(0, np.int64)
        special = words < 0
        plain = np.where(special, 0, words)
        lens = np.where(special, 1, self.lens[plain] if len(self.lens) else 1)
        starts = np.where(special, 0, self.starts[plain] if len(self.starts) else 0)
        flat = self.flat[common.ranges(starts, lens)] if len(self.flat) else np.zeros(int(lens.sum()), np.uint32)
        if special.any():
            flat[(np.cumsum(lens) - lens)[special]] = (-1 - words[special]).astype(np.uint32)
        total = np.r_[0, np.cumsum(lens)]
        bounds = total[np.r_[0, np.cumsum(n)]]
        return [flat[s:e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def decode(self, tokens: np.ndarray) -> bytes:
        return b"".join(map(self.v.bytes.__getitem__, tokens.tolist())).decode("utf-8", "replace").encode()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary, so its cache serves all tasks of the worker."""
    common.claim("bpe", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``tokens`` (array of int) and ``decoded`` (text) for every row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in common.chunks(batches, CHUNK_BYTES):
            got = enc.encode(common.bodies(part))
            flat = np.concatenate(got).astype(np.int32) if got else np.zeros(0, np.int32)
            offsets = np.r_[0, np.cumsum([len(x) for x in got])].astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            text = pa.array([enc.decode(x).decode() for x in got], pa.string())
            yield pa.RecordBatch.from_arrays([common.ids(part), tokens, text], names=["id", "tokens", "decoded"])

    return common.texts(docs, id_col, text_col).mapInArrow(work, "id long, tokens array<int>, decoded string")


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and digests of ids and decoded text: ``encode`` with its results hashed where
    they are made, so that no token leaves the worker."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in common.chunks(batches, CHUNK_BYTES):
            got = enc.encode(common.bodies(part))
            yield pa.RecordBatch.from_arrays(
                [
                    common.ids(part),
                    pa.array([len(x) for x in got], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in got], pa.string()),
                    pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in got], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return common.texts(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
