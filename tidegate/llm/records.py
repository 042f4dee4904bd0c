"""Token ids in length-delimited binary records, with an index beside each file.

A data file is a run of records: the payload's length (8 bytes), a masked checksum of these bytes
(4), the payload (token ids, 2 or 4 bytes each), and a masked checksum of it (4), all little-endian.
Its index file starts with a header (magic, bytes per id, number of records) and has a fixed-size
entry per record: document id, byte offset of the record, number of tokens and whether the id
is there at all. So records can be read in any order. The checksum is CRC-32, rotated and shifted
by a constant so that a checksum over data that holds checksums stays useful.

Writing: documents are encoded where they are read, and the ids, which are shorter than the texts,
are dealt in ranges of ascending id; each partition, sorted by id, is one file.
A file is written under a name of its own and renamed when complete, so a task that runs again or
twice leaves the same file. A manifest (one row per file) turns per-file totals into offsets.

Defined cases: null and empty texts are records of the end id alone; documents without an id come
first and keep a null id; rows that repeat (same id) are all written, in an order that their texts
fix; texts of any length are one record; an empty table writes no file and reads back as no rows.
Columns beside the id and the text aren't read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.llm import bpe, common

MAGIC = b"TIDEREC1"
ENTRY = np.dtype([("id", "<i8"), ("offset", "<u8"), ("tokens", "<u4"), ("has_id", "<u4")])
MASK = 0xA282EAD8
CHUNK_BYTES = 2 << 20
#: Rows sampled for each file to find where its ids end.
SAMPLED = 50
#: Cached encodings of words and of runs of marks, by worker; some 50 bytes each.
CACHE_WORDS = 400_000


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


class Corrupt(ValueError):
    """A record whose checksum doesn't fit."""


def unframe(data, at: int) -> tuple[bytes, int]:
    """The payload of the record at a place, and the place after it."""
    head = bytes(data[at : at + 8])
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise Corrupt(f"length at byte {at}")
    (n,) = struct.unpack("<Q", head)
    payload = bytes(data[at + 12 : at + 12 + n])
    if len(payload) < n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise Corrupt(f"payload at byte {at}")
    return payload, at + 16 + n


def where(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


# ---------------------------------------------------------------- encoding


# Letters that the library's normaliser only lowers, whatever stands around them; ASCII
# marks that the vocabulary's pattern never joins to a letter and that aren't in all special tokens.
LETTERS, LOWER = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[a-zß-öø-ÿ]"
MARKS = r"""[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{}~]"""


class WordCache:
    """Encodings by the library of what lies between ASCII blanks.

    The vocabulary's pre-tokenizer drops blanks and its pieces never span one, and neither its
    normaliser nor its special tokens reach across one, so a text's ids are those of its parts in
    order. A part that is a word of LETTERS with marks around it is its marks, its letters in lower case
    and its marks; other parts lose the marks that follow a last such letter. What is left is looked
    up in one Arrow array, and what is new in a chunk is encoded: plain words by the model itself
    (which, but for the characters that stand for bytes, is all that the library does to them), the
    rest by the whole library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would each hold memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chars = dict(enumerate(bpe.byte_chars()))
        self.reset()

    def reset(self) -> None:
        self.known = pa.array([], pa.string())
        self.starts, self.lens, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def numbers(self, pieces: pa.StringArray) -> np.ndarray:
        """Of each piece its place in the cache; new ones are learnt."""
        coded = pieces.dictionary_encode()
        at = pc.index_in(coded.dictionary, self.known)
        if at.null_count:
            missing = at.is_null()
            self.learn(coded.dictionary.filter(missing))
            found = pc.fill_null(at, 0).to_numpy().astype(np.int64)
            found[missing.to_numpy(zero_copy_only=False)] = np.arange(len(self.known) - at.null_count, len(self.known))
        else:
            found = at.to_numpy().astype(np.int64)
        return found[coded.indices.to_numpy()]

    def learn(self, new: pa.StringArray) -> None:
        plain = pc.match_substring_regex(new, f"^{LOWER}+$")
        model = self.tokenizer.model.tokenize
        as_bytes = lambda w: w if w.isascii() else w.encode().decode("latin-1").translate(self.chars)
        ids = [[t.id for t in model(as_bytes(w))] if p else None for w, p in zip(new.to_pylist(), plain.to_pylist(), strict=True)]
        other = [k for k, found in enumerate(ids) if found is None]
        for k, got in zip(other, self.tokenizer.encode_batch_fast(new.take(pa.array(other, pa.int64())).to_pylist(), add_special_tokens=False), strict=True):
            ids[k] = got.ids
        lens = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((x for i in ids for x in i), np.uint32, int(lens.sum()))
        self.known = pa.concat_arrays([self.known, new])
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lens, dtype=np.int64) - lens]
        self.lens, self.flat = np.r_[self.lens, lens], np.r_[self.flat, flat]

    def words(self, parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts end to end, and where each part's begin and how many it has."""
        front, core, tail = pc.extract_regex(parts, f"^(?P<a>{MARKS}*)(?P<b>{LETTERS}+)(?P<c>{MARKS}*)$").flatten()
        odd = core.is_null()
        rest = parts.filter(odd)
        behind = pc.extract_regex(rest, f"(?s)^(?P<b>.*{LETTERS})(?P<c>{MARKS}+)$").flatten()
        core = pc.replace_with_mask(pc.utf8_lower(core), odd, pc.coalesce(behind[0], rest))
        tail = pc.fill_null(pc.replace_with_mask(tail, odd, behind[1]), "")
        front = pc.fill_null(front, "")
        got = self.numbers(pa.concat_arrays([front, core, tail])).reshape(3, -1).T
        lens = self.lens[got].astype(np.int64)
        flat = self.flat[common.ranges(self.starts[got].ravel(), lens.ravel())]
        each = lens.sum(1)
        return flat, np.cumsum(each) - each, each

    def encode_arrow(self, texts: pa.StringArray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin and the last's end."""
        if len(self.known) > CACHE_WORDS:
            self.reset()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        flat, starts, lens = self.words(coded.dictionary)
        which = coded.indices.to_numpy()
        n = lens[which]
        ids = flat[common.ranges(starts[which], n)]
        cut = np.r_[0, np.cumsum(n)][bounds - bounds[0]]
        if end is not None:
            ids = np.insert(ids, cut[1:], end)
            cut = cut + np.arange(len(cut))
        return ids, cut

    def encode(self, bodies: list[bytes], end: int | None = None) -> list[np.ndarray]:
        ids, cut = self.encode_arrow(pa.array([b.decode("utf-8", "replace") for b in bodies], pa.string()), end)
        return [ids[s:e] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


_caches: dict[str, WordCache] = {}


def cache_of(path: str) -> WordCache:
    common.claim("records", _caches.clear)
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


# ---------------------------------------------------------------- files


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts with what orders them within one id: a hash of the text, and any number for equal ones."""
    return common.texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("body")).withColumn("any", F.monotonically_increasing_id())


def bounds(keyed: DataFrame, n: int) -> list[tuple]:
    """Upper ends of all but the last of ``n`` ranges of ``id``, ``tie`` and ``any`` with about as many rows
    each, from a sample of some SAMPLED rows a range."""
    rows = keyed.count()
    sample = keyed.select("id", "tie", "any").sample(min(1.0, SAMPLED * n / max(rows, 1)), 3).collect() if n > 1 else []
    keys = sorted((r.id is not None, r.id or 0, r.tie, r["any"]) for r in sample)
    return [keys[k * len(keys) // n] for k in range(1, n)] if keys else []


def encoded(keyed: DataFrame, path: str, end: int | None, ends: list[tuple]) -> DataFrame:
    """``part`` (the range that a document is in), ``id``, ``tie``, ``tokens`` (their number), ``width``
    (bytes of an id) and ``payload`` (the ids) of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_of(path)
        width = 2 if cache.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 and (end or 0) < 65536 else 4
        for chunk in common.chunks(batches, CHUNK_BYTES):
            ids, cut = cache.encode_arrow(common.strings(chunk), end)
            payload = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chunk), [None, pa.py_buffer(cut * width), pa.py_buffer(ids.astype(f"<u{width}").tobytes())])
            keys = zip(chunk.column("id").to_pylist(), chunk.column("tie").to_pylist(), chunk.column("any").to_pylist(), strict=True)
            part = pa.array([bisect_right(ends, (i is not None, i or 0, t, a)) for i, t, a in keys], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part, common.ids(chunk), common.ids(chunk, "tie"), pa.array(np.diff(cut)), pa.array(np.full(len(chunk), width, np.int32)), payload.cast(pa.binary())],
                names=["part", "id", "tie", "tokens", "width", "payload"],
            )
            del ids, cut, payload
            pa.default_memory_pool().release_unused()

    return keyed.mapInArrow(work, "part int, id long, tie long, tokens long, width int, payload binary")


def write(docs: DataFrame, path: str, folder: str, end: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files; returns the written manifest: ``file``, ``part``, ``docs``, ``tokens`` and
    ``before`` (tokens in the files before it)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = where(folder)
        name, own = f"{root}/part-{part:06d}", f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        out, offset, tokens, width = None, 0, 0, 0
        entries = []
        for chunk in common.chunks(batches, CHUNK_BYTES, "payload"):
            if out is None:
                fs.create_dir(root, recursive=True)
                out, width = fs.open_output_stream(f"{own}.rec"), chunk.column("width")[0].as_py()
            frames = [frame(x) for x in common.bodies(chunk, "payload")]
            out.write(b"".join(frames))
            sizes = np.fromiter(map(len, frames), np.int64, len(frames))
            e = np.zeros(len(frames), ENTRY)
            ids = common.ids(chunk)
            e["has_id"] = ids.is_valid().to_numpy(zero_copy_only=False)
            e["id"] = ids.fill_null(0).to_numpy()
            e["offset"] = offset + np.cumsum(sizes) - sizes
            e["tokens"] = chunk.column("tokens").to_numpy()
            entries.append(e)
            offset += int(sizes.sum())
            tokens += int(e["tokens"].sum(dtype=np.int64))
        if out is None:
            return
        out.close()
        every = np.concatenate(entries)
        with fs.open_output_stream(f"{own}.idx") as f:
            f.write(MAGIC + struct.pack("<II", width, 0) + struct.pack("<Q", len(every)) + every.tobytes())
        fs.move(f"{own}.idx", f"{name}.idx")
        fs.move(f"{own}.rec", f"{name}.rec")
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/part-{part:06d}"]), pa.array([part], pa.int32()), pa.array([len(every)], pa.int64()), pa.array([tokens], pa.int64())],
            names=["file", "part", "docs", "tokens"],
        )

    # the ids are shuffled, not the texts; ranges are of ids and then of a hash and any number, so that
    # rows without an id, or with one id, or all alike, are dealt out too
    keyed = _keyed(docs, id_col, text_col)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = encoded(keyed, path, end, bounds(keyed, n)).repartitionById(n, F.col("part")).sortWithinPartitions("id", "tie", "payload")
    manifest = common.written(dealt.mapInArrow(work, "file string, part int, docs long, tokens long"), "manifest")
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("before", before)


class RecordFile:
    """Random access to one data file by its index."""

    def __init__(self, file: str):
        fs, path = where(file)
        with fs.open_input_stream(f"{path}.idx") as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise Corrupt(f"{file}.idx")
        self.width = struct.unpack_from("<I", raw, 8)[0]
        self.entries = np.frombuffer(raw, ENTRY, offset=24)
        if len(self.entries) != struct.unpack_from("<Q", raw, 16)[0]:
            raise Corrupt(f"{file}.idx")
        self.data = fs.open_input_file(f"{path}.rec")

    def __len__(self) -> int:
        return len(self.entries)

    def span(self, first: int, last: int) -> bytes:
        """The bytes of records first to last - 1."""
        start = int(self.entries["offset"][first])
        end = int(self.entries["offset"][last]) if last < len(self) else self.data.size()
        return self.data.read_at(end - start, start)

    def ids(self, payload: bytes) -> np.ndarray:
        return np.frombuffer(payload, f"<u{self.width}").astype(np.uint32)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.ids(unframe(self.span(k, k + 1), 0)[0])

    def shuffled(self, seed: int) -> Iterator[tuple[int, np.ndarray]]:
        """(document id, ids) of all records in an order that the seed fixes."""
        for k in np.random.default_rng(seed).permutation(len(self)).tolist():
            yield int(self.entries["id"][k]), self[k]


def read(manifest: DataFrame) -> DataFrame:
    """One row per record, with its checks made: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                records = RecordFile(file)
                start = before
                for first in range(0, len(records), 2000):
                    e = records.entries[first : first + 2000]
                    raw, at, crc = records.span(first, first + len(e)), 0, []
                    for n in e["tokens"].tolist():
                        payload, at = unframe(raw, at)
                        ids = records.ids(payload)
                        if len(ids) != n:
                            raise Corrupt(f"{file}: {len(ids)} tokens, {n} in the index")
                        crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    n = e["tokens"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(e["id"], mask=e["has_id"] == 0), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    start += int(n.sum())

    # one task for each file, though the rows that name them are few: the number is given, so that
    # it isn't lowered to fit their bytes
    files = manifest.select("file", "before", "part")
    return files.repartitionByRange(max(1, files.count()), "part").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return read(write(docs, public_tokenizers.path("word_bpe_49k.json"), common.shared_dir(spark, "records"), end=2))
