import hashlib
import random
import zlib

import numpy as np
import pytest

from tidegate.llm import bpe, common, records

PIECES = ["a", "b", "A ", "1", "'s", "t", "é", "é", "中", "\n", "\t", " ", "  ", "\x1c", "\x85", "Σ", "😀", "<|endoftext|>", "<|startoftext|>", "!", ".", "aaaa", "՘", "꟎"]


def texts(n=300, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 40))) for _ in range(n)] + ["", "a" * 3000, "ab" * 2000, " " * 100, "the quick brown fox " * 50]


@pytest.fixture(scope="module")
def library(tokenizers_dir):
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(f"{tokenizers_dir}/{n}") for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def test_pair_index_equals_the_library(library, tokenizers_dir):
    enc, lib = bpe.Encoder(f"{tokenizers_dir}/byte_bpe_50k.json"), library["byte_bpe_50k.json"]
    every = texts()
    got = enc.encode([t.encode() for t in every])
    want = lib.encode_batch(every, add_special_tokens=False)
    assert [g.tolist() for g in got] == [w.ids for w in want]
    for g, w, t in zip(got, want, every, strict=True):
        assert enc.decode(g).decode() == lib.decode(w.ids, skip_special_tokens=False) == t
    again = enc.encode([t.encode() for t in every])  # from the cache
    assert all((a == b).all() for a, b in zip(got, again, strict=True))


def test_digest_on_odd_rows(odd, nothing, library, tokenizers_dir):
    path = f"{tokenizers_dir}/byte_bpe_50k.json"
    rows = bpe.digest(odd, path).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in odd.collect():
        ids = library["byte_bpe_50k.json"].encode(r.text or "", add_special_tokens=False).ids
        by.setdefault(r.doc_id, []).append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in by[r.doc_id]
    assert bpe.digest(nothing, path).count() == 0
    full = {r.id: r for r in bpe.encode(odd, path).collect() if r.id is not None}
    assert full[3].tokens == [] and full[5].decoded == "é中😀 <|endoftext|> a\x00b\x85c"


def test_word_cache_equals_the_library(library, tokenizers_dir):
    cache = records.WordCache(f"{tokenizers_dir}/word_bpe_49k.json")
    every = texts(seed=2)
    assert [g.tolist() for g in cache.encode([t.encode() for t in every])] == [w.ids for w in library["word_bpe_49k.json"].encode_batch(every, add_special_tokens=False)]


def test_words_and_marks_equal_the_library(library, tokenizers_dir):
    """Parts of letters and marks in all orders, with what joins or splits them."""
    cache, lib = records.WordCache(f"{tokenizers_dir}/word_bpe_49k.json"), library["word_bpe_49k.json"]
    r = random.Random(5)
    marks = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    letters = [*"aZzQ", "the", "É", "ß", "ÿ", "Ÿ", "ñ", "İ", "Σ", "ς", "ﬁ", "ª", "é", "\u0301", "\u0338", "×", "9", "½", "中", "'s", "'LL", "<|endoftext|>", "\x00", "\x1f", "\xa0"]
    every = ["".join(r.choice(marks if r.random() < 0.45 else letters) for _ in range(r.randint(1, 7))) for _ in range(30000)]
    every += [a + b for a in letters for b in marks] + [b + a for a in letters for b in marks] + [chr(c) for c in range(0x250)] + ["x" + chr(c) + "y." for c in range(0x250)]
    for k in (0, 1):  # the second time from the cache
        got = cache.encode([t.encode() for t in every])
        for t, g, w in zip(every, got, lib.encode_batch(every, add_special_tokens=False), strict=True):
            assert g.tolist() == w.ids, (k, t)
    assert cache.encode([b"\xff\xfea b"])[0].tolist() == lib.encode("\ufffd\ufffda b", add_special_tokens=False).ids


def test_records_round_trip(spark, odd, nothing, library, tokenizers_dir):
    path = f"{tokenizers_dir}/word_bpe_49k.json"
    manifest = records.write(odd, path, common.shared_dir(spark, "records"), end=2)
    got = sorted(records.read(manifest).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    start = 0
    for g, (i, t) in zip(got, want, strict=True):
        ids = [*library["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    file = manifest.first().file
    one = records.RecordFile(file)
    seen = dict(enumerate(x.tolist() for _, x in one.shuffled(3)))
    assert sorted(map(len, seen.values())) == sorted(one.entries["tokens"].tolist())
    empty = records.write(nothing, path, common.shared_dir(spark, "records"), end=2)
    assert records.read(empty).count() == 0


def test_damaged_records_are_noticed():
    data = records.frame(b"\1\2\3\4")
    assert records.unframe(data, 0) == (b"\1\2\3\4", len(data))
    for k in range(len(data)):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(records.Corrupt):
            records.unframe(bytes(bad), 0)
