import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm import decontam, lattice, linecrf, pii, toxicity, urls


# ---------------------------------------------------------------- decontamination


def test_leaks(spark, odd, nothing):
    r = random.Random(1)
    word = lambda: "".join(r.choice(["an", "er", "th", "on", "in", "st"]) for _ in range(r.randint(1, 4)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(k, f"{sentence(12)} {sentence(8)}") for k in range(30)] + [(99, None), (98, ""), (97, "the.")]
    docs, want = [], set()
    for k in range(60):
        text = " ".join(sentence(10) for _ in range(r.randint(1, 30)))
        if k % 3 == 0:
            item = r.choice(items[:30])
            cut = r.randint(0, len(text))
            text = text[:cut] + " " + (item[1].upper() if k % 2 else item[1]) + " " + text[cut:]
            want.add((k, item[0]))
        if k % 3 == 1:  # the question alone is no leak
            text += " " + items[k % 30][1].split(".")[0]
        docs.append((k, text))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.leaks(df, bench).collect()}
    assert got == want
    assert {x.doc_id for x in decontam.without_leaks(df, bench).collect()} == {k for k, _ in docs} - {k for k, _ in want}
    assert decontam.leaks(odd, bench).count() == 0 and decontam.leaks(nothing, bench).count() == 0
    assert decontam.leaks(df, bench.limit(0)).count() == 0 and decontam.without_leaks(odd, bench).count() == odd.count()


def test_search_equals_plain_scores(monkeypatch):
    """Pruned search against scoring every item for every window."""
    monkeypatch.setattr(decontam, "LEAST_OVERLAP", -1.0)
    r = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(6, 14))).encode()) for k in range(40)]
    index = decontam.build(items)
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 90))).encode() for _ in range(40)]
    got = {(d, k) for d, k, *_ in decontam.search(index, decontam.Terms(index.vocab), texts)}
    seqs = {i: decontam.words_of(t) for i, t in items}
    n, mean = len(items), np.mean([len(s) for s in seqs.values()])
    df = Counter(w for s in seqs.values() for w in set(s))
    idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    want = set()
    for d, t in enumerate(texts):
        ws = decontam.words_of(t)
        step = index.window // 2
        for b in range(0, max(1, len(ws)), step):
            have = set(ws[b : b + index.window])
            for i, s in seqs.items():
                one = {w: idf[w] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(s) / mean)) for w, c in Counter(s).items()}
                if sum(v for w, v in one.items() if w in have) / sum(one.values()) >= decontam.THRESHOLD - 1e-9:
                    want.add((d, i))
    assert got == want and want


def test_short_items_are_word_sequences(spark, monkeypatch):
    """Items of one to four words, beside long ones and in several shards; columns with clashing names."""
    items = [(1, "Who?"), (2, "blue sky"), (3, "one two three four"), (4, "two three"), (5, "..."), (6, None), (7, "blue sky"), (8, "what is the answer to all of this? forty two it is")]
    docs = [(1, "who knows"), (2, "a Blue, SKY!"), (3, "sky blue"), (4, "one two three"), (5, "x one two three four y one two three four"), (6, "blue"), (7, "sky"), (8, None), (9, "what is the answer to all of this? forty two it is")]
    bench = spark.createDataFrame([(*i, "b", 1) for i in items], "item_id long, text string, doc_id string, score int")
    df = spark.createDataFrame([(*d, "x", 0.5) for d in docs], "doc_id long, text string, item_id string, score double")
    want = {(1, 1), (2, 2), (2, 7), (4, 4), (5, 3), (5, 4), (9, 8)}
    for most in (50_000, 2):
        monkeypatch.setattr(decontam, "ITEMS_PER_SHARD", most)
        got = decontam.leaks(df, bench).collect()
        assert len(got) == len(want) and {(r.doc_id, r.item_id) for r in got} == want
        assert {(r.item_id, r.first_word) for r in got if r.doc_id == 5} == {(3, 1), (4, 2)}
        left = decontam.without_leaks(df, bench)
        assert {r.doc_id for r in left.collect()} == {3, 6, 7, 8} and left.columns == df.columns


# ---------------------------------------------------------------- personal data

PATTERNS = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    r = random.Random(3)
    for _ in range(5000):
        t = "".join(r.choice("ab.@-+_ 0123459()") for _ in range(r.randint(1, 40)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("9" * 200000) == [] and pii.base_spans("a" * 200000 + "@") == []


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_field_on_held_out_rows(field):
    good = found = wanted = 0
    for text, spans in pii.labelled_table(150, seed=99):
        got = {(s, e, pii.KINDS[k]) for s, k, e in pii.added_spans(field, [text], [[]])[0]}
        good += len(got & set(spans))
        found += len(got)
        wanted += len(spans)
    assert good / found > 0.9 and good / wanted > 0.9
    for clean in ["a plain text of words", "In 2024 we sold 12 units, v1.2.3, at 10:45.", 'token = "9b0b3c6a43eb78aa99cbd7049c372391524f37a8"', ""]:
        assert pii.added_spans(field, [clean], [[]]) == [[]]


#: Written by hand, apart from the table that the field learns from: text with [kind|span] marks.
BY_HAND = """
Please write to [email|john.a at mail dot com] before Friday.
Contact: [email|maria (at) posteo (dot) de], we answer soon.
Reach me under [email|t.smith [at] web [dot] org].
Fax and phone [phone|(030) 555-0199] in the office hours.
Ring [phone|212-555-0147] and ask for Anna.
My number is [phone|0049 30 123 4567].
Card number [card|4111-1111-1111-1112] was refused.
They paid with [card|5500 0000 0000 0005] yesterday.
The host [ip|192[.]168[.]0[.]12] did not answer.
Traffic came from [ip|10 . 0 . 0 . 7] all night.
In 1998 some 1,250 people met at the lake.
Chapter 12, pages 34-56, second edition 2004.
We meet at noon at the dot of the line.
The train at 10:45 costs 12.50, or 20 % less.
Version 3.11.2 fixed 42 defects.
Order 20240517 holds 3 items.
He was born on 12.05.1987 in Wien.
""".strip().split("\n")


def test_field_on_rows_by_hand(field):
    good = found = wanted = clean = 0
    for row in BY_HAND:
        text, spans = "", set()
        for k, part in enumerate(re.split(r"\[(email|phone|card|ip)\|(.*?)\](?=[ ,.]|$)", row)):
            if k % 3 == 1:
                kind = part
                continue
            if k % 3 == 2:
                spans.add((len(text), len(text) + len(part), kind))
            text += part
        base = pii.base_spans(text)
        got = {(s, e, pii.KINDS[k]) for s, k, e in [*base, *pii.added_spans(field, [text], [base])[0]]}
        good, found, wanted, clean = good + len(got & spans), found + len(got), wanted + len(spans), clean + (not spans and not got)
    assert good / found >= 0.8 and good / wanted >= 0.8 and clean >= 6, (good, found, wanted, clean)


def whole_decode(field, text):
    """Added spans by one Viterbi over every token of the text."""
    tokens, gaps, places = pii.tokens_of(text)
    if not tokens:
        return []
    base = pii.base_spans(text)
    labels = pii.crf.viterbi(field.scores(tokens, gaps)[None], np.ones((1, len(tokens)), bool), field.trans)[0]
    return sorted((s, k, e) for s, k, e in pii.runs(labels, places) if pii.plausible(k, text[s:e]) and all(e <= b or s >= f for b, _, f in base))


@pytest.mark.parametrize("around, scored", [(40, 20_000), (0, 7), (3, 20_000)])
def test_pieces_equal_a_decode_of_the_whole_text(monkeypatch, field, around, scored):
    monkeypatch.setattr(pii, "AROUND", around)
    monkeypatch.setattr(pii, "SCORED", scored)
    r = random.Random(10)
    rows = [t for t, _ in pii.labelled_table(80, seed=5)]
    texts = [" ".join(r.choice([*rows, " ".join(filler(r, r.randint(0, 40)))]) for _ in range(r.randint(1, 12))) for _ in range(150)]
    texts += ["".join(r.choice(["1", "22", " ", ".", "-", "a", "Bc", "@", " at ", " dot ", "(at) ", "é", "\n", "[", "+", "²"]) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["x at " + "a" * 45 + " dot org now", "y" * 5000 + "@ " + "z" * 5000, "12 " * 700, "", "7", "@"]
    for t in texts:
        assert pii.added_spans(field, [t], [pii.base_spans(t)])[0] == whole_decode(field, t), t


def test_pii_rows(spark, odd, nothing, field):
    rows = [(1, "é mail x.y@a.example.org or +1 (017) 555-7713 from 10.0.0.1 card 4111 1111 1111 1111"), (2, "call (212) 555-0123 now"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans(df, field).collect()}
    base = plain_spans(rows[0][1])
    text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[1].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) <= set(got[1].spans.split(","))
    assert got[2].n_phone == 0 and got[2].spans == "phone:5:19" and got[3].spans == ""
    clean = {r.doc_id: r.text for r in pii.redacted(df, field).collect()}
    assert clean[2] == "call <PHONE> now" and clean[3] is None and "@" not in clean[1]
    assert pii.spans(odd, field).count() == odd.count() and pii.spans(nothing, field).count() == 0 and pii.redacted(odd, field).columns == odd.columns
    assert pii.redact("abcdef", [(1, 0, 3), (2, 1, 4)]) == "a<EMAIL>ef"


# ---------------------------------------------------------------- classifiers


def labelled(spark, make, n=400, seed=4):
    r = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        y = int(r.random() < 0.3)
        docs.append((k, make(r, y)))
        labels.append((k, y))
    return spark.createDataFrame(docs, "doc_id long, text string"), labels


def filler(r, n):
    return [r.choice(["an", "er", "th", "on"]) + r.choice(["in", "st", "re"]) + r.choice(["", "ed", "ing"]) for _ in range(n)]


def auc(scores, y):
    rank = np.argsort(np.argsort(scores)) + 1
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_toxicity_held_out(spark, odd, nothing):
    def make(r, y):
        w = filler(r, r.randint(20, 200))
        for _ in range(4 * y):
            w.insert(r.randrange(len(w)), r.choice(["vile", "scum", "rotten"]) + r.choice(["", ",", "ness"]))
        return " ".join(w)

    df, labels = labelled(spark, make)
    lab = spark.createDataFrame(labels + [(5, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    index = toxicity.fit(df, lab)
    got = {r.id: r.score for r in toxicity.score(df, index).collect()}
    held = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    s, y = np.array([got[k] for k, _ in held]), np.array([y for _, y in held])
    assert auc(s, y) > 0.97 and ((s >= toxicity.THRESHOLD) == y).mean() > 0.95
    rows = toxicity.score(odd, index).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and toxicity.score(nothing, index).count() == 0
    kept = {r.doc_id for r in toxicity.without_toxic(df, index).collect()}
    assert kept == {k for k, v in got.items() if v < toxicity.THRESHOLD}
    none = toxicity.fit(df, lab.limit(0))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}


def test_nearest_is_exact():
    r = np.random.default_rng(5)
    index = toxicity.Index([b"t%d" % k for k in range(50)], np.full(50, 3.0), 500)
    vecs = []
    for _ in range(500):
        t = np.sort(r.choice(50, r.integers(1, 6), replace=False))
        vecs.append(index.vector(t, r.integers(1, 4, len(t)).astype(float), int(r.integers(5, 300))))
    index.build(np.arange(500), r.integers(0, 2, 500), vecs)
    dense = np.zeros((500, 51))
    for k, (t, w) in enumerate(vecs):
        dense[k, t] = w
    for k in range(0, 500, 7):
        near, cos = index.nearest(*vecs[k], 15)
        full = np.round(dense @ dense[k], 12)
        want = np.lexsort((np.arange(500), -full))[:15]
        assert (near == want).all() and np.allclose(cos, full[want])


@pytest.mark.parametrize("heads, block", [(0, 1), (5, 7), (40, 16), (512, 64)])
def test_block_maxima_leave_no_neighbour_out(monkeypatch, heads, block):
    monkeypatch.setattr(toxicity, "HEADS", heads)
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "POSTINGS", 500)
    r = np.random.default_rng(6)
    index = toxicity.Index([b"t%d" % k for k in range(300)], r.integers(1, 90, 300).astype(float), 200)
    vecs = []
    for k in range(200):
        t = np.unique(np.minimum(r.geometric(0.02, 20), 300) - 1) if k else np.zeros(0, np.int64)
        vecs.append(index.vector(t, r.integers(1, 4, len(t)).astype(float), 0.0 if k % 3 else 9.0))
    vecs[9] = vecs[8]
    ids = r.permutation(1000)[:200]
    index.build(ids, np.zeros(200), vecs)
    dense = np.zeros((200, 301))
    for k, (t, w) in enumerate(vecs):
        dense[k, t] = w
    full = np.round(dense @ dense.T, 12)
    at = {i: k for k, i in enumerate(index.ids.tolist())}
    found = list(index.search(toxicity.stacked(vecs), 9, np.array([at[i] for i in ids.tolist()])))
    for k, (near, cos) in enumerate(found):
        others = np.flatnonzero((np.arange(200) != k) & (full[k] > 0))
        want = others[np.lexsort((ids[others], -full[k, others]))][:9]
        assert index.ids[near].tolist() == ids[want].tolist() and np.allclose(cos, full[k, want])


def test_other_labels_count_as_none(spark):
    df = spark.createDataFrame([(k, "vile scum" if k < 20 else "fine words") for k in range(40)], "doc_id long, text string")
    lab = spark.createDataFrame([(k, int(k < 20)) for k in range(40)] + [(3, 7), (30, -1), (31, None)], "doc_id long, toxic int")
    index = toxicity.fit(df, lab)
    assert set(index.labels) == {0.0, 1.0} and len(index.ids) == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(40))
    got = {r.id: r.score for r in toxicity.score(df, index).collect()}
    assert got[3] > 0.5 > got[30]


def test_sample_is_bounded_by_bytes(spark):
    rows = [(k, "a" * 100) for k in range(40)] + [(1, "b" * 900), (1, "c")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, at int".replace(", at int", ""))
    lab = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    every = toxicity.examples(df, lab, "toxic", 2).collect()
    assert len(every) == len({r.id for r in every}) and all(bytes(r.body) == b"a" * 100 for r in every)
    some = toxicity.examples(df, lab, "toxic", 2, most_bytes=550).collect()
    assert [r.id for r in sorted(some, key=lambda r: r["at"])] == [r.id for r in sorted(every, key=lambda r: r["at"])][:5]
    assert toxicity.examples(df, lab, "toxic", 2, most_bytes=1).count() == 1


def test_toxic_copies_without_tied_words(spark):
    """Examples whose words are tied to no label are found by their texts."""
    r = random.Random(11)
    rows = [(k, " ".join(filler(r, 40)) + (" vile scum" if k % 5 == 0 else "")) for k in range(200)]
    lone = " ".join(f"zq{k}x" for k in range(25))
    rows += [(200 + k, lone) for k in range(2)] + [(300, lone.upper() + "!"), (301, lone + " and on"), (302, "unheard, of"), (303, "...")]
    labels = [(k, int(k % 5 == 0)) for k in range(200)] + [(200, 1), (201, 1)]
    assert {zlib.crc32(str(k).encode()) % 4 == 2 for k in (200, 201)} == {False}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x.id: x for x in toxicity.score(df, index).collect()}
    for k in (300, 301):
        assert got[k].neighbours[:2] == [200, 201] and got[k].score >= toxicity.THRESHOLD
    assert got[300].cosines[:2] == pytest.approx([1, 1]) and 0.9 < got[301].cosines[0] < 1
    assert got[302].neighbours == got[303].neighbours == [] and got[302].score == got[303].score == index.empty_score
    assert {x.doc_id for x in toxicity.without_toxic(df, index).collect()} == {k for k, x in got.items() if x.score < toxicity.THRESHOLD}


def test_cosines_are_over_all_words(spark):
    """Neighbours and cosines of whole texts against sums over dictionaries."""
    r = random.Random(12)
    rows = [(k, " ".join(filler(r, r.randint(1, 60)) + r.choices([f"rare{j}" for j in range(300)], k=6)) + (" viler, vile scum" if k % 6 == 0 else "")) for k in range(300)]
    labels = [(k, int(k % 6 == 0)) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    count = {k: Counter(x for w in t.encode().lower().split() for x in toxicity.terms_of(w)) for k, t in rows}
    known = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 4 != 2]
    n, p = len(known), sum(y for _, y in known) / len(known)
    df1, df0 = Counter(t for k, y in known if y for t in count[k]), Counter(t for k, y in known if not y for t in count[k])
    tied = {t for t, a in df1.items() if a >= 4 and (a - (a + df0[t]) * p) / ((a + df0[t]) * p * (1 - p)) ** 0.5 >= toxicity.Z_LEAST}
    assert b"scum" in tied and b"vile*" in tied

    def vector(k):
        v = {t: (1 + np.log(c)) * (np.log((1 + n) / (1 + df1[t] + df0[t])) + 1) * (toxicity.BOOST if t in tied else 1) for t, c in count[k].items() if t in tied or not t.endswith(b"*")}
        size = sum(x * x for x in v.values()) ** 0.5
        return {t: x / size for t, x in v.items()}

    every = {k: vector(k) for k, _ in known}
    for x in toxicity.score(df, index).collect():
        v = vector(x.id)
        cos = {k: round(sum(a * v.get(t, 0) for t, a in u.items()), 10) for k, u in every.items()}
        assert [round(c, 10) for c in x.cosines] == pytest.approx(sorted(cos.values(), reverse=True)[: toxicity.K], abs=1e-9)
        assert [cos[k] for k in x.neighbours] == pytest.approx(x.cosines, abs=1e-9)


def test_quality_held_out(spark, odd, nothing):
    def make(r, bad):
        lines = []
        for _ in range(r.randint(1, 12)):
            w = filler(r, r.randint(3, 20))
            if bad and r.random() < 0.8:
                w = [x + "###" for x in w]
            lines.append(" ".join(w).capitalize() + ".")
        return "\n".join(lines)

    df, labels = labelled(spark, make)
    lab = spark.createDataFrame([(k, 1 - y) for k, y in labels], "doc_id long, quality int")
    field = linecrf.fit(df, lab)
    got = {r.id: r.score for r in linecrf.score(df, field).collect()}
    held = [(k, 1 - y) for k, y in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    s, y = np.array([got[k] for k, _ in held]), np.array([y for _, y in held])
    assert auc(s, y) > 0.95
    rows = linecrf.score(odd, field).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and linecrf.score(nothing, field).count() == 0
    lines = {r.id: r.good for r in linecrf.line_marginals(df.limit(20), field).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    assert all(len(g) == texts[k].count("\n") + 1 for k, g in lines.items())
    assert {r.score for r in linecrf.score(odd, linecrf.fit(df, lab.limit(0))).collect()} == {1.0}


def plain_marginals(scores, trans):
    """Of a chain of lines, by enumeration of all label paths."""
    total, good, pairs = 0.0, np.zeros(len(scores)), np.zeros((2, 2))
    for path in itertools.product((0, 1), repeat=len(scores)):
        p = math.exp(sum(s for s, y in zip(scores, path, strict=True) if y) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
        total += p
        good += p * np.array(path)
        for a, b in itertools.pairwise(path):
            pairs[a, b] += p
    return good / total, pairs / total


def random_field(seed=8):
    r = np.random.default_rng(seed)
    field = linecrf.Field()
    field.constant, field.slope, field.offset = None, 1.3, -0.4
    field.weights, field.trans = r.normal(size=(3, linecrf.N_FEATURES)), r.normal(size=(2, 2))
    return field


LINES = ["Plain words here.", "", "same same same", "### ???", "éà 12 12 x", " \t ", "END"]


@pytest.mark.parametrize("run, lines, size", [(2000, 20000, 1 << 20), (1, 2, 9), (3, 1, 1), (2, 5, 40)])
def test_marginals_equal_enumeration(monkeypatch, run, lines, size):
    monkeypatch.setattr(linecrf, "RUN", run)
    monkeypatch.setattr(linecrf, "SLICE_LINES", lines)
    monkeypatch.setattr(linecrf, "SLICE_BYTES", size)
    r, field = random.Random(9), random_field()
    docs = ["\n".join(r.choice(LINES) for _ in range(r.randint(1, 9))).encode() for _ in range(30)] + [b"", b"\n\n"]
    good, per_doc, sizes = field.lines(docs)
    pairs, at = np.zeros((2, 2)), 0
    want_score = []
    for d, n in zip(docs, per_doc.tolist(), strict=True):
        rows = d.split(b"\n")
        assert n == len(rows) and sizes[at : at + n].tolist() == [len(x) + 1 for x in rows]
        x = np.vstack([linecrf.line_features([y])[0] for y in rows])
        s = [x[k] @ field.weights[0] + (x[k - 1] @ field.weights[1] if k else 0) + (x[k + 1] @ field.weights[2] if k + 1 < n else 0) for k in range(n)]
        want, p = plain_marginals(s, field.trans)
        assert np.allclose(good[at : at + n], want)
        pairs += p
        q = np.clip((want * sizes[at : at + n]).sum() / sizes[at : at + n].sum(), 1e-4, 1 - 1e-4)
        want_score.append(1 / (1 + math.exp(-(field.slope * math.log(q / (1 - q)) + field.offset))))
        at += n
    assert np.allclose(field.score(docs), want_score)
    if run == 2000:
        assert np.allclose(field.marginals(linecrf.beside(linecrf.line_features(docs)[0] @ field.weights.T, per_doc), per_doc)[1], pairs)


def test_a_million_short_lines():
    field = random_field()
    text = b"a\nbc\n\n" * 350_000
    tracemalloc.start()
    got = field.score([text, b"a"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(got).all() and peak < 600 << 20
    few = field.lines([b"a\nbc\n\n" * 400])[0]
    assert np.allclose(field.lines([text])[0][:300], few[:300]) and np.allclose(field.lines([text])[0][-300:], few[-300:])


# ---------------------------------------------------------------- language model


def test_lattice_equals_plain_recursion(tokenizers_dir):
    p = lattice.pieces(f"{tokenizers_dir}/piece_bpe_32k.model")
    words = [b"the", b"thndwhble", b"\xc3\xa9\xc3\xa7", b"\xf0\x9f\x98\x80z", b"a" * 30, b"hello,world!", b"\xff"]
    assert np.allclose(p.log_probs(words), [lattice.brute_force(p, w) for w in words])
    assert np.isfinite(p.log_probs([b"x" * 20000])).all() and len(p.log_probs([])) == 0


@pytest.mark.parametrize("most", [100_000, 3])
def test_language_model(spark, odd, nothing, tokenizers_dir, monkeypatch, most):
    plain = lattice.frequent
    monkeypatch.setattr(lattice, "frequent", lambda counts: plain(counts, most))
    path = f"{tokenizers_dir}/piece_bpe_32k.model"
    from tidegate.llm import common

    rows = [(k, " ".join(filler(random.Random(k), 30)).upper() if k % 5 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    every = [(r.doc_id, (r.text or "").encode().lower().split() + [b"\n"]) for r in df.collect()]
    training = common.texts(df.where("doc_id is not null")).where(common.fold("id", 7) != 2)
    counts = common.written(lattice.word_counts(training), "counts")
    got = lattice.score(df, counts, path).collect()
    assert len(got) == len(every)
    c = Counter(w for i, ws in every if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    p = lattice.pieces(path)
    want = {}
    for i, ws in every:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        lat = np.array([math.log(lattice.STOP) if w == b"\n" else p.log_probs([w])[0] for w in set(ws)])
        each = dict(zip(set(ws), lat, strict=True))
        mixed = sum(np.logaddexp(math.log(c[w] / (n + v)) if c[w] else -np.inf, math.log(v / (n + v)) + each[w]) / math.log(10) for w in ws)
        alone = sum(each[w] / math.log(10) for w in ws)
        want.setdefault(i, []).append((len(ws), sum(c[w] > 0 for w in ws), base, mixed, alone))
    for r in got:
        assert r.train_tokens == n
        assert any((r.n_tokens, r.n_known) == w[:2] and math.isclose(r.base_score, w[2], rel_tol=1e-9) and math.isclose(r.score, w[3], rel_tol=1e-9) and math.isclose(r.lattice_score, w[4], rel_tol=1e-9) for w in want[r.id]), r
    assert lattice.score(nothing, counts, path).count() == 0
    bare = lattice.score(odd, counts.limit(0), path).collect()
    assert len(bare) == odd.count() and all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in bare)


# ---------------------------------------------------------------- urls


def test_urls(spark):
    rows = [
        (1, "http://a.example.org/en/825?x=1#y"), (2, "https://example.org/es/1"), (3, "HTTPS://EXAMPLE.ORG/en/17"), (4, "http://x.com/fr/"), (5, "http://x.com/de/1"), (6, "http://notorg/"),
        (7, None), (8, "no scheme"), (9, "http://org"), (10, "http://host.net"), (11, "http://user@h.com:80/fr/?q=://z"), (11, "http://user@h.com:80/fr/?q=://z"), (None, "http://a.com/fr/x"), (12, ""), (13, "x://É.org/ü/é?"), (14, "http://b.org#/x"),
    ]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id long, url string, times int, host string")
    got = urls.judge(df).collect()
    assert len(got) == len(rows)
    want = {1: ("a.example.org", "/en/825", "org/", "allow"), 2: ("example.org", "/es/1", "example.org/es/", "block"), 3: ("example.org", "/en/17", "example.org/en/1", "block"), 4: ("x.com", "/fr/", "com/fr/", "allow"), 5: ("x.com", "/de/1", "com/de/", "block"), 6: ("notorg", "/", None, None), 7: ("", "", None, None), 8: ("", "", None, None), 9: ("org", "", None, None), 11: ("user@h.com:80", "/fr/", None, None), 13: ("É.org", "/ü/é", "org/", "allow"), 14: ("b.org", "", None, None)}
    for r in got:
        assert r.verdict in ("allow", "block")
        if r.page_id in want:
            w = want[r.page_id]
            assert (r.host, r.path, r.rule) == w[:3] and w[3] in (None, r.verdict), r
    assert sum(r.page_id == 11 for r in got) == 2
    assert urls.judge(df.limit(0)).count() == 0


def test_url_model_equals_plain_smoothing(spark):
    rows = [(f"http://{h}.org/{p}", "allow") for h in "abc" for p in ("en", "fr1")] + [(f"http://{h}.com/x-{p}", "block") for h in "xyz" for p in ("spam", "win9")]
    df = spark.createDataFrame(rows, "url string, by_rule string").withColumn("codes", urls.codes(urls.symbols(F.col("url"))))
    table = {r.code: r.ratio for r in urls.ratios(urls.counts(df)).collect()}

    def number(ch):
        return ord(ch) - 97 if "a" <= ch <= "z" else 26 if ch.isdigit() else {"/": 27, ".": 28, "-": 29}.get(ch, 30)

    seqs = {y: [[31] * 3 + [number(c) for c in u] for u, v in rows if v == y] for y in ("allow", "block")}

    def prob(y, ctx, s):
        if not ctx:
            flat = [c for q in seqs[y] for c in q[3:]]
            return (flat.count(s) + 1) / (len(flat) + 32)
        after = [q[k] for q in seqs[y] for k in range(3, len(q)) if tuple(q[k - len(ctx) : k]) == ctx]
        low = prob(y, ctx[1:], s)
        return low if not after else (after.count(s) + len(set(after)) * low) / (len(after) + len(set(after)))

    seen = 0
    for y in seqs:
        for q in seqs[y]:
            for k in range(3, len(q)):
                ctx = tuple(q[k - 3 : k])
                code = (1 << 20) + sum(v * 32**j for j, v in enumerate(reversed((*ctx, q[k]))))
                assert math.isclose(table[code], math.log(prob("allow", ctx, q[k]) / prob("block", ctx, q[k])), abs_tol=1e-9)
                seen += 1
    assert seen > 100
    scored = urls.scored(df.select("url", "codes").distinct(), spark.createDataFrame(list(table.items()), "code int, ratio double")).collect()
    assert all((r.score > 0) == (".org" in r.url) for r in scored)
