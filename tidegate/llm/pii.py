"""Personal data: exact base patterns, and a linear-chain conditional random field that adds spans.

The base finds e-mail and IP addresses, payment cards (Luhn) and phone numbers by the patterns of
its contract. The field finds what they miss: numbers and addresses in other spellings, told by
word shapes and neighbouring words. It is trained on the driver from a small labelled table
(``labelled_table``) and decodes by Viterbi in numpy batches. An added span is one of the four kinds
too, holds what its kind must hold (``plausible``: digits, an at sign or a spelled ``at ... dot``) and
never overlaps a base span.

The added spans are those of a decoding of the whole text. Where "other" beats every label of a token
by more than the transitions to and from its neighbours can make up for, the best path has "other"
there, whatever else the text holds; so the text falls apart at such tokens and only the pieces that
hold what a span must hold are decoded. They are found by reading on from each digit, at sign or
``at ... dot`` to such a token on either side, however far off it is.

Defined cases: null and empty texts have no spans; counts and digest are of base spans, ``spans``
has both; offsets are code points; rows that repeat are reported each; texts of any length are read
whole; bytes that are no UTF-8 are replaced; an empty table gives no rows. Columns beside the id and
the text aren't read (``redacted`` keeps them).
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import common, crf

KINDS = ("email", "ip", "card", "phone")
CHUNK_BYTES = 8 << 20

# The base patterns. A look-behind lets a run of digits begin a match once only, which
# changes no match and keeps long runs linear.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_in(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: a run of local characters that ends at an at sign, then a domain."""
    done = at = 0
    while (m := DOMAIN.search(text, at)) is not None:
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, 0, m.end()
            done = at = m.end()
        else:
            at = m.start() + 1


def base_spans(text: str) -> list[Span]:
    out: list[Span] = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            d = digits_in(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(digits_in(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# ---------------------------------------------------------------- the field

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_")
SPELLED = r"(?i:[\[( ]at[\]) ](?=([^\n]{1,60}?[\[( ]dot[\]) ])))"
TRIGGER = re.compile(rf"[0-9@]+|{SPELLED}")
SPELLED = re.compile(SPELLED)
#: Code points that are read at first on either side of what a span must hold.
AROUND = 40
#: Tokens before and after one that its features look at, and tokens scored at once.
BEFORE, AFTER, SCORED = 2, 3, 20_000
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def shape(token: str) -> str:
    c = token[0]
    if c.isdigit():
        return f"d{len(token)}" if len(token) < 20 else "d20"
    if c.isalpha():
        case = "X" if token.isupper() else "Xx" if c.isupper() else "x"
        return f"{case}{min(len(token), 4)}" if token.isascii() else f"{case}u"
    return token


def features(tokens: list[str], gaps: list[bool], first: int = 0, last: int | None = None) -> list[list[str]]:
    """Of each token (or of those from first to last - 1): shapes and words of it and its neighbours;
    ``gaps``: a blank stands before."""
    n = len(tokens)
    shapes = [shape(t) for t in tokens]
    lower = [t.lower() for t in tokens]
    get = lambda xs, k: xs[k] if 0 <= k < n else "#"
    glue = lambda k: "_" if 0 <= k < n and gaps[k] else "-"
    out = []
    for i in range(first, n if last is None else last):
        s = shapes
        f = [f"s={s[i]}", f"w={lower[i]}", f"s-1={get(s, i - 1)}{glue(i)}", f"s+1={glue(i + 1)}{get(s, i + 1)}"]
        f += [f"s-2={get(s, i - 2)}{glue(i - 1)}", f"s+2={glue(i + 2)}{get(s, i + 2)}", f"w-1={get(lower, i - 1)}", f"w+1={get(lower, i + 1)}", f"w-2={get(lower, i - 2)}", f"w+2={get(lower, i + 2)}", f"w+3={get(lower, i + 3)}"]
        f += [f"s-1s={get(s, i - 1)}{glue(i)}{s[i]}", f"ss+1={s[i]}{glue(i + 1)}{get(s, i + 1)}"]
        f += [f"s-1ss+1={get(s, i - 1)}{glue(i)}{s[i]}{glue(i + 1)}{get(s, i + 1)}", f"s-2s-1s={get(s, i - 2)}{glue(i - 1)}{get(s, i - 1)}{glue(i)}{s[i]}", f"ss+1s+2={s[i]}{glue(i + 1)}{get(s, i + 1)}{glue(i + 2)}{get(s, i + 2)}"]
        out.append(f)
    return out


def tokens_of(text: str, start: int = 0, end: int | None = None) -> tuple[list[str], list[bool], list[tuple[int, int]]]:
    found = list(TOKEN.finditer(text, start, len(text) if end is None else end))
    spans = [m.span() for m in found]
    gaps = [k == 0 or spans[k][0] > spans[k - 1][1] for k in range(len(spans))]
    return [m[0] for m in found], gaps, spans


def labelled_table(rows: int = 600, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]) rows made from templates: what the field learns from."""
    r = random.Random(seed)
    digit = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(["an", "er", "th", "on", "le", "ch", "qu", "os", "ein", "re", "mi", "da"]) for _ in range(r.randint(1, 4)))
    host = lambda: r.choice(["mail", "post", "web"]) + r.choice(["", digit(1)])
    top = lambda: r.choice(["com", "org", "net", "de", "fr", "es"])

    def phone() -> str:
        a, b, c = digit(3), digit(3), digit(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digit(2)} {digit(2)} {digit(3)} {digit(4)}", f"0{digit(3)} {digit(6)}", f"+{digit(1)} {a} {b}", f"0{digit(2)}/{digit(7)}", f"({a}){b}-{c}"])

    def card() -> str:
        g = [digit(4) for _ in range(4)]
        return r.choice(["".join(g), " ".join(g), "-".join(g), ".".join(g), f"{g[0]} {digit(6)} {digit(5)}", "".join(g)])

    def ip() -> str:
        p = [str(r.randint(1, 254)) for _ in range(4)]
        return r.choice([f"{p[0]} . {p[1]} . {p[2]} . {p[3]}", f"{p[0]}[.]{p[1]}[.]{p[2]}[.]{p[3]}", f"{p[0]}(.){p[1]}(.){p[2]}(.){p[3]}", ".".join(p)])

    def email() -> str:
        name = lambda: r.choice([word(), word(), word(), r.choice("abcdefgjmpst"), word() + digit(r.randint(1, 3)), word().capitalize()])
        u = r.choice([name(), name(), f"{name()}.{name()}", f"{name()}.{name()}", f"{name()}_{name()}", f"{name()}-{name()}"])
        return r.choice([f"{u} at {host()} dot {top()}", f"{u} [at] {host()} [dot] {top()}", f"{u}(at){host()}(dot){top()}", f"{u} @ {host()} . {top()}", f"{u}@{host()}.{word()}.{top()}", f"{u} AT {host()} DOT {top()}"])

    def other() -> str:
        return r.choice(
            [f"{r.randint(1980, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1980, 2030)}", f"{digit(2)}:{digit(2)}", f"v{digit(1)}.{digit(1)}.{digit(1)}", f"{digit(r.randint(1, 6))}", f"{digit(1)},{digit(3)},{digit(3)}", f"{digit(2)}.{digit(2)}", f"{digit(2)} %", f"id {digit(9)}", f"{digit(8)}", f"{digit(24)}", f"p. {digit(2)}-{digit(2)}", f"{digit(3)} {word()} {digit(2)}", f"{word()} at {word()} {word()}", f"http://{word()}.com/{digit(3)}", "token = \"" + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', f"{digit(4)}/{digit(2)}", f"{digit(3)}, {digit(3)}, {digit(4)}", f"isbn {digit(3)}-{digit(1)}-{digit(5)}-{digit(3)}-{digit(1)}", f"Version {digit(1)}.{digit(1)}", f"{digit(3)} {digit(3)} {digit(3)} {digit(3)} {digit(3)} {digit(3)} {digit(3)}", f"{digit(10)}"]
        )

    make = {"phone": phone, "card": card, "ip": ip, "email": email}
    cue = {"phone": ["call", "tel", "phone", "tel :", ""], "card": ["card", "visa", "card number", "", ""], "ip": ["from", "ip", "host", ""], "email": ["mail", "write to", "contact", ""]}
    out = []
    for _ in range(rows):
        text = ""
        spans = []
        for part in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 5))) + r.choice([" ", " ", ". ", ", ", " | "])
            kind = r.choice(["phone", "card", "ip", "email", None, None, None, None])
            value = other() if kind is None else make[kind]()
            if kind is not None and (c := r.choice(cue[kind])):
                text += c + " "
            if kind is not None:
                spans.append((len(text), len(text) + len(value), kind))
            text += value + r.choice([" ", " ", ". ", ", ", "; ", " | "])
        text += " ".join(word() for _ in range(r.randint(0, 4)))
        out.append((text, spans))
    return out


class Field:
    """Weights of the trained field, and decoding."""

    def __init__(self, numbers: dict[str, int], emit: np.ndarray, trans: np.ndarray):
        self.numbers, self.emit, self.trans = numbers, np.vstack([emit, np.zeros((1, len(LABELS)))]), trans
        # the most by which a path can gain from transitions when one label is put in place of "other"
        ends = np.vstack([trans, np.zeros(len(LABELS))])
        begins = np.hstack([trans, np.zeros((len(LABELS), 1))])
        self.gain = (ends - ends[:, :1]).max(0) + (begins - begins[:1]).max(1)

    def scores(self, tokens: list[str], gaps: list[bool]) -> np.ndarray:
        """Emission scores of a sequence's tokens."""
        get, none = self.numbers.get, len(self.numbers)
        out = np.zeros((len(tokens), len(LABELS)))
        for i in range(0, len(tokens), SCORED):
            lo, hi = max(0, i - BEFORE - 1), min(len(tokens), i + SCORED + AFTER + 1)
            part = features(tokens[lo:hi], gaps[lo:hi], i - lo, min(i + SCORED, len(tokens)) - lo)
            out[i : i + len(part)] = self.emit[np.array([[get(x, none) for x in f] for f in part], np.int64)].sum(1)
        return out

    def certain(self, scores: np.ndarray) -> np.ndarray:
        """Tokens that are "other" on the best path, whatever stands around them."""
        return (scores[:, :1] - scores[:, 1:] > self.gain[1:] + 1e-9).all(1)

    def viterbi(self, pieces: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each piece, given its scores."""
        lens = np.array([len(p) for p in pieces], np.int64)
        if not len(lens):
            return []
        flat = np.concatenate(pieces)
        starts = np.cumsum(lens) - lens
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        for group in crf.batches(lens):
            e, mask = crf.padded(flat, starts[group], lens[group])
            got = crf.viterbi(e, mask, self.trans)
            for row, k in enumerate(group.tolist()):
                out[k] = got[row, : lens[k]]
        return out


def train(table: list[tuple[str, list[tuple[int, int, str]]]] | None = None, rounds: int = 60) -> Field:
    """Maximum likelihood with a small quadratic penalty, by Adam over the whole table."""
    table = labelled_table() if table is None else table
    rows, gold = [], []
    for text, spans in table:
        tokens, gaps, places = tokens_of(text)
        labels = []
        for s, e in places:
            inside = next(((a, k) for a, b, k in spans if a <= s and e <= b), None)
            labels.append(0 if inside is None else 1 + 2 * KINDS.index(inside[1]) + (s > inside[0]))
        if tokens:
            rows.append(features(tokens, gaps))
            gold.append(labels)
    count = Counter(x for row in rows for token in row for x in token)
    numbers = {x: k for k, x in enumerate(sorted(x for x, n in count.items() if n > 1))}
    none, k = len(numbers), len(LABELS)
    feat = np.array([[numbers.get(x, none) for x in token] for row in rows for token in row])
    lens = np.array([len(r) for r in rows])
    starts = np.cumsum(lens) - lens
    y = np.array([v for g in gold for v in g])
    emit, trans = np.zeros((none + 1, k)), np.zeros((k, k))
    truth = np.eye(k)[y]
    seen = np.zeros((k, k))
    for s, n in zip(starts, lens, strict=True):
        np.add.at(seen, (y[s : s + n - 1], y[s + 1 : s + n]), 1)
    groups = list(crf.batches(lens, 20_000))
    flat_feat = feat.ravel()

    def gradient() -> list[np.ndarray]:
        flat = emit[feat].sum(1)
        marginal, pairs = np.zeros_like(flat), np.zeros((k, k))
        for g in groups:
            e, mask = crf.padded(flat, starts[g], lens[g])
            _, m, p = crf.forward_backward(e, mask, trans)
            pairs += p
            place = (starts[g][:, None] + np.arange(mask.shape[1]))[mask]
            marginal[place] = m[mask]
        miss = np.repeat(marginal - truth, feat.shape[1], axis=0)
        d = np.stack([np.bincount(flat_feat, weights=miss[:, j], minlength=none + 1) for j in range(k)], axis=1)
        d[none] = 0
        return [d / len(rows) + 1e-4 * emit, (pairs - seen) / len(rows) + 1e-4 * trans]

    crf.adam(gradient, [emit, trans], rounds, 0.1)
    return Field(numbers, emit[:none], trans)


def triggers(text: str) -> list[tuple[int, int]]:
    """Where a span of some kind must lie about: digits, at signs, ``at ... dot``."""
    return [(m.start(), m.end(1) if m[1] else m.end()) for m in TRIGGER.finditer(text)]


def segments(text: str, around: int) -> list[tuple[int, int, int, int]]:
    """Parts of a text (start, end) that reach ``around`` beyond their triggers (first start, last
    end) and on to the next place that lies in no word; parts that meet are one."""
    out: list[list[int]] = []
    for s, e in triggers(text):
        lo, hi = max(0, s - around), min(len(text), e + around)
        if out and lo <= out[-1][1]:
            out[-1][1], out[-1][3] = max(hi, out[-1][1]), max(e, out[-1][3])
            continue
        out.append([lo, hi, s, e])
    for part in out:
        while 0 < part[0] and (text[part[0] - 1].isalnum() and text[part[0]].isalnum()):
            part[0] -= 1
        while part[1] < len(text) and text[part[1] - 1].isalnum() and text[part[1]].isalnum():
            part[1] += 1
    return [tuple(p) for p in out]


def pieces(field: Field, text: str) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
    """Scores and places of the tokens of each piece that is to be decoded: from one certain "other"
    (or the text's end) to the next."""
    around = AROUND
    open_ = segments(text, around)
    while open_:
        again: list[tuple[int, int, int, int]] = []
        for lo, hi, first, last in open_:
            tokens, gaps, places = tokens_of(text, lo, hi)
            if not tokens:
                continue
            scores = field.scores(tokens, gaps)
            sure = field.certain(scores)
            # what lies beyond a part's ends is in the features of its outermost tokens
            if lo > 0:
                sure[:BEFORE] = False
            if hi < len(text):
                sure[max(0, len(sure) - AFTER) :] = False
            cut = np.flatnonzero(sure).tolist()
            if (lo > 0 and not any(places[k][1] <= first for k in cut[:1])) or (hi < len(text) and not any(places[k][0] >= last for k in cut[-1:])):
                again.append((lo, hi, first, last))
                continue
            ends = [*([0] if lo == 0 else []), *cut, *([len(tokens) - 1] if hi == len(text) else [])]
            for a, b in zip(ends, ends[1:], strict=False):
                if b > a + 1 or (b > a and not (sure[a] and sure[b])):
                    yield scores[a : b + 1], places[a : b + 1]
            if len(tokens) == 1 and not sure[0]:
                yield scores, places
        around = max(16, 4 * around)
        # the parts that go on are made anew, farther out
        wider = segments(text, around) if again else []
        open_ = [w for w in wider if any(w[2] <= p[2] and p[3] <= w[3] for p in again)]


def plausible(kind: int, text: str) -> bool:
    n = len(digits_in(text))
    if kind == 0:
        return ("@" in text or SPELLED.search(text) is not None) and any(c.isalpha() for c in text)
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 12 <= n <= 19 if kind == 2 else 7 <= n <= 15


def added_spans(field: Field, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans of the field, by text, that overlap no base span."""
    owner, scores, places = [], [], []
    for k, t in enumerate(texts):
        for e, where in pieces(field, t):
            owner.append(k)
            scores.append(e)
            places.append(where)
    out: list[set[Span]] = [set() for _ in texts]
    # base spans begin in order; how far those up to each one reach
    begin = [[b for b, _, _ in spans] for spans in base]
    reach = [list(accumulate((f for _, _, f in spans), max)) for spans in base]
    for k, where, labels in zip(owner, places, field.viterbi(scores), strict=True):
        for s, kind, e in runs(labels, where):
            if plausible(kind, texts[k][s:e]):
                before = bisect_left(begin[k], e)
                if not before or reach[k][before - 1] <= s:
                    out[k].add((s, kind, e))
    return [sorted(x) for x in out]


def runs(labels: np.ndarray, places: list[tuple[int, int]]) -> Iterator[Span]:
    """The spans that labels mark."""
    i = 0
    while i < len(labels):
        if labels[i] == 0:
            i += 1
            continue
        kind = (int(labels[i]) - 1) // 2
        j = i + 1
        while j < len(labels) and labels[j] == 2 + 2 * kind:
            j += 1
        yield places[i][0], kind, places[j - 1][1]
        i = j


def found(field: Field, bodies: list[bytes]) -> tuple[list[list[Span]], list[list[Span]], list[str]]:
    """Base spans, all spans and the texts."""
    texts = [b.decode("utf-8", "replace") for b in bodies]
    base = [base_spans(t) for t in texts]
    return base, [sorted({*b, *m}) for b, m in zip(base, added_spans(field, texts, base), strict=True)], texts


def spans(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, base counts by kind, digest of the base spans, and all spans."""
    field = field or train()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches, CHUNK_BYTES):
            base, every, _ = found(field, common.bodies(part))
            yield pa.RecordBatch.from_arrays(
                [
                    common.ids(part),
                    *(pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(4)),
                    pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()),
                    pa.array([joined(s) for s in every], pa.string()),
                ],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return common.texts(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, marks: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping ones the first."""
    out, at = [], 0
    for s, k, e in marks:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in its texts replaced by kinds."""
    field = field or train()

    def writer():
        def write(bodies: list[bytes]) -> list[bytes]:
            _, every, texts = found(field, bodies)
            return [redact(t, s).encode() if s else b for t, s, b in zip(texts, every, bodies, strict=True)]

        return write

    return common.rewritten(docs, writer, text_col)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(common.table(spark, sf_dir, "documents"))
