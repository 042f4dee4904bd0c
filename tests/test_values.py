import math

import pytest
from pyspark.sql import functions as F

from tidegate.functions import patterns, values
from tidegate.lang.tree import RuleFileError

TEXTS = ["42", " 42", "42 ", "", "-1.5e3", ".5", "5.", "1e400", "1e-400", "inf", "-Infinity", "nan", "1.0d", "1f", "abc", "+7", "0", "0.0", "1e5x", "\t3", "9" * 130, "--1", "1_000"]


def test_numbers_from_texts():
    want = {"42": 42.0, " 42": 42.0, "-1.5e3": -1500.0, ".5": 0.5, "5.": 5.0, "+7": 7.0, "0": 0.0, "0.0": 0.0, "\t3": 3.0, "inf": math.inf, "-Infinity": -math.inf}
    for t in TEXTS:
        got = values.to_number(t)
        if t == "nan":
            assert math.isnan(got)
        else:
            assert got == want.get(t), t
    assert values.to_number("0x10") == 16.0


def test_numbers_as_columns_agree(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", values.number_of(F.col("t")).alias("x")).collect()
    for r in rows:
        want = values.to_number(r.t)
        assert (r.x is None) == (want is None) and (want is None or r.x == want or (math.isnan(want) and math.isnan(r.x))), r.t


@pytest.mark.parametrize(("x", "text"), [(15.0, "15"), (0.1, "0.1"), (1e8, "100000000"), (1 / 3, "0.3333333333333333"), (1e300, "1e+300"), (-0.0, "-0"), (2.5, "2.5")])
def test_shortest_text(x, text):
    assert values.number_text(x) == text and float(text) == x


def test_fixed_text_is_half_even_on_the_binary_value():
    assert values.fixed_text(0.25, 1) == "0.2" and values.fixed_text(42.16, 1) == "42.2"


def test_division_and_rounding(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (5.0, 2.0)], "a double, b double")
    got = [r.q for r in df.select(values.divide(F.col("a"), F.col("b")).alias("q")).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3] == 2.5
    half = spark.createDataFrame([(2.5,), (-2.5,), (0.49999999999999994,), (1e17,)], "x double")
    assert [r.y for r in half.select(values.half_away(F.col("x")).alias("y")).collect()][:2] == [3.0, -3.0]


@pytest.mark.parametrize("bad", ["(?=a)", "(?<!a)", r"(a)\1", "a++", "[[:alpha:]]", r"\pL", "(?P<n>a)", "a{300}", "(a", "a" * 2000])
def test_refused_patterns(bad):
    with pytest.raises(RuleFileError):
        patterns.check(bad)


@pytest.mark.parametrize(("p", "r", "t", "want"), [("b*", "-", "abc", "-a-c-"), ("[0-9]+", "#", "a12b3", "a#b#"), ("x", "$1", "axb", "a$1b")])
def test_replace(p, r, t, want):
    assert patterns.replace_all(p, r, t) == want


def test_capture():
    assert patterns.first_group("t=([0-9]+)", "id=7 t=215 z") == "215"
    assert patterns.first_group("[0-9]+", "id=7") == "7"
    assert patterns.first_group("a(b)?", "a") is None
    assert patterns.compiled("foo$").search("foo\n") is None


def test_hexadecimal_texts_read_alike(spark):
    """The Column and the Python reading on random spellings, valid and not."""
    import random
    import struct


    r = random.Random(3)
    digits = lambda n: "".join(r.choice("0123456789abcdefABCDEF") for _ in range(n))
    texts = ["0x1A", "0x", "0x.8", "-0x0", "0x0p99999999999999999999", "0x1p-1022", "0x1p-1023", "0x1p1024", "0x1.fffffffffffff7ffp0", " +0X1.8P+2", "0x1.8p", "0x10 ", "0x" + "f" * 100, "0x" + "f" * 126, "nan", "-nan", "+NaN", "-inf", "Infinity", "xnan", "1e400", "1e-400", "0e9", " " * 130 + "nan"]
    texts += [r.choice(["", "-", "+", " "]) + "0x" + digits(r.randint(0, 25)) + r.choice(["", "." + digits(r.randint(0, 20))]) + r.choice(["", f"p{r.randint(-1100, 1100)}"]) for _ in range(500)]
    texts += ["".join(r.choice("0019.eEpPxX+-af \t") for _ in range(r.randint(1, 8))) for _ in range(2000)]
    bits = lambda x: None if x is None else "nan" if x != x else struct.pack("d", x)
    for row in spark.createDataFrame([(t,) for t in texts], "t string").select("t", values.number_of(F.col("t")).alias("x")).collect():
        assert bits(row.x) == bits(values.to_number(row.t)), row
