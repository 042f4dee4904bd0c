import pytest

from tidegate.lang.program import filter_matches, load, may_match, subject_ok, validate
from tidegate.lang.tree import Call, Key, RuleFileError, Sym, Vec, read_all, show

EDN = '(lvc ["demo.>"]) (on "demo.*" (-> payload-float (moving-avg :ms 5000) (publish! (subject-append "avg") :dp 1)))'
JSON = '[["lvc", "demo.>"], ["on", "demo.*", ["->", "$payload-float", ["moving-avg", {"ms": 5000}], ["publish!", ["subject-append", "avg"], {"dp": 1}]]]]'
YAML = """
lvc:
  - "demo.>"
on:
  - sub: "demo.*"
    pipeline:
      - $payload-float
      - [moving-avg, {ms: 5000}]
      - [publish!, [subject-append, "avg"], {dp: 1}]
"""


def test_reader():
    (form,) = read_all('(f "a\\n\\"b" #"\\d+" -1.5 :ms [x 2] nil true) ; end')
    assert form == Call("f", ('a\n"b', "\\d+", -1.5, Key("ms"), Vec((Sym("x"), 2.0)), None, True))
    assert read_all(show(form))[0] == form


@pytest.mark.parametrize("bad", ["(", ")", '("a")', '"x', "(f [)", '(f "\\q")', "(f 1x)"])
def test_reader_errors(bad):
    with pytest.raises(RuleFileError):
        read_all(bad)


def test_three_spellings_are_one_program():
    a, b, c = load(EDN), load(JSON, "json"), load(YAML, "yaml")
    assert a == b == c and a.lvc == ["demo.>"]


@pytest.mark.parametrize(
    "bad",
    ['(on "a" (nope 1))', '(on "a" payload-flaot)', '(on "a b" payload)', '(on "a" (if payload (nope)))', '(on "a" (matches? subject "x"))', '(on "a" (-> payload (dropout :ms 1 :lost 1 :found 2)))', '(on "a" (round 1))', "(every :ms 0 nil)", "(every :ms 1.5 nil)", '(on "a" (rate 5 payload))', '(export :servers "x") (export :servers "y")', '(import :core [["a"]] :subject "b")', '(on "a" (publish! :foo 1 "b" 2))', '(lvc "a..b")', '(export :servers (env "SURELY_NOT_SET_X"))', '(import :streams [[:subject "a"]])'],
)
def test_refused_programs(bad):
    with pytest.raises(RuleFileError):
        load(bad)


def test_yaml_errors():
    for bad in ["on:\n  - sub: a\n    do: [publish!, x, payload]", "on:\n  - sub: a\n    pipline: []", "nope: 1", "on:\n  - sub: a\n    do: [publish!, \"x\", $payload-flaot]"]:
        with pytest.raises(RuleFileError):
            load(bad, "yaml")


def test_config_and_ignored_forms():
    p = load('(import :servers "n://h:1" :core [["a.>"]] :streams [[:subject "s.>" :stream "S" :consumer "c"]]) (export :servers (env "H") :export "o.>") (note 1)', environ={"H": "n://e"})
    assert p.export == {"servers": ["n://e"], "export": ["o.>"]} and p.imports["streams"][0]["stream"] == "S" and p.ignored == ["note"]


def test_subjects():
    assert subject_ok("a.b") and not subject_ok("a..b") and not subject_ok("a.*") and subject_ok("a.*.>", wildcards=True) and not subject_ok("a.>.b", wildcards=True)
    for f, s, want in [("a.*", "a.b", True), ("a.*", "a.b.c", False), ("a.>", "a", False), ("a.>", "a.b.c", True), (">", "x", True), ("*.b", "a.b", True)]:
        assert filter_matches(f, s) is want
    assert may_match("a.*", "*.b") and may_match("a.>", "a.b.c") and not may_match("a.b", "a.c") and not may_match("a.b", "a.b.c")


def test_validate():
    assert validate('(on ">" (publish! "a" payload))') == []
    assert validate("(on")[0].startswith("error")
    assert any("sample message" in w for w in validate('(on ">" (publish! "a" (+ 1 (json-get "x" payload))))'))
