"""A rule file as a checked program: rules, timers and what else is configured."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from tidegate.lang.spellings import BINDINGS, from_json, from_yaml
from tidegate.lang.tree import Call, Key, Pattern, RuleFileError, Sym, Vec, read_all

#: Forms with their least and greatest number of arguments, options apart.
FORMS: dict[str, tuple[int, int]] = {
    "if": (2, 3), "when": (2, 99), "do": (0, 99), "and": (0, 99), "or": (0, 99), "not": (1, 1), "->": (1, 99),
    "=": (1, 99), ">": (2, 99), "<": (2, 99), ">=": (2, 99), "<=": (2, 99),
    "contains?": (2, 2), "starts-with?": (2, 2), "ends-with?": (2, 2), "transition": (3, 3),
    "+": (1, 99), "-": (1, 99), "*": (1, 99), "/": (1, 99), "round": (2, 2), "quantize": (2, 2), "clamp": (3, 3),
    "min": (1, 99), "max": (1, 99), "abs": (1, 1), "sign": (1, 1),
    "str-concat": (0, 99), "subject-append": (1, 1), "subject-token": (1, 2), "subject-with": (1, 99),
    "matches?": (2, 2), "re-capture": (2, 2), "re-replace": (3, 3), "now": (0, 0),
    "moving-avg": (2, 2), "moving-sum": (2, 2), "moving-max": (2, 2), "moving-min": (2, 2), "variance": (2, 2),
    "stddev": (2, 2), "percentile": (3, 3), "median": (2, 2), "rate": (2, 2), "throttle": (3, 3), "ewma": (2, 2),
    "bar!": (2, 2), "squelch": (1, 1), "changed?": (1, 1), "delta": (1, 1), "rising-edge": (1, 1),
    "falling-edge": (1, 1), "hysteresis": (3, 3), "deadband": (2, 2), "hold-off": (2, 2), "last": (1, 1),
    "json-get": (2, 2), "json-demux!": (2, 99), "publish!": (2, 2), "reply!": (1, 1), "print!": (1, 2),
    "count!": (0, 1), "debounce!": (2, 2), "sample!": (2, 2), "aggregate!": (2, 2), "on-silence": (1, 99), "dropout": (0, 0),
}
ALIASES = {"publish": "publish!", "publish-to!": "publish!", "publish-to": "publish!", "count": "count!", "bar": "bar!", "json-demux": "json-demux!"}
#: Options of forms, by form.
OPTIONS = {
    "publish!": ("dp",), "reply!": ("dp",), "count!": ("subject",), "bar!": ("ms",), "json-demux!": ("leaf",),
    "debounce!": ("ms",), "sample!": ("ms",), "aggregate!": ("ms", "avg", "sum", "min", "max", "count", "rate"), "on-silence": ("ms",),
    "dropout": ("ms", "lost", "found"), "now": ("date", "hour", "minute"),
    **dict.fromkeys(["moving-avg", "moving-sum", "moving-max", "moving-min", "variance", "stddev", "percentile", "median", "rate", "throttle"], ("ms",)),
}
FLAGS = ("leaf", "avg", "sum", "min", "max", "count", "rate", "date", "hour", "minute")
WINDOWED = ("moving-avg", "moving-sum", "moving-max", "moving-min", "variance", "stddev", "percentile", "median", "rate", "throttle", "bar!")
CLOCKED = ("on-silence", "dropout", "debounce!", "sample!", "aggregate!")
MAX_DEPTH = 8

#: Option names of connections.
CONNECTION = ("servers", "name", "creds", "user", "password", "token", "tls", "tls-ca", "tls-cert", "tls-key", "tls-skip-verify", "connect-timeout-ms", "ping-interval-ms", "reconnect-wait-ms", "max-reconnect")
EXPORT = (*CONNECTION, "export", "origin-header", "replay-header")
IMPORT = (*CONNECTION, "subject", "subjects", "origin-header", "max-pending", "stream", "consumer", "catch-up", "core", "streams")


@dataclass
class Form:
    """A call with its options apart from its arguments, and its place in the rule."""

    name: str
    args: list
    options: dict
    site: int


@dataclass
class Rule:
    index: int
    filter: str
    body: object
    reentrant: bool = False
    every_ms: int | None = None


@dataclass
class Program:
    rules: list[Rule] = field(default_factory=list)
    lvc: list[str] = field(default_factory=list)
    export: dict | None = None
    imports: dict | None = None
    ignored: list[str] = field(default_factory=list)
    user_forms: frozenset = frozenset()


def subject_ok(subject: str, wildcards: bool = False) -> bool:
    """Whether a subject (or, with wildcards, a filter) is well formed."""
    tokens = subject.split(".")
    for k, t in enumerate(tokens):
        if not t or re.search(r"[\x00-\x20\x7f]", t):
            return False
        if t in ("*", ">"):
            if not wildcards or (t == ">" and k < len(tokens) - 1):
                return False
        elif "*" in t or ">" in t:
            return False
    return True


def filter_matches(pattern: str, subject: str) -> bool:
    want, have = pattern.split("."), subject.split(".")
    for k, t in enumerate(want):
        if t == ">":
            return len(have) > k
        if k >= len(have) or (t != "*" and t != have[k]):
            return False
    return len(want) == len(have)


def may_match(a: str, b: str) -> bool:
    """Whether some subject fits both filters."""
    x, y = a.split("."), b.split(".")
    for p, q in zip(x, y, strict=False):
        if ">" in (p, q):
            return True
        if p != q and "*" not in (p, q):
            return False
    return len(x) == len(y)


# ---------------------------------------------------------------- bodies


class Resolver:
    """Checks a body and numbers its calls in the order in which they are met."""

    def __init__(self, user_forms: frozenset = frozenset(), user_symbols: frozenset = frozenset()):
        self.sites = 0
        self.user_forms, self.user_symbols = user_forms, user_symbols

    def expr(self, x, threaded: bool = False):
        if isinstance(x, Call):
            return self.call(x, threaded)
        if isinstance(x, Vec):
            return Vec(tuple(self.expr(v) for v in x.items))
        if isinstance(x, Sym) and x.name not in BINDINGS and x.name not in self.user_symbols:
            raise RuleFileError(f"unknown name {x.name}")
        return x

    def call(self, x: Call, threaded: bool) -> Form:
        name = ALIASES.get(x.head, x.head)
        site = self.sites
        self.sites += 1
        if name not in FORMS:
            if name in self.user_forms:
                return Form(name, [self.expr(a) for a in x.args], {}, site)
            raise RuleFileError(f"unknown form {x.head}")
        args, options = [], {}
        known = OPTIONS.get(name, ())
        k = 0
        while k < len(x.args):
            a = x.args[k]
            if isinstance(a, Key):
                if a.name not in known:
                    raise RuleFileError(f"{x.head} has no option :{a.name}")
                if a.name in FLAGS:
                    options[a.name] = True
                else:
                    if k + 1 >= len(x.args):
                        raise RuleFileError(f":{a.name} of {x.head} needs a value")
                    k += 1
                    options[a.name] = self.expr(x.args[k])
            else:
                args.append(a)
            k += 1
        n = len(args) + threaded
        low, high = FORMS[name]
        if name in WINDOWED and "ms" in options:
            low, high = low - 1, high - 1
        if not low <= n <= high:
            raise RuleFileError(f"{x.head} takes {low} to {high} arguments, not {n}")
        if name in CLOCKED and "ms" not in options:
            raise RuleFileError(f"{x.head} needs :ms")
        if name == "rate" and "ms" not in options:
            raise RuleFileError("rate needs :ms")
        if name == "dropout" and not {"lost", "found"} <= set(options):
            raise RuleFileError("dropout needs :lost and :found")
        if name == "->":
            return self.thread(args, site)
        if name in ("matches?", "re-capture", "re-replace"):
            if not isinstance(args[0], str):
                raise RuleFileError(f"the pattern of {x.head} must be a literal text")
            from tidegate.functions.patterns import check

            check(args[0])
            args[0] = Pattern(args[0])
            if name == "re-replace" and not isinstance(args[1], str):
                raise RuleFileError("the replacement of re-replace must be a literal text")
        return Form(name, [self.expr(a) for a in args], options, site)

    def thread(self, args: list, site: int) -> Form:
        steps = [self.expr(args[0])]
        for step in args[1:]:
            if isinstance(step, Sym):
                step = Call(step.name, ())
            if not isinstance(step, Call):
                raise RuleFileError("a step of -> is a call or the name of a form")
            if ALIASES.get(step.head, step.head) in ("on-silence", "dropout"):
                raise RuleFileError(f"{step.head} can't be a step of ->")
            steps.append(self.expr(step, threaded=True))
        return Form("->", steps, {}, site)


# ---------------------------------------------------------------- files


def parse(source: str, spelling: str = "edn") -> list:
    return {"edn": read_all, "json": from_json, "yaml": from_yaml}[spelling](source)


def load(source: str, spelling: str = "edn", user_forms: frozenset = frozenset(), user_symbols: frozenset = frozenset(), environ: dict | None = None) -> Program:
    """A checked program from the text of a rule file."""
    program = Program(user_forms=user_forms)
    environ = dict(os.environ) if environ is None else environ
    for form in parse(source, spelling):
        if not isinstance(form, Call):
            raise RuleFileError("a rule file holds lists only")
        if form.head == "on":
            program.rules.append(_on(form, len(program.rules), user_forms, user_symbols))
        elif form.head == "every":
            program.rules.append(_every(form, len(program.rules), user_forms, user_symbols))
        elif form.head == "lvc":
            program.lvc += _filters(form.args, environ)
        elif form.head in ("export", "bridge"):
            if program.export is not None:
                raise RuleFileError("only one export is allowed")
            program.export = _config(form, EXPORT, environ)
            for f in program.export.get("export", []):
                _check_filter(f)
        elif form.head == "import":
            if program.imports is not None:
                raise RuleFileError("only one import is allowed")
            program.imports = _imports(form, environ)
        else:
            program.ignored.append(form.head)
    return program


def load_file(path: str, **more) -> Program:
    """The spelling follows the file's ending, or for others its first character."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    if path.endswith((".yml", ".yaml")):
        spelling = "yaml"
    elif path.endswith(".json") or source.lstrip()[:1] == "[" and not path.endswith(".edn"):
        spelling = "json"
    else:
        spelling = "edn"
    return load(source, spelling, **more)


def _flag(args: list) -> tuple[list, bool]:
    """Arguments without :reentrant, and its value."""
    out, value, k = [], False, 0
    while k < len(args):
        if isinstance(args[k], Key) and args[k].name == "reentrant":
            if k + 1 >= len(args) or not isinstance(args[k + 1], bool):
                raise RuleFileError(":reentrant is true or false")
            value = args[k + 1]
            k += 2
        else:
            out.append(args[k])
            k += 1
    return out, value


def _check_filter(f) -> str:
    if not isinstance(f, str) or not subject_ok(f, wildcards=True):
        raise RuleFileError(f"{f!r} is no subject filter")
    return f


def _on(form: Call, index: int, user_forms: frozenset, user_symbols: frozenset) -> Rule:
    args, reentrant = _flag(list(form.args))
    if len(args) != 2:
        raise RuleFileError("on takes a filter and a body")
    return Rule(index, _check_filter(args[0]), Resolver(user_forms, user_symbols).expr(args[1]), reentrant)


def _every(form: Call, index: int, user_forms: frozenset, user_symbols: frozenset) -> Rule:
    args, reentrant = _flag(list(form.args))
    if len(args) < 3 or args[0] != Key("ms"):
        raise RuleFileError("every takes :ms, a number and a body")
    n = args[1]
    if not isinstance(n, float) or n != int(n) or not 1 <= n <= 1e12:
        raise RuleFileError("the interval of every is a whole number from 1 to 1e12")
    body = args[2] if len(args) == 3 else Call("do", tuple(args[2:]))
    return Rule(index, "", Resolver(user_forms, user_symbols).expr(body), reentrant, int(n))


def _value(x, environ: dict):
    if isinstance(x, Call) and x.head == "env":
        name = x.args[0] if len(x.args) == 1 else None
        if not isinstance(name, str) or not environ.get(name):
            raise RuleFileError(f"environment variable {name} isn't set")
        return environ[name]
    if isinstance(x, Vec):
        return [_value(v, environ) for v in x.items]
    if isinstance(x, (Call, Sym)):
        raise RuleFileError("a configuration holds texts, numbers and lists of them")
    return x


def _filters(args: tuple, environ: dict) -> list[str]:
    found = [v for a in args for v in (a.items if isinstance(a, Vec) else (a,))]
    return [_check_filter(_value(v, environ)) for v in found]


def _config(form: Call, known: tuple, environ: dict) -> dict:
    if len(form.args) % 2:
        raise RuleFileError(f"{form.head} takes options with values")
    out: dict = {}
    for key, value in zip(form.args[::2], form.args[1::2], strict=True):
        if not isinstance(key, Key) or key.name not in known:
            raise RuleFileError(f"{form.head} has no option {getattr(key, 'name', key)}")
        if key.name in out:
            raise RuleFileError(f"{form.head} has :{key.name} twice")
        out[key.name] = _value(value, environ)
    for name in ("servers", "export", "subjects"):
        if isinstance(out.get(name), str):
            out[name] = [out[name]]
    return out


def _imports(form: Call, environ: dict) -> dict:
    out = _config(form, IMPORT, environ)
    nested, flat = {"core", "streams"} & set(out), {"subject", "subjects", "stream", "consumer"} & set(out)
    if nested and flat:
        raise RuleFileError("import lists either its own subject or :core and :streams")
    if not nested and not flat:
        raise RuleFileError("import needs a subject, :core or :streams")
    pairs = lambda xs: dict(zip((getattr(k, "name", k) for k in xs[::2]), xs[1::2], strict=False))
    for kind in ("core", "streams"):
        out[kind] = [pairs(e) if isinstance(e, list) else {"subject": e} for e in out.get(kind, [])]
    if flat:
        entry = {k: out[k] for k in ("subject", "subjects", "stream", "consumer", "catch-up") if k in out}
        out["streams" if "stream" in entry else "core"].append(entry)
    for e in out["streams"]:
        subjects = e.get("subjects", [e["subject"]] if "subject" in e else [])
        if len(subjects) != 1 or not e.get("stream") or not e.get("consumer"):
            raise RuleFileError("a stream entry needs one subject, :stream and :consumer")
    for e in out["core"] + out["streams"]:
        for s in e.get("subjects", [e["subject"]] if "subject" in e else []):
            _check_filter(s)
    return out


def validate(source: str, spelling: str = "edn", **more) -> list[str]:
    """What is wrong with a rule file: nothing, or the first error; then warnings."""
    try:
        program = load(source, spelling, **more)
    except RuleFileError as e:
        return [f"error: {e}"]
    out = [f"warning: form {h} is ignored" for h in program.ignored]
    from tidegate.runtime.machine import Machine

    for error in Machine(program).feed(0, 0, "x.y.z", "1", "_INBOX.validate").errors:
        out.append(f"warning: rule {error[0]} on a sample message: {error[1]}")
    return out
