"""Rules as DataFrame plans.

Every expression becomes a Value: a kind known at compile time, a Column, and a Column telling on
which rows it fails. State advances only on rows that reach a call site, so a stateful form looks
at its rows through a guard: windows are partitioned by subject and guard, which keeps rows that
don't reach the site out of the frame without any join. Effects collect under their guards and
come out as one projection. The frame is dealt by subject once, before the first window; all windows
of a rule use that partitioning.

What has no such plan (windows whose size is computed, timers inside re-entry, cyclic rules)
raises NotPlannable, and ``engine.run`` gives it to the message-by-message machine.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions import patterns, values
from tidegate.lang.program import Form, Program, Rule, filter_matches
from tidegate.lang.tree import Pattern, Sym, Vec
from tidegate.operators.folds import folded

TIES = 1 << 20  # messages of one subject in one millisecond, at most
DYN = "struct<k:string,n:double,s:string,b:boolean>"
EMITTED = ["path", "rule_idx", "ts_ms", "subject", "payload_num", "payload_text", "places", "depth", "source"]


class NotPlannable(Exception):
    """The rule needs the message-by-message machine."""


class Refused(ValueError):
    """A literal argument that is wrong on every message."""


@dataclass
class Value:
    kind: str  # num, str, bool, nil, dyn or vec
    col: Column | None = None
    err: Column | None = None
    items: tuple = ()
    literal: object = None


NIL = Value("nil", F.lit(None).cast("string") if False else None)


def matches(pattern: str, subject: Column) -> Column:
    """A subject filter as a predicate; a literal beginning is a comparison that reaches the scan."""
    tokens = pattern.split(".")
    if "*" not in tokens and ">" not in tokens:
        return subject == pattern
    if tokens == [">"]:
        return F.length(subject) > 0
    head = []
    for t in tokens:
        if t in ("*", ">"):
            break
        head.append(t)
    prefix = "".join(f"{t}." for t in head)
    rest = tokens[len(head) :]
    if rest == [">"]:
        return subject.startswith(prefix) & (F.length(subject) > len(prefix))
    escape = lambda t: "".join(c if c.isalnum() or c in "-_" else f"\\{c}" if c.isascii() else c for c in t)
    body = r"\.".join("[^.]+" if t == "*" else ".+" if t == ">" else escape(t) for t in tokens)
    exact = subject.rlike(f"(?s)^{body}\\z")
    return subject.startswith(prefix) & exact if prefix else exact


def subject_valid(subject: Column) -> Column:
    return F.coalesce(subject.rlike(r"^[^\x00-\x20\x7f.*>]+(?:\.[^\x00-\x20\x7f.*>]+)*\z") & ~subject.startswith("$LVC.") & ~subject.startswith("$STATS."), F.lit(False))


def either(*errs: Column | None) -> Column | None:
    out = None
    for e in errs:
        if e is not None:
            out = e if out is None else out | e
    return out


def clear(g: Column, err: Column | None) -> Column:
    return g if err is None else g & ~F.coalesce(err, F.lit(False))


class RulePlan:
    """One rule over a message frame. ``emissions()`` is the result; ``counts`` has the conditions of
    suppressed and failed evaluations."""

    def __init__(self, program: Program, rule: Rule, messages: DataFrame, order: str = "seq", t_end: int | None = None, user_forms: dict | None = None, user_symbols: dict | None = None, everything: DataFrame | None = None):
        self.program, self.rule, self.order, self.t_end = program, rule, order, t_end
        self.user_forms, self.user_symbols = user_forms or {}, user_symbols or {}
        self.everything = messages if everything is None else everything
        self.df = messages.where(matches(rule.filter, F.col("subject")))
        self.base = list(messages.columns)
        self.n = 0
        self.dealt = False
        self.effects: list[dict] = []
        self.timers: list[DataFrame] = []
        self.suppress: list[Column] = []
        result = self.expr(rule.body, F.lit(True))
        self.failed = F.lit(False) if result.err is None else F.coalesce(result.err, F.lit(False))
        for e in self.effects:
            e["index"] = e.get("index", 0)

    # ---- columns

    def put(self, col: Column) -> Column:
        self.n += 1
        name = f"_{self.n}"
        self.df = self.df.withColumn(name, col)
        return F.col(name)

    def name(self, col: Column) -> str:
        self.put(col)
        return f"_{self.n}"

    def deal(self) -> None:
        """From here on the rows of a subject lie together."""
        if not self.dealt:
            self.df = self.df.repartition("subject")
            self.dealt = True

    def window(self, g: Column, order: str | None = None):
        self.deal()
        return Window.partitionBy("subject", self.name(g)).orderBy(order or self.order)

    def plain_window(self, g: Column):
        """Window over all rows that reach a site, and the guard as a stored column."""
        held = self.put(F.coalesce(g, F.lit(False)))
        self.deal()
        return Window.partitionBy("subject", held).orderBy(self.order), held

    # ---- kinds

    def number(self, v: Value) -> tuple[Column, Column | None]:
        if v.kind == "num":
            return v.col, None if v.literal is not None else v.col.isNull()
        if v.kind == "str":
            if isinstance(v.literal, str):
                x = values.to_number(v.literal)
                return F.lit(x).cast("double"), F.lit(x is None)
            x = self.put(values.number_of(v.col, self.put(values.spelled(v.col))))
            return x, x.isNull()
        if v.kind == "dyn":
            x = self.put(F.coalesce(v.col["n"], values.number_of(v.col["s"], self.put(values.spelled(v.col["s"])))))
            return x, x.isNull()
        return F.lit(None).cast("double"), F.lit(True)

    def text(self, v: Value) -> tuple[Column, Column | None]:
        if v.kind == "str":
            return v.col, None if v.literal is not None else v.col.isNull()
        if v.kind == "bool":
            return v.col.cast("string"), v.col.isNull()
        if v.kind == "dyn":
            x = F.coalesce(v.col["s"], v.col["b"].cast("string"))
            return x, x.isNull()
        return F.lit(None).cast("string"), F.lit(True)

    @staticmethod
    def truth(v: Value) -> Column:
        if v.kind == "nil":
            return F.lit(False)
        if v.kind == "bool":
            return F.coalesce(v.col, F.lit(False))
        if v.kind == "dyn":
            return v.col.isNotNull() & F.coalesce(v.col["b"], F.lit(True))
        if v.kind == "vec" or v.literal is not None:
            return F.lit(True)
        return v.col.isNotNull()

    @staticmethod
    def present(v: Value) -> Column:
        return F.lit(False) if v.kind == "nil" else F.lit(True) if v.kind == "vec" or v.literal is not None else v.col.isNotNull()

    @staticmethod
    def dyn(v: Value) -> Column:
        none = F.lit(None).cast(DYN)
        if v.kind == "nil":
            return none
        if v.kind == "dyn":
            return v.col
        if v.kind == "vec":
            raise NotPlannable("a vector as a value")
        part = {"num": "n", "str": "s", "bool": "b"}[v.kind]
        kinds = {"n": "double", "s": "string", "b": "boolean"}
        made = F.struct(F.lit(v.kind).alias("k"), *[(v.col if p == part else F.lit(None)).cast(t).alias(p) for p, t in kinds.items()])
        return F.when(v.col.isNotNull(), made.cast(DYN)).otherwise(none)

    def choose(self, c: Column, a: Value, b: Value) -> Value:
        """a where c holds, else b."""
        err = None
        if a.err is not None or b.err is not None:
            err = F.when(c, F.lit(False) if a.err is None else a.err).otherwise(F.lit(False) if b.err is None else b.err)
        kinds = {v.kind for v in (a, b)} - {"nil"}
        if not kinds:
            return Value("nil", err=err)
        if len(kinds) == 1 and "vec" not in kinds:
            kind = kinds.pop()
            null = F.lit(None)
            return Value(kind, F.when(c, null if a.kind == "nil" else a.col).otherwise(null if b.kind == "nil" else b.col), err)
        return Value("dyn", F.when(c, self.dyn(a)).otherwise(self.dyn(b)), err)

    # ---- expressions

    def expr(self, x, g: Column) -> Value:
        if isinstance(x, Value):
            return x
        if isinstance(x, Sym):
            return self.symbol(x.name)
        if isinstance(x, Vec):
            items = tuple(self.expr(v, g) for v in x.items)
            return Value("vec", None, either(*(i.err for i in items)), items)
        if x is None:
            return Value("nil")
        if isinstance(x, bool):
            return Value("bool", F.lit(x), literal=x)
        if isinstance(x, float):
            return Value("num", F.lit(x), literal=x)
        if isinstance(x, (str, Pattern)):
            source = x if isinstance(x, str) else x.source
            return Value("str", F.lit(source), literal=source)
        if x.name in self.user_forms:
            args, err, _ = self.eval(x.args, g)
            made = self.user_forms[x.name](*[a.col for a in args])
            return Value(*made, err) if isinstance(made, tuple) else Value("str", made, err)
        method = FORM_METHODS.get(x.name)
        if method is None:
            raise NotPlannable(x.name)
        return getattr(self, method)(x, g)

    def eval(self, args: list, g: Column) -> tuple[list[Value], Column | None, Column]:
        """Arguments from left to right; their joint error; the guard of what comes next."""
        out, err = [], None
        for a in args:
            v = self.expr(a, clear(g, err))
            err = either(err, v.err)
            out.append(v)
        return out, err, clear(g, err)

    def numbers(self, x: Form, g: Column) -> tuple[list[Column], Column | None, Column]:
        vs, err, g = self.eval(x.args, g)
        pairs = [self.number(v) for v in vs]
        err = either(err, *(e for _, e in pairs))
        return [c for c, _ in pairs], err, clear(g, either(*(e for _, e in pairs)))

    def literal(self, v, what: str) -> float:
        v = v.literal if isinstance(v, Value) else v
        if isinstance(v, str):
            v = values.to_number(v)
        if not isinstance(v, float) or isinstance(v, bool):
            raise NotPlannable(f"{what} isn't a literal number")
        return v

    def size(self, v, what: str, least: int = 1) -> int:
        n = self.literal(v, what)
        if n != math.floor(n) or n < least:
            raise Refused(f"{what} must be a whole number from {least}")
        return int(n)

    def symbol(self, name: str) -> Value:
        if name in self.user_symbols:
            return Value(*self.user_symbols[name])
        if name == "subject":
            return Value("str", F.col("subject"))
        if name == "payload":
            return Value("str", F.col("payload"))
        if name == "reply-to":
            return Value("str", F.nullif(F.col("reply_to"), F.lit("")))
        if name == "replaying?":
            return Value("bool", F.col("replaying"))
        if name == "payload-bool":
            low = F.lower(F.col("payload"))
            b = self.put(F.when(low.isin("true", "1", "on"), True).when(low.isin("false", "0", "off"), False))
            return Value("bool", b, b.isNull())
        x = self.put(values.number_of(F.col("payload"), self.put(values.spelled(F.col("payload")))))
        if name == "payload-int":
            ok = x.isNotNull() & (F.abs(x) < float("inf")) & (F.floor(x).cast("double") == x)
            return Value("num", x, ~F.coalesce(ok, F.lit(False)))
        return Value("num", x, x.isNull())

    # ---- control

    def c_thread(self, x: Form, g: Column) -> Value:
        first, *steps = x.args
        v = self.expr(first, g)
        for step in steps:
            on = self.put(clear(g, v.err) & self.present(v))
            before = v
            got = self.expr(Form(step.name, [*step.args, before], step.options, step.site), on)
            # the step's own error, and what came before it
            own = None if got.err is None else on & got.err
            v = self.choose(on, Value(got.kind, got.col, None, got.items), Value("nil"))
            v.err = either(before.err, own)
        return v

    def c_if(self, x: Form, g: Column) -> Value:
        c = self.expr(x.args[0], g)
        g = clear(g, c.err)
        on = self.put(self.truth(c))
        a = self.expr(x.args[1], g & on)
        b = self.expr(x.args[2], g & ~on) if len(x.args) > 2 else Value("nil")
        out = self.choose(on, a, b)
        out.err = either(c.err, out.err)
        return out

    def c_when(self, x: Form, g: Column) -> Value:
        return self.c_if(Form("if", [x.args[0], Form("do", x.args[1:], {}, -1)], {}, x.site), g)

    def c_do(self, x: Form, g: Column) -> Value:
        err, v = None, Value("nil")
        for a in x.args:
            v = self.expr(a, clear(g, err))
            err = either(err, v.err)
        return Value(v.kind, v.col, err, v.items, v.literal)

    def c_and(self, x: Form, g: Column) -> Value:
        if not x.args:
            return Value("bool", F.lit(True), literal=True)
        v = self.expr(x.args[0], g)
        for a in x.args[1:]:
            on = self.put(clear(g, v.err) & self.truth(v))
            w = self.expr(a, on)
            got = self.choose(on, w, Value(v.kind, v.col, None, v.items, None))
            got.err = either(v.err, got.err)
            v = got
        return v

    def c_or(self, x: Form, g: Column) -> Value:
        out, err, done = Value("nil"), None, F.lit(False)
        for a in x.args:
            on = self.put(clear(g, err) & ~done)
            v = self.expr(a, on)
            hit = on & self.truth(v)
            err = either(err, None if v.err is None else on & v.err)
            out = self.choose(hit, Value(v.kind, v.col, None, v.items), out)
            done = self.put(done | hit)
        return Value(out.kind, out.col, err)

    def c_not(self, x: Form, g: Column) -> Value:
        (v,), err, _ = self.eval(x.args, g)
        return Value("bool", ~self.truth(v), err)

    def equal(self, a: Value, b: Value) -> Column:
        if "vec" in (a.kind, b.kind):
            return F.lit(False)
        if "dyn" in (a.kind, b.kind):
            x, y = self.dyn(a), self.dyn(b)
            both = (x["k"] == y["k"]) & (x["n"].eqNullSafe(y["n"]) & ~F.coalesce(F.isnan(x["n"]), F.lit(False))) & x["s"].eqNullSafe(y["s"]) & x["b"].eqNullSafe(y["b"])
            return F.coalesce(both, x.isNull() & y.isNull())
        if a.kind == "nil" or b.kind == "nil":
            return ~self.present(a) & ~self.present(b)
        both_nil = ~self.present(a) & ~self.present(b)
        if a.kind != b.kind:
            return both_nil
        same = a.col.eqNullSafe(b.col)
        return same & ~F.coalesce(F.isnan(a.col), F.lit(False)) if a.kind == "num" else same

    def c_equals(self, x: Form, g: Column) -> Value:
        vs, err, _ = self.eval(x.args, g)
        out = F.lit(True)
        for v in vs[1:]:
            out = out & self.equal(vs[0], v)
        return Value("bool", out, err)

    def c_compare(self, x: Form, g: Column) -> Value:
        cs, err, _ = self.numbers(x, g)
        out = F.lit(True)
        for a, b in zip(cs, cs[1:], strict=False):
            one = {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[x.name]
            out = out & one & ~F.isnan(a) & ~F.isnan(b)
        return Value("bool", out, err)

    def c_contains(self, x: Form, g: Column) -> Value:
        (where, what), err, _ = self.eval(x.args, g)
        if where.kind == "vec":
            out = F.lit(False)
            for item in where.items:
                out = out | self.equal(item, what)
            return Value("bool", out, err)
        (a, ea), (b, eb) = self.text(where), self.text(what)
        return Value("bool", F.contains(a, b), either(err, ea, eb))

    def c_affix(self, x: Form, g: Column) -> Value:
        vs, err, _ = self.eval(x.args, g)
        (a, ea), (b, eb) = map(self.text, vs)
        return Value("bool", F.startswith(a, b) if x.name == "starts-with?" else F.endswith(a, b), either(err, ea, eb))

    # ---- numbers and texts

    def c_arithmetic(self, x: Form, g: Column) -> Value:
        cs, err, _ = self.numbers(x, g)
        step = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": values.divide}[x.name]
        out = cs[0]
        if len(cs) == 1:
            out = {"-": -out, "/": values.divide(F.lit(1.0), out)}.get(x.name, out)
        for c in cs[1:]:
            out = step(out, c)
        return Value("num", out, err)

    def c_scalar(self, x: Form, g: Column) -> Value:
        if x.name == "round":
            n = self.size(x.args[0], "the places of round", 0)
            cs, err, _ = self.numbers(x, g)
            return Value("num", values.half_away(cs[1] * 10.0**n) / F.lit(10.0**n), err)
        cs, err, _ = self.numbers(x, g)
        if x.name == "quantize":
            bad = ~(cs[0] > 0)
            return Value("num", values.half_away(F.when(cs[0] > 0, F.try_divide(cs[1], cs[0]))) * cs[0], either(err, bad))
        if x.name == "clamp":
            lo, hi, v = cs
            return Value("num", F.least(F.greatest(v, lo), hi), err)
        out = {"abs": lambda: F.abs(cs[0]), "sign": lambda: F.signum(cs[0]), "min": lambda: F.least(*cs) if len(cs) > 1 else cs[0], "max": lambda: F.greatest(*cs) if len(cs) > 1 else cs[0]}[x.name]()
        return Value("num", out, err)

    def c_str_concat(self, x: Form, g: Column) -> Value:
        vs, err, _ = self.eval(x.args, g)
        parts = []
        for v in vs:
            if v.kind == "nil":
                continue
            if v.kind in ("num", "vec"):
                return Value("str", F.lit(None).cast("string"), F.lit(True))
            c, _ = self.text(v)
            if v.kind == "dyn":
                err = either(err, v.col["n"].isNotNull())
            parts.append(F.coalesce(c, F.lit("")))
        return Value("str", F.concat(*parts) if parts else F.lit(""), err)

    def c_subject_append(self, x: Form, g: Column) -> Value:
        (v,), err, _ = self.eval(x.args, g)
        c, e = self.text(v)
        return Value("str", F.concat(F.col("subject"), F.lit("."), c), either(err, e))

    def c_subject_token(self, x: Form, g: Column) -> Value:
        n = self.size(x.args[0], "the number of subject-token", 0)
        vs, err, _ = self.eval(x.args[1:], g)
        subject, e = self.text(vs[0]) if vs else (F.col("subject"), None)
        return Value("str", F.get(F.split(subject, r"\."), F.lit(n)), either(err, e))

    def as_payload(self, v: Value) -> Column:
        """The text a value is published as."""
        if v.kind == "num":
            return values.text_of_number(v.col, F.lit(None).cast("int"))
        if v.kind == "dyn":
            return F.coalesce(v.col["s"], v.col["b"].cast("string"), values.text_of_number(v.col["n"], F.lit(None).cast("int")))
        return v.col.cast("string")

    def c_subject_with(self, x: Form, g: Column) -> Value:
        vs, err, _ = self.eval(x.args, g)
        if len(vs) == 1 and vs[0].kind == "vec":
            vs = list(vs[0].items)
        if any(v.kind == "nil" for v in vs):
            return Value("str", F.lit(None).cast("string"), F.lit(True))
        cols = [self.as_payload(v) for v in vs]
        out = self.put(F.concat(*[c for k, c in enumerate([y for z in cols for y in (F.lit("."), z)][1:]) for c in [c]]))
        return Value("str", out, either(err, ~subject_valid(out)))

    def c_matches(self, x: Form, g: Column) -> Value:
        (v,), err, _ = self.eval(x.args[1:], g)
        c, e = self.text(v)
        return Value("bool", c.rlike(patterns.java(x.args[0].source)), either(err, e))

    def c_re_capture(self, x: Form, g: Column) -> Value:
        (v,), err, _ = self.eval(x.args[1:], g)
        c, e = self.text(v)
        source = x.args[0].source
        groups = patterns.compiled(source).groups
        if groups and (any(s in source for s in (")?", ")*", "){0", "|"))):  # the group may take no part
            out = _python_text(lambda t: patterns.first_group(source, t))(c)
        else:
            java = patterns.java(source)
            out = F.when(c.rlike(java), F.regexp_extract(c, java, 1 if groups else 0))
        return Value("str", out, either(err, e))

    def c_re_replace(self, x: Form, g: Column) -> Value:
        (v,), err, _ = self.eval(x.args[2:], g)
        c, e = self.text(v)
        source, to = x.args[0].source, x.args[1]
        if patterns.nullable(source):
            out = _python_text(lambda t: patterns.replace_all(source, to, t))(c)
        else:
            out = F.regexp_replace(c, F.lit(patterns.java(source)), F.lit(to.replace("\\", "\\\\").replace("$", "\\$")))
        return Value("str", out, either(err, e))

    def c_now(self, x: Form, g: Column) -> Value:
        style = "yyyy-MM-dd'T'HH" if "hour" in x.options else "yyyy-MM-dd'T'HHmm" if "minute" in x.options else "yyyy-MM-dd"
        utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_millis("wall_ms").cast("timestamp_ntz"))
        return Value("str", F.date_format(utc, style))

    # ---- JSON

    def json_value(self, source: Column, path: str) -> Column:
        steps = path.split(".")
        if not 1 <= len(steps) <= 4 or not all(steps):
            raise Refused("a JSON path has one to four names")
        where = "$" + "".join(f"[{s}]" if s.isdigit() and s.isascii() else f'["{s}"]' for s in steps)
        doc = self.put(F.try_parse_json(source))
        at = self.put(F.try_variant_get(doc, where, "variant"))
        kind = F.schema_of_variant(at)
        n = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), F.try_variant_get(at, "$", "double"))
        s = F.when(kind == "STRING", F.try_variant_get(at, "$", "string"))
        b = F.when(kind == "BOOLEAN", F.try_variant_get(at, "$", "boolean"))
        k = F.when(n.isNotNull(), F.lit("num")).when(s.isNotNull(), F.lit("str")).when(b.isNotNull(), F.lit("bool"))
        return self.put(F.when(k.isNotNull(), F.struct(k.alias("k"), n.alias("n"), s.alias("s"), b.alias("b")).cast(DYN)))

    def c_json_get(self, x: Form, g: Column) -> Value:
        (path, source), err, _ = self.eval(x.args, g)
        if not isinstance(path.literal, str):
            raise NotPlannable("a computed JSON path")
        c, e = self.text(source)
        return Value("dyn", self.json_value(c, path.literal), either(err, e))

    def c_json_demux(self, x: Form, g: Column) -> Value:
        *specs, source = x.args
        if len(specs) == 1 and isinstance(specs[0], Vec) and any(isinstance(i, Vec) for i in specs[0].items):
            specs = list(specs[0].items)
        v = self.expr(source, g)
        c, e = self.text(v)
        err = either(v.err, e)
        g = clear(g, err)
        for spec in specs:
            path, suffix = spec.items if isinstance(spec, Vec) else (spec, spec.split(".")[-1] if "leaf" in x.options else spec)
            self.effect(g, F.concat(F.col("subject"), F.lit(f".{suffix}")), Value("dyn", self.json_value(c, path)))
        return Value("nil", err=err)

    # ---- effects

    def effect(self, g: Column, subject: Column, v: Value, places: int | None = None, text: Column | None = None) -> None:
        num = v.col if v.kind == "num" else v.col["n"] if v.kind == "dyn" else F.lit(None).cast("double")
        said = text if text is not None else F.coalesce(v.col["s"], v.col["b"].cast("string")) if v.kind == "dyn" else F.lit(None).cast("string") if v.kind == "num" else v.col.cast("string")
        on = g & self.present(v)
        self.effects.append({"on": on, "subject": subject, "num": num, "text": said, "places": places})

    def c_publish(self, x: Form, g: Column) -> Value:
        (subject, v), err, g = self.eval(x.args, g)
        if v.kind == "vec":
            raise NotPlannable("a vector as a value")
        places = self.size(x.options["dp"], ":dp", 0) if "dp" in x.options else None
        if places is not None and places > 15:
            raise Refused(":dp goes up to 15")
        if subject.kind not in ("str", "dyn"):
            return Value("nil", err=F.lit(True))
        c, _ = self.text(subject)
        bad = self.present(v) & ~subject_valid(c)
        if places is not None and v.kind != "num":
            bad = bad | (self.present(v) if v.kind != "dyn" else self.present(v) & v.col["n"].isNull())
        self.effect(clear(g, bad), c, v, places)
        return Value("nil", err=either(err, bad))

    def c_reply(self, x: Form, g: Column) -> Value:
        (v,), err, g = self.eval(x.args, g)
        places = self.size(x.options["dp"], ":dp", 0) if "dp" in x.options else None
        to = F.nullif(F.col("reply_to"), F.lit(""))
        some = self.present(v) & to.isNotNull()
        bad = some & ~subject_valid(to)
        if places is not None and v.kind != "num":
            bad = bad | (some if v.kind != "dyn" else some & v.col["n"].isNull())
        self.effect(clear(g, bad) & to.isNotNull(), to, v, places)
        self.suppress.append(g & ~some)
        return Value("nil", err=either(err, bad))

    def c_print(self, x: Form, g: Column) -> Value:
        vs, err, _ = self.eval(x.args, g)
        return Value(vs[-1].kind, vs[-1].col, err, vs[-1].items, vs[-1].literal)

    def c_count(self, x: Form, g: Column) -> Value:
        err, subject = None, F.concat(F.col("subject"), F.lit(".count"))
        if "subject" in x.options:
            s = self.expr(x.options["subject"], g)
            subject, e = self.text(s)
            err = either(s.err, e, ~subject_valid(subject))
        on = F.lit(True)
        if x.args:
            v = self.expr(x.args[0], clear(g, err))
            err, on = either(err, v.err), self.truth(v)
        g = clear(g, err)
        w, held = self.plain_window(g & on)
        self.suppress.append(g & ~on)
        n = self.put(F.when(held, F.row_number().over(w)).cast("double"))
        self.effect(held, subject, Value("num", n))
        return Value("nil", err=err)

    # ---- gates

    def stored(self, v: Value) -> tuple[Column, str]:
        """A value as gates keep it: nil as the empty text."""
        if v.kind == "vec":
            return F.lit(None), "vec"
        if v.kind == "num":
            return v.col, "num"
        if v.kind == "dyn":
            return F.coalesce(self.dyn(v), self.dyn(Value("str", F.lit("")))), "dyn"
        return (F.lit("") if v.kind == "nil" else F.coalesce(v.col.cast("string"), F.lit(""))), "str"

    def changes(self, v: Value, g: Column) -> tuple[Column, Column]:
        c, kind = self.stored(v)
        if kind == "vec":
            raise NotPlannable("a vector as a value")
        if kind == "num" and v.literal is None:
            c = F.when(v.col.isNotNull(), c)
        c = self.put(c)
        w, held = self.plain_window(g)
        before, first = F.lag(c).over(w), F.row_number().over(w) == 1
        same = c.eqNullSafe(before)
        if kind == "num":
            same = same & ~F.coalesce(F.isnan(c), F.lit(False))
        change = self.put(held & (first | ~same))
        self.suppress.append(held & ~change)
        return change, held

    def c_squelch(self, x: Form, g: Column) -> Value:
        (v,), err, g = self.eval(x.args, g)
        change, _ = self.changes(v, g)
        out = self.choose(change, Value(v.kind, v.col), Value("nil"))
        return Value(out.kind, out.col, err)

    def c_changed(self, x: Form, g: Column) -> Value:
        (v,), err, g = self.eval(x.args, g)
        return Value("bool", self.changes(v, g)[0], err)

    def c_delta(self, x: Form, g: Column) -> Value:
        (c,), err, g = self.numbers(x, g)
        c = self.put(c)
        w, _ = self.plain_window(g)
        return Value("num", self.put(c - F.coalesce(F.lag(c).over(w), c)), err)

    def edges(self, v: Value, g: Column) -> tuple[Column, Column, Column]:
        now = self.put(self.truth(v))
        w, held = self.plain_window(g)
        before = self.put(F.lag(now).over(w))
        rising = self.put(held & F.coalesce(~before & now, F.lit(False)))
        falling = self.put(held & F.coalesce(before & ~now, F.lit(False)))
        return rising, falling, held

    def c_edge(self, x: Form, g: Column) -> Value:
        (v,), err, g = self.eval(x.args, g)
        rising, falling, held = self.edges(v, g)
        hit = rising if x.name == "rising-edge" else falling
        self.suppress.append(held & ~hit)
        return Value("bool", F.when(hit, F.lit(True)), err)

    def c_transition(self, x: Form, g: Column) -> Value:
        c = self.expr(x.args[0], g)
        rising, falling, held = self.edges(c, clear(g, c.err))
        self.suppress.append(held & ~rising & ~falling)
        up = self.expr(x.args[1], rising)
        down = self.expr(x.args[2], falling)
        out = self.choose(rising, up, self.choose(falling, down, Value("nil")))
        return Value(out.kind, out.col, either(c.err, None if up.err is None else rising & up.err, None if down.err is None else falling & down.err))

    def c_hysteresis(self, x: Form, g: Column) -> Value:
        (lo, hi, v), err, g = self.numbers(x, g)
        bad = ~(F.abs(lo) < float("inf")) | ~(F.abs(hi) < float("inf")) | (lo > hi)
        g = clear(g, bad)
        said = self.put(F.when((v >= hi) & ~F.isnan(v), F.lit(True)).when(v <= lo, F.lit(False)))
        w, _ = self.plain_window(g)
        return Value("bool", self.put(F.coalesce(F.last(said, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))), either(err, bad))

    def fold(self, kind: str, g: Column, v: Column, params: tuple) -> Column:
        held, value = self.name(F.coalesce(g, F.lit(False))), self.name(v)
        self.deal()
        self.n += 1
        self.df = folded(self.df, kind, held, value, params, f"_{self.n}", self.order, partitioned=True)
        return F.col(f"_{self.n}")

    def passes(self, v: Value, ok: Column, held: Column, err: Column | None) -> Value:
        self.suppress.append(held & ~F.coalesce(ok, F.lit(False)))
        out = self.choose(F.coalesce(ok, F.lit(False)), Value(v.kind, v.col), Value("nil"))
        return Value(out.kind, out.col, err)

    def c_deadband(self, x: Form, g: Column) -> Value:
        width = self.literal(x.args[0], "the width of deadband")
        (_, c), err, g = self.numbers(x, g)
        if not width >= 0:
            return Value("nil", err=F.lit(True))
        c = self.put(c)
        return self.passes(Value("num", c), self.fold("deadband", g, c, (width,)), g, err)

    def c_hold_off(self, x: Form, g: Column) -> Value:
        ms = self.size(x.args[0], "the time of hold-off", 0)
        (_, v), err, g = self.eval(x.args, g)
        if v.kind == "vec":
            raise NotPlannable("a vector as a value")
        v = Value(v.kind, v.col if v.kind == "nil" else self.put(v.col))
        return self.passes(v, self.fold("hold-off", g, F.lit(0.0), (ms,)), g, err)

    def c_ewma(self, x: Form, g: Column) -> Value:
        alpha = self.literal(x.args[0], "the weight of ewma")
        (_, c), err, g = self.numbers(x, g)
        bad = F.lit(True) if not 0 < alpha <= 1 else ~(F.abs(c) < float("inf"))
        return Value("num", self.fold("ewma", clear(g, bad), c, (alpha,)), either(err, bad))

    # ---- windows

    def frame(self, x: Form, args: list, g: Column):
        """The trailing frame of a windowed form over the rows that reach it."""
        if "ms" not in x.options:
            n = self.size(args[0], "a window")
            w, held = self.plain_window(g)
            return w.rowsBetween(-(n - 1), 0), held, n
        ms = self.size(x.options["ms"], "a window")
        held = self.put(F.coalesce(g, F.lit(False)))
        self.deal()
        # a place of its own for each message, so that a range frame ends at this one and begins
        # with the first one of its millisecond
        rank = F.row_number().over(Window.partitionBy("subject", "ts_ms").orderBy(self.order)) - 1
        place = self.put(F.col("ts_ms") * (2 * TIES) + rank)
        w = Window.partitionBy("subject", held).orderBy(place)
        return w.rangeBetween(-(ms * 2 * TIES) - (TIES - 1), 0), held, ms

    def c_moving(self, x: Form, g: Column) -> Value:
        vs, err, g = self.eval(x.args, g)
        if x.name == "rate":
            frame, held, ms = self.frame(x, vs, g)
            return Value("num", self.put(F.when(held, F.count(F.lit(1)).over(frame) * 1000 / F.lit(float(ms)))), err)
        c, e = self.number(vs[-1])
        err, g = either(err, e), clear(g, e)
        c = self.put(c)
        if x.name in ("percentile", "median"):
            p = 0.5 if x.name == "median" else self.literal(vs[-2], "the share of percentile")
            if not 0 <= p <= 1:
                return Value("nil", err=F.lit(True))
            frame, held, _ = self.frame(x, vs, g)
            have = F.sort_array(F.collect_list(F.when(held, c)).over(frame))
            have = self.put(have)
            return Value("num", self.put(F.get(have, F.floor(F.lit(p) * (F.size(have) - 1)).cast("int"))), err)
        frame, held, _ = self.frame(x, vs, g)
        agg = {"moving-avg": F.avg, "moving-sum": F.sum, "moving-max": F.max, "moving-min": F.min, "variance": F.var_pop, "stddev": F.stddev_pop}[x.name]
        return Value("num", self.put(F.when(held, agg(c).over(frame))), err)

    def c_throttle(self, x: Form, g: Column) -> Value:
        vs, err, g = self.eval(x.args, g)
        v = vs[-1]
        most = self.size(vs[-2], "the limit of throttle", 0)
        kind, n = ("throttle-ms", self.size(x.options["ms"], "a window")) if "ms" in x.options else ("throttle", self.size(vs[0], "a window"))
        if v.kind == "vec":
            raise NotPlannable("a vector as a value")
        v = Value(v.kind, v.col if v.kind == "nil" else self.put(v.col))
        return self.passes(v, self.fold(kind, g, F.lit(0.0), (n, most)), g, err)

    # ---- bars, timers

    def timer_rows(self, df: DataFrame, due: Column, parts: list[tuple[Column, Column, Column, int | None]], source: str = "timer") -> None:
        """Emissions at ``due`` up to the end of the run: (subject, number, text, places) each."""
        made = F.array(*[F.struct(F.lit(k).alias("k"), s.alias("subject"), n.cast("double").alias("n"), t.cast("string").alias("t"), F.lit(p).cast("int").alias("p")) for k, (s, n, t, p) in enumerate(parts)])
        rows = df.select(due.cast("long").alias("due"), F.explode(made).alias("e"))
        if self.t_end is not None:
            rows = rows.where(F.col("due") <= self.t_end)
        self.timers.append(
            rows.select(
                F.array(F.lit(-1).cast("long"), F.col("due"), F.lit(self.rule.index).cast("long"), F.col("e.k").cast("long")).alias("path"), F.lit(self.rule.index).alias("rule_idx"), F.col("due").alias("ts_ms"), F.col("e.subject").alias("subject"),
                F.col("e.n").alias("payload_num"), F.col("e.t").alias("payload_text"), F.col("e.p").alias("places"), F.lit(0).alias("depth"), F.lit(source).alias("source"),
            )
        )

    BAR = ("open", "high", "low", "close")

    def bar_text(self, c: Column) -> Column:
        return _python_number_text("%.17g")(c)

    def c_bar(self, x: Form, g: Column) -> Value:
        vs, err, g = self.eval(x.args, g)
        c, e = self.number(vs[-1])
        err, g = either(err, e), clear(g, e)
        c = self.put(c)
        w, held = self.plain_window(g)
        if "ms" in x.options:
            n = self.size(x.options["ms"], "a bar")
            bucket = F.floor(F.col("ts_ms") / n)
            grouped = self.df.where(held).withColumn("_v", c).groupBy("subject", bucket.alias("_b"))
            order = F.col(self.order)
            bars = grouped.agg(F.min_by("_v", order).alias("open"), F.max("_v").alias("high"), F.min("_v").alias("low"), F.max_by("_v", order).alias("close"))
            self.timer_rows(bars, (F.col("_b") + 1) * n, [(F.concat("subject", F.lit(f".bar.{k}")), F.col(k), self.bar_text(F.col(k)), None) for k in self.BAR])
            self.suppress.append(held)
            return Value("nil", err=err)
        n = self.size(vs[0], "a bar")
        at = self.put(F.row_number().over(w) - 1)
        group = self.put(F.floor(at / n))
        gw = Window.partitionBy("subject", held, group).orderBy(self.order)
        whole = gw.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        got = {"open": F.first(c).over(whole), "high": F.max(c).over(whole), "low": F.min(c).over(whole), "close": c}
        done = self.put(held & (at % n == n - 1))
        self.suppress.append(held & ~done)
        for k in self.BAR:
            v = self.put(got[k])
            self.effect(done, F.concat(F.col("subject"), F.lit(f".bar.{k}")), Value("num", v), text=self.bar_text(v))
        return Value("nil", err=err)

    def effect_free(self, f):
        """Runs ``f`` and fails if it had an effect or a timer: those can't stand inside a timer."""
        effects, timers = len(self.effects), len(self.timers)
        out = f()
        if len(self.timers) != timers:
            raise NotPlannable("a timer within a timer")
        mine, self.effects = self.effects[effects:], self.effects[:effects]
        return out, mine

    def next_ts(self, g: Column) -> tuple[Column, Column]:
        w, held = self.plain_window(g)
        return self.put(F.lead("ts_ms").over(w)), held

    def settled(self, x: Form, g: Column, n: int) -> Column:
        """Rows after which nothing reaches the site for n ms."""
        after, held = self.next_ts(g)
        return self.put(held & (after.isNull() | (after - F.col("ts_ms") >= n)))

    def held_value(self, vs: list[Value]) -> tuple[Column, Column, Column]:
        subject, v = vs
        s, _ = self.text(subject)
        num = v.col if v.kind == "num" else v.col["n"] if v.kind == "dyn" else F.lit(None).cast("double")
        said = F.lit("") if v.kind == "nil" else F.lit(None).cast("string") if v.kind == "num" else F.coalesce(v.col["s"], v.col["b"].cast("string")) if v.kind == "dyn" else F.coalesce(v.col.cast("string"), F.lit(""))
        return self.put(s), self.put(num), self.put(said)

    def c_debounce(self, x: Form, g: Column) -> Value:
        n = self.size(x.options["ms"], ":ms")
        vs, err, g = self.eval(x.args, g)
        s, num, said = self.held_value(vs)
        quiet = self.settled(x, g, n)
        self.timer_rows(self.df.where(quiet & subject_valid(s)), F.col("ts_ms") + n, [(s, num, said, None)])
        return Value("nil", err=err)

    def c_sample(self, x: Form, g: Column) -> Value:
        n = self.size(x.options["ms"], ":ms")
        if self.t_end is None:
            raise NotPlannable("sample! without an end of the run")
        vs, err, g = self.eval(x.args, g)
        s, num, said = self.held_value(vs)
        w, held = self.plain_window(g)
        t0 = self.put(F.min("ts_ms").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        after = self.put(F.coalesce(F.lead("ts_ms").over(w), F.lit(self.t_end)))
        # grid points after this message, up to and with the next one's time
        first = F.floor((F.col("ts_ms") - t0) / n) + 1
        last = F.floor((F.least(after, F.lit(self.t_end)) - t0) / n)
        rows = self.df.where(held & subject_valid(s)).withColumn("_k", F.explode(F.when(first <= last, F.sequence(first, last))))
        self.timer_rows(rows, t0 + F.col("_k") * n, [(s, num, said, None)])
        return Value("nil", err=err)

    def c_aggregate(self, x: Form, g: Column) -> Value:
        n = self.size(x.options["ms"], ":ms")
        metric = next((m for m in ("avg", "sum", "min", "max", "count", "rate") if m in x.options), None)
        if metric is None:
            raise Refused("aggregate! needs a metric")
        (subject, v), err, g = self.eval(x.args, g)
        c, e = (F.lit(0.0), None) if metric in ("count", "rate") else self.number(v)
        err, g = either(err, e), clear(g, e)
        s, _ = self.text(subject)
        s, c = self.put(s), self.put(c)
        w, held = self.plain_window(g)
        t0 = self.put(F.min("ts_ms").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        k = F.floor((F.col("ts_ms") - t0) / n)
        agg = {"avg": F.avg(c), "sum": F.sum(c), "min": F.min(c), "max": F.max(c), "count": F.count("*"), "rate": F.count("*") * 1000 / F.lit(float(n))}[metric]
        bars = self.df.where(held).groupBy("subject", t0.alias("_t0"), k.alias("_k")).agg(agg.cast("double").alias("_v"), F.max_by(s, F.col(self.order)).alias("_s"))
        self.timer_rows(bars.where(subject_valid(F.col("_s"))), F.col("_t0") + (F.col("_k") + 1) * n, [(F.col("_s"), F.col("_v"), F.lit(None), None)])
        return Value("nil", err=err)

    def timed_effects(self, rows: Column, due: Column, mine: list[dict]) -> None:
        for e in mine:
            self.timer_rows(self.df.where(rows & e["on"]), due, [(e["subject"], e["num"], e["text"], e["places"])])

    def c_on_silence(self, x: Form, g: Column) -> Value:
        n = self.size(x.options["ms"], ":ms")
        quiet = self.settled(x, g, n)
        if self.t_end is not None:
            quiet = self.put(quiet & (F.col("ts_ms") + n <= self.t_end))
        outer = self.df
        # the body sees the last message at the time of the silence
        self.df = self.df.withColumn("_at", F.col("ts_ms") + n).withColumn("_ts", F.col("ts_ms"))
        del outer
        _, mine = self.effect_free(lambda: self.expr(Form("do", x.args, {}, -1), quiet))
        self.timed_effects(quiet, F.col("ts_ms") + n, mine)
        return Value("nil")

    def c_dropout(self, x: Form, g: Column) -> Value:
        n = self.size(x.options["ms"], ":ms")
        quiet = self.settled(x, g, n)
        w, held = self.plain_window(g)
        back = self.put(held & F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(w) >= n, F.lit(False)))
        if _mentions(x.options["lost"], "payload"):
            raise NotPlannable("a dropout body that reads the payload, which is empty then")
        _, mine = self.effect_free(lambda: self.expr(x.options["lost"], quiet))
        self.timed_effects(quiet, F.col("ts_ms") + n, mine)
        v = self.expr(x.options["found"], back)
        out = self.choose(back, v, Value("nil"))
        return Value(out.kind, out.col, None if v.err is None else back & v.err)

    # ---- last values

    def c_last(self, x: Form, g: Column) -> Value:
        """The latest payload of a literal subject: rows of both are merged in ranges of the order, and
        what a range begins with comes from the ranges before it, so no task sees the whole run."""
        subject = x.args[0] if isinstance(x.args[0], str) else None
        if subject is None:
            raise NotPlannable("last of a computed subject")
        if not any(filter_matches(f, subject) for f in self.program.lvc):
            return Value("str", F.lit(None).cast("string"))
        if self.order != "seq":
            raise NotPlannable("last together with re-entry")
        span = 1 << 16
        told = self.everything.where(F.col("subject") == subject).select(F.col("seq").alias("_seq"), F.col("payload").alias("_told"))
        bucket = F.floor(F.col("_seq") / span)
        ends = told.groupBy(bucket.alias("_range")).agg(F.max_by("_told", "_seq").alias("_end"))
        asks = self.df.withColumn("_seq", F.col("seq"))
        ranges = asks.select(bucket.alias("_range")).distinct().join(ends, "_range", "full")
        carried = ranges.withColumn("_before", F.last("_end", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
        rows = asks.withColumn("_told", F.lit(None).cast("string")).withColumn("_ask", F.lit(True))
        both = rows.unionByName(told.withColumn("_ask", F.lit(False)), allowMissingColumns=True).withColumn("_range", bucket)
        w = Window.partitionBy("_range").orderBy("_seq", "_ask").rowsBetween(Window.unboundedPreceding, 0)
        met = both.withColumn("_here", F.last("_told", ignorenulls=True).over(w)).where("_ask").join(carried.select("_range", "_before"), "_range", "left")
        self.n += 1
        name = f"_{self.n}"
        self.df = met.withColumn(name, F.coalesce("_here", "_before")).drop("_seq", "_told", "_ask", "_range", "_here", "_before")
        self.dealt = False
        return Value("str", F.col(name))

    # ---- results

    def emissions(self, *carried: str) -> DataFrame:
        """Rows of EMISSION_ROWS; with the message's columns that are ``carried``, for rules without timers."""
        parts = list(self.timers)
        if self.effects:
            one = F.struct
            made = [
                F.when(
                    F.coalesce(e["on"], F.lit(False)),
                    one(F.lit(k).alias("k"), e["subject"].alias("subject"), e["num"].cast("double").alias("n"), e["text"].cast("string").alias("t"), F.lit(e["places"]).cast("int").alias("p")),
                )
                for k, e in enumerate(self.effects)
            ]
            if len(made) == 1:
                rows = self.df.withColumn("e", made[0]).where(F.col("e").isNotNull())
            else:
                rows = self.df.withColumn("e", F.explode(F.array(*made))).where(F.col("e").isNotNull())
            path = F.col("path") if "path" in self.df.columns else F.array(F.col("seq"))
            # numbers of emissions count those that were made, as they go
            parts.append(
                rows.select(
                    F.concat(path.cast("array<bigint>"), F.array(F.lit(self.rule.index).cast("bigint"), F.col("e.k").cast("bigint"))).alias("path"), F.lit(self.rule.index).alias("rule_idx"), "ts_ms", F.col("e.subject").alias("subject"),
                    F.col("e.n").alias("payload_num"), F.col("e.t").alias("payload_text"), F.col("e.p").alias("places"), (F.col("depth") if "depth" in self.df.columns else F.lit(0)).alias("depth"), F.lit("rule").alias("source"), *carried,
                )
            )
        if not parts:
            none = self.df.sparkSession.createDataFrame([], EMISSION_ROWS)
            return none.select("*", *(F.lit(None).cast(self.df.schema[c].dataType).alias(c) for c in carried))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def statistics(self) -> DataFrame:
        """One row: messages that matched, evaluations suppressed and failed."""
        suppressed = F.lit(0)
        for c in self.suppress:
            suppressed = suppressed + F.coalesce(c, F.lit(False)).cast("long")
        return self.df.agg(F.lit(self.rule.index).alias("rule_idx"), F.count("*").alias("matched"), F.coalesce(F.sum(suppressed), F.lit(0)).alias("suppressed"), F.coalesce(F.sum(self.failed.cast("long")), F.lit(0)).alias("failures"))


EMISSION_ROWS = "path array<bigint>, rule_idx int, ts_ms bigint, subject string, payload_num double, payload_text string, places int, depth int, source string"


def _mentions(x, beginning: str) -> bool:
    if isinstance(x, Sym):
        return x.name.startswith(beginning)
    if isinstance(x, Form):
        return any(_mentions(a, beginning) for a in [*x.args, *x.options.values()])
    return isinstance(x, Vec) and any(_mentions(a, beginning) for a in x.items)


def _python_text(call):
    @F.pandas_udf(T.StringType())
    def f(xs):
        import pandas as pd

        return pd.Series([None if v is None else call(v) for v in xs], dtype=object)

    return f


def _python_number_text(form: str):
    @F.pandas_udf(T.StringType())
    def f(xs):
        import pandas as pd

        return pd.Series([None if v is None or v != v else form % v for v in xs], dtype=object)

    return f


#: Which method plans which form.
FORM_METHODS = {
    "->": "c_thread", "if": "c_if", "when": "c_when", "do": "c_do", "and": "c_and", "or": "c_or", "not": "c_not", "=": "c_equals",
    **dict.fromkeys([">", "<", ">=", "<="], "c_compare"), **dict.fromkeys(["+", "-", "*", "/"], "c_arithmetic"),
    **dict.fromkeys(["round", "quantize", "clamp", "min", "max", "abs", "sign"], "c_scalar"),
    **dict.fromkeys(["starts-with?", "ends-with?"], "c_affix"), "contains?": "c_contains", "transition": "c_transition",
    "str-concat": "c_str_concat", "subject-append": "c_subject_append", "subject-token": "c_subject_token", "subject-with": "c_subject_with",
    "matches?": "c_matches", "re-capture": "c_re_capture", "re-replace": "c_re_replace", "now": "c_now",
    **dict.fromkeys(["moving-avg", "moving-sum", "moving-max", "moving-min", "variance", "stddev", "percentile", "median", "rate"], "c_moving"),
    "throttle": "c_throttle", "ewma": "c_ewma", "bar!": "c_bar", "squelch": "c_squelch", "changed?": "c_changed", "delta": "c_delta",
    **dict.fromkeys(["rising-edge", "falling-edge"], "c_edge"), "hysteresis": "c_hysteresis", "deadband": "c_deadband", "hold-off": "c_hold_off",
    "last": "c_last", "json-get": "c_json_get", "json-demux!": "c_json_demux", "publish!": "c_publish", "reply!": "c_reply", "print!": "c_print",
    "count!": "c_count", "debounce!": "c_debounce", "sample!": "c_sample", "aggregate!": "c_aggregate", "on-silence": "c_on_silence", "dropout": "c_dropout",
}
