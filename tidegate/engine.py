"""Programs over message tables: plans where there are plans, the machine where there are none."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import values
from tidegate.lang.program import MAX_DEPTH, Form, Program, Rule, filter_matches, load, may_match
from tidegate.lang.tree import Sym, Vec
from tidegate.plans.compiler import EMISSION_ROWS, NotPlannable, RulePlan, matches
from tidegate.session import ship

#: After the last message timers go on for so long.
LINGER_MS = 10_000


def run(program: Program | str, messages: DataFrame, linger_ms: int = LINGER_MS, t_end: int | None = None, user_forms: dict | None = None, user_symbols: dict | None = None) -> DataFrame:
    """All emissions of a program over a table of messages (``sources.messages`` has the columns):
    ``path``, ``rule_idx``, ``ts_ms``, ``subject``, ``payload``, ``payload_num``, ``depth``, ``source``.

    ``payload`` is made at the very end and only if it is read; comparisons and further plans
    go by ``payload_num``.
    """
    if isinstance(program, str):
        program = load(program, user_forms=frozenset(user_forms or ()), user_symbols=frozenset(user_symbols or ()))
    ship(messages.sparkSession)
    if t_end is None and any(_timed(r.body) or r.every_ms for r in program.rules):
        last = messages.agg(F.max("ts_ms").alias("t")).first().t
        t_end = None if last is None else last + linger_ms
    rows = None
    for part in _parts(program, messages, t_end, user_forms, user_symbols):
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = messages.sparkSession.createDataFrame([], EMISSION_ROWS)
    return finished(rows)


def finished(rows: DataFrame, *carried: str) -> DataFrame:
    text = F.coalesce("payload_text", values.text_of_number(F.col("payload_num"), F.col("places")))
    return rows.select("path", "rule_idx", "ts_ms", "subject", text.alias("payload"), "payload_num", "depth", "source", *carried)


def _timed(x) -> bool:
    return isinstance(x, Form) and (x.name in ("debounce!", "sample!", "aggregate!", "on-silence", "dropout") or (x.name == "bar!" and "ms" in x.options) or any(map(_timed, [*x.args, *x.options.values()])))


def _uses(x, name: str) -> bool:
    return isinstance(x, Form) and (x.name == name or any(_uses(a, name) for a in [*x.args, *x.options.values()])) or isinstance(x, Vec) and any(_uses(a, name) for a in x.items)


# ---------------------------------------------------------------- what rules publish


def published(x, own: str) -> list[str]:
    """Filters that cover the subjects a body can publish, for messages that fit ``own``."""
    if isinstance(x, Vec):
        return [p for a in x.items for p in published(a, own)]
    if not isinstance(x, Form):
        return []
    out = [p for a in [*x.args, *x.options.values()] for p in published(a, own)]
    name = x.name
    if name in ("publish!", "debounce!", "sample!", "aggregate!"):
        out.append(_shape(x.args[0], own))
    elif name == "count!":
        out.append(_shape(x.options["subject"], own) if "subject" in x.options else _below(own, ["count"]))
    elif name == "bar!":
        out.append(_below(own, ["bar", "*"]))
    elif name in ("json-demux!", "reply!"):
        out.append(_below(own, [">"]) if name == "json-demux!" else ">")
    return out


def _below(own: str, tail: list[str]) -> str:
    tokens = own.split(".")
    return ".".join([*tokens[:-1], ">"] if tokens[-1] == ">" else [*tokens, *tail])


def _shape(x, own: str) -> str:
    """A filter that covers a subject expression."""
    if isinstance(x, str):
        return x
    if isinstance(x, Sym) and x.name == "subject":
        return own
    if isinstance(x, Form) and x.name == "subject-append" and isinstance(x.args[0], str):
        return _below(own, x.args[0].split("."))
    if isinstance(x, Form) and x.name == "subject-with" and not any(isinstance(a, Vec) for a in x.args):
        return ".".join(a if isinstance(a, str) else "*" for a in x.args)
    return ">"


def _order(program: Program) -> list[Rule] | None:
    """Rules so that each comes after those that feed it; None if they feed one another."""
    rules = [r for r in program.rules if r.every_ms is None]
    feeds = {r.index: {q.index for q in rules for p in published(r.body, r.filter) if may_match(p, q.filter)} if r.reentrant else set() for r in rules}
    out: list[Rule] = []
    left = {r.index: r for r in rules}
    while left:
        free = [i for i in left if not any(i in feeds[j] for j in left)]
        if not free:
            return None
        for i in free:
            out.append(left.pop(i))
    return out


# ---------------------------------------------------------------- the parts of a run


def _parts(program: Program, messages: DataFrame, t_end: int | None, forms: dict | None, symbols: dict | None) -> Iterator[DataFrame]:
    reentrant = [r for r in program.rules if r.reentrant]
    uses_last = any(_uses(r.body, "last") for r in program.rules)
    writes_lvc = uses_last and any(may_match(p, f) for r in program.rules for p in published(r.body, r.filter or ">") for f in program.lvc)
    if writes_lvc or any(r.every_ms is not None and (r.reentrant or _uses(r.body, "last")) for r in program.rules):
        yield machine_run(program, messages, t_end, forms, symbols)
        return
    if reentrant:
        order = _order(program)
        if order is None or uses_last or any(_timed(r.body) for r in program.rules):
            yield machine_run(program, messages, t_end, forms, symbols)
            return
        try:
            yield from _cascade(program, order, messages, t_end, forms, symbols)
        except NotPlannable:
            yield machine_run(program, messages, t_end, forms, symbols)
            return
        for r in program.rules:
            if r.every_ms is not None:
                yield _ticks(program, r, messages, t_end, forms, symbols)
        return
    for r in program.rules:
        if r.every_ms is not None:
            yield _ticks(program, r, messages, t_end, forms, symbols)
            continue
        try:
            yield RulePlan(program, r, messages, "seq", t_end, forms, symbols).emissions()
        except NotPlannable:
            yield machine_by_subject(program, r, messages, t_end, forms, symbols)


def _cascade(program: Program, order: list[Rule], messages: DataFrame, t_end: int | None, forms: dict | None, symbols: dict | None) -> Iterator[DataFrame]:
    """Rules in the order in which they feed one another; each sees the messages and what the rules
    before it republished, placed by path."""
    base = messages.withColumn("path", F.array(F.col("seq").cast("bigint"))).withColumn("depth", F.lit(0))
    fed: list[tuple[list[str], DataFrame]] = []
    for r in order:
        frame = base
        for shapes, rows in fed:
            if any(may_match(p, r.filter) for p in shapes):
                frame = frame.unionByName(rows)
        if not r.reentrant:
            yield RulePlan(program, r, frame, "path", t_end, forms, symbols).emissions()
            continue
        # what a republished message has of the first one comes along, so that nothing is joined back
        of_first = ("wall_ms", "replaying")
        out = RulePlan(program, r, frame, "path", t_end, forms, symbols).emissions(*of_first)
        yield out.drop(*of_first)
        told = finished(out, *of_first).where(F.col("depth") < MAX_DEPTH)
        again = told.select(
            F.col("path")[0].alias("seq"), "ts_ms", "wall_ms", "subject", "payload", F.lit(None).cast("string").alias("reply_to"), "replaying", "path", (F.col("depth") + 1).alias("depth")
        )
        fed.append((published(r.body, r.filter), again.select(*base.columns)))


def _ticks(program: Program, rule: Rule, messages: DataFrame, t_end: int | None, forms: dict | None, symbols: dict | None) -> DataFrame:
    plan = _tick_plan(program, rule, messages, t_end, forms, symbols)
    return messages.sparkSession.createDataFrame([], EMISSION_ROWS) if plan is None else plan.emissions().withColumn("source", F.lit("timer"))


def _tick_plan(program: Program, rule: Rule, messages: DataFrame, t_end: int | None, forms: dict | None, symbols: dict | None) -> RulePlan | None:
    """A timer rule: its body on a frame of ticks, one row each; none without messages."""
    if t_end is None:
        return None
    start = messages.agg(F.min("ts_ms").alias("t0"))
    grid = start.select(F.explode(F.expr(f"case when t0 + {rule.every_ms} <= {t_end} then sequence(t0 + {rule.every_ms}, {t_end}L, {rule.every_ms}L) end")).alias("ts_ms"))
    frame = grid.select(
        F.col("ts_ms").alias("seq"), "ts_ms", F.col("ts_ms").alias("wall_ms"), F.lit("").alias("subject"), F.lit("").alias("payload"), F.lit(None).cast("string").alias("reply_to"), F.lit(False).alias("replaying"),
        F.array(F.lit(-1).cast("bigint"), F.col("ts_ms")).alias("path"), F.lit(0).alias("depth"),
    )
    return RulePlan(program, replace(rule, filter="", every_ms=None), frame, "seq", t_end, forms, symbols)


# ---------------------------------------------------------------- the machine on tables

COLUMNS = ["seq", "ts_ms", "wall_ms", "subject", "payload", "reply_to", "replaying"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in COLUMNS), strict=True)


def _batch(found: list) -> pa.RecordBatch:
    columns = list(zip(*[(list(e.path), e.rule, e.ts, e.subject, e.number, e.payload, None, e.depth, e.source) for e in found], strict=True)) or [[]] * 9
    kinds = [pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    names = ["path", "rule_idx", "ts_ms", "subject", "payload_num", "payload_text", "places", "depth", "source"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def machine_by_subject(program: Program, rule: Rule, messages: DataFrame, t_end: int | None, forms: dict | None = None, symbols: dict | None = None) -> DataFrame:
    """One rule whose state is by subject: subjects are dealt out, one machine for each in turn."""
    alone = Program([rule], program.lvc, user_forms=program.user_forms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidegate.runtime.machine import Machine

        machine, subject, found = None, object(), []
        for seq, ts, wall, s, payload, reply, replaying in _rows(batches):
            if s != subject:
                if machine is not None and t_end is not None:
                    found += machine.finish(t_end).emissions
                machine, subject = Machine(alone, forms, symbols), s
            found += machine.feed(seq, ts, s, payload or "", reply, wall, bool(replaying)).emissions
            if len(found) > 5000:
                yield _batch(found)
                found = []
        if machine is not None and t_end is not None:
            found += machine.finish(t_end).emissions
        yield _batch(found)

    mine = messages.where(matches(rule.filter, F.col("subject"))).select(*COLUMNS)
    return mine.repartition("subject").sortWithinPartitions("subject", "seq").mapInArrow(work, EMISSION_ROWS)


def machine_run(program: Program, messages: DataFrame, t_end: int | None, forms: dict | None = None, symbols: dict | None = None) -> DataFrame:
    """A whole program in the order of its messages. Rules that feed one another in a circle share
    state across subjects, so their messages pass one task; it holds their state, not the messages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidegate.runtime.machine import Machine

        machine, found = Machine(program, forms, symbols), []
        for seq, ts, wall, s, payload, reply, replaying in _rows(batches):
            found += machine.feed(seq, ts, s, payload or "", reply, wall, bool(replaying)).emissions
            if len(found) > 5000:
                yield _batch(found)
                found = []
        if t_end is not None:
            found += machine.finish(t_end).emissions
        yield _batch(found)

    wanted = F.lit(any(r.every_ms is not None for r in program.rules))
    for f in [*(r.filter for r in program.rules if r.every_ms is None), *program.lvc]:
        wanted = wanted | matches(f, F.col("subject"))
    return messages.where(wanted).select(*COLUMNS).repartition(1).sortWithinPartitions("seq").mapInArrow(work, EMISSION_ROWS)


# ---------------------------------------------------------------- tables beside the emissions


COUNTS = "rule_idx int, matched bigint, emitted bigint, suppressed bigint, failures bigint"


def machine_statistics(program: Program, rule: Rule, messages: DataFrame, t_end: int | None) -> DataFrame:
    """``statistics`` of a rule that has no plan: the machine's counters, by subject, added up."""
    alone = Program([rule], program.lvc, user_forms=program.user_forms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidegate.runtime.machine import Machine

        machine, subject, total = None, object(), [0, 0, 0, 0]

        def leave() -> None:
            if machine is not None:
                if t_end is not None:
                    machine.finish(t_end)
                total[1:] = [a + b for a, b in zip(total[1:], machine.stats[rule.index], strict=True)]

        for seq, ts, wall, s, payload, reply, replaying in _rows(batches):
            if s != subject:
                leave()
                machine, subject = Machine(alone), s
            total[0] += 1
            machine.feed(seq, ts, s, payload or "", reply, wall, bool(replaying))
        leave()
        yield pa.RecordBatch.from_arrays([pa.array([rule.index], pa.int32()), *(pa.array([n], pa.int64()) for n in total)], names=["rule_idx", "matched", "emitted", "suppressed", "failures"])

    mine = messages.where(matches(rule.filter, F.col("subject"))).select(*COLUMNS)
    parts = mine.repartition("subject").sortWithinPartitions("subject", "seq").mapInArrow(work, COUNTS)
    # without a message that matches there may be no task, and the sums are of nothing
    return parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matched", "emitted", "suppressed", "failures"))).select(F.lit(rule.index).alias("rule_idx"), "*")


def statistics(program: Program | str, messages: DataFrame, linger_ms: int = LINGER_MS) -> DataFrame:
    """``rule_idx``, ``matched``, ``emitted``, ``suppressed``, ``failures`` by rule. A timer rule matches its
    ticks. Each rule is counted over the messages as they came (re-entry isn't followed)."""
    program = load(program) if isinstance(program, str) else program
    ship(messages.sparkSession)
    t_end = messages.agg(F.max("ts_ms").alias("t")).first().t
    t_end = None if t_end is None else t_end + linger_ms
    out = messages.sparkSession.createDataFrame([], COUNTS)
    for r in program.rules:
        try:
            plan = _tick_plan(program, r, messages, t_end, None, None) if r.every_ms is not None else RulePlan(program, r, messages, "seq", t_end)
            if plan is None:
                continue
            emitted = plan.emissions().agg(F.count("*").alias("emitted"))
            one = plan.statistics().join(emitted, F.lit(True)).select("rule_idx", "matched", "emitted", "suppressed", "failures")
        except NotPlannable:
            one = machine_statistics(program, r, messages, t_end)
        out = out.unionAll(one)
    return out


def last_values(program: Program | str, messages: DataFrame, emissions: DataFrame | None = None) -> DataFrame:
    """The last-value table: ``subject``, ``payload``, ``seq`` for subjects that an lvc filter names."""
    program = load(program) if isinstance(program, str) else program
    wanted = F.lit(False)
    for f in program.lvc:
        wanted = wanted | matches(f, F.col("subject"))
    rows = messages.select("subject", "payload", F.array(F.col("seq").cast("bigint")).alias("path"))
    if emissions is not None:
        rows = rows.unionByName(emissions.select("subject", "payload", "path"))
    rows = rows.where(wanted)
    return rows.groupBy("subject").agg(F.max_by("payload", "path").alias("payload"), F.max("path")[0].alias("seq"))


def replayed(program: Program | str, messages: DataFrame, pattern: str, joined: int) -> DataFrame:
    """What a subscription to ``$LVC.<pattern>`` that joins after message number ``joined`` gets: the
    cached values first, then every later message of a subject that an lvc filter names."""
    program = load(program) if isinstance(program, str) else program
    mine = messages.where(matches(pattern, F.col("subject")))
    cached = last_values(program, mine.where(F.col("seq") <= joined)).select("seq", "subject", "payload", F.lit(True).alias("cached"))
    wanted = F.lit(False)
    for f in program.lvc:
        wanted = wanted | matches(f, F.col("subject"))
    live = mine.where(wanted & (F.col("seq") > joined)).select("seq", "subject", "payload", F.lit(False).alias("cached"))
    return cached.unionByName(live).withColumn("subject", F.concat(F.lit("$LVC."), "subject"))


def status_messages(stats: DataFrame) -> DataFrame:
    """Statistics as messages ``$STATS.rules.<rule>.<count>``."""
    names = [c for c in stats.columns if c != "rule_idx"]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("value")) for n in names])).alias("s")
    return stats.select("rule_idx", each).select(F.concat(F.lit("$STATS.rules."), F.col("rule_idx").cast("string"), F.lit("."), F.col("s.name")).alias("subject"), F.col("s.value").cast("string").alias("payload"))


def delivered(subscriptions: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages by subscription (``sid``, ``filter``, optional ``queue`` and ``most``): every plain
    subscription gets each message that fits; of a queue group one member does, chosen by a hash;
    ``most`` ends a subscription after so many deliveries."""
    subs = subscriptions
    for name, kind in (("queue", "string"), ("most", "long")):
        if name not in subs.columns:
            subs = subs.withColumn(name, F.lit(None).cast(kind))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("filter", r"([.$^+?{}\[\]()|\\])", r"\\$1"), r"\*", "[^.]+"), r"(^|\\\.)>$", "$1.+")
    # a filter's tokens before its first wildcard are what a message must begin with: an equality,
    # so that the pattern is held only against messages that do
    subs = subs.withColumn("_pattern", F.concat(F.lit("(?s)^"), body, F.lit("\\z")))
    subs = subs.withColumn("_begin", F.regexp_extract("filter", r"^((?:[^.*>]+\.)*[^.*>]*\z|(?:[^.*>]+\.)*)", 1))
    subs = subs.withColumn("_begin", F.regexp_replace("_begin", r"\.\z", ""))
    begins = subs.agg(F.collect_set(F.size(F.split(F.col("_begin"), r"\."))), F.max(F.col("_begin") == "")).first()
    lengths = sorted({n for n in begins[0]}) or [1]
    tokens = F.split("subject", r"\.")
    starts = F.array_distinct(F.array(*([F.lit("")] if begins[1] else []), *(F.concat_ws(".", F.slice(tokens, 1, n)) for n in lengths)))
    met = messages.withColumn("_begin", F.explode(starts)).join(F.broadcast(subs) if subs.count() <= 65_536 else subs, "_begin").where("subject rlike _pattern")
    group = Window.partitionBy("seq", "filter", "queue").orderBy(F.xxhash64("seq", "sid"), "sid")
    one = met.where("queue is not null").withColumn("_k", F.row_number().over(group)).where("_k = 1").drop("_k")
    met = met.where("queue is null").unionByName(one)
    # only what ends after some deliveries needs them counted
    turn = Window.partitionBy("sid").orderBy("seq")
    ended = met.where("most is not null").withColumn("_turn", F.row_number().over(turn)).where("_turn <= most").drop("_turn")
    met = met.where("most is null").unionByName(ended)
    return met.select("sid", "seq", "subject", "payload")


def exported(program: Program, rows: DataFrame) -> DataFrame:
    """What the program's export sends on."""
    wanted = F.lit(False)
    for f in (program.export or {}).get("export", []):
        wanted = wanted | matches(f, F.col("subject"))
    return rows.where(wanted)


def covers(program: Program, subject: str) -> bool:
    return any(filter_matches(f, subject) for f in program.lvc)
