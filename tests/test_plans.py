"""Plans against the machine, over messages with ties, gaps, errors and several subjects."""

import random

import pytest

from tidegate import engine, sources
from tidegate.lang.program import load
from tidegate.runtime.machine import Machine

RULES = [
    '(on "a.*" (-> payload-float (round 1) (squelch) (publish! (subject-append "stable"))))',
    '(on ">" (when (> payload-float 20) (publish! "o" (delta payload-float))))',
    '(on ">" (-> payload-float (moving-avg 3) (deadband 2) (publish! (subject-append "sm"))))',
    '(on ">" (do (-> payload (hold-off 100) (publish! "h")) (-> payload (throttle :ms 100 2) (publish! "t")) (-> payload-float (ewma 0.5) (publish! "e"))))',
    '(on ">" (do (publish! "a" (moving-sum :ms 50 payload-float)) (publish! "p" (percentile 5 0.9 payload-float)) (publish! "r" (rate :ms 100 payload))))',
    '(on "a.>" (do (bar! 3 payload-float) (bar! :ms 100 payload-float)))',
    '(on ">" (transition (hysteresis 10 30 payload-float) (publish! (subject-append "hot") "hot") (publish! (subject-append "cool") "cool")))',
    '(on ">" (do (count!) (count! :subject "tot.x" (contains? payload "err"))))',
    '(on ">" (json-demux! "t" ["s" "word"] "b" "n.q.1" "zz" payload))',
    '(on ">" (do (debounce! :ms 50 (subject-append "q") payload) (sample! :ms 70 (subject-append "g") payload) (on-silence :ms 60 (publish! "s" payload))))',
    '(on ">" (do (aggregate! :ms 150 (subject-append "g") :avg payload-float)))',
    '(on ">" (dropout :ms 60 :lost (publish! (subject-append "l") "lost") :found (publish! (subject-append "f") payload)))',
    '(on ">" (publish! "o" (if (> payload-float 20) "hi" payload-float)))',
    '(on ">" (publish! "o" (and (> payload-float 20) (squelch payload))))',
    '(on ">" (publish! "o" (re-replace "b*" "-" (str-concat (re-capture "a(b)?|x" payload) payload))))',
    '(on ">" (reply! payload))',
    '(lvc [">"]) (on "a.x" (-> (last "b.z") (- payload-float) (publish! "o")))',
    '(on "a.*" :reentrant true (publish! "room.all" payload)) (on "room.all" (publish! "room.average" (moving-avg 2 payload-float)))',
    '(on "a.x" :reentrant true (publish! "a.x" "loop"))',
    '(on ">" (publish! "o" (moving-avg (+ 1 2) payload-float)))',
    '(every :ms 250 (publish! "tick" "x"))',
]


def made(seed):
    r, ts, rows = random.Random(seed), 1000, []
    for k in range(120):
        ts += r.choice([0, 10, 30, 60, 200])
        text = r.choice(["abc err 12", "", '{"t":%d,"s":"w","b":true,"n":{"q":[1,%s]}}' % (k, k / 4), "true", " 7", "1e400"])
        rows.append((k, ts, ts, r.choice(["a.x", "a.y", "b.z"]), r.choice([text, str(r.randint(0, 40)), str(round(r.uniform(-5, 50), 2))]), r.choice([None, "r.1"]), False))
    return rows


@pytest.fixture(scope="module")
def rows():
    return made(3)


def shown(es):
    return sorted(str((e[0], e[1], None if e[2] is None else ("nan" if e[2] != e[2] else round(e[2], 9)), e[3] if e[2] is None else None, e[4], e[5])) for e in es)


@pytest.mark.parametrize("source", RULES)
def test_plan_equals_machine(spark, rows, source):
    program, t_end = load(source), rows[-1][1] + 500
    machine, want = Machine(program), []
    for r in rows:
        want += machine.feed(r[0], r[1], r[3], r[4], r[5], r[2], r[6]).emissions
    want += machine.finish(t_end).emissions
    df = spark.createDataFrame(rows, sources.MESSAGE).repartition(3)
    got = engine.run(program, df, t_end=t_end).collect()
    assert shown((e.ts_ms, e.subject, e.payload_num, e.payload, e.depth, e.source) for e in got) == shown((e.ts, e.subject, e.number, e.payload, e.depth, e.source) for e in want)
    texts = sorted((e.subject, e.payload) for e in got if e.payload_num is not None and "avg" not in source and "ewma" not in source)
    assert not texts or texts == sorted((e.subject, e.payload) for e in want if e.number is not None)


def test_empty_table(spark):
    df = spark.createDataFrame([], sources.MESSAGE)
    assert engine.run('(on ">" (do (count!) (debounce! :ms 5 "o" payload)))', df).collect() == []


def test_filters_reach_the_scan(spark, data):
    df = spark.read.parquet(f"{data}/nation.parquet")
    msgs = sources.messages(df, "n_nationkey", df.n_nationkey, df.n_name, df.n_name)
    plan = engine.run('(on "FRANCE" (publish! "o" payload))', msgs)._jdf.queryExecution().toString()
    assert "EqualTo(n_name,FRANCE)" in plan


def test_one_shuffle_serves_all_windows(spark, rows):
    df = spark.createDataFrame(rows, sources.MESSAGE)
    out = engine.run('(on ">" (do (publish! "a" (moving-avg 3 payload-float)) (publish! "b" (delta payload-float)) (count!)))', df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_tables_beside_emissions(spark, rows):
    df = spark.createDataFrame(rows, sources.MESSAGE)
    lvc = {r.subject: r.payload for r in engine.last_values('(lvc ["a.>"])', df).collect()}
    want = {r[3]: r[4] for r in rows if r[3].startswith("a.")}
    assert lvc == want
    subs = spark.createDataFrame([(1, "a.*", None, None), (2, "a.*", "q", None), (3, "a.*", "q", None), (4, ">", None, 2)], "sid int, filter string, queue string, most long")
    got = engine.delivered(subs, df).groupBy("sid").count().collect()
    n = {r.sid: r["count"] for r in got}
    a = sum(r[3].startswith("a.") for r in rows)
    assert n[1] == a and n.get(2, 0) + n.get(3, 0) == a and n[4] == 2
    stats = engine.statistics('(on "a.*" (squelch payload-float))', df).first()
    assert stats.matched == a and stats.failures > 0


def test_user_forms_as_columns(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows[:5], sources.MESSAGE)
    got = engine.run('(on ">" (publish! "o" (shout payload)))', df, user_forms={"shout": lambda c: F.upper(c)}).collect()
    assert sorted(r.payload for r in got) == sorted(r[4].upper() for r in rows[:5])


def test_sources_and_soundcheck(spark, tmp_path):
    got = engine.run('(on ">" (publish! "o" (+ 1 payload-float)))', sources.lines(spark, ["a.b|1", "a.c|x|y"])).collect()
    assert [(r.subject, r.payload) for r in got] == [("o", "2")]
    from tidegate.soundcheck import check

    f = tmp_path / "r.edn"
    f.write_text('(on ">" (debounce! :ms 10 "calm" payload))')
    assert [line for line, bad in check(str(f), ["a|1\n", "\n", "a|2"])] == ["a|1", "a|2", "  calm|2"]
    assert sources.kafka_options({"servers": ["nats://h:1", "h2:2"], "tls": True})["kafka.bootstrap.servers"] == "h:1,h2:2"
    assert sources.export_rows(got and spark.createDataFrame([("o.x", "1")], "subject string, payload string"), {"origin-header": "X"}).first().topic == "o"
    assert sources.envelopes(spark.createDataFrame([("s", "p"), ("s", "\0")], "subject string, payload string")).count() == 1


def test_statistics_of_every_kind_of_rule(spark):
    """Planned, computed-window and timer rules are counted, and a rule that nothing matches is 0."""
    from tidegate import engine

    rows = [(k, 1000 * k, 1000 * k, f"a.{k % 3}", "0x1A" if k % 2 else "oops", None, False) for k in range(30)]
    df = spark.createDataFrame(rows, "seq long, ts_ms long, wall_ms long, subject string, payload string, reply_to string, replaying boolean")
    rules = '(on "a.*" (publish! "o.x" payload-float)) (on "a.*" (publish! "o.y" (moving-avg (+ 1 2) payload-float))) (every :ms 10000 (publish! "tick" 1)) (on "none" (publish! "o.z" (moving-avg (+ 1 2) payload-float)))'
    got = {r.rule_idx: (r.matched, r.emitted, r.suppressed, r.failures) for r in engine.statistics(rules, df).collect()}
    assert got[0] == (30, 15, 0, 15) and got[1] == (30, 15, 0, 15) and got[3] == (0, 0, 0, 0)
    assert got[2][0] == got[2][1] == 3


def test_subscriptions_by_their_beginnings(spark):
    """Filters of all shapes against the plain matcher, without a nested loop."""
    from tidegate import engine
    from tidegate.lang.program import filter_matches

    subjects = ["a", "a.b", "a.b.c", "b.a", "a.x$y", "x.b.c", "a..b", "b"]
    filters = ["a", "a.b", "a.*", "a.>", ">", "*", "*.b.>", "a.b.c", "a.*.c", "a.x$y", "b.>", "none"]
    messages = spark.createDataFrame([(k, s, "p") for k, s in enumerate(subjects * 3)], "seq long, subject string, payload string")
    subs = spark.createDataFrame([(k, f, 2 if f == "a.>" else None) for k, f in enumerate(filters)], "sid int, filter string, most long")
    out = engine.delivered(subs, messages)
    want = []
    for k, f in enumerate(filters):
        mine = [(k, n) for n, s in enumerate(subjects * 3) if filter_matches(f, s)]
        want += mine[:2] if f == "a.>" else mine
    assert sorted((r.sid, r.seq) for r in out.collect()) == sorted(want)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_republished_messages_are_not_joined_back(spark):
    from tidegate import engine

    df = spark.createDataFrame([(k, k, 7 * k, "a.b", str(k), None, k > 2) for k in range(5)], "seq long, ts_ms long, wall_ms long, subject string, payload string, reply_to string, replaying boolean")
    out = engine.run('(on "a.b" :reentrant true (publish! "c.d" payload)) (on "c.d" (when replaying? (publish! "e" (now :date))))', df)
    assert sum(r.subject == "e" for r in out.collect()) == 2
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
