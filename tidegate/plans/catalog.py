"""Queries, one or more for each form, over the ``events`` table as messages, with the SQL that says
the same. Numbers are compared in whole millionths, so that the order in which two engines add
doubles doesn't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate import engine, sources

HOUR = 3_600_000
DAY = 24 * HOUR


def micro(c: Column) -> Column:
    return F.round(c * 1e6).cast("long")


def run_rules(spark: SparkSession, sf_dir: str, rules: str, kind: str, payload: str = "value", per_user: bool = True) -> DataFrame:
    """Emissions as the query's rows: ``n``umbers or ``t``exts, by message or (``N``, ``T``) by time."""
    out = engine.run(rules, sources.events(spark, sf_dir, payload, per_user))
    key = F.col("path")[0].alias("seq") if kind.islower() else F.col("ts_ms")
    value = micro(F.col("payload_num")).alias("v_micro") if kind in "nN" else F.col("payload").alias("s")
    return out.select(key, "subject", value)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round a noisy reading to one place, drop repeats, republish."""
    return run_rules(spark, sf_dir, '(on "events.*.*" (-> payload-float (round 1) (squelch) (publish! (subject-append "stable"))))', "n")


#: The messages in SQL; ``w`` is the order within a subject.
M = """m AS (SELECT event_id AS seq, CAST(epoch_ns(ts) // 1000000 AS BIGINT) AS ts_ms, 'events.' || event_type || '.' || user_id AS subject,
 event_type, user_id, value AS x, props, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events),
 t_end AS (SELECT max(ts_ms) + 10000 AS t_end FROM m)"""
W = "OVER (PARTITION BY subject ORDER BY seq)"
MICRO = "CAST(round(({}) * 1000000) AS BIGINT) AS v_micro"


def q_num(value: str, where: str = "TRUE", subject: str = "'o.x'", source: str = "m") -> str:
    return f"WITH {M} SELECT seq, {subject} AS subject, {MICRO.format(value)} FROM (SELECT *, {W_COLUMNS} FROM {source}) WHERE {where}"


def q_text(value: str, where: str = "TRUE", subject: str = "'o.x'") -> str:
    return f"WITH {M} SELECT seq, {subject} AS subject, {value} AS s FROM m WHERE {where}"


#: Values of the row before within the subject, and row numbers.
W_COLUMNS = f"lag(x) {W} AS px, lag(k) {W} AS pk, row_number() {W} AS rn, lag(ts_ms) {W} AS pts, lead(ts_ms) {W} AS nts, first_value(ts_ms) {W} AS t0"


def over(agg: str, frame: str) -> str:
    """An aggregate over a trailing frame, by message."""
    return f"WITH {M} SELECT seq, 'o.x' AS subject, {MICRO.format(f'{agg} OVER (PARTITION BY subject ORDER BY {frame})')} FROM m"


def recursive(state0: str, step: str, value: str, where: str) -> str:
    """A sequential form as a recursion over the messages of each subject."""
    return f"""WITH RECURSIVE {M}, n AS (SELECT *, row_number() {W} AS rn FROM m),
 r AS (SELECT subject, seq, rn, x, ts_ms, {state0} FROM n WHERE rn = 1
 UNION ALL SELECT n.subject, n.seq, n.rn, n.x, n.ts_ms, {step} FROM n JOIN r ON n.subject = r.subject AND n.rn = r.rn + 1)
 SELECT seq, 'o.x' AS subject, {MICRO.format(value)} FROM r WHERE {where}"""


TICK3 = "seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"
TICK5 = "seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW"
TIME = f"ts_ms RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW"
STABLE = "(CASE WHEN x < 0 THEN -floor(-x * 10 + 0.5) ELSE floor(x * 10 + 0.5) END) / 10"


def one(body: str, filter_: str = "events.*.*") -> str:
    return f'(on "{filter_}" {body})'


def to(expr: str) -> str:
    return one(f'(publish! "o.x" {expr})')


#: name -> (rules, kind, payload, SQL or None)
CASES: dict[str, tuple[str, str, str, str | None]] = {
    # rules and subjects
    "flagship_stable": (one('(-> payload-float (round 1) (squelch) (publish! (subject-append "stable")))'), "n", "value",
        f"WITH {M}, r AS (SELECT seq, subject, {STABLE} AS v FROM m), p AS (SELECT *, lag(v) {W} AS pv, row_number() {W} AS rn FROM r) SELECT seq, subject || '.stable' AS subject, {MICRO.format('v')} FROM p WHERE rn = 1 OR v <> pv"),
    "filter_star": (one('(publish! "o.x" payload-float)', "events.*.7"), "n", "value", q_num("x", "user_id = 7")),
    "filter_tail": (one('(publish! "o.x" payload-float)', "events.purchase.>"), "n", "value", q_num("x", "event_type = 'purchase'")),
    "filter_literal": (one('(publish! "o.x" payload-float)', "events.error.3"), "n", "value", q_num("x", "event_type = 'error' AND user_id = 3")),
    "every": ("(every :ms 86400000 (publish! \"tick.day\" 1))", "N", "value",
        f"WITH {M} SELECT t AS ts_ms, 'tick.day' AS subject, CAST(1000000 AS BIGINT) AS v_micro FROM (SELECT unnest(range((SELECT min(ts_ms) FROM m) + {DAY}, (SELECT t_end FROM t_end) + 1, {DAY})) AS t)"),
    # control flow and predicates
    "if": (to("(if (> payload-float 50) payload-float (- payload-float))"), "n", "value", q_num("CASE WHEN x > 50 THEN x ELSE -x END")),
    "when": (one('(when (> payload-float 50) (publish! "o.x" payload-float))'), "n", "value", q_num("x", "x > 50")),
    "do": (one('(do (publish! "o.x" payload-float) (publish! "o.y" (* 2 payload-float)))'), "n", "value", f"WITH {M} SELECT seq, 'o.x' AS subject, {MICRO.format('x')} FROM m UNION ALL SELECT seq, 'o.y' AS subject, {MICRO.format('2 * x')} FROM m"),
    "and": (to("(and (> payload-float 50) payload-float)"), "n", "value", q_num("CASE WHEN x > 50 THEN x END")),
    "and_guard": (one('(when (and (> payload-float 20) (< payload-float 60)) (publish! "o.x" payload-float))'), "n", "value", q_num("x", "x > 20 AND x < 60")),
    "or": (one('(when (or (> payload-float 90) (< payload-float 10)) (publish! "o.x" payload-float))'), "n", "value", q_num("x", "x > 90 OR x < 10")),
    "not": (one('(when (not (> payload-float 50)) (publish! "o.x" payload-float))'), "n", "value", q_num("x", "NOT x > 50")),
    "thread": (to("(-> payload-float (- 100) (abs))"), "n", "value", q_num("abs(100 - x)")),
    "equals": (one('(when (= subject "events.click.5") (publish! "o.x" payload-float))'), "n", "value", q_num("x", "subject = 'events.click.5'")),
    "compare_chain": (one('(when (< 20 payload-float 60) (publish! "o.x" payload-float))'), "n", "value", q_num("x", "20 < x AND x < 60")),
    "compare_or_equal": (one('(when (and (>= payload-float 20) (<= payload-float 60)) (publish! "o.x" payload-float))'), "n", "value", q_num("x", "x >= 20 AND x <= 60")),
    "contains": (one('(when (contains? payload "7") (publish! "o.x" payload))'), "t", "props", q_text("props", "contains(props, '7')")),
    "contains_vector": (one('(when (contains? ["events.click.1" "events.view.2"] subject) (publish! "o.x" payload-float))'), "n", "value", q_num("x", "subject IN ('events.click.1', 'events.view.2')")),
    "affixes": (one('(when (or (starts-with? subject "events.p") (ends-with? subject "9")) (publish! "o.x" payload-float))'), "n", "value", q_num("x", "starts_with(subject, 'events.p') OR ends_with(subject, '9')")),
    "transition": (one('(transition (> payload-float 50) (publish! "o.x" 1) (publish! "o.x" 0))'), "n", "value", q_num("CASE WHEN x > 50 THEN 1 ELSE 0 END", "rn > 1 AND (x > 50) <> (px > 50)")),
    # numbers
    "arithmetic": (to("(+ 1 (* 2 payload-float) (- payload-float 3) (/ payload-float 4))"), "n", "value", q_num("1 + 2 * x + (x - 3) + x / 4")),
    "unary": (to("(+ (- payload-float) (/ (+ 1 payload-float)))"), "n", "value", q_num("-x + 1 / (1 + x)")),
    "round": (to("(round 1 payload-float)"), "n", "value", q_num(STABLE)),
    "quantize": (to("(quantize 0.5 payload-float)"), "n", "value", q_num("floor(x / 0.5 + 0.5) * 0.5")),
    "clamp": (to("(clamp 20 60 payload-float)"), "n", "value", q_num("least(greatest(x, 20), 60)")),
    "min_max": (to("(+ (min 30 payload-float) (max 10 payload-float))"), "n", "value", q_num("least(30, x) + greatest(10, x)")),
    "abs_sign": (to("(* (sign (- payload-float 50)) (abs (- payload-float 50)))"), "n", "value", q_num("sign(x - 50) * abs(x - 50)")),
    "payload_int": (to("payload-int"), "n", "event_id", q_num("CAST(seq AS DOUBLE)")),
    "payload_bool": (one('(when payload-bool (publish! "o.x" 1))'), "n", "flag", q_num("1", "event_type = 'click'")),
    # texts and subjects
    "str_concat": (to('(str-concat subject ":" payload)'), "t", "props", q_text("subject || ':' || props")),
    "subject_append": (one('(publish! (subject-append "copy.a") payload-float)'), "n", "value", q_num("x", subject="subject || '.copy.a'")),
    "subject_token": (to("(subject-token 1)"), "t", "value", q_text("event_type")),
    "subject_with": (one('(publish! (subject-with "by" (subject-token 2) (subject-token 1)) payload-float)'), "n", "value", q_num("x", subject="'by.' || user_id || '.' || event_type")),
    "matches": (one('(when (matches? "k.: [1-4][0-9]?}$" payload) (publish! "o.x" payload))'), "t", "props", q_text("props", "regexp_matches(props, 'k.: [1-4][0-9]?}$')")),
    "re_capture": (one('(-> (re-capture ": ([0-9]+)" payload) (publish! "o.x"))'), "t", "props", q_text("regexp_extract(props, ': ([0-9]+)', 1)", "regexp_matches(props, ': ([0-9]+)')")),
    "re_replace": (to('(re-replace "[0-9]+" "<n>" payload)'), "t", "props", q_text("regexp_replace(props, '[0-9]+', '<n>', 'g')")),
    "re_replace_empty": (to('(re-replace "7*" "-" payload)'), "t", "props", q_text("regexp_replace(props, '7*', '-', 'g')")),
    "now_date": (to("(now :date)"), "t", "value", q_text("strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d')")),
    "now_hour": (to("(now :hour)"), "t", "value", q_text("strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H')")),
    "now_minute": (to("(now :minute)"), "t", "value", q_text("strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H%M')")),
    # windows
    "moving_avg": (to("(moving-avg 3 payload-float)"), "n", "value", over("avg(x)", TICK3)),
    "moving_sum": (to("(moving-sum 3 payload-float)"), "n", "value", over("sum(x)", TICK3)),
    "moving_max": (to("(moving-max 3 payload-float)"), "n", "value", over("max(x)", TICK3)),
    "moving_min": (to("(moving-min 3 payload-float)"), "n", "value", over("min(x)", TICK3)),
    "moving_avg_time": (to(f"(moving-avg :ms {3 * DAY} payload-float)"), "n", "value", over("avg(x)", TIME)),
    "moving_sum_time": (to(f"(moving-sum :ms {3 * DAY} payload-float)"), "n", "value", over("sum(x)", TIME)),
    "moving_max_time": (to(f"(moving-max :ms {3 * DAY} payload-float)"), "n", "value", over("max(x)", TIME)),
    "variance": (to("(variance 5 payload-float)"), "n", "value", over("var_pop(x)", TICK5)),
    "stddev": (to("(stddev 5 payload-float)"), "n", "value", over("stddev_pop(x)", TICK5)),
    "stddev_time": (to(f"(stddev :ms {3 * DAY} payload-float)"), "n", "value", over("stddev_pop(x)", TIME)),
    "percentile": (to("(percentile 5 0.75 payload-float)"), "n", "value",
        f"WITH {M}, l AS (SELECT seq, list_sort(list(x) OVER (PARTITION BY subject ORDER BY {TICK5})) AS v FROM m) SELECT seq, 'o.x' AS subject, {MICRO.format('v[CAST(floor(0.75 * (len(v) - 1)) AS BIGINT) + 1]')} FROM l"),
    "median": (to("(median 5 payload-float)"), "n", "value",
        f"WITH {M}, l AS (SELECT seq, list_sort(list(x) OVER (PARTITION BY subject ORDER BY {TICK5})) AS v FROM m) SELECT seq, 'o.x' AS subject, {MICRO.format('v[CAST(floor(0.5 * (len(v) - 1)) AS BIGINT) + 1]')} FROM l"),
    "rate": (to(f"(rate :ms {3 * DAY} payload)"), "n", "value", over("count(*)", TIME).replace("count(*) OVER", "1000.0 / 259200000 * count(*) OVER")),
    "throttle": (one('(-> payload-float (throttle 4 2) (publish! "o.x"))'), "n", "value",
        recursive("[1] AS p, TRUE AS ok", "CASE WHEN len(list_append(r.p, 0)) > 4 THEN list_append(r.p, CASE WHEN list_sum(r.p) < 2 THEN 1 ELSE 0 END)[2:] ELSE list_append(r.p, CASE WHEN list_sum(r.p) < 2 THEN 1 ELSE 0 END) END, list_sum(r.p) < 2", "x", "ok")),
    "throttle_time": (one(f'(-> payload-float (throttle :ms {5 * DAY} 2) (publish! "o.x"))'), "n", "value",
        recursive("[ts_ms] AS p, TRUE AS ok", f"CASE WHEN len(list_filter(r.p, lambda t: t >= n.ts_ms - {5 * DAY})) < 2 THEN list_append(list_filter(r.p, lambda t: t >= n.ts_ms - {5 * DAY}), n.ts_ms) ELSE list_filter(r.p, lambda t: t >= n.ts_ms - {5 * DAY}) END, len(list_filter(r.p, lambda t: t >= n.ts_ms - {5 * DAY})) < 2", "x", "ok")),
    "ewma": (to("(ewma 0.3 payload-float)"), "n", "value", recursive("x AS e", "0.3 * n.x + (1 - 0.3) * r.e", "e", "TRUE")),
    "bar_ticks": (one("(bar! 3 payload-float)"), "n", "value",
        f"WITH {M}, n AS (SELECT *, row_number() {W} - 1 AS i FROM m), b AS (SELECT subject, i // 3 AS g, max(seq) AS seq, arg_min(x, seq) AS o, max(x) AS h, min(x) AS l, arg_max(x, seq) AS c FROM n GROUP BY ALL HAVING count(*) = 3)"
        f" SELECT seq, subject || '.bar.open' AS subject, {MICRO.format('o')} FROM b UNION ALL SELECT seq, subject || '.bar.high', {MICRO.format('h')} FROM b UNION ALL SELECT seq, subject || '.bar.low', {MICRO.format('l')} FROM b UNION ALL SELECT seq, subject || '.bar.close', {MICRO.format('c')} FROM b"),
    "bar_time": (one(f"(bar! :ms {7 * DAY} payload-float)"), "N", "value",
        f"WITH {M}, b AS (SELECT subject, (ts_ms // {7 * DAY} + 1) * {7 * DAY} AS ts_ms, arg_min(x, seq) AS o, max(x) AS h, min(x) AS l, arg_max(x, seq) AS c FROM m GROUP BY 1, 2), d AS (SELECT b.* FROM b, t_end WHERE ts_ms <= t_end)"
        f" SELECT ts_ms, subject || '.bar.open' AS subject, {MICRO.format('o')} FROM d UNION ALL SELECT ts_ms, subject || '.bar.high', {MICRO.format('h')} FROM d UNION ALL SELECT ts_ms, subject || '.bar.low', {MICRO.format('l')} FROM d UNION ALL SELECT ts_ms, subject || '.bar.close', {MICRO.format('c')} FROM d"),
    # gates
    "squelch": (one('(-> payload (json-get "k") (quantize 20) (squelch) (publish! "o.x"))'), "n", "props", q_num("floor(k / 20 + 0.5) * 20", "rn = 1 OR floor(k / 20 + 0.5) <> floor(pk / 20 + 0.5)")),
    "changed": (one('(when (changed? (> payload-float 50)) (publish! "o.x" payload-float))'), "n", "value", q_num("x", "rn = 1 OR (x > 50) <> (px > 50)")),
    "delta": (to("(delta payload-float)"), "n", "value", q_num("x - coalesce(px, x)")),
    "delta_guarded": (one('(when (> payload-float 50) (publish! "o.x" (delta payload-float)))'), "n", "value", f"WITH {M} SELECT seq, 'o.x' AS subject, {MICRO.format(f'x - coalesce(lag(x) {W}, x)')} FROM m WHERE x > 50"),
    "rising_edge": (one('(when (rising-edge (> payload-float 50)) (publish! "o.x" payload-float))'), "n", "value", q_num("x", "rn > 1 AND x > 50 AND NOT px > 50")),
    "falling_edge": (one('(when (falling-edge (> payload-float 50)) (publish! "o.x" payload-float))'), "n", "value", q_num("x", "rn > 1 AND NOT x > 50 AND px > 50")),
    "hysteresis": (one('(when (hysteresis 30 70 payload-float) (publish! "o.x" payload-float))'), "n", "value",
        f"WITH {M}, h AS (SELECT *, last_value(CASE WHEN x >= 70 THEN TRUE WHEN x <= 30 THEN FALSE END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up FROM m) SELECT seq, 'o.x' AS subject, {MICRO.format('x')} FROM h WHERE coalesce(up, FALSE)"),
    "deadband": (one('(-> payload-float (deadband 30) (publish! "o.x"))'), "n", "value", recursive("x AS kept, TRUE AS ok", "CASE WHEN abs(n.x - r.kept) >= 30 THEN n.x ELSE r.kept END, abs(n.x - r.kept) >= 30", "x", "ok")),
    "hold_off": (one(f'(-> payload-float (hold-off {2 * DAY}) (publish! "o.x"))'), "n", "value", recursive("ts_ms AS passed, TRUE AS ok", f"CASE WHEN n.ts_ms - r.passed >= {2 * DAY} THEN n.ts_ms ELSE r.passed END, n.ts_ms - r.passed >= {2 * DAY}", "x", "ok")),
    "last": ('(lvc ["events.error.1"]) (on "events.purchase.*" (-> (last "events.error.1") (- payload-float) (publish! "o.x")))', "n", "value",
        f"WITH {M}, b AS (SELECT seq AS bseq, x AS told FROM m WHERE subject = 'events.error.1') SELECT m.seq, 'o.x' AS subject, {MICRO.format('m.x - b.told')} FROM m ASOF JOIN b ON m.seq >= b.bseq WHERE event_type = 'purchase'"),
    # JSON
    "json_get": (one('(-> payload (json-get "k") (publish! "o.x"))'), "n", "props", q_num("k", "k IS NOT NULL")),
    "json_demux": (one('(json-demux! "k" ["k" "twice"] "none" payload)'), "n", "props", f"WITH {M} SELECT seq, subject || '.k' AS subject, {MICRO.format('k')} FROM m UNION ALL SELECT seq, subject || '.twice', {MICRO.format('k')} FROM m"),
    # effects
    "publish_text": (one('(publish! "o.x" payload)'), "t", "props", q_text("props")),
    "publish_places": (to(":dp 1 payload-float"), "t", "value", q_text("printf('%.1f', x)")),
    "publish_shortest": (to("(round 1 payload-float)"), "t", "value", q_text(f"regexp_replace(printf('%.1f', {STABLE}), '\\.0$', '')")),
    "reply": (one("(reply! payload-float)"), "n", "value", f"WITH {M} SELECT seq, 'inbox.' || user_id AS subject, {MICRO.format('x')} FROM m WHERE event_type = 'click'"),
    "print": (to('(print! "seen" payload-float)'), "n", "value", q_num("x")),
    "count": (one("(count!)"), "n", "value", q_num("rn", subject="subject || '.count'")),
    "count_if": (one("(count! (> payload-float 50))"), "n", "value", f"WITH {M} SELECT seq, subject || '.count' AS subject, {MICRO.format(f'row_number() {W}')} FROM m WHERE x > 50"),
    "count_to": (one('(count! :subject "total.x" (> payload-float 50))'), "n", "value", f"WITH {M} SELECT seq, 'total.x' AS subject, {MICRO.format(f'row_number() {W}')} FROM m WHERE x > 50"),
    # timers
    "debounce": (one(f'(debounce! :ms {DAY} (subject-append "calm") payload-float)'), "N", "value",
        f"WITH {M}, n AS (SELECT *, lead(ts_ms) {W} AS nts FROM m) SELECT ts_ms + {DAY} AS ts_ms, subject || '.calm' AS subject, {MICRO.format('x')} FROM n, t_end WHERE (nts IS NULL OR nts - ts_ms >= {DAY}) AND ts_ms + {DAY} <= t_end"),
    "sample": (one(f'(sample! :ms {3 * DAY} (subject-append "grid") payload-float)'), "N", "value",
        f"WITH {M}, g AS (SELECT subject, min(ts_ms) AS t0 FROM m GROUP BY 1), d AS (SELECT subject, unnest(range(t0 + {3 * DAY}, t_end + 1, {3 * DAY})) AS due FROM g, t_end) SELECT due AS ts_ms, d.subject || '.grid' AS subject, {MICRO.format('arg_max(x, seq)')} FROM d JOIN m ON m.subject = d.subject AND m.ts_ms < d.due GROUP BY d.subject, due"),
    **{
        f"aggregate_{metric}": (one(f'(aggregate! :ms {3 * DAY} (subject-append "agg") :{metric} payload-float)'), "N", "value",
            f"WITH {M}, g AS (SELECT *, min(ts_ms) OVER (PARTITION BY subject) AS t0 FROM m), d AS (SELECT subject, t0 + ((ts_ms - t0) // {3 * DAY} + 1) * {3 * DAY} AS due, {sql} AS v FROM g GROUP BY 1, 2) SELECT due AS ts_ms, subject || '.agg' AS subject, {MICRO.format('v')} FROM d, t_end WHERE due <= t_end")
        for metric, sql in {"avg": "avg(x)", "sum": "sum(x)", "min": "min(x)", "max": "max(x)", "count": "count(*)", "rate": "count(*) * 1000.0 / 259200000"}.items()
    },
    "on_silence": (one(f'(on-silence :ms {2 * DAY} (publish! (subject-append "quiet") payload-float))'), "N", "value",
        f"WITH {M}, n AS (SELECT *, lead(ts_ms) {W} AS nts FROM m) SELECT ts_ms + {2 * DAY} AS ts_ms, subject || '.quiet' AS subject, {MICRO.format('x')} FROM n, t_end WHERE (nts IS NULL OR nts - ts_ms >= {2 * DAY}) AND ts_ms + {2 * DAY} <= t_end"),
    "dropout": (one(f'(dropout :ms {2 * DAY} :lost (publish! (subject-append "lost") 1) :found (publish! (subject-append "found") 2))'), "N", "value",
        f"WITH {M}, n AS (SELECT *, lead(ts_ms) {W} AS nts, lag(ts_ms) {W} AS pts FROM m) SELECT ts_ms + {2 * DAY} AS ts_ms, subject || '.lost' AS subject, CAST(1000000 AS BIGINT) AS v_micro FROM n, t_end WHERE (nts IS NULL OR nts - ts_ms >= {2 * DAY}) AND ts_ms + {2 * DAY} <= t_end UNION ALL SELECT ts_ms, subject || '.found', CAST(2000000 AS BIGINT) FROM n WHERE ts_ms - pts >= {2 * DAY}"),
    # re-entry: rules that feed rules
    "funnel": ('(on "events.purchase.*" :reentrant true (publish! "all.purchase" payload)) (on "all.purchase" (publish! "all.avg" :dp 3 (moving-avg 2 payload-float)))', "n", "value",
        f"WITH {M}, p AS (SELECT * FROM m WHERE event_type = 'purchase') SELECT seq, 'all.purchase' AS subject, CAST(NULL AS BIGINT) AS v_micro FROM p UNION ALL SELECT seq, 'all.avg', {MICRO.format('avg(x) OVER (ORDER BY seq ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)')} FROM p"),
    "reentry_loop": ('(on "events.error.1" :reentrant true (publish! "events.error.1" payload))', "t", "props",
        f"WITH {M} SELECT seq, subject, props AS s FROM m, range(9) WHERE subject = 'events.error.1'"),
    "demux_then_delta": ('(on "events.*.*" :reentrant true (json-demux! "k" payload)) (on "events.*.*.k" (publish! "o.x" (delta payload-float)))', "n", "props",
        f"WITH {M} SELECT seq, subject || '.k' AS subject, {MICRO.format('k')} FROM m UNION ALL SELECT seq, 'o.x', {MICRO.format(f'k - coalesce(lag(k) {W}, k)')} FROM m"),
}


def _events(spark: SparkSession, sf_dir: str, payload: str) -> DataFrame:
    if payload in ("value", "props", "event_id"):
        return sources.events(spark, sf_dir, payload)
    base = sources.events(spark, sf_dir, "value")  # flag: whether the event is a click
    return base.withColumn("payload", F.when(F.col("subject").startswith("events.click."), "true").otherwise("off"))


def case(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, kind, payload, _ = CASES[name]
    table = _events(spark, sf_dir, payload)
    if name == "reply":
        user = F.element_at(F.split("subject", r"\."), 3)
        table = table.withColumn("reply_to", F.when(F.col("subject").startswith("events.click."), F.concat(F.lit("inbox."), user)))
    out = engine.run(rules, table)
    key = F.col("path")[0].alias("seq") if kind.islower() else F.col("ts_ms")
    value = micro(F.col("payload_num")).alias("v_micro") if kind in "nN" else F.col("payload").alias("s")
    return out.select(key, "subject", value)


# ---------------------------------------------------------------- tables beside the emissions


def lvc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.last_values('(lvc ["events.purchase.>"])', sources.events(spark, sf_dir, "props")).select("subject", "payload", "seq")


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = spark.createDataFrame([(1, "events.click.>", None), (2, "events.*.5", None), (3, "events.error.2", 2)], "sid int, filter string, most long")
    return engine.delivered(subs, sources.events(spark, sf_dir, "props")).select("sid", "seq", "subject")


def queue_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message reaches one member; which one doesn't matter, so members are left out."""
    subs = spark.createDataFrame([(1, "events.click.>", "q"), (2, "events.click.>", "q")], "sid int, filter string, queue string")
    return engine.delivered(subs, sources.events(spark, sf_dir, "props")).select("seq", "subject")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.statistics('(on "events.*.*" (-> payload-float (round 0) (squelch) (publish! "o.x")))', sources.events(spark, sf_dir))


def stats_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a rule whose window size is computed, which the machine runs."""
    return engine.statistics('(on "events.*.*" (publish! "o.x" (moving-avg (+ 1 2) payload-float)))', sources.events(spark, sf_dir))


def lvc_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.replayed('(lvc ["events.purchase.>"])', sources.events(spark, sf_dir, "props"), "events.*.*", 500)


def stats_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.status_messages(stats(spark, sf_dir))


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.lang.program import load

    program = load('(export :servers "nats://localhost:4222" :export ["o.>"]) (on "events.*.*" (publish! "o.x" payload-float))')
    out = engine.exported(program, engine.run(program, sources.events(spark, sf_dir)))
    return out.select(F.col("path")[0].alias("seq"), "subject", micro(F.col("payload_num")).alias("v_micro"))


def sse_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.envelopes(sources.events(spark, sf_dir, "props"))


EXTRA: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "lvc_table": (lvc_table, f"WITH {M} SELECT subject, arg_max(props, seq) AS payload, max(seq) AS seq FROM m WHERE event_type = 'purchase' GROUP BY subject"),
    "subscriptions": (subscriptions, f"WITH {M} SELECT CAST(1 AS INTEGER) AS sid, seq, subject FROM m WHERE event_type = 'click' UNION ALL SELECT CAST(2 AS INTEGER), seq, subject FROM m WHERE user_id = 5 UNION ALL SELECT * FROM (SELECT CAST(3 AS INTEGER), seq, subject FROM m WHERE subject = 'events.error.2' ORDER BY seq LIMIT 2)"),
    "queue_group": (queue_group, f"WITH {M} SELECT seq, subject FROM m WHERE event_type = 'click'"),
    "statistics": (stats, f"WITH {M}, r AS (SELECT *, floor(x + 0.5) AS v FROM m), p AS (SELECT *, lag(v) {W} AS pv, row_number() {W} AS rn FROM r) SELECT CAST(0 AS INTEGER) AS rule_idx, count(*) AS matched, CAST(sum(CASE WHEN rn = 1 OR v <> pv THEN 1 ELSE 0 END) AS BIGINT) AS emitted, CAST(sum(CASE WHEN rn = 1 OR v <> pv THEN 0 ELSE 1 END) AS BIGINT) AS suppressed, CAST(0 AS BIGINT) AS failures FROM p"),
    "lvc_replay": (lvc_replay, f"WITH {M} SELECT max(seq) AS seq, '$LVC.' || subject AS subject, arg_max(props, seq) AS payload, TRUE AS cached FROM m WHERE event_type = 'purchase' AND seq <= 500 GROUP BY subject UNION ALL SELECT seq, '$LVC.' || subject, props, FALSE FROM m WHERE event_type = 'purchase' AND seq > 500"),
    "statistics_machine": (stats_machine, f"WITH {M}, r AS (SELECT x, row_number() {W} AS rn FROM m) SELECT CAST(0 AS INTEGER) AS rule_idx, count(*) AS matched, count(*) AS emitted, CAST(0 AS BIGINT) AS suppressed, CAST(0 AS BIGINT) AS failures FROM r"),
    "stats_messages": (stats_messages, f"WITH {M}, r AS (SELECT *, floor(x + 0.5) AS v FROM m), p AS (SELECT *, lag(v) {W} AS pv, row_number() {W} AS rn FROM r), s AS (SELECT count(*) AS n, sum(CASE WHEN rn = 1 OR v <> pv THEN 1 ELSE 0 END) AS e FROM p) SELECT '$STATS.rules.0.matched' AS subject, CAST(n AS VARCHAR) AS payload FROM s UNION ALL SELECT '$STATS.rules.0.emitted', CAST(CAST(e AS BIGINT) AS VARCHAR) FROM s UNION ALL SELECT '$STATS.rules.0.suppressed', CAST(CAST(n - e AS BIGINT) AS VARCHAR) FROM s UNION ALL SELECT '$STATS.rules.0.failures', '0'"),
    "export": (export_rows, q_num("x")),
    "sse_envelopes": (sse_envelopes, f"""WITH {M} SELECT '{{"subject":"' || subject || '","payload":"' || replace(props, '"', '\\"') || '"}}' AS value FROM m"""),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{name: partial(case, name) for name in CASES}, **{name: f for name, (f, _) in EXTRA.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{name: c[3] for name, c in CASES.items() if c[3] is not None}, **{name: sql for name, (_, sql) in EXTRA.items()}}
