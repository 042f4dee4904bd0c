import json

from tidegate import sources
from tidegate.streaming import live


def test_live_rules_with_timers(spark, tmp_path):
    rows = [(0, 1000, "a", "10"), (1, 1050, "a", "20"), (2, 1300, "a", "20"), (3, 1310, "b", "7"), (4, 9000, "z", "0")]
    src = tmp_path / "in"
    src.mkdir()
    (src / "part.json").write_text("\n".join(json.dumps({"seq": s, "ts_ms": t, "wall_ms": t, "subject": x, "payload": p, "replaying": False}) for s, t, x, p in rows))
    stream = spark.readStream.schema(sources.MESSAGE).json(str(src))
    out = live.emissions(stream, '(on ">" (do (publish! "d" (delta payload-float)) (debounce! :ms 100 (subject-append "calm") payload)))')
    q = out.writeStream.format("memory").queryName("live_rules").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.ts_ms, r.subject, r.payload) for r in spark.sql("select * from live_rules").collect())
    assert (1050, "d", "10") in got and (1300, "d", "0") in got
    assert {(1150, "a.calm", "20"), (1400, "a.calm", "20"), (1410, "b.calm", "7")} <= set(got)
