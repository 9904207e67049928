"""Deliveries: a clock that ticks through all times, literal histories, and the stream against the batch."""

import datetime
import random

from proofmill.streaming import deliveries as D


def ticking(events, until):
    """The same rules by looking at every moment in turn."""
    out, failed, due, expires, going = [], 0, None, None, False
    times = sorted({e[0] for e in events})
    now = times[0] if times else 0
    left = list(events)
    while now <= max(until, times[-1] if times else 0):
        later = bool(left) and now <= left[-1][0]
        if going and due == now and (later or now <= until):
            out.append((now, "due", failed + 1))
            due, expires = None, now + D.KEPT
        if going and due is None and expires == now and (later or now <= until):
            out.append((now, "expired", failed + 1))
            going = False
        while left and left[0][0] == now:
            what = left.pop(0)[1]
            if what == "change":
                going, failed, due = True, 0, now + D.QUIET
            elif going and due is None and what == "sent":
                out.append((now, "settled", failed + 1))
                going = False
            elif going and due is None and what == "failed":
                failed += 1
                if failed >= D.ATTEMPTS:
                    out.append((now, "given up", failed))
                    going = False
                else:
                    due = now + min(D.LONGEST, D.WAIT * 2 ** (failed - 1))
        now += 1
    return out


def test_timers_equal_a_ticking_clock(monkeypatch):
    for name, value in (("QUIET", 3), ("WAIT", 4), ("LONGEST", 9), ("KEPT", 25), ("ATTEMPTS", 3)):
        monkeypatch.setattr(D, name, value)
    rng = random.Random(8)
    for _ in range(300):
        events = sorted((rng.randint(0, 120), rng.choice(["change", "failed", "failed", "sent", "noise"])) for _ in range(rng.randint(1, 14)))
        events.sort(key=lambda e: e[0])
        until = rng.randint(0, 160)
        copy, out = None, []
        for at, what in events:
            copy, rows = D.step(copy, at, what)
            out += rows
        out += D.fire(copy, until)[1]
        assert out == ticking(events, until), events


def rows():
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    out, seq = [], 0
    for minute in range(240):
        for _ in range(rng.randint(0, 3)):
            seq += 1
            out.append((f"p{rng.randint(0, 8)}", start + datetime.timedelta(minutes=minute * 11, seconds=rng.randint(0, 59)), seq, rng.choice(["change", "change", "failed", "failed", "sent"])))
    return sorted(out, key=lambda r: (r[1], r[2]))


def test_stream_gives_the_batch_rows_and_lets_state_go(spark, tmp_path):
    data = rows()
    schema = "paper string, ts timestamp, seq long, what string"
    for i in range(6):
        part = data[i * len(data) // 6 : (i + 1) * len(data) // 6]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.createDataFrame(data, schema)
    want = sorted(tuple(r) for r in D.log(whole).collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = D.follow(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want and {"due", "settled", "given up", "expired"} & {r[2] for r in got} >= {"due", "settled"}
    moving = {r[0] for r in data}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert kept and kept[-1] < len(moving)


def test_no_events(spark):
    assert D.log(spark.createDataFrame([], "paper string, ts timestamp, seq long, what string")).count() == 0
