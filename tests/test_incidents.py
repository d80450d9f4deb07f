"""Incidents, maintenance and cross-poll rules on small fixtures."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from playwatch.operators import crosspoll, incidents, maintenance

T0 = datetime(2024, 1, 1)
FINDING = "ts timestamp, vantage string, target string, variant string, check string, severity string, message string"


def finding(s, target="a", vantage="v", severity="critical", check="stalled"):
    return (T0 + timedelta(seconds=s), vantage, target, "", check, severity, f"m{s}")


def notices(spark, rows, windows=None, **cfg):
    found = spark.createDataFrame(rows, FINDING)
    windows = spark.createDataFrame(windows or [], maintenance.SCHEMA)
    out = incidents.notifications(found, windows, **cfg).orderBy("ts", "status").collect()
    return [(r.status, r["count"], int((r.ts - T0).total_seconds())) for r in out]


def test_same_fault_for_five_minutes_is_one_notice_and_one_resolution(spark):
    assert notices(spark, [finding(4 * i) for i in range(75)]) == [("firing", 1, 0), ("resolved", 75, 296 + 90)]


def test_blip_with_persistence_says_nothing(spark):
    assert notices(spark, [finding(0)], persist=30) == []


def test_reminders_are_one_for_each_interval(spark):
    got = notices(spark, [finding(10 * i) for i in range(13)], repeat=60)
    assert [g for g in got if g[0] == "firing"] == [("firing", 1, 0), ("firing", 7, 60), ("firing", 13, 120)]


def test_fault_that_outlives_a_window_is_announced_when_it_closes(spark):
    window = (0, "w", ["a"], None, "UTC", T0, T0 + timedelta(seconds=50), None, None, None)
    assert notices(spark, [finding(10 * i) for i in range(8)], [window])[0] == ("firing", 6, 50)
    assert notices(spark, [finding(0), finding(10)], [window]) == []


def test_two_vantages_are_two_incidents_and_sweeps_extend(spark):
    rows = [finding(0), finding(0, vantage="w"), finding(95)]
    found = spark.createDataFrame(rows, FINDING)
    assert incidents.incidents(found, resolve_after=90).count() == 3
    # a sweep every minute looks at second 120 next, so the finding at 95 still belongs
    assert incidents.incidents(found, resolve_after=90, sweep=60).count() == 2
    assert incidents.incidents(found.limit(0)).count() == 0


def test_night_windows_follow_local_clocks_and_opening_days(spark):
    night = (0, "night", None, None, "Europe/Berlin", None, None, 23 * 60, 5 * 60, [5])  # opens on Fridays
    stamps = [datetime(2024, 7, 5, 20, 59), datetime(2024, 7, 5, 21, 0), datetime(2024, 7, 6, 2, 59), datetime(2024, 7, 6, 3, 0), datetime(2024, 7, 7, 1, 0)]
    found = spark.createDataFrame([(t, "v", "a", "", "c", "info", str(i)) for i, t in enumerate(stamps)], FINDING)
    windows = spark.createDataFrame([night], maintenance.SCHEMA)
    got = {r.message: r.window for r in maintenance.suppressed_by(found, windows).collect()}
    assert got == {"0": None, "1": "night", "2": "night", "3": None, "4": None}
    # windows of a target come before later ones for all, whichever array they stand in, and repeated findings stay repeated
    own = [(*night[:2], ["a", "b"], *night[3:]), (1, "all", None, ["c"], "UTC", datetime(2024, 7, 1), datetime(2024, 8, 1), None, None, None)]
    windows = spark.createDataFrame(own, maintenance.SCHEMA)
    got = {r.message: r.window for r in maintenance.suppressed_by(found, windows).collect()}
    assert got == {"0": "all", "1": "night", "2": "night", "3": "all", "4": "all"}
    assert maintenance.suppressed_by(found.unionAll(found), windows).count() == 10


def test_snapshot_comes_back_open_unless_too_old(spark):
    found = incidents.incidents(spark.createDataFrame([finding(0)], FINDING))
    now = F.lit("2024-01-01 00:00:10").cast("timestamp")
    saved = incidents.save_snapshot(found, now)
    assert incidents.restore_snapshot(saved, now).first()["open"]
    assert incidents.restore_snapshot(saved, F.lit("2024-01-01 02:00:00").cast("timestamp")).count() == 0
    assert not incidents.incidents_changed(found, found)


def test_rollback_resets_the_baseline_and_first_polls_are_silent(spark):
    polls = spark.createDataFrame([(T0 + timedelta(seconds=i), i, "a", v) for i, v in enumerate([5, 6, 2, 3, 3])], "ts timestamp, fetch_id long, target string, seq long")
    assert [r.fetch_id for r in crosspoll.rollbacks(polls, ["target"], "seq").collect()] == [2]
    assert [r.fetch_id for r in crosspoll.stalled(polls, ["target"], "seq", F.lit(0.5)).collect()] == [4]


def fold(rows, resolve_after, sweep, persist, repeat):
    """Incidents and notices by going through the findings one by one."""
    micro, out, count = 1_000_000, [], 0
    over = lambda last: last + resolve_after * micro if not sweep else -(-(last + resolve_after * micro) // (sweep * micro)) * sweep * micro
    by_key, incs = {}, []
    for ts, vantage, target, variant, check, severity, message in rows:
        by_key.setdefault((vantage, target, variant, check), []).append((round((ts - T0).total_seconds() * micro), message))
    for key, own in by_key.items():
        inc = None
        for at, _ in sorted(own):
            if inc and (over(inc["last"]) < at if sweep else over(inc["last"]) <= at):
                incs.append((key, inc))
                inc = None
            inc = inc or {"first": at, "n": 0, "told": None, "notices": []}
            inc |= {"last": at, "n": inc["n"] + 1}
            due = inc["told"] is None or (repeat and at - inc["told"] >= repeat * micro)
            if at - inc["first"] >= persist * micro and due:
                inc["told"] = at
                inc["notices"].append((at, inc["n"]))
        incs.append((key, inc))
    for key, inc in incs:
        out += [(*key, "firing", n, at) for at, n in inc["notices"]]
        if inc["notices"]:
            out.append((*key, "resolved", inc["n"], over(inc["last"])))
    return sorted(out), sorted((*key, inc["n"], inc["first"], inc["last"]) for key, inc in incs)


def test_incidents_over_many_days_equal_a_walk_through_them(spark):
    import random

    rng = random.Random(8)
    for resolve_after, sweep, persist, repeat in ((90_000, 0, 0, 0), (40_000, 3600, 600, 0), (90_000, 0, 60, 100_000), (5000, 600, 0, 9000)):
        rows = []
        for target in ("a", "b", None):
            at = 0
            for i in range(60):
                at += rng.choice([0, 1, 50, 4000, 30_000, 100_000])
                rows.append((T0 + timedelta(seconds=at), "v", target, "", "c", "info", f"m{i:03}"))
        found = spark.createDataFrame(rows, FINDING)
        notices_, incs = fold([r for r in rows if r[2]], resolve_after, sweep, persist, repeat)
        us = lambda t: round((t - T0).total_seconds() * 1_000_000)
        got = [r for r in incidents.incidents(found, resolve_after, sweep).collect() if r.target]
        assert sorted(("v", r.target, "", "c", r["count"], us(r.first_seen), us(r.last_seen)) for r in got) == incs
        windows = spark.createDataFrame([], maintenance.SCHEMA)
        got = [r for r in incidents.notifications(found, windows, resolve_after, sweep, persist, repeat).collect() if r.target]
        assert sorted(("v", r.target, "", "c", r.status, r["count"], us(r.ts)) for r in got) == notices_


def test_incident_metrics(spark):
    window = (0, "w", ["a"], None, "UTC", T0, T0 + timedelta(seconds=50), None, None, None)
    rows = [finding(10 * i) for i in range(8)] + [finding(0, target="b")]
    found, windows = spark.createDataFrame(rows, FINDING), spark.createDataFrame([window], maintenance.SCHEMA)
    told = incidents.notifications(found, windows)
    quiet = incidents.suppressed_total(found, windows)
    assert [(r.target, r.window, r.n) for r in quiet.collect()] == [("a", "w", 5)]
    totals = {r.target: (r.opened, r.resolved, r.suppressed) for r in incidents.incident_totals(told, quiet).collect()}
    assert totals == {"a": (1, 1, 5), "b": (1, 1, 0)}
    now = F.lit("2024-01-01 00:00:45").cast("timestamp")
    assert [(r.window, r.active) for r in incidents.maintenance_gauges(windows, now).collect()] == [("w", 1)]
    own = incidents.announced(incidents.incidents(found), told.filter("target = 'b'"))
    gauges = {r.target: (r.open, r.critical, r.announced) for r in incidents.incident_gauges(own, now).collect()}
    assert gauges == {"a": (1, 1, 0), "b": (1, 1, 1)}
    assert {r.active for r in incidents.incident_active(told).collect()} == {0}
    assert {r.target: r.active for r in incidents.incident_active(told.filter("status = 'firing'")).collect()} == {"a": 1, "b": 1}


def test_snapshots_are_written_only_when_they_differ(spark, tmp_path):
    now = F.lit("2024-01-01 00:00:10").cast("timestamp")
    later = F.lit("2024-01-01 00:00:11").cast("timestamp")
    found = incidents.incidents(spark.createDataFrame([finding(0), finding(1, target="b")], FINDING))
    path = str(tmp_path / "snapshots")
    assert incidents.write_snapshot(found, now, path) and not incidents.write_snapshot(found, later, path)
    assert incidents.write_snapshot(found.filter("target = 'b'"), later, path)
    assert [r.target for r in incidents.newest_snapshot(spark, path).collect()] == ["b"]
