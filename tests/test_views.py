"""Configuration, sinks, views and samples on small fixtures."""

import json
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from playwatch.operators import gauges, views
from playwatch.sources import logs, stored
from playwatch.streaming import streams

T0 = datetime(2024, 1, 1)
SAMPLE = "ts timestamp, vantage string, target string, variant string, name string, labels map<string,string>, value double, kind string"


def now():
    return F.lit("2024-01-01 00:10:00").cast("timestamp")


def sample(s, name, value, target="a", variant="", kind="gauge", vantage="v"):
    return (T0 + timedelta(seconds=s), vantage, target, variant, name, {"target": target, "variant": variant} if variant else {"target": target}, float(value), kind)


def test_configuration_is_read_with_defaults_and_judged(spark, tmp_path):
    path = str(tmp_path / "c.json")
    config = {
        "targets": [{"name": "a", "url": "u", "type": "HLS"}, {"name": "a", "type": "x"}, {"url": "u", "inspect": True}],
        "maintenance": [{"name": "n", "daily_start": "23:00", "daily_end": "05:00", "days": ["Mon", "friday"], "tz": "UTC"}, {"name": "b", "start": "2024-01-02T00:00:00Z"}, {"start": "2024-01-01T00:00:00Z", "end": "2024-01-02T00:00:00Z"}, {"name": "d", "daily_start": "25:00", "daily_end": "05:00"}, {"name": "w", "daily_start": "01:00", "daily_end": "02:00", "days": ["noday"]}],
    }
    (tmp_path / "c.json").write_text(json.dumps(config))
    own = logs.read_targets(spark, path)
    assert own.filter("name = 'a'").first()["interval_s"] == 10.0
    assert {(r.name, r.problem) for r in logs.validate_targets(own).collect()} == {("a", "duplicate name"), ("a", "unknown type"), ("", "missing name"), ("", "inspection without segment samples")}
    assert [r.problem for r in logs.validate_targets(own.limit(0)).collect()] == ["no targets"]
    windows = logs.read_maintenance(spark, path)
    assert (windows.first()["daily_start_min"], windows.first()["days"]) == (1380, [1, 5])
    assert {(r.ord, r.problem) for r in logs.validate_maintenance(windows).collect()} == {(1, "both ends are needed"), (2, "missing name"), (3, "both clocks are needed"), (4, "unknown weekday")}


def test_sinks(spark, tmp_path):
    row = (T0, "v", "a", "x", "c", "critical", "m", "firing")
    kinds = "ts timestamp, vantage string, target string, variant string, check string, severity string, message string, status string"
    notices = spark.createDataFrame([row, (*row[:3], "", *row[4:7], "resolved"), (*row[:5], "info", "m", "firing")], kinds)
    assert [r.text for r in logs.render_alert_text(notices).collect()] == ["[critical] a (x) — c: m", "[resolved] a — c: m"]
    logs.write_findings_json(notices.coalesce(1), str(tmp_path / "f"))
    lines = [json.loads(x) for f in (tmp_path / "f").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 3 and sum("variant" in x for x in lines) == 2
    seen = []
    logs.fan_out({"seen": lambda df, n: seen.append((df.count(), n)), "files": logs.idempotent(str(tmp_path / "i"))})(notices, 4)
    logs.idempotent(str(tmp_path / "i"))(notices, 4)
    assert seen == [(3, 4)] and spark.read.parquet(str(tmp_path / "i")).count() == 3
    fetches = spark.createDataFrame([(1, logs.MOST_BODY, None), (2, 5, None)], "fetch_id int, body_len long, error string")
    assert [r.error for r in logs.capped(fetches).orderBy("fetch_id").collect()] == ["body too large", None]


def test_decoder_logs(spark):
    text = "Duration: 00:01:02.50\nmean_volume: -20.5 dB\nmax_volume: -3.0 dB\nblack_duration:1.5\nblack_duration:0.5\nfreeze_duration: 2"
    got = logs.decode_content_log(spark.createDataFrame([(1, text), (2, "")], "id int, log string")).orderBy("id").collect()
    assert tuple(got[0]) == (1, -20.5, -3.0, 1.5, 2.0, 62.5) and tuple(got[1]) == (2, None, None, 0.0, 0.0, None)


def test_exposition_and_labels(spark):
    own = spark.createDataFrame([sample(0, "probe_up", 1), sample(0, "segment_count", 5, variant="x")], SAMPLE)
    lines = [r.line for r in views.to_exposition(own).collect()]
    assert lines[:3] == [f"# HELP probe_up {gauges.HELP['probe_up']}", "# TYPE probe_up gauge", 'probe_up{target="a"} 1.0']
    assert lines[-1] == 'segment_count{target="a",variant="x"} 5.0' and len(gauges.HELP) == 41
    marked = views.with_constant_labels(own, {"target": "z", "site": "s"})
    assert all(r.labels["target"] == "z" and r.labels["site"] == "s" for r in marked.collect())
    assert views.drop_series(own, spark.createDataFrame([("a",)], "name string")).count() == 0
    assert views.counter_totals(spark.createDataFrame([sample(0, "n", 1, kind="counter"), sample(1, "n", 2, kind="counter")], SAMPLE)).first()["value"] == 3


def test_status_and_tiles(spark):
    rows = [sample(0, "probe_up", 1), sample(5, "probe_up", 0), sample(0, "probe_up", 1, "b"), sample(0, "segment_count", 3, "b", "x"), sample(0, "stream_live", 1, "b", "y"), sample(0, "variant_up", 0, "b", "y"),
            sample(0, "segment_ttfb_seconds", 0.2, "b", "x"), sample(9, "segment_ttfb_seconds", 0.4, "b", "x"), sample(0, "playlist_window_seconds", 30, "b", "x"), sample(0, "playlist_window_seconds", 20, "b", "y"), sample(0, "manifest_age_seconds", 7, "b", "y")]
    past = spark.createDataFrame(rows, SAMPLE)
    targets = spark.createDataFrame([("a", "u", "HLS"), ("b", "u", ""), ("c", "u", None)], "name string, url string, type string")
    incident = "vantage string, target string, variant string, check string, severity string, message string, first_seen timestamp, open boolean, announced boolean"
    incidents = spark.createDataFrame([("v", "b", "x", "c", "warning", "w", T0, True, True), ("v", "b", "", "d", "info", "i", T0, True, False), ("v", "b", "", "e", "critical", "x", T0, False, True)], incident)
    own = views.status(targets, views.current_gauges(past).drop("ts"), incidents, history=past)
    got = {r.target: r for r in own.collect()}
    assert [(got[t].up, got[t].live, got[t].format, got[t].firing, got[t].worst) for t in "abc"] == [(False, None, "hls", 0, None), (True, True, "auto", 2, "warning"), (None, None, "auto", 0, None)]
    x, y = got["b"].streams
    assert (x.up, x.live, x.firing, y.up, y.live) == (True, None, 1, False, True) and {t["key"]: t["value"] for t in x.trends} == {"segment_ttfb_seconds": [0.2, 0.4]}
    assert tuple(views.status_summary(own, incidents).select("targets", "up", "streams", "streams_up", "firing", "suppressed", "in_trouble").first()) == (3, 1, 2, 1, 1, 1, 1)
    assert [r.target for r in views.trouble_first(own).collect()] == ["b", "a", "c"]
    health = views.tile_health(own, incidents)
    tiles = {r.target: tuple(r)[2:] for r in health.collect()}
    assert tiles == {"a": ("critical", "unreachable", 0.0, 0.0, 0.0), "b": ("warning", "w", 0.4, 7.0, 20.0), "c": ("ok", "", 0.0, 0.0, 0.0)}
    frames = spark.createDataFrame([("b", T0 + timedelta(seconds=570))], "target string, ts timestamp")
    late = views.tile_status(targets, health.filter("target <> 'c'"), frames, now(), F.lit(T0), 60)
    assert {r.target: (r.health, r.frame_age_s, r.stale) for r in late.collect()} == {"a": ("critical", -1.0, True), "b": ("warning", 30.0, True), "c": ("ok", -1.0, True)}
    assert not any(r.stale for r in views.tile_status(targets, health, frames, now(), now()).collect())


def test_panels_and_alerts(spark):
    rows = [sample(60 * i, "media_sequence", 10 * i, variant="x") for i in range(3)] + [sample(0, "probe_up", 1), sample(1, "probe_up", 1, "b"), sample(0, "segment_count", 0, variant="x")]
    rows += [sample(s, "probe_up", 0, "c") for s in (0, 60, 125)] + [sample(60 * i, "segment_ttfb_seconds", 3, "d", "x") for i in range(7)] + [sample(60 * i, "manifest_age_seconds", 61, "d", "x") for i in range(7)]
    rows += [(*sample(0, "incident_active", 1)[:5], {"check": "c", "severity": "critical"}, 1.0, "gauge"), (*sample(9, "incident_active", 0)[:5], {"check": "c", "severity": "critical"}, 0.0, "gauge"), (*sample(0, "incident_active", 1)[:5], {"check": "d", "severity": "info"}, 1.0, "gauge")]
    own = spark.createDataFrame(rows, SAMPLE)
    number = lambda df: df.first()["value"]
    assert (number(views.panel_targets_reachable(own)), number(views.panel_incidents_firing(own)), number(views.panel_streams_probed(own)), number(views.panel_windows_open(own))) == (2.0, 1.0, 1.0, 0.0)
    assert [round(r.speed, 6) for r in views.panel_edge_speed(own).orderBy("ts").collect() if r.speed is not None] == [10.0, 10.0]
    assert (views.panel_ttfb(own).count(), views.panel_cache_age(own).count(), views.panel_window(own).count()) == (7, 7, 0)
    assert [r.target for r in views.target_unreachable(own).collect()] == ["c"]
    assert views.segment_latency_high(own).count() == 2
    live = spark.createDataFrame([("d", 1.0)], "target string, value double")
    assert views.manifest_age_climbing(own, live).count() == 2 and views.manifest_age_climbing(own, live.filter("value < 0")).count() == 0
    assert [r.vantage for r in views.prober_down(own, now()).collect()] == ["v"] and views.prober_down(own, F.lit(T0)).count() == 0


def test_requests_targets_and_divergence(spark):
    playlists = spark.createDataFrame([("a",), ("a",), ("a",)], "target string")
    targets = spark.createDataFrame([("a", 2, "u"), ("b", 0, "u")], "name string, segment_sample int, url string")
    assert {(r.target, r.requests) for r in views.request_budget(playlists, targets).collect()} == {("a", 13), ("b", 1)}
    incident = "vantage string, target string, variant string, check string, severity string, message string, first_seen timestamp, count long, opened_at timestamp, resolved_at timestamp"
    open_ = spark.createDataFrame([("v", t, "", "c", "critical", "m", T0, 1, T0, datetime(2024, 1, 2)) for t in "ab"], incident)
    probed = spark.createDataFrame([("a", "v"), ("a", "w"), ("b", "v"), ("b", "v")], "target string, vantage string")
    # a target probed from one place cannot diverge
    assert [(r.target, r.seen, r.silent) for r in views.regional_divergence(open_, probed).collect()] == [("a", 1, 1)]
    changes, notices, left = streams.apply_targets(targets, targets.filter("name = 'a'"), open_, spark.createDataFrame([sample(0, "probe_up", 1), sample(0, "probe_up", 1, "b")], SAMPLE), now())
    assert [tuple(r) for r in changes.collect()] == [("b", "removed")] and [r.target for r in notices.collect()] == ["b"] and [r.target for r in left.collect()] == ["a"]
    fetches = spark.createDataFrame([("t", "origin", T0, T0), ("t", "edge", T0 + timedelta(seconds=5), T0 - timedelta(seconds=9))], "target string, vantage string, ts timestamp, edge timestamp")
    pairs = spark.createDataFrame([("edge", "origin"), ("edge", "nowhere")], "edge_vantage string, origin_vantage string")
    assert {(r.origin, r.behind_s) for r in views.edge_vs_origin(fetches, pairs).collect()} == {("origin", 9.0), ("nowhere", None)}


def test_a_batch_run_again_passes_over_the_sinks_that_are_done(spark, tmp_path):
    first, second, failing = [], [], [True]

    def breaks(df, n):
        if failing.pop() if failing else False:
            raise RuntimeError("down")
        second.append(n)

    df, marks = spark.range(3), str(tmp_path / "marks")
    send = logs.fan_out({"first": lambda df, n: first.append(n), "second": breaks}, marks)
    with pytest.raises(RuntimeError):
        send(df, 0)
    again = logs.fan_out({"first": lambda df, n: first.append(n), "second": breaks}, marks)
    for n in (0, 0, 1, 2, 3, 3):
        again(df, n)
    assert first == [0, 1, 2, 3] and second == [0, 1, 2, 3]
    assert sorted(f.name for f in (tmp_path / "marks" / "first").iterdir() if not f.name.startswith(".")) == ["done-2", "done-3"]


def test_scans_of_a_key_cross_its_stretches(spark):
    from playwatch.operators import crosspoll

    days = [0, 0.1, 0.2, 1.5, 4, 4.1, 9]
    polls = [(f"f{i}", T0 + timedelta(days=d), k, v) for k in ("a", None) for i, (d, v) in enumerate(zip(days, [1, 1, None, None, 2, 2, 2], strict=True))]
    df = spark.createDataFrame(polls, "fetch_id string, ts timestamp, k string, value int")
    got = {(r.k, r.fetch_id): (r.prev_value, (r.changed_at - T0).total_seconds() / 86400) for r in crosspoll.change_points(df, ["k"], "value").collect()}
    want = {0: (None, 0), 1: (1, 0), 2: (1, 0.2), 3: (None, 0.2), 4: (None, 4), 5: (2, 4), 6: (2, 4)}
    assert got == {(k, f"f{i}"): v for k in ("a", None) for i, v in want.items()}
    held = crosspoll.sustained(df, ["k"], F.col("value") == 2, 86_400)
    assert Counter((r.k, r.fetch_id, (r.since - T0).days) for r in held.collect()) == Counter([("a", "f6", 4), (None, "f6", 4)])
    plan = crosspoll.change_points(df, ["k"], "value")._jdf.queryExecution().optimizedPlan().toString()
    assert all("stretch" in line for line in plan.splitlines() if "Window" in line)


def test_a_session_elsewhere_must_name_the_shared_folder(tmp_path):
    class Elsewhere:
        conf = type("conf", (), {"get": staticmethod(lambda name, default=None: default)})
        sparkContext = type("context", (), {"master": "spark://there:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        stored.shared_folder(Elsewhere())
