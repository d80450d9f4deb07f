"""Streams give what batches give."""

import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from playwatch.operators import decode, incidents, maintenance
from playwatch.plans import fetchlog
from playwatch.streaming import streams

T0 = datetime(2024, 1, 1)
FINDING = "ts timestamp, vantage string, target string, variant string, check string, severity string, message string"


def run(spark, tmp_path, rows, schema, make, name, files=1):
    """The rows of a stream over ``rows``, which come as ``files`` files, each a micro-batch."""
    folder = str(tmp_path / "in")
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = (
        make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    return spark.table(name)


def said(df):
    return sorted((r.target, r.status, r["count"], int((r.ts - T0).total_seconds())) for r in df.collect())


def findings(seconds, target="a"):
    return [(T0 + timedelta(seconds=s), "v", target, "", "c", "critical", f"m{s:05}") for s in seconds]


# a stream resolves what its watermark has passed, so a last finding of another target moves it on
PUSH = findings([100_000], "z")


@pytest.mark.parametrize("name, options", [("plain", {}), ("swept", {"sweep": 60, "persist": 15}), ("reminded", {"repeat": 20})])
def test_incidents_of_a_stream_are_those_of_a_batch(spark, tmp_path, name, options):
    rows = findings([10, 20, 30, 45, 300, 1000, 1010, 1030, 1100])
    windows = spark.createDataFrame([(0, "w", ["a"], None, "UTC", T0, T0 + timedelta(seconds=20), None, None, None)], maintenance.SCHEMA)
    got = run(spark, tmp_path, rows + PUSH, FINDING, lambda s: streams.stream_incidents(s, maintenance=windows, **options), name)
    want = incidents.notifications(spark.createDataFrame(rows + PUSH, FINDING), windows, **options)
    # the last incident of all is still open in a stream
    assert said(got) == [x for x in said(want) if x[:2] != ("z", "resolved")]


def test_a_snapshot_goes_on_in_a_stream(spark, tmp_path):
    old = incidents.incidents(spark.createDataFrame(findings([0, 5, 40]), FINDING))
    now = F.lit("2024-01-01 00:00:50").cast("timestamp")
    back = incidents.restore_snapshot(incidents.save_snapshot(old, now), now)
    got = run(spark, tmp_path, findings([60, 70]) + PUSH, FINDING, lambda s: streams.stream_incidents(s, restored=back), "restored")
    # announced before, so only its end is told
    assert [x for x in said(got) if x[0] == "a"] == [("a", "resolved", 5, 160)]


def facts(rows):
    return [(f"f{i}", T0 + timedelta(seconds=s), "v", "t", "direct", "u", "hls", seq, T0 + timedelta(seconds=e) if e is not None else None, key, 18.0 if seq is not None else None, 30.0 if key else None) for i, (s, seq, e, key) in enumerate(rows)]


def test_incidents_do_not_depend_on_the_order_of_delivery(spark, tmp_path):
    rng, rows = random.Random(5), []
    for target in "abc":
        at = 0.0
        for _ in range(60):
            at += rng.choice([1, 5, 20, 45, 80, 95, 200])
            rows += findings([at] * rng.choice([1, 1, 2]), target)
    # a late row bridges two incidents that were 130 seconds apart, and one stands before the first
    rows += findings([20_000, 20_130, 20_065, 19_990], "d")
    windows = spark.createDataFrame([(0, "w", ["b"], None, "UTC", T0 + timedelta(seconds=100), T0 + timedelta(seconds=900), None, None, None)], maintenance.SCHEMA)
    options = {"persist": 10, "repeat": 60, "sweep": 10}
    want = said(incidents.notifications(spark.createDataFrame(rows + PUSH, FINDING), windows, **options))
    delivered = sorted(rows, key=lambda r: (r[0] - T0).total_seconds() + rng.uniform(0, 290))
    assert delivered != sorted(rows)
    got = run(spark, tmp_path, delivered + findings([100_000], "z"), FINDING, lambda s: streams.stream_incidents(s, maintenance=windows, delay="300 seconds", **options), "shuffled", files=6)
    # what the watermark has not passed, the last row, is not judged yet
    assert said(got) == [x for x in want if x[0] != "z"] and any(x[:3] == ("d", "resolved", 4) for x in want)


def test_a_removed_target_is_resolved_once_and_settings_change_at_an_instant(spark, tmp_path):
    rows = [(*f, None, None, None, None) for f in findings([0, 10, 20, 500, 510], "a") + findings([0, 30, 60, 200], "b") + findings([5, 6], "quiet") + PUSH]
    late = [(T0 + timedelta(seconds=25), "v", "a", "other", "c2", "warning", "m", None, None, None, None)]
    control = [(T0 + timedelta(seconds=s), None, t, None, None, None, None, a, r, None, None) for s, t, a, r in [(40, "a", "remove", None), (50, "b", "set", 300.0), (300, "quiet", "remove", None)]]
    schema = FINDING + ", action string, resolve_after double, persist double, repeat double"

    def make(source):
        own = source.filter("action IS NULL").select(*(c.split(" ")[0] for c in FINDING.split(", ")))
        return streams.stream_incidents(own, delay="600 seconds", controls=source.filter("action IS NOT NULL").select(*(c.split(" ")[0] for c in streams.CONTROL.split(", "))))

    mixed = control + late + rows
    random.Random(1).shuffle(mixed)
    got = run(spark, tmp_path, sorted(mixed, key=lambda r: r[0] > T0 + timedelta(seconds=600)), schema, make, "controlled", files=3)
    texts = sorted((r.target, r.variant, r.status, r["count"], int((r.ts - T0).total_seconds()), r.message == "target removed") for r in got.collect())
    assert texts == [
        ("a", "", "firing", 1, 0, False), ("a", "", "firing", 1, 500, False), ("a", "", "resolved", 2, 600, False), ("a", "", "resolved", 3, 40, True),
        ("a", "other", "firing", 1, 25, False), ("a", "other", "resolved", 1, 40, True),
        ("b", "", "firing", 1, 0, False), ("b", "", "resolved", 4, 500, False),
        ("quiet", "", "firing", 1, 5, False), ("quiet", "", "resolved", 2, 96, False),
    ]
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    made = streams.target_controls(names, names.filter("name = 'b'"), F.lit(T0)).collect()
    assert [(r.target, r.action) for r in made] == [("a", "remove")]


def test_polls_are_judged_in_order_whatever_the_order_of_delivery(spark, tmp_path):
    rng, rows = random.Random(3), []
    for stream in range(4):
        at, seq, edge = 0, 10, 0
        for _ in range(50):
            at += rng.choice([2, 4, 10, 30])
            seq += rng.choice([0, 0, 1, 1, 2, -3])
            edge += rng.choice([0, 0, 4, 6])
            rows.append((f"f{rng.random()}", T0 + timedelta(seconds=at), "v", f"t{stream % 2}", "direct", f"u{stream}", "hls" if stream else "dash", seq, T0 + timedelta(seconds=edge) if rng.random() < 0.8 else None, None, 18.0, None))
            if rng.random() < 0.5:
                rows.append((f"f{rng.random()}", T0 + timedelta(seconds=at + 1), "v", f"t{stream % 2}", "direct", f"u{stream}", "hls" if stream else "dash", None, None, rng.choice(["k1", "k1", "k1", None]), None, 30.0))
    want = Counter(map(tuple, streams.cross_poll_findings(spark.createDataFrame(rows, streams.FACT)).collect()))
    delivered = sorted(rows, key=lambda r: (r[1] - T0).total_seconds() + rng.uniform(0, 590))
    end = [("end", T0 + timedelta(days=1), "v", "z", "direct", "z", "hls", 1, None, None, 18.0, None)]
    got = run(spark, tmp_path, delivered + end, streams.FACT, streams.stream_cross_poll, "reordered", files=5)
    assert Counter(map(tuple, got.collect())) == want and len({k[4] for k in want}) == 4


def test_a_poll_that_comes_late_is_no_rollback(spark, tmp_path):
    rows = [(f"f{s}", T0 + timedelta(seconds=s), "v", "t", "direct", "u", "hls", q, None, None, 18.0, None) for s, q in [(0, 1), (20, 3), (10, 2), (5_000, 4)]]
    got = run(spark, tmp_path, rows, streams.FACT, streams.stream_cross_poll, "late_poll", files=4)
    assert got.count() == 0


def test_polls_of_a_stream_are_held_against_the_ones_before(spark, tmp_path):
    rows = facts([(0, 5, 0, None), (10, 6, 10, None), (20, 7, 10, None), (30, 3, 30, None), (40, 3, None, None), (60, 3, 60, None), (61, None, None, "k1"), (95, None, None, "k1"), (96, None, None, "k2"), (5000, None, None, "k2")])
    got = run(spark, tmp_path, rows, streams.FACT, streams.stream_cross_poll, "crossed", files=3)
    assert sorted((int((r.ts - T0).total_seconds()), r.check) for r in got.collect()) == [
        (20, "pdt_not_advancing"), (30, "playlist_rollback"), (60, "playlist_stalled"), (95, "key_rotation_stalled"),
    ]


def test_late_rows_go_to_a_table_of_their_own(spark, tmp_path):
    late, kept = [], []
    split = streams.without_late(
        60, lambda df, n: late.extend(r.message for r in df.collect()), lambda df, n: kept.extend(r.message for r in df.collect()), str(tmp_path / "marks")
    )
    batches = [findings([0, 100]), findings([50, 10, 200]), findings([150, 141, 139])]
    for n, rows in enumerate(batches):
        split(spark.createDataFrame(rows, FINDING), n)
    assert sorted(late) == ["m00010", "m00139"] and len(kept) == 6
    # run again, the last batch meets the mark that it met first, and no earlier mark is kept than the one it needs
    split(spark.createDataFrame(batches[2], FINDING), 2)
    assert sorted(late) == ["m00010", "m00139", "m00139"] and sorted(os.listdir(tmp_path / "marks")) == ["batch-1", "batch-2"]
    split(spark.createDataFrame([], FINDING), 3)
    split(spark.createDataFrame(findings([139, 140]), FINDING), 4)
    assert sorted(late) == ["m00010", "m00139", "m00139", "m00139"]


@pytest.mark.parametrize("minutes, every", [(5, 5), (5, 1), (60, 15)])
def test_rates_slide_over_panes(spark, tmp_path, minutes, every):
    rng = random.Random(7)
    rows = findings([rng.uniform(0, 7200) for _ in range(300)]) + findings([90_000], "z")
    df = spark.createDataFrame(rows, FINDING)
    starts = Counter()
    for r in rows[:300]:
        at = (r[0] - T0).total_seconds()
        first = int(at // (60 * every)) * every - minutes + every
        for start in range(first, first + minutes, every):
            starts[start] += 1
    shape = lambda d: Counter({int((r.window.start - T0).total_seconds() / 60): r.n for r in d.collect() if r.window.start < T0 + timedelta(hours=12)})
    batch = streams.stream_rates(df, minutes, every)
    assert shape(batch) == starts and all(abs(r.rate - r.n / minutes) < 1e-12 for r in batch.collect())
    got = run(spark, tmp_path, rows, FINDING, lambda s: streams.stream_rates(streams.with_lateness(s, "2 hours"), minutes, every), f"rates_{minutes}_{every}", files=3)
    assert shape(got) == starts


def test_polls_split_over_files_give_what_whole_ones_give(spark, tmp_path):
    log, targets = fetchlog.hls_log(spark, "/root/testdata/sf0.001")
    few = lambda c: F.substring(c, 2, 9).cast("int") <= 90
    log, targets = log.filter(few("target")), targets.filter(few(F.col("name")))
    rows = log.withColumn("part", F.pmod(F.xxhash64("fetch_id"), F.lit(3))).toArrow()
    rows = spark.createDataFrame(rows)
    assert rows.groupBy("poll_id").agg(F.count_distinct("part").alias("n")).filter("n > 1").count() > 20
    end = rows.limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 DAYS")).withColumn("poll_id", F.lit("end")).withColumn("part", F.lit(9).cast("long"))
    folder = str(tmp_path / "in")
    for part in (2, 0, 1):
        rows.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(folder)
    end.drop("part").coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    # rules that need more than one fetch of a poll, and some that need its manifest alone
    names = ["manifest_fetch", "media_fetch", "segment_availability", "init_segment_availability", "blocking_reload_missing", "key_fetch", "key_size_invalid", "master_empty", "targetduration_missing"]
    said, facts, read_again = [], [], []

    def settings():
        read_again.append(1)
        return targets

    keep = lambda df: [tuple(r) for r in df.select("ts", "vantage", "target", "variant", "check", "severity", "message").collect()]
    query = streams.stream_polls(
        source, settings, lambda df, n: said.extend(keep(df)), lambda df, n: facts.extend(map(tuple, df.collect())), str(tmp_path / "cp"), delay="6 hours", names=names,
    ).trigger(availableNow=True).start()
    query.awaitTermination(600)
    tables = decode.decode_fetches(rows.drop("part"), targets)
    assert Counter(said) == Counter(keep(decode.findings_of(tables, names))) and len({x[4] for x in said}) >= 8
    assert Counter(facts) == Counter(map(tuple, streams.poll_facts(tables).collect())) and len(facts) > 50
    assert read_again
    assert not [f for f in os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) if f.startswith("scratch-")]


def test_sessions_of_findings_over_files_equal_gaps_in_them(spark, tmp_path):
    rows = [(T0 + timedelta(seconds=s), "v", t, "", "c", "info", "m") for t, at in (("a", (0, 30, 200, 289, 900)), ("b", (10, 100, 190))) for s in at]
    df = spark.createDataFrame(rows, FINDING)
    shape = lambda d: sorted((r.target, int((r.first_seen - T0).total_seconds()), int((r.last_seen - T0).total_seconds()), r.count_) for r in d.withColumnRenamed("count", "count_").collect() if r.target != "end")
    want = [("a", 0, 30, 2), ("a", 200, 289, 2), ("a", 900, 900, 1), ("b", 10, 10, 1), ("b", 100, 100, 1), ("b", 190, 190, 1)]
    assert shape(streams.stream_sessions(df)) == want
    end = [(T0 + timedelta(days=2), "v", "end", "", "c", "info", "m")]
    got = run(spark, tmp_path, rows + end, FINDING, lambda s: streams.stream_sessions(streams.with_lateness(s, "2 hours")), "sessions", files=3)
    assert shape(got) == want
