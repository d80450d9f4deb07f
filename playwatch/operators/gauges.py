"""Metric series derived from decoded tables: what each poll shows of its target, as samples.

samples: ts, vantage, target, variant, name, labels, value, kind. Gauges are the value at their instant, counters an increase.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playwatch.functions.columns import blank_to_null, key_flags
from playwatch.operators import dash, hls
from playwatch.operators.maintenance import window_active

HELP = {
    "probe_up": "1 if the manifest can be fetched", "variant_up": "1 if the media playlist can be fetched", "manifest_fetch_seconds": "Time to fetch the manifest",
    "manifest_age_seconds": "Age that a cache gave the manifest", "manifest_cache_hit": "1 if a cache served the manifest", "media_fetch_seconds": "Time to fetch a media playlist",
    "media_sequence": "Number of the newest segments", "playlist_window_seconds": "Length of the window that can be played", "segment_count": "Segments in the window",
    "segment_available": "1 if sampled segments can be fetched", "segment_ttfb_seconds": "Time to the first byte of a segment", "variant_count": "Variants of a master",
    "rendition_count": "Renditions of a master", "period_count": "Periods of an MPD", "representation_count": "Representations of an MPD", "low_latency": "1 if parts are published",
    "part_target_seconds": "Declared length of parts", "timeline_breaks": "Breaks of the timeline in the window", "findings_total": "Findings", "key_count": "Distinct keys or protection systems",
    "key_available": "1 if a key can be fetched", "init_segment_available": "1 if the init segment can be fetched", "chunked_delivery": "1 if a segment in production is sent as it is made",
    "stream_live": "1 if the stream is live", "media_readable": "1 if media could be read", "media_streams": "Streams found in media", "inspect_seconds": "Time to read media",
    "audio_peak_dbfs": "Peak level", "audio_mean_dbfs": "Mean level", "black_seconds": "Longest black run", "freeze_seconds": "Longest frozen run", "ts_aligned": "1 if packets align",
    "ts_packets": "Packets of a segment", "ts_continuity_errors": "Breaks of continuity counters", "ts_transport_errors": "Packets marked corrupt", "key_fetch_seconds": "Time to fetch a key",
    "incident_active": "1 while an incident fires", "incidents_opened_total": "Incidents announced", "incidents_resolved_total": "Incidents resolved",
    "maintenance_active": "1 while a window is open", "notifications_suppressed_total": "Findings that a window kept quiet",
}


def series(df: DataFrame, values: dict[str, Column | str], kind: str = "gauge", labels: dict[str, str] | None = None) -> DataFrame:
    """A sample for each row and name whose value is not null. labels: further label -> column."""
    each = F.array(*(F.struct(F.lit(n).alias("name"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("value")) for n, c in values.items()))
    pairs = {"target": "target", "variant": "variant", "vantage": "vantage", **(labels or {})}
    marks = F.create_map(*(x for n, c in pairs.items() for x in (F.lit(n), F.col(c).cast("string"))))
    own = df.withColumn("labels", F.map_filter(marks, lambda _, v: blank_to_null(v).isNotNull()))
    own = own.select("ts", "vantage", "target", "variant", "labels", F.explode(each).alias("s")).filter("s.value IS NOT NULL")
    return own.select("ts", "vantage", "target", "variant", "s.name", "labels", "s.value", F.lit(kind).alias("kind"))


def _one(holds: str | Column) -> Column:
    return (F.expr(holds) if isinstance(holds, str) else holds).cast("int")


CAME = "coalesce(error, '') = '' AND coalesce(status, 0) = 200"
THERE = "coalesce(error, '') = '' AND coalesce(status, 0) < 400"


def fetch_gauges(fetches: DataFrame) -> DataFrame:
    """Of every fetch that its poll judges: whether it came, how long it took, what caches said."""
    of = lambda kind, values: series(fetches.filter(F.col("kind") == kind), values)
    cache = {"manifest_age_seconds": F.when(F.expr(CAME), F.col("age_s")), "manifest_cache_hit": F.when(F.expr(CAME), F.when(F.col("hit").isin("HIT", "STALE"), 1).when(F.col("hit") == "MISS", 0))}
    return reduce(DataFrame.unionByName, [
        of("manifest", {"probe_up": _one(CAME), "manifest_fetch_seconds": "dur_s", **cache}),
        of("media", {"variant_up": _one(CAME), "media_fetch_seconds": "dur_s", **cache}),
        of("segment", {"segment_available": _one(THERE), "segment_ttfb_seconds": F.when(F.expr(THERE), F.col("ttfb_s"))}),
        of("init", {"init_segment_available": _one(THERE)}),
        of("key", {"key_available": _one(CAME), "key_fetch_seconds": "dur_s"}),
    ])


def hls_gauges(tables: dict[str, DataFrame]) -> DataFrame:
    masters = tables["masters"].withColumn("n", F.size(F.filter("ls", lambda x: x.startswith("#EXT-X-MEDIA:"))))
    media = tables["media"]
    direct = {"variant_up": F.lit(1)}
    keys = tables["keys"].filter(key_flags(F.col("method"), F.col("uri"), F.col("keyformat"))["encrypted"])
    count = hls.distinct_keys(keys).groupBy("fetch_id").agg(F.count(F.lit(1)).alias("n_keys"))
    header = {
        "stream_live": _one("NOT endlist"), "media_sequence": "media_sequence", "playlist_window_seconds": "window_s", "segment_count": "n_segments", "low_latency": _one("low_latency"),
        "part_target_seconds": F.when(F.col("low_latency"), F.col("part_target")), "key_count": F.coalesce("n_keys", F.lit(0)),
    }
    return reduce(DataFrame.unionByName, [
        series(masters, {"variant_count": "n_declared", "rendition_count": "n"}), series(media.join(count, "fetch_id", "left"), header), series(media.filter("variant = 'direct'"), direct),
    ])


def dash_gauges(tables: dict[str, DataFrame]) -> DataFrame:
    documents = tables["pages"].filter("format = 'dash' AND m IS NOT NULL").withColumn("n_periods", F.greatest(F.size("m.Period"), F.lit(0)))
    by_label = lambda df: df.withColumn("variant", F.col("label"))
    first = F.struct("n", "start_ns")
    window = tables["dash_segments"].groupBy(*dash.REP_KEY).agg(F.count(F.lit(1)).alias("n_segments"), F.max_by("number", "n").alias("number"), (F.max_by("end_ns", "n") - F.min_by("start_ns", first)).alias("window_ns"))
    breaks = dash.breaks_in_window(tables["breaks"], tables["dash_segments"]).groupBy(*dash.REP_KEY).agg(F.count(F.lit(1)).alias("n_breaks"))
    reps = tables["selected"].join(window, dash.REP_KEY, "left").join(breaks, dash.REP_KEY, "left")
    some = F.col("n_segments") > 0
    systems = F.size(F.array_distinct(F.filter(F.transform("protections", dash.protection_system), lambda s: s != "")))
    values = {
        "stream_live": _one("dynamic"), "segment_count": F.coalesce("n_segments", F.lit(0)), "media_sequence": "number", "playlist_window_seconds": F.col("window_ns") / 1e9,
        "timeline_breaks": F.when(some, F.coalesce("n_breaks", F.lit(0))), "key_count": F.when(some, F.greatest(systems, F.lit(0))),
    }
    asked = by_label(tables["producing"]).join(tables["probes"].select("poll_id", F.col("url").alias("uri"), "content_length"), ["poll_id", "uri"])
    return reduce(DataFrame.unionByName, [
        series(documents, {"period_count": "n_periods", "representation_count": "n_declared"}), series(by_label(reps), values),
        series(asked, {"chunked_delivery": _one("coalesce(content_length, -1) < 0")}),
    ])


def media_gauges(tables: dict[str, DataFrame]) -> DataFrame | None:
    out = []
    if "ts" in tables:
        aligned = lambda c: F.when(F.col("aligned"), F.col(c))
        out.append(series(tables["ts"], {"ts_aligned": _one("aligned"), "ts_packets": aligned("packets"), "ts_continuity_errors": aligned("continuity_errors"), "ts_transport_errors": aligned("transport_errors")}))
    if "media_probes" in tables:
        probes = tables["media_probes"]
        read = F.coalesce("error", F.lit("")) == ""
        took = {"inspect_seconds": "dur_s"} if "dur_s" in probes.columns else {}
        out.append(series(probes, {"media_readable": _one(read), "media_streams": F.when(read, F.greatest(F.size("streams"), F.lit(0))), **took}))
    if "levels" in tables:
        heard, seen = lambda c: F.when(F.col("has_audio"), F.col(c)), lambda c: F.when(F.col("has_video"), F.col(c))
        out.append(series(tables["levels"], {"audio_peak_dbfs": heard("peak_db"), "audio_mean_dbfs": heard("mean_db"), "black_seconds": seen("black_s"), "freeze_seconds": seen("freeze_s")}))
    return reduce(DataFrame.unionByName, out) if out else None


def samples(tables: dict[str, DataFrame]) -> DataFrame:
    """Every gauge that the tables of decode_fetches give."""
    out = [fetch_gauges(tables["fetches"])]
    if "masters" in tables:
        out.append(hls_gauges(tables))
    if "selected" in tables:
        out.append(dash_gauges(tables))
    media = media_gauges(tables)
    return reduce(DataFrame.unionByName, out if media is None else [*out, media])


def incident_samples(findings: DataFrame, notices: DataFrame, suppressed: DataFrame, maintenance: DataFrame, now: Column) -> DataFrame:
    """The series about findings and incidents: a sample for each finding and notice, and for windows and withheld notices as of ``now``.

    suppressed: see suppressed_total.
    """
    marks = {"check": "check", "severity": "severity"}
    firing = F.col("status") == "firing"
    each = lambda holds: F.when(holds, 1)
    at = lambda df: df.withColumns({"ts": now, "vantage": F.lit(""), "variant": F.lit("")})
    windows = at(maintenance.withColumn("target", F.lit("")).withColumn("window", F.col("name")).withColumn("active", window_active(now).cast("int")))
    return reduce(DataFrame.unionByName, [
        series(findings, {"findings_total": F.lit(1)}, "counter", marks), series(notices, {"incident_active": _one(firing)}, "gauge", marks),
        series(notices, {"incidents_opened_total": each(firing), "incidents_resolved_total": each(~firing)}, "counter", marks), series(windows, {"maintenance_active": "active"}, "gauge", {"window": "window"}),
        series(at(suppressed), {"notifications_suppressed_total": "n"}, "counter", {"check": "check", "window": "window"}),
    ])
