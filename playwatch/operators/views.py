"""Metrics, status views, alert conditions and configuration differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playwatch.functions.columns import bool_of, display_format, lookup, series_key, severity_rank, short_name
from playwatch.operators.crosspoll import as_of, edge_speed, findings_rate, sustained, trend
from playwatch.operators.gauges import HELP

SERIES = ["vantage", "target", "variant", "name"]


def current_gauges(samples: DataFrame) -> DataFrame:
    """The latest value of each gauge series."""
    own = samples.filter("kind = 'gauge'").groupBy(*SERIES)
    return own.agg(F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("ts"))


def counter_totals(samples: DataFrame) -> DataFrame:
    return samples.filter("kind = 'counter'").groupBy(*SERIES).agg(F.sum("value").alias("value"))


def findings_total(findings: DataFrame) -> DataFrame:
    return findings.groupBy("target", "variant", "check", "severity").agg(F.count(F.lit(1)).alias("n"))


def findings_rollup(findings: DataFrame) -> DataFrame:
    """Counts by vantage, target and check with subtotals; level is the grouping id."""
    return findings.rollup("vantage", "target", "check").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def request_budget(playlists: DataFrame, targets: DataFrame) -> DataFrame:
    """Requests of one poll of each target: the master, and for each playlist itself, its init section and its samples."""
    own = playlists.groupBy("target").agg(F.count(F.lit(1)).alias("p"))
    own = targets.select(F.col("name").alias("target"), "segment_sample").join(own, "target", "left").na.fill({"p": 0})
    return own.select("target", (1 + F.col("p") * (2 + F.col("segment_sample"))).alias("requests"))


def diff_targets(old: DataFrame, new: DataFrame) -> DataFrame:
    """name and change (added, removed, changed) of targets whose settings differ in any field."""
    cols = sorted(set(old.columns) - {"name"})
    pack = lambda d, n: d.select("name", F.struct(*cols).alias(n))
    own = pack(old, "o").join(pack(new, "n"), "name", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return own.select("name", change.alias("change")).filter("change IS NOT NULL")


def removed_targets(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("name").subtract(new.select("name"))


def drop_series(samples: DataFrame, removed: DataFrame) -> DataFrame:
    return samples.join(removed.select(F.col("name").alias("target")), "target", "left_anti")


def with_constant_labels(samples: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Samples with constant labels, which win over their own."""
    if not labels:
        return samples
    const = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return samples.withColumn("labels", F.map_concat(F.map_filter("labels", lambda k, _: ~k.isin(*labels)), const))


def to_exposition(samples: DataFrame) -> DataFrame:
    """line: the text form of the current values, series of one name together under HELP and TYPE lines, in order."""
    help_text = lambda name: F.coalesce(lookup(HELP, name), name)
    own = samples.select("name", "kind", series_key(F.col("name"), F.col("labels")).alias("key"), "value")
    body = own.select("name", F.lit(2).alias("o"), "key", F.concat_ws(" ", "key", F.col("value").cast("string")).alias("line"))
    heads = own.groupBy("name").agg(F.first("kind").alias("kind"))
    help_ = heads.select("name", F.lit(0).alias("o"), F.lit("").alias("key"), F.concat(F.lit("# HELP "), "name", F.lit(" "), help_text(F.col("name"))).alias("line"))
    type_ = heads.select("name", F.lit(1).alias("o"), F.lit("").alias("key"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind").alias("line"))
    return help_.unionByName(type_).unionByName(body).orderBy("name", "o", "key").select("line")


def on_live_targets(samples: DataFrame, liveness: DataFrame) -> DataFrame:
    live = liveness.groupBy("target").agg(F.max("value").alias("v")).filter("v > 0")
    return samples.join(live.select("target"), "target", "left_semi")


def edge_vs_origin(fetches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fetches of the edge vantages with origin, origin_edge and behind_s: the newest edge that the paired origin had shown by then for the
    same target, and how far the fetch's own edge is behind it; null where the origin had shown none.

    pairs: edge_vantage and origin_vantage, any number of rows; a vantage may stand in several. fetches: target, vantage, ts, edge, ...
    """
    edges = fetches.join(pairs.select(F.col("edge_vantage").alias("vantage"), F.col("origin_vantage").alias("origin")).distinct(), "vantage")
    origins = fetches.filter("edge IS NOT NULL").join(pairs.select(F.col("origin_vantage").alias("vantage")).distinct(), "vantage", "left_semi")
    origins = origins.select("target", F.col("vantage").alias("origin"), "ts", F.col("edge").alias("origin_edge"))
    own = as_of(edges, origins, ["target", "origin"], ["origin_edge"])
    return own.withColumn("behind_s", (F.unix_micros("origin_edge") - F.unix_micros("edge")) / 1e6)


def regional_divergence(incidents: DataFrame, vantages: DataFrame) -> DataFrame:
    """target, variant, check with the number of vantages that see it and of those that probe the target and do not, where both exist.

    vantages: target and vantage of whatever was probed, in any number of rows.
    """
    seen = incidents.groupBy("target", "variant", "check").agg(F.count_distinct("vantage").alias("seen"))
    total = vantages.groupBy("target").agg(F.count_distinct("vantage").alias("probing"))
    return seen.join(total, "target").withColumn("silent", F.col("probing") - F.col("seen")).filter("silent > 0").drop("probing")


def with_firing(df: DataFrame, incidents: DataFrame) -> DataFrame:
    """df by target with firing, the number of its open incidents, and worst, their gravest severity."""
    own = incidents.filter("open").groupBy("target").agg(F.count(F.lit(1)).alias("firing"), F.min_by("severity", severity_rank(F.col("severity"))).alias("worst"))
    return df.join(own, "target", "left").na.fill({"firing": 0})


#: Series whose last values a status shows.
TRENDS = ["segment_ttfb_seconds", "manifest_age_seconds", "playlist_window_seconds", "segment_count"]


def status(targets: DataFrame, samples: DataFrame, incidents: DataFrame, prefix: str = "", history: DataFrame | None = None, points: int = 60) -> DataFrame:
    """One row for each target: url and format if known, up and live (null where not observed), streams in order, metrics, firing.

    samples are current gauges; those without a variant are the target's own. A stream is up if its playlist is, or, where none is
    fetched for it, if it has segments. A target is live as the first of its streams that says so. history are all samples: the last
    ``points`` values of TRENDS come from them. Each series belongs to one vantage; a status is of one.
    """
    own = samples.withColumn("name", short_name(F.col("name"), prefix))
    maps = own.groupBy("target", "variant").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("gauges"))
    lines = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<double>>"))
    if history is not None:
        past = history.withColumn("name", short_name(F.col("name"), prefix)).filter(F.col("name").isin(*TRENDS))
        past = trend(past, ["target", "variant", "name"], points).groupBy("target", "variant").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "values")))).alias("past"))
        maps = maps.join(past, ["target", "variant"], "left").withColumn("trends", F.coalesce("past", lines)).drop("past")
    else:
        maps = maps.withColumn("trends", lines)
    by_stream = incidents.filter("open").groupBy("target", "variant").agg(F.count(F.lit(1)).alias("firing"))
    maps = maps.join(by_stream, ["target", "variant"], "left").na.fill({"firing": 0})
    top = maps.filter("variant = ''").select("target", bool_of(F.col("gauges"), "probe_up").alias("up"), F.col("gauges").alias("metrics"), "trends")
    has_segments = F.when(F.try_element_at("gauges", F.lit("segment_count")) > 0, True)
    stream = F.struct(
        "variant", F.coalesce(bool_of(F.col("gauges"), "variant_up"), has_segments).alias("up"), bool_of(F.col("gauges"), "stream_live").alias("live"), "firing",
        F.array_sort(F.map_entries("gauges")).alias("gauges"), F.array_sort(F.map_entries("trends")).alias("trends"),
    )
    streams = maps.filter("variant <> ''").groupBy("target").agg(F.array_sort(F.collect_list(stream)).alias("streams"))
    known = [c for c in ("url", "type") if c in targets.columns]
    out = targets.select(F.col("name").alias("target"), *known).join(top, "target", "left").join(streams, "target", "left")
    if "type" in known:
        out = out.withColumn("format", display_format(F.col("type"))).drop("type")
    out = out.withColumn("live", F.get(F.filter(F.transform("streams", lambda s: s["live"]), lambda x: x.isNotNull()), F.lit(0)))
    count = lambda c: F.greatest(F.size(c), F.lit(0))
    out = out.withColumn("n_streams", count("streams")).withColumn("streams_up", count(F.filter("streams", lambda s: F.coalesce(s["up"], F.lit(False)))))
    return with_firing(out, incidents)


def status_summary(status: DataFrame, incidents: DataFrame) -> DataFrame:
    """targets, up, streams, streams_up, firing (open incidents that were announced), suppressed (the other open ones) and in_trouble."""
    told = F.col("announced") if "announced" in incidents.columns else F.lit(True)
    own = incidents.filter("open").agg(F.count_if(told).alias("firing"), F.count_if(~told).alias("suppressed"))
    sums = status.agg(
        F.count(F.lit(1)).alias("targets"), F.count_if("up").alias("up"), F.coalesce(F.sum("n_streams"), F.lit(0)).alias("streams"), F.coalesce(F.sum("streams_up"), F.lit(0)).alias("streams_up"),
        F.count_if(F.col("firing") > 0).alias("in_trouble"),
    )
    # one row each
    return sums.withColumn("firing", own.select("firing").scalar()).withColumn("suppressed", own.select("suppressed").scalar())


def trouble_first(status: DataFrame) -> DataFrame:
    return status.orderBy((F.col("firing") > 0).desc(), F.coalesce(~F.col("up"), F.lit(False)).desc(), "target")


def recent(notices: DataFrame, n: int = 200) -> DataFrame:
    return notices.orderBy(F.desc("ts"), "vantage", "target", "variant", "check").limit(n)


def tile_health(status: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row for each target: the gravest open severity with its message, at least critical where it is unreachable; the worst time
    to first byte, the first cache age known and the smallest window of its streams."""
    worst = incidents.filter("open").groupBy("target").agg(F.min_by(F.struct("severity", "message"), F.struct(severity_rank(F.col("severity")), "first_seen", "check")).alias("w"))
    own = status.join(worst, "target", "left")
    down = F.coalesce(~F.col("up"), F.lit(False))
    gauge = lambda s, n: F.get(F.transform(F.filter(s["gauges"], lambda g: g["key"] == n), lambda g: g["value"]), F.lit(0))
    of_streams = lambda n: F.filter(F.transform(F.coalesce("streams", F.array().cast(own.schema["streams"].dataType)), lambda s: gauge(s, n)), lambda v: v > 0)
    top = lambda n: F.nullif(F.try_element_at("metrics", F.lit(n)), F.lit(0.0))
    window = F.array_min(F.concat(F.array_compact(F.array(top("playlist_window_seconds"))), of_streams("playlist_window_seconds")))
    return own.select(
        "target", "up", F.when(down, "critical").otherwise(F.coalesce("w.severity", F.lit("ok"))).alias("health"), F.coalesce("w.message", F.when(down, "unreachable"), F.lit("")).alias("message"),
        F.coalesce(F.array_max(of_streams("segment_ttfb_seconds")), F.lit(0.0)).alias("ttfb_s"),
        F.coalesce(top("manifest_age_seconds"), F.get(of_streams("manifest_age_seconds"), F.lit(0)), F.lit(0.0)).alias("age_s"), F.coalesce(window, F.lit(0.0)).alias("window_s"),
    )


def tile_status(targets: DataFrame, health: DataFrame, frames: DataFrame, now: Column, prober_seen: Column | None = None, silent_after: float = 60) -> DataFrame:
    """A tile for each target (name): its health with frame_age_s (-1 without a frame) and stale.

    Health is the last that the prober reported; once it has said nothing for ``silent_after`` seconds since ``prober_seen``, tiles keep
    it but are stale. A target that the report lacks has an empty tile.
    """
    age = (F.unix_micros(now) - F.unix_micros("frame_ts")) / 1e6
    own = targets.select(F.col("name").alias("target")).join(health, "target", "left").withColumn("health", F.coalesce("health", F.lit("ok"))).na.fill("", ["message"]).na.fill(0.0, ["ttfb_s", "age_s", "window_s"])
    own = own.join(frames.groupBy("target").agg(F.max("ts").alias("frame_ts")), "target", "left").withColumn("frame_age_s", F.coalesce(age, F.lit(-1.0)))
    silent = F.lit(False) if prober_seen is None else F.coalesce((F.unix_micros(now) - F.unix_micros(prober_seen)) / 1e6 > silent_after, F.lit(True))
    return own.withColumn("stale", silent).drop("frame_ts")


def prober_down(samples: DataFrame, now: Column, seconds: float = 120) -> DataFrame:
    own = samples.groupBy("vantage").agg(F.max("ts").alias("last_ts"))
    return own.withColumn("silent_s", (F.unix_micros(now) - F.unix_micros("last_ts")) / 1e6).filter(F.col("silent_s") > seconds)


def active_incident_alerts(incidents: DataFrame) -> DataFrame:
    return incidents.filter("open AND severity IN ('critical', 'warning')").groupBy("target", "severity").agg(F.count(F.lit(1)).alias("n"))


def target_unreachable(samples: DataFrame) -> DataFrame:
    return sustained(samples.filter("name = 'probe_up'"), ["vantage", "target"], F.col("value") == 0, 120, "value")


def manifest_age_climbing(samples: DataFrame, liveness: DataFrame) -> DataFrame:
    return sustained(on_live_targets(samples.filter("name = 'manifest_age_seconds'"), liveness), ["vantage", "target", "variant"], F.col("value") > 60, 300, "value")


def segment_latency_high(samples: DataFrame) -> DataFrame:
    return sustained(samples.filter("name = 'segment_ttfb_seconds'"), ["vantage", "target", "variant"], F.col("value") > 2, 300, "value")


# Panels of a dashboard: numbers of current values, and lines over time


def _number(samples: DataFrame, name: str, total: Column) -> DataFrame:
    return current_gauges(samples.filter(F.col("name") == name)).agg(F.coalesce(total, F.lit(0.0)).alias("value"))


def panel_targets_reachable(samples: DataFrame) -> DataFrame:
    return _number(samples, "probe_up", F.sum("value"))


def panel_incidents_firing(samples: DataFrame) -> DataFrame:
    """incident_active has a series for each check and severity, told apart by labels."""
    own = samples.filter("name = 'incident_active'").withColumn("key", series_key(F.col("name"), F.col("labels")))
    return own.groupBy("key").agg(F.max_by("value", F.struct("ts", -F.col("value"))).alias("value")).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def panel_streams_probed(samples: DataFrame) -> DataFrame:
    return _number(samples, "segment_count", F.count("value").cast("double"))


def panel_windows_open(samples: DataFrame) -> DataFrame:
    own = samples.filter("name = 'maintenance_active'").withColumn("key", series_key(F.col("name"), F.col("labels")))
    return own.groupBy("key").agg(F.max_by("value", "ts").alias("value")).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def _line(samples: DataFrame, name: str) -> DataFrame:
    return samples.filter(F.col("name") == name).select("ts", "vantage", "target", "variant", "value")


def panel_edge_speed(samples: DataFrame, seconds: int = 120) -> DataFrame:
    """Segments a minute by which the live edge moves."""
    return edge_speed(_line(samples, "media_sequence"), ["vantage", "target", "variant"], seconds)


def panel_ttfb(samples: DataFrame) -> DataFrame:
    return _line(samples, "segment_ttfb_seconds")


def panel_cache_age(samples: DataFrame) -> DataFrame:
    return _line(samples, "manifest_age_seconds")


def panel_window(samples: DataFrame) -> DataFrame:
    return _line(samples, "playlist_window_seconds")


def panel_findings_rate(findings: DataFrame) -> DataFrame:
    """Findings a minute over five minutes, by check and severity."""
    return findings_rate(findings, 5)
