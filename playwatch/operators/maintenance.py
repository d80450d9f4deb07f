"""Maintenance windows: one-off or daily in a local zone, matched to findings by scope; the first match in order wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playwatch.functions.columns import local_minute, local_weekday, scope_contains

SCHEMA = (
    "ord int, name string, targets array<string>, checks array<string>, tz string, start timestamp, `end` timestamp, "
    "daily_start_min int, daily_end_min int, days array<int>"
)


def window_active(ts: Column, window: Column | None = None) -> Column:
    """Whether a window, a struct or by default the row's own columns, covers an instant: from start until before end, by date or by
    local clock. A daily window that crosses midnight belongs to the weekday on which it opens."""
    own = (lambda c: F.col(f"`{c}`")) if window is None else (lambda c: window[c])
    one_off = (ts >= own("start")) & (ts < own("end"))
    tz = F.coalesce(own("tz"), F.lit("UTC"))
    minute, day = local_minute(ts, tz), local_weekday(ts, tz)
    on = lambda d: (F.coalesce(F.size(own("days")), F.lit(0)) < 1) | F.array_contains(own("days"), d)
    opens, closes = own("daily_start_min"), own("daily_end_min")
    same_day = (opens < closes) & (minute >= opens) & (minute < closes) & on(day)
    over_night = (opens > closes) & (((minute >= opens) & on(day)) | ((minute < closes) & on((day + 6) % 7)))
    return F.coalesce(F.when(own("start").isNotNull(), one_off).otherwise(same_day | over_night), F.lit(False))


FIELDS = ["ord", "name", "targets", "checks", "tz", "start", "end", "daily_start_min", "daily_end_min", "days"]


def suppressed_by(findings: DataFrame, maintenance: DataFrame) -> DataFrame:
    """``findings`` with window: the name of the first window, in their order, that covers each; null for none.

    Windows are configuration, and each finding tests those that concern its target: windows that name targets meet it by an equi-join
    on the target, as one array for each; windows without targets come as one array, a scalar subquery. Nothing runs before an action.
    """
    packed = F.struct(*(F.col(f"`{c}`") for c in FIELDS)).alias("w")
    general = maintenance.filter("coalesce(size(targets), 0) < 1").select(packed).agg(F.array_sort(F.collect_list("w")).alias("ws"))
    named = maintenance.filter("size(targets) > 0").select(F.explode(F.array_distinct("targets")).alias("target"), packed)
    named = named.groupBy("target").agg(F.array_sort(F.collect_list("w")).alias("__named"))
    covers = lambda w: scope_contains(w["checks"], F.col("check")) & window_active(F.col("ts").cast("timestamp"), w)
    first = lambda ws: F.get(F.filter(ws, covers), F.lit(0))
    out = findings.join(named, "target", "left").withColumn("__general", general.scalar())
    out = out.withColumn("__a", first(F.col("__named"))).withColumn("__b", first(F.col("__general")))
    by_order = F.when(F.col("__a").isNull() | (F.col("__b.ord") < F.col("__a.ord")), F.col("__b.name")).otherwise(F.col("__a.name"))
    return out.select(*(F.col(f"`{c}`") for c in findings.columns), by_order.alias("window"))
