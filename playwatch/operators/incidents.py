"""Findings folded to incidents, and what is said about them: opening, reminders, resolution.

An incident is a run of findings of one (vantage, target, variant, check); its message is not part of its identity. It ends after
``resolve_after`` seconds without a finding, at the next sweep (every ``sweep`` seconds of the epoch; 0 for at once), so that a
finding before that sweep still belongs to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playwatch.operators.crosspoll import as_of
from playwatch.operators.maintenance import suppressed_by, window_active
from playwatch.sources.stored import stored

KEY = ["vantage", "target", "variant", "check"]
MICRO = 1_000_000


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def ends_at(last: Column, resolve_after: float, sweep: float) -> Column:
    """The instant (microseconds) at which an incident last seen then is over."""
    quiet = last + int(resolve_after * MICRO)
    if not sweep:
        return quiet
    step = int(sweep * MICRO)
    return (F.ceil(quiet / step) * step).cast("long")


#: Findings of a key are numbered within stretches of this many microseconds, so that a key of any length is many tasks' work.
STRETCH = 86_400 * MICRO


def with_islands(findings: DataFrame, resolve_after: float, sweep: float) -> DataFrame:
    """Findings with at (microseconds), began (when their incident began), nth (their place in it) and island (a number within the key).

    Windows run within a key's stretches of a day. What a stretch needs from those before it, the last instant, the last start and
    how many rows there were, comes from a table of a row for each stretch, over which alone a window spans a whole key.
    """
    rows = findings.withColumn("at", micros(F.col("ts"))).withColumn("stretch", F.floor(F.col("at") / STRETCH))
    own = Window.partitionBy(*KEY, "stretch").orderBy("at", "message")
    rows = rows.withColumn("before", F.lag("at").over(own)).withColumn("place", F.row_number().over(own))
    starts = lambda before, at: before.isNull() | _over_by(before, at, resolve_after, sweep)
    # within a stretch all but the first row know whether they start an incident
    inner = F.when(F.col("place") > 1, starts(F.col("before"), F.col("at")))
    rows = rows.withColumn("inner", F.coalesce(inner, F.lit(False)))
    ends = rows.groupBy(*KEY, "stretch").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("rows"),
        F.max(F.when(F.col("inner"), F.struct("at", "place"))).alias("last_start"),
    )
    key = Window.partitionBy(*KEY).orderBy("stretch")
    ends = ends.withColumn("opens", starts(F.lag("last_at").over(key), F.col("first_at")))
    ends = ends.withColumn("rows_before", F.coalesce(F.sum("rows").over(key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the last start of a stretch, counted over the key; its first row's where only that starts
    latest = F.coalesce(
        F.when(F.col("last_start").isNotNull(), F.struct(F.col("last_start.at").alias("at"), (F.col("rows_before") + F.col("last_start.place")).alias("place"))),
        F.when(F.col("opens"), F.struct(F.col("first_at").alias("at"), (F.col("rows_before") + 1).alias("place"))),
    )
    ends = ends.withColumn("carried", F.last(latest, ignorenulls=True).over(key.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.select(*(F.col(c).alias(f"its_{c}") for c in (*KEY, "stretch")), "opens", "rows_before", "carried")
    same = F.lit(True)
    for c in (*KEY, "stretch"):
        same &= F.col(c).eqNullSafe(F.col(f"its_{c}"))
    rows = rows.join(ends, same).withColumn("place", F.col("rows_before") + F.col("place"))
    begins = F.col("inner") | (F.col("opens") & F.col("before").isNull())
    start = F.last(F.when(begins, F.struct("at", "place")), ignorenulls=True).over(own)
    rows = rows.withColumn("start", F.coalesce(start, "carried"))
    return rows.select(
        *(F.col(f"`{c}`") for c in findings.columns), "at", F.col("start.at").alias("began"), F.col("start.place").alias("island"), (F.col("place") - F.col("start.place") + 1).alias("nth")
    )


def _over_by(before: Column, at: Column, resolve_after: float, sweep: float) -> Column:
    """Whether an incident last seen at ``before`` is over at ``at``."""
    end = ends_at(before, resolve_after, sweep)
    return end < at if sweep else end <= at


def incidents(findings: DataFrame, resolve_after: float = 90, sweep: float = 0, persist: float = 0) -> DataFrame:
    """One row for each incident: key, latest severity and message, first_seen, last_seen, count, opened_at and resolved_at.

    opened_at is the first finding ``persist`` seconds after the first, null where none is; rows of null keys form incidents too.
    """
    rows = with_islands(findings, resolve_after, sweep)
    late = F.when(F.col("at") - F.col("began") >= int(persist * MICRO), F.col("at"))
    latest = F.max_by(F.struct("severity", "message"), F.struct("at", "message"))
    out = rows.groupBy(*KEY, "island").agg(
        latest.alias("latest"), F.min("at").alias("a"), F.max("at").alias("b"), F.count(F.lit(1)).alias("count"), F.min(late).alias("o")
    )
    stamp = F.timestamp_micros
    return out.select(
        *KEY, "latest.severity", "latest.message", stamp("a").alias("first_seen"), stamp("b").alias("last_seen"), "count",
        stamp("o").alias("opened_at"), stamp(ends_at(F.col("b"), resolve_after, sweep)).alias("resolved_at"),
    )


def _joined(left: DataFrame, right: DataFrame, on: list[str], kind: str = "inner") -> DataFrame:
    """A join on columns of which any may be null; the right side's other columns come along."""
    right = right.withColumnsRenamed({c: f"its_{c}" for c in on})
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in on))
    return left.join(right, same, kind).drop(*(f"its_{c}" for c in on))


def _reminded(due: DataFrame, wait: int) -> DataFrame:
    """Of the findings that may be told, those that are: each incident's first, and then the next one ``wait`` after the last told.

    Each depends on the one before, but where each would lead does not: the next instant at least ``wait`` later is looked up for all
    instants at once. Those pointers are doubled, and the instants that the first one leads to grow by as many jumps each time, so an
    incident of n notices takes log2(n) rounds of joins on (incident, instant), and none passes through one task. Incidents too short for
    a round's jumps have no pointers left in it.
    """
    own = [*KEY, "island"]
    due = stored(due, "due")
    instants = due.select(*own, "at").distinct()
    # in reversed time the last instant not after (at + wait) is the first one not before it
    probes = instants.withColumn("ts", F.timestamp_micros(-(F.col("at") + wait)))
    jumps = as_of(probes, instants.select(*own, F.timestamp_micros(-F.col("at")).alias("ts"), F.col("at").alias("next")), own, ["next"])
    jumps = stored(jumps.filter("next IS NOT NULL").select(*own, "at", "next"), "jumps")
    told = instants.groupBy(*own).agg(F.min("at").alias("at"))
    longest = instants.groupBy(*own).agg((F.max("at") - F.min("at")).alias("span")).agg(F.max("span")).first()[0] or 0
    reach, most = 1, longest // wait
    while reach <= most:
        more = _joined(told, jumps, [*own, "at"]).select(*own, F.col("next").alias("at"))
        told = stored(told.unionByName(more), "told")
        reach *= 2
        if reach <= most:
            after = jumps.select(*own, F.col("at").alias("next"), F.col("next").alias("last"))
            jumps = stored(_joined(jumps, after, [*own, "next"]).select(*own, "at", F.col("last").alias("next")), "jumps")
    picked = _joined(due, told, [*own, "at"])
    rest = [c for c in due.columns if c not in (*own, "at", "message", "nth")]
    first = picked.groupBy(*own, "at").agg(F.min(F.struct("message", "nth", *rest)).alias("r"))
    return first.select(*own, "at", "r.*")


def notifications(
    findings: DataFrame, maintenance: DataFrame, resolve_after: float = 90, sweep: float = 0, persist: float = 0, repeat: float = 0
) -> DataFrame:
    """Finding columns with status, count and first_seen: announcements, reminders and resolutions.

    A finding under maintenance counts but says nothing. The first open, unsuppressed finding announces; with ``repeat`` seconds,
    the next one that long after the last notice reminds. An announced incident is resolved once over.
    """
    rows = suppressed_by(with_islands(findings, resolve_after, sweep), maintenance)
    may = F.col("window").isNull() & (F.col("at") - F.col("began") >= int(persist * MICRO))
    own = F.struct("at", "message", "severity", "nth")
    ended = rows.groupBy(*KEY, "island").agg(
        F.min("began").alias("began"), F.min(F.when(may, own)).alias("told"), F.max(own).alias("last"), F.count(F.lit(1)).alias("n")
    )
    ended = ended.filter("told IS NOT NULL")
    if repeat > 0:
        due = rows.filter(may).select(*KEY, "island", "at", "message", "severity", "nth", "began")
        firing = _reminded(due, int(repeat * MICRO))
    else:
        firing = ended.select(*KEY, "told.*", "began")
    firing = firing.select(
        F.timestamp_micros("at").alias("ts"), *KEY, "severity", "message", F.lit("firing").alias("status"), F.col("nth").cast("long").alias("count"), F.timestamp_micros("began").alias("first_seen")
    )
    seconds = F.round((F.col("last.at") - F.col("began")) / MICRO).cast("long")
    resolved = ended.select(
        F.timestamp_micros(ends_at(F.col("last.at"), resolve_after, sweep)).alias("ts"), *KEY, F.col("last.severity").alias("severity"),
        F.concat(F.lit("cleared after "), F.col("n").cast("string"), F.lit(" observation(s) over "), seconds.cast("string"), F.lit("s")).alias("message"),
        F.lit("resolved").alias("status"), "n", F.timestamp_micros("began").alias("first_seen"),
    ).withColumnRenamed("n", "count")
    return firing.unionByName(resolved)


def resolve(incidents: DataFrame, now: Column) -> DataFrame:
    """Incidents with open: whether they are not over by ``now``."""
    return incidents.withColumn("open", F.col("opened_at").isNotNull() & (F.col("resolved_at") > now))


def forget(incidents: DataFrame, removed: DataFrame, now: Column) -> DataFrame:
    """Resolution notices for the open, announced incidents of removed targets (target)."""
    gone = resolve(incidents, now).filter("open").join(removed.select("target").distinct(), "target", "left_semi")
    return gone.select(now.alias("ts"), *KEY, "severity", F.lit("target removed").alias("message"), F.lit("resolved").alias("status"), "count", "first_seen")


def announced(incidents: DataFrame, notices: DataFrame) -> DataFrame:
    """Incidents with announced: whether a notice told of them."""
    told = notices.filter("status = 'firing'").select(*(F.col(c).alias(f"its_{c}") for c in (*KEY, "first_seen"))).distinct()
    same = F.lit(True)
    for c in (*KEY, "first_seen"):
        same &= F.col(c).eqNullSafe(F.col(f"its_{c}"))
    own = incidents.join(told.withColumn("announced", F.lit(True)), same, "left")
    return own.select(*(F.col(f"`{c}`") for c in incidents.columns), F.coalesce("announced", F.lit(False)).alias("announced"))


def incident_gauges(incidents: DataFrame, now: Column) -> DataFrame:
    """open, critical and, of incidents that say so, announced: how many incidents are open at ``now``, by target."""
    own = resolve(incidents, now).filter("open")
    told = F.col("announced") if "announced" in incidents.columns else F.lit(False)
    return own.groupBy("target").agg(F.count(F.lit(1)).alias("open"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(told).alias("announced"))


def maintenance_gauges(maintenance: DataFrame, now: Column) -> DataFrame:
    """window and active (1 or 0) of every maintenance window at ``now``."""
    return maintenance.select(F.col("name").alias("window"), window_active(now).cast("int").alias("active"))


def incident_totals(notices: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """opened (reminders count as openings), resolved and withheld, by target. suppressed: see suppressed_total."""
    own = notices.groupBy("target").agg(F.count_if(F.col("status") == "firing").alias("opened"), F.count_if(F.col("status") == "resolved").alias("resolved"))
    if suppressed is None:
        return own.withColumn("suppressed", F.lit(0).cast("long"))
    quiet = suppressed.groupBy("target").agg(F.sum("n").alias("suppressed"))
    return own.join(quiet, "target", "full_outer").na.fill({"opened": 0, "resolved": 0, "suppressed": 0})


def suppressed_total(
    findings: DataFrame, maintenance: DataFrame, resolve_after: float = 90, sweep: float = 0, persist: float = 0
) -> DataFrame:
    """target, check, window and n: findings of open incidents that a maintenance window kept quiet."""
    rows = suppressed_by(with_islands(findings, resolve_after, sweep), maintenance)
    own = rows.filter(F.col("window").isNotNull() & (F.col("at") - F.col("began") >= int(persist * MICRO)))
    return own.groupBy("target", "check", "window").agg(F.count(F.lit(1)).alias("n"))


def incident_active(notices: DataFrame) -> DataFrame:
    """target, variant, check, severity and active: 1 while the last notice fires, 0 once it resolves."""
    own = notices.groupBy("target", "variant", "check", "severity")
    return own.agg(F.max_by("status", F.struct("ts", (F.col("status") == "resolved").alias("r"), "vantage")).alias("s")).select(
        "target", "variant", "check", "severity", (F.col("s") == "firing").cast("int").alias("active")
    )


def open_incidents(incidents: DataFrame, now: Column) -> DataFrame:
    """Open incidents, the gravest first, then the oldest."""
    from playwatch.functions.columns import severity_rank

    return resolve(incidents, now).filter("open").orderBy(severity_rank(F.col("severity")), "first_seen", *KEY)


def save_snapshot(incidents: DataFrame, now: Column) -> DataFrame:
    """Open incidents as a snapshot to write, in the order of their keys: version and saved_at beside their columns."""
    own = resolve(incidents, now).filter("open").drop("open").withColumn("version", F.lit(1)).withColumn("saved_at", now)
    return own.orderBy(*KEY, "first_seen")


def write_snapshot(incidents: DataFrame, now: Column, path: str) -> bool:
    """Writes the snapshot of ``now`` to a folder of its own under ``path`` unless the newest one there says the same; whether it wrote.

    A new folder for each write leaves the one before whole if the write fails.
    """
    spark = incidents.sparkSession
    own = save_snapshot(incidents, now)
    try:
        old = newest_snapshot(spark, path)
    except AnalysisException:  # nothing written yet
        old = None
    if old is not None and not incidents_changed(old.drop("saved_at"), own.drop("saved_at")):
        return False
    at = spark.range(1).select(micros(now)).first()[0]
    own.write.mode("overwrite").parquet(f"{path}/saved={at}")
    return True


def newest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    own = spark.read.option("basePath", path).parquet(f"{path}/saved=*")
    return own.filter(F.col("saved") == own.agg(F.max("saved")).scalar()).drop("saved")


def restore_snapshot(snapshot: DataFrame, now: Column, most_age: float = 3600) -> DataFrame:
    """The incidents of a snapshot of this version that is not older than ``most_age`` seconds, seen as of ``now``."""
    fresh = snapshot.filter((F.col("version") == 1) & (micros(now) - micros(F.col("saved_at")) <= int(most_age * MICRO)))
    return fresh.drop("version", "saved_at").withColumn("last_seen", now).withColumn("open", F.lit(True))


def incidents_changed(before: DataFrame, after: DataFrame) -> bool:
    """Whether two snapshots differ, by a hash of their rows that ignores order."""
    mark = lambda d: d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*sorted(d.columns))), F.sum(F.xxhash64(*sorted(d.columns)) % 1_000_003)).first()
    return mark(before) != mark(after)
