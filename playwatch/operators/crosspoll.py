"""Rules over consecutive polls of one key, and windowed metrics: change points, edges, persistence, rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows of a key are scanned within stretches of this many microseconds of ts.
STRETCH = 86_400_000_000


def scanned(
    df: DataFrame, key: list[str], order: list[str], previous: dict[str, Column] | None = None, latest: dict[str, Column] | None = None, inclusive: bool = False
) -> DataFrame:
    """``df`` with, for each name of ``previous``, the value of the row before in the order of ts and ``order``, as a struct v (null where
    no row is before), and for each name of ``latest`` the last value before (``inclusive``: up to the row itself and others of its place) that is
    not null.

    Two levels: windows run within a key's stretches of a day, and what a stretch needs from those before it comes from a table of a row
    for each stretch, over which alone a window spans a whole key. So a key of any length, and a hot one, is many tasks' work. Rows of
    null ts stand first. Columns of df keep their names, and none may begin with two underscores.
    """
    previous, latest = previous or {}, latest or {}
    sort = ["ts", *order]
    rows = df.withColumns({f"__v_{n}": c for n, c in (previous | latest).items()})
    rows = rows.withColumn("__stretch", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / STRETCH))
    own = Window.partitionBy(*key, "__stretch").orderBy(*sort)
    # rows of one place see one another where the row itself counts, so that it does not matter which of them a scan meets first
    upto = own if inclusive else own.rowsBetween(Window.unboundedPreceding, -1)
    inner = {n: F.lag(F.struct(F.col(f"__v_{n}").alias("v"))).over(own) for n in previous} | {n: F.last(f"__v_{n}", ignorenulls=True).over(upto) for n in latest}
    place = F.struct(*sort)
    ends = rows.groupBy(*key, "__stretch").agg(
        *(F.max_by(F.struct(F.col(f"__v_{n}").alias("v")), place).alias(f"__e_{n}") for n in previous),
        *(F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), place)).alias(f"__e_{n}") for n in latest),
    )
    over = Window.partitionBy(*key).orderBy("__stretch")
    carry = [F.lag(f"__e_{n}").over(over).alias(f"__c_{n}") for n in previous]
    carry += [F.last(f"__e_{n}", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__c_{n}") for n in latest]
    ends = ends.select(*(F.col(c).alias(f"__k_{c}") for c in (*key, "__stretch")), *carry)
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in (*key, "__stretch")))
    rows = rows.withColumns({f"__i_{n}": c for n, c in inner.items()}).join(ends, same)
    return rows.select(*(F.col(f"`{c}`") for c in df.columns), *(F.coalesce(f"__i_{n}", f"__c_{n}").alias(n) for n in inner))


def with_previous(df: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """prev_<column> of the poll before."""
    own = scanned(df, key, ["fetch_id"], previous={f"__prev_{c}": F.col(c) for c in cols})
    return own.withColumns({f"prev_{c}": F.col(f"__prev_{c}")["v"] for c in cols}).drop(*(f"__prev_{c}" for c in cols))


def change_points(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """prev_value, and changed_at: when the value last became what it is."""
    own = scanned(df, key, ["fetch_id"], previous={"prev_poll": F.col(value)})
    own = own.withColumn("prev_value", F.col("prev_poll")["v"])
    changed = F.col("prev_poll").isNull() | ~F.col("prev_value").eqNullSafe(F.col(value))
    return scanned(own.withColumn("prev_poll", changed), key, ["fetch_id"], latest={"changed_at": F.when(F.col("prev_poll"), F.col("ts"))}, inclusive=True).drop("prev_poll")


def as_of(left: DataFrame, right: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Rows of left with ``cols`` of the last row of right, of the same ``by``, whose ts is not later; null where there is none. Of rows of
    one instant the one of greatest ``cols`` is the last. Both have ts; a null in ``by`` is a value like others."""
    a = left.select(*by, "ts", F.struct(*left.columns).alias("row"), F.lit(1).alias("side"))
    b = right.select(*by, "ts", F.struct(*cols).alias("seen"), F.lit(0).alias("side"))
    both = a.unionByName(b, allowMissingColumns=True)
    out = scanned(both, by, ["side", "seen"], latest={"found": F.col("seen")}, inclusive=True).filter("side = 1")
    return out.select("row.*", *(F.col("found")[c].alias(c) for c in cols))


def rollbacks(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Polls whose value is below the one before."""
    return with_previous(df, key, [value]).filter(F.col(value) < F.col(f"prev_{value}"))


def stalled(df: DataFrame, key: list[str], value: str, seconds: Column) -> DataFrame:
    """Polls whose value has been the same for longer than ``seconds``, with unchanged_s."""
    own = change_points(df, key, value)
    own = own.withColumn("unchanged_s", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("changed_at").cast("timestamp"))) / 1e6)
    return own.filter(F.col("unchanged_s") > seconds)


def unchanged_longer_than(df: DataFrame, key: list[str], identity: str, seconds: float) -> DataFrame:
    return stalled(df, key, identity, F.lit(float(seconds)))


def pdt_not_advancing(edges: DataFrame, key: list[str]) -> DataFrame:
    """Polls whose sequence advanced while the edge did not pass the last edge known before. edges: media_sequence, edge."""
    own = scanned(edges, key, ["fetch_id"], previous={"prev_poll": F.col("media_sequence")}, latest={"last_edge": F.col("edge")})
    own = own.withColumn("prev_sequence", F.col("prev_poll")["v"]).drop("prev_poll")
    return own.filter((F.col("media_sequence") > F.col("prev_sequence")) & (F.col("edge") <= F.col("last_edge")))


def sustained(df: DataFrame, key: list[str], predicate: Column, seconds: float, tie: str = "fetch_id") -> DataFrame:
    """Rows at which a predicate has held, poll by poll, for ``seconds`` at least. Polls of one instant stand in the order of ``tie``."""
    own = scanned(df.withColumn("holds", F.coalesce(predicate, F.lit(False))), key, [tie], previous={"held_before": F.col("holds")})
    begins = F.col("holds") & ~F.coalesce(F.col("held_before")["v"], F.lit(False))
    own = scanned(own, key, [tie], latest={"since": F.when(begins, F.col("ts"))}, inclusive=True)
    held = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))) / 1e6
    return own.filter(F.col("holds") & (held >= seconds)).drop("holds", "held_before")


#: 2024-01-01 in seconds.
EPOCH = 1_704_067_200.0


def edge_speed(samples: DataFrame, key: list[str], seconds: int = 120) -> DataFrame:
    """speed: units a minute of value, by least squares over the last seconds; null where they hold a single instant."""
    # from a fixed instant on, as squares of seconds since 1970 would leave few digits
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - EPOCH
    own = samples.withColumn("__s", at.cast("long")).withColumn("__at", at)
    w = Window.partitionBy(*key).orderBy("__s").rangeBetween(-seconds, 0)
    return own.withColumn("speed", F.regr_slope("value", "__at").over(w) * 60).drop("__s", "__at")


def findings_rate(findings: DataFrame, minutes: int = 5) -> DataFrame:
    """start, check, severity, n and rate (a minute) of findings in tumbling windows."""
    own = findings.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "check", "severity").agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.col("w.start").alias("start"), "check", "severity", "n", (F.col("n") / minutes).alias("rate"))


def trend(samples: DataFrame, key: list[str], n: int = 60) -> DataFrame:
    """The last n values of each series in order, of series with two values or more."""
    w = Window.partitionBy(*key).orderBy(F.desc("ts"), F.desc("value"))
    last = samples.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n)
    own = last.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("i"), "value"))).alias("v"))
    return own.select(*key, F.transform("v", lambda x: x["value"]).alias("values")).filter(F.size("values") >= 2)
