"""Structured Streaming forms: findings from fetches, state across polls, incidents, rates."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from playwatch.functions.columns import NS, stall_ns
from playwatch.operators import crosspoll, dash, decode, rules
from playwatch.operators.incidents import KEY
from playwatch.operators.maintenance import suppressed_by
from playwatch.sources.stored import delete_folder, folder_exists, scratch

NOTICE = "ts timestamp, vantage string, target string, variant string, check string, severity string, message string, status string, count long, first_seen timestamp"


def with_lateness(df: DataFrame, delay: str = "5 minutes") -> DataFrame:
    return df.withWatermark("ts", delay)


def without_late(delay_s: float, late: Callable[[DataFrame, int], None], sink: Callable[[DataFrame, int], None], state: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands rows older than the watermark to ``late`` and the others to ``sink``.

    The watermark is the newest instant of all batches before, less ``delay_s`` seconds, as Structured Streaming has it. A batch leaves
    the newest instant up to its end under ``state`` and reads that of the batch before alone, so a batch run again meets the watermark
    that it met first, and the cost of a batch does not grow with their number: marks of earlier batches are deleted.
    """

    def send(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{state}/batch-{batch_id - 1}"
        newest = spark.read.schema("newest timestamp").json(before).agg(F.max("newest")).first()[0] if folder_exists(spark, before) else None
        batch = batch.persist()
        try:
            held = batch.agg(F.max("ts").alias("newest")).select(F.greatest("newest", F.lit(newest).cast("timestamp")).alias("newest"))
            held.write.mode("overwrite").json(f"{state}/batch-{batch_id}")
            if newest is None:
                sink(batch, batch_id)
            else:
                mark = F.lit(newest) - F.make_dt_interval(secs=F.lit(float(delay_s)))
                is_late = F.coalesce(F.col("ts") < mark, F.lit(False))
                late(batch.filter(is_late), batch_id)
                sink(batch.filter(~is_late), batch_id)
            delete_folder(spark, f"{state}/batch-{batch_id - 2}")
        finally:
            batch.unpersist()

    return send


def stream_findings(fetches: DataFrame, rules: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that applies per-poll rules to every micro-batch of fetches, with the functions that batch jobs use."""
    return fetches.writeStream.foreachBatch(lambda batch, n: sink(rules(batch), n)).option("checkpointLocation", checkpoint)


#: Rules that compare polls, which a micro-batch cannot: stream_cross_poll has their state.
CROSS_POLL = [
    "hls_playlist_rollback", "hls_playlist_stalled", "pdt_not_advancing", "hls_key_rotation_stalled", "dash_playlist_rollback", "dash_playlist_stalled", "dash_key_rotation_stalled",
]
FACT = "fetch_id string, ts timestamp, vantage string, target string, variant string, stream string, format string, seq long, edge timestamp, identity string, stall_s double, rotation_s double"


def poll_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """What one poll says that the next is held against, a row (see FACT) for each live playlist or representation.

    stream is the playlist's URL or the representation's label; seq and edge are null where only keys are compared.
    """
    none = lambda kind: F.lit(None).cast(kind)
    out = []
    if "media" in tables:
        media = tables["media"]
        live = media.filter("NOT endlist AND n_segments > 0")
        stall = 3.0 * F.greatest(F.col("target_duration"), F.lit(2))
        keys = rules.last_keys(tables["keys"])
        own = ["fetch_id", "ts", "vantage", "target", "variant", F.col("url").alias("stream"), F.lit("hls").alias("format")]
        moved = live.select(*own, F.col("media_sequence").alias("seq"), "edge", none("string").alias("identity"), stall.alias("stall_s"), none("double").alias("rotation_s"))
        turned = rules.with_target(keys, tables["targets"].select("name", "key_rotation_max_s")).filter("key_rotation_max_s > 0")
        turned = turned.select(*own, none("long").alias("seq"), none("timestamp").alias("edge"), "identity", none("double").alias("stall_s"), F.col("key_rotation_max_s").cast("double").alias("rotation_s"))
        out += [moved, turned]
    if "edges" in tables:
        label = ["fetch_id", "ts", "vantage", "target", F.col("label").alias("variant"), F.concat_ws("|", "url", "label").alias("stream"), F.lit("dash").alias("format")]
        edges = tables["edges"].join(tables["mpd"].select("fetch_id", "min_update_ns"), "fetch_id")
        moved = edges.select(*label, F.col("tick").alias("seq"), none("timestamp").alias("edge"), none("string").alias("identity"), (stall_ns(F.col("seg_ns"), F.col("min_update_ns")) / NS).cast("double").alias("stall_s"), none("double").alias("rotation_s"))
        kept = dash.protection_identity(tables["present"].filter("size(protections) > 0"))
        kept = rules.with_target(kept, tables["targets"].select("name", "key_rotation_max_s")).filter("key_rotation_max_s > 0")
        turned = kept.select(*label, none("long").alias("seq"), none("timestamp").alias("edge"), "identity", none("double").alias("stall_s"), F.col("key_rotation_max_s").cast("double").alias("rotation_s"))
        out += [moved, turned]
    return reduce(DataFrame.unionByName, out)


def whole_polls(fetches: DataFrame, wait: str = "30 seconds", delay: str = "10 seconds") -> DataFrame:
    """A stream of fetches, each released with all others of its poll at once.

    A poll is whole once ``wait`` of event time has passed after its last fetch, and ``delay`` more for those that come late. Until then its
    fetches are kept as the state of a session of its poll_id, whichever micro-batches they came in. What follows after that is a
    poll of its own. A fetch without a poll_id is a poll by itself.
    """
    own = fetches.withWatermark("ts", delay)
    key = F.coalesce("poll_id", F.concat(F.lit("fetch "), F.col("fetch_id")))
    polls = own.groupBy(key.alias("__poll"), F.session_window("ts", wait)).agg(F.collect_list(F.struct(*fetches.columns)).alias("__rows"))
    return polls.select(F.explode("__rows").alias("__row")).select("__row.*")


def stream_polls(
    fetches: DataFrame, targets: DataFrame | Callable[[], DataFrame], findings: Callable[[DataFrame, int], None], facts: Callable[[DataFrame, int], None],
    checkpoint: str, wait: str = "30 seconds", delay: str = "10 seconds", names: list[str] | None = None,
):
    """The first of two queries over a stream of fetches: gathers polls whole (see whole_polls), decodes them, hands the findings of all
    rules within a poll to ``findings`` and its poll_facts to ``facts``, the table that the second, stream_cross_poll, streams from.

    targets: a table, or a function that gives it anew for each micro-batch, so that a configuration read again applies to the next. What
    a micro-batch stores between steps lies in a folder of its own, deleted at its end. names: the rules within a poll to run, all if not
    given. A micro-batch that releases no poll calls nothing.
    """

    def send(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            with scratch(batch.sparkSession):
                tables = decode.decode_fetches(batch, targets() if callable(targets) else targets)
                runnable = [n for n, (_, needs, _) in rules.RULES.items() if n not in CROSS_POLL and all(t in tables for t in needs)]
                findings(decode.findings_of(tables, names or runnable), batch_id)
                facts(poll_facts(tables), batch_id)
        finally:
            batch.unpersist()

    return whole_polls(fetches, wait, delay).writeStream.outputMode("append").foreachBatch(send).option("checkpointLocation", checkpoint)


def stream_rates(findings: DataFrame, minutes: int = 5, every: int | None = None) -> DataFrame:
    """window, check, severity, n and rate (a minute) of findings in windows of ``minutes`` that begin every ``every`` minutes (of as many,
    if not given: tumbling). Findings need a watermark in a stream.

    A finding is counted once, in a pane of ``every`` minutes; windows add up panes, of which they hold minutes / every. So ``every`` must
    divide ``minutes``.
    """
    every = every or minutes
    if minutes % every:
        raise ValueError("every must divide minutes")
    panes = findings.groupBy(F.window("ts", f"{every} minutes").alias("pane"), "check", "severity").agg(F.count(F.lit(1)).alias("n"))
    if every != minutes:
        panes = panes.groupBy(F.window(F.window_time("pane"), f"{minutes} minutes", f"{every} minutes").alias("pane"), "check", "severity").agg(F.sum("n").alias("n"))
    return panes.select(F.col("pane").alias("window"), "check", "severity", "n", (F.col("n") / minutes).alias("rate"))


def stream_sessions(findings: DataFrame, gap_s: int = 90) -> DataFrame:
    """Quick incidents: runs of findings without a gap of that long; no reminders."""
    # a session window takes in what starts as it ends, where an incident ends after gap_s
    own = findings.groupBy(*KEY, F.session_window("ts", f"{gap_s * 1_000_000 - 1} microseconds").alias("w")).agg(F.count(F.lit(1)).alias("count"), F.max("ts").alias("last_seen"))
    return own.select(*KEY, F.col("w.start").alias("first_seen"), "last_seen", "count")


class InOrder(StatefulProcessor):
    """Rows in order of event time: they wait in state, by the millisecond that ends theirs, until the watermark has passed it, so that none
    before them can follow. Then ``judge`` gets them, sorted, whichever micro-batches they came in. A key has one timer, for the next instant
    that waits or the one that ``until`` names."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "rows string")

    def packed(self, row) -> dict:
        """A row as it waits: JSON with ``at``, in microseconds."""
        raise NotImplementedError

    def order(self, row: dict):
        raise NotImplementedError

    def judge(self, key, row: dict) -> list[dict]:
        raise NotImplementedError

    def passed(self, key, now: float) -> list[dict]:
        """What is to be said, beyond rows, now that the watermark has come to ``now`` seconds."""
        raise NotImplementedError

    def until(self) -> float | None:
        """The next instant (seconds) at which ``passed`` has something to do."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[dict]] = {}
        for frame in rows:
            for row in frame.itertuples():
                if pd.notna(row.ts):
                    own = self.packed(row)
                    new.setdefault(-(-own["at"] // 1000), []).append(own)
        for at, some in new.items():
            old = json.loads(self.waiting.getValue((at,))[0]) if self.waiting.containsKey((at,)) else []
            self.waiting.updateValue((at,), (json.dumps(old + some),))
        if new:
            self.wake(min(new))
        yield from ()

    def wake(self, at: int) -> None:
        timers = [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]
        if timers and min(timers) <= at:
            return
        for old in timers:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        instants = sorted(k[0] for k in list(self.waiting.keys()))
        out = []
        for at in instants:
            if at > now:
                break
            for row in sorted(json.loads(self.waiting.getValue((at,))[0]), key=self.order):
                out += self.judge(key, row)
            self.waiting.removeKey((at,))
        out += self.passed(key, now / 1000)
        for old in [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]:
            self.handle.deleteTimer(old)
        again = [at for at in instants if at > now][:1]
        more = self.until()
        if more is not None:
            again.append(math.ceil(more * 1000))
        if again:
            self.handle.registerTimer(min(again))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def micros(ts) -> int:
    """Microseconds of a naive UTC timestamp."""
    return ts.value // 1000


def stamp(seconds: float) -> pd.Timestamp:
    return pd.Timestamp(round(seconds * 1e6), unit="us")


def plain(value):
    return None if pd.isna(value) else value


class Incidents(InOrder):
    """Incidents, in order of their findings: each announced once it has lasted ``persist`` seconds, reminded every ``repeat``, resolved
    at the first sweep (every ``sweep`` seconds of the epoch; 0 for at once) after ``resolve_after`` quiet seconds. A finding with a
    window counts and says nothing. What a snapshot restored is the state to begin with. Control rows of a target come before its findings
    of their instant: see stream_incidents. One key may hold many incidents, a target's."""

    def __init__(self, resolve_after: float, persist: float, repeat: float, sweep: float = 0):
        self.first = {"resolve_after": float(resolve_after), "persist": float(persist), "repeat": float(repeat)}
        self.sweep = sweep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("incidents", "of string", "body string")
        self.settings = handle.getValueState("settings", "body string")

    def packed(self, row) -> dict:
        own = {c: plain(getattr(row, c)) for c in (*KEY, "severity", "message", "window", "action", "resolve_after", "persist", "repeat")}
        return own | {"at": micros(row.ts)}

    def order(self, row: dict):
        return row["at"], row["action"] is None, row["message"] or "", row["severity"] or ""

    def now_set(self) -> dict:
        return json.loads(self.settings.get()[0]) if self.settings.exists() else self.first

    def ends(self, inc: dict) -> float:
        quiet = inc["last"] + inc["resolve_after"]
        return math.ceil(quiet / self.sweep) * self.sweep if self.sweep else quiet

    def over(self, inc: dict, at: float) -> bool:
        return self.ends(inc) < at if self.sweep else self.ends(inc) <= at

    def each(self) -> list[tuple[tuple, dict]]:
        return [(k, json.loads(v[0])) for k, v in list(self.open.iterator())]

    def keep(self, of: tuple, inc: dict) -> None:
        self.open.updateValue(of, (json.dumps(inc),))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for row in initialState.to_dict("records"):
            inc = {c: plain(row[c]) for c in (*KEY, "severity", "message")} | {
                "first": row["first_seen"].timestamp(), "last": row["last_seen"].timestamp(), "count": int(row["count"]),
                "told": row["told_at"].timestamp() if pd.notna(row["told_at"]) else None, "resolve_after": self.first["resolve_after"],
            }
            self.keep((json.dumps([inc[c] for c in KEY]),), inc)
        self.wake(math.ceil(self.until() * 1000))

    def judge(self, key, row: dict) -> list[dict]:
        at = row["at"] / 1e6
        if row["action"] is not None:
            return self.control(row, at)
        of = (json.dumps([row[c] for c in KEY]),)
        inc = json.loads(self.open.getValue(of)[0]) if self.open.containsKey(of) else None
        out, rules_ = [], self.now_set()
        if inc and self.over(inc, at):
            out += self.closing(inc)
            inc = None
        inc = inc or {c: row[c] for c in KEY} | {"first": at, "count": 0, "told": None, "last": at}
        inc |= {"last": max(at, inc["last"]), "count": inc["count"] + 1, "severity": row["severity"], "message": row["message"], "resolve_after": rules_["resolve_after"]}
        due = inc["told"] is None or (rules_["repeat"] > 0 and at - inc["told"] >= rules_["repeat"])
        if at - inc["first"] >= rules_["persist"] and due and row["window"] is None:
            inc["told"] = at
            out.append(self.notice(inc, at, row["message"], "firing"))
        self.keep(of, inc)
        return out

    def control(self, row: dict, at: float) -> list[dict]:
        if row["action"] == "set":
            self.settings.update((json.dumps({c: row[c] if row[c] is not None else old for c, old in self.now_set().items()}),))
            return []
        # removed: what is over by then ends as usual, what is open ends now
        out = []
        for of, inc in self.each():
            out += self.closing(inc) if self.over(inc, at) else self.closing(inc, at, "target removed")
            self.open.removeKey(of)
        self.settings.clear()
        return out

    def passed(self, key, now: float) -> list[dict]:
        out = []
        for of, inc in self.each():
            if self.ends(inc) <= now:
                out += self.closing(inc)
                self.open.removeKey(of)
        return out

    def until(self) -> float | None:
        return min((self.ends(inc) for _, inc in self.each()), default=None)

    def closing(self, inc: dict, at: float | None = None, text: str | None = None) -> list[dict]:
        if inc["told"] is None:
            return []
        text = text or f"cleared after {inc['count']} observation(s) over {round(inc['last'] - inc['first'])}s"
        return [self.notice(inc, self.ends(inc) if at is None else at, text, "resolved")]

    def notice(self, inc: dict, at: float, message: str, status: str) -> dict:
        return {c: inc[c] for c in KEY} | {"ts": stamp(at), "severity": inc["severity"], "message": message, "status": status, "count": inc["count"], "first_seen": stamp(inc["first"])}


CONTROL = "ts timestamp, target string, action string, resolve_after double, persist double, repeat double"


def target_controls(old: DataFrame, new: DataFrame, at) -> DataFrame:
    """Control rows (CONTROL) of a configuration that was read again at an instant: the targets that it no longer has are removed."""
    from playwatch.operators import views

    none = [F.lit(None).cast("double").alias(c) for c in ("resolve_after", "persist", "repeat")]
    return views.removed_targets(old, new).select(at.cast("timestamp").alias("ts"), F.col("name").alias("target"), F.lit("remove").alias("action"), *none)


def stream_incidents(
    findings: DataFrame,
    resolve_after: float = 90,
    persist: float = 0,
    repeat: float = 0,
    delay: str = "0 seconds",
    sweep: float = 0,
    maintenance: DataFrame | None = None,
    restored: DataFrame | None = None,
    controls: DataFrame | None = None,
) -> DataFrame:
    """Notices of incidents as a stream, by event time; needs the RocksDB state store.

    Findings are judged in order of their instants once the watermark, ``delay`` behind the newest, has passed them; so those that come late
    within it count, extend and join incidents as if they had come in time, and notices are those of a batch. Later ones are dropped.
    maintenance: windows, joined before the state, so a window that is read again applies from the next micro-batch on. restored: the
    incidents of a snapshot (see restore_snapshot), which go on as open ones; those with announced, or without that column, as told at
    their last_seen.

    controls: a stream of CONTROL rows, in order with the findings. "remove" ends the target's incidents at its instant, with one resolution
    for each that was announced, and forgets all about it; "set" changes the settings that it gives for findings from its instant on. State
    is then kept by target, as a control row must reach all incidents of one.
    """
    own = findings.select("ts", *KEY, "severity", "message")
    own = own.withColumn("window", F.lit(None).cast("string")) if maintenance is None else suppressed_by(own, maintenance)
    own = own.select("ts", *KEY, "severity", "message", "window")
    if controls is None:
        kinds = dict(c.split(" ") for c in CONTROL.split(", "))
        own = own.withColumns({c: F.lit(None).cast(kinds[c]) for c in ("action", "resolve_after", "persist", "repeat")})
    else:
        own = own.unionByName(controls, allowMissingColumns=True)
    by = KEY if controls is None else ["target"]
    before = None
    if restored is not None:
        told = F.when(F.col("announced") if "announced" in restored.columns else F.lit(True), F.col("last_seen"))
        before = restored.select(*KEY, "severity", "message", "first_seen", "last_seen", F.col("count").cast("long").alias("count"), told.alias("told_at")).groupBy(*by)
    own = own.withWatermark("ts", delay)
    return own.groupBy(*by).transformWithStateInPandas(Incidents(resolve_after, persist, repeat, sweep), NOTICE, "Append", "eventtime", before)


class CrossPoll(InOrder):
    """What a stream's last polls said: sequence and since when, newest edge, key and since when. ``ttl_s`` seconds of event time
    without a poll forget it."""

    def __init__(self, ttl_s: float):
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("polls", "body string")

    def packed(self, row) -> dict:
        own = {c: plain(getattr(row, c)) for c in ("fetch_id", "vantage", "target", "variant", "format", "seq", "identity", "stall_s", "rotation_s")}
        return own | {"at": micros(row.ts), "edge": micros(row.edge) if pd.notna(row.edge) else None, "seq": int(row.seq) if pd.notna(row.seq) else None}

    def order(self, row: dict):
        return row["at"], row["fetch_id"] or "", row["seq"] is None

    def judge(self, key, row: dict) -> list[dict]:
        was = json.loads(self.state.get()[0]) if self.state.exists() else {}
        at, out = row["at"], []
        if was and at - was["at"] > self.ttl_s * 1e6:
            was = {}

        def tell(check: str, severity: str, message: str) -> None:
            out.append({"ts": pd.Timestamp(at, unit="us"), "vantage": row["vantage"], "target": row["target"], "variant": row["variant"], "check": check, "severity": severity, "message": message})

        if row["seq"] is not None:
            seq, before, edge = row["seq"], was.get("seq"), row["edge"]
            what = "media sequence" if row["format"] == "hls" else "the edge"
            if before is not None and seq < before:
                tell("playlist_rollback", "critical", f"{what} went from {before} to {seq}")
            if before is not None and seq > before and edge is not None and was.get("edge") is not None and edge <= was["edge"]:
                tell("pdt_not_advancing", "warning", "the sequence advanced, the live edge did not")
            if before != seq:
                was |= {"seq": seq, "seq_at": at}
            elif at - was["seq_at"] > row["stall_s"] * 1e6:
                tell("playlist_stalled", "critical", f"unchanged for {(at - was['seq_at']) / 1e6:.1f}s")
            if edge is not None:
                was["edge"] = edge
        if row["rotation_s"] is not None:
            if "key_at" not in was or was["key"] != row["identity"]:
                was |= {"key": row["identity"], "key_at": at}
            elif at - was["key_at"] > row["rotation_s"] * 1e6:
                tell("key_rotation_stalled", "warning", f"the same key{'s' if row['format'] == 'dash' else ''} for {(at - was['key_at']) / 1e6:.1f}s")
        self.state.update((json.dumps(was | {"at": at}),))
        return out

    def passed(self, key, now: float) -> list[dict]:
        ends = self.until()
        if ends is not None and ends < now:
            self.state.clear()
        return []

    def until(self) -> float | None:
        # a poll at the very end of the time still belongs
        return json.loads(self.state.get()[0])["at"] / 1e6 + self.ttl_s + 0.001 if self.state.exists() else None


FINDING = "ts timestamp, vantage string, target string, variant string, check string, severity string, message string"


def stream_cross_poll(facts: DataFrame, ttl_s: float = 86_400, delay: str = "10 minutes") -> DataFrame:
    """Findings of the rules that compare polls, from a stream of poll_facts: rollback, stall, an edge that does not advance, and keys
    that do not rotate. Polls are judged in order of their instants once the watermark has passed them, so those that come late, within
    ``delay``, are held against the polls before and after them: the findings are those of cross_poll_findings over the same table. The
    state of a stream that is not polled for ``ttl_s`` seconds is dropped, so its next poll is a first one."""
    own = facts.select(*(f.split(" ")[0] for f in FACT.split(", "))).withWatermark("ts", delay)
    return own.groupBy("vantage", "target", "stream").transformWithStateInPandas(CrossPoll(ttl_s), FINDING, "Append", "eventtime")


def cross_poll_findings(facts: DataFrame) -> DataFrame:
    """The same as a batch, of a table of poll_facts: each kind of fact is held against the one before it by windows."""
    key = ["vantage", "target", "stream"]
    moved, turned = facts.filter("seq IS NOT NULL"), facts.filter("rotation_s IS NOT NULL")
    hls = F.col("format") == "hls"
    tell = lambda df, check, severity, message: df.select("ts", "vantage", "target", "variant", F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.alias("message"))
    whole = F.format_string("unchanged for %.1fs", F.col("unchanged_s"))
    back = crosspoll.rollbacks(moved, key, "seq")
    what = F.concat(F.when(hls, "media sequence").otherwise("the edge"), F.lit(" went from "), F.col("prev_seq").cast("string"), F.lit(" to "), F.col("seq").cast("string"))
    behind = crosspoll.pdt_not_advancing(moved.withColumn("media_sequence", F.col("seq")), key)
    same = F.format_string("the same key%s for %.1fs", F.when(hls, "").otherwise("s"), F.col("unchanged_s"))
    out = [
        tell(back, "playlist_rollback", "critical", what),
        tell(behind, "pdt_not_advancing", "warning", F.lit("the sequence advanced, the live edge did not")),
        tell(crosspoll.stalled(moved, key, "seq", F.col("stall_s")), "playlist_stalled", "critical", whole),
        tell(crosspoll.stalled(turned, key, "identity", F.col("rotation_s")), "key_rotation_stalled", "warning", same),
    ]
    return reduce(DataFrame.unionByName, out)


def apply_targets(old: DataFrame, new: DataFrame, incidents: DataFrame, samples: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changes, resolution notices and surviving samples of a configuration that was read again."""
    from playwatch.operators import incidents as inc
    from playwatch.operators import views

    gone = views.removed_targets(old, new)
    return views.diff_targets(old, new), inc.forget(incidents, gone.select(F.col("name").alias("target")), now), views.drop_series(samples, gone)
