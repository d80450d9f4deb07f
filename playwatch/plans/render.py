"""Manifests, packets and logs rendered from the given tables, so that decoding them can be held against the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Keys in a stretch: documents are rendered by stretches too, so that more rows are more documents, not longer ones.
STRETCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its zoneless timestamps are read as UTC, which sessions are pinned to."""
    own = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return own.withColumns({c: F.col(c).cast("timestamp") for c, t in own.dtypes if t == "timestamp_ntz"})


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: the user is the target, the type the check, every third user another vantage."""
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("value") >= 100, "critical").when(F.col("value") >= 20, "warning").otherwise("info")
    return e.select(
        "ts", F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("vantage"), F.col("user_id").cast("string").alias("target"), F.lit("").alias("variant"),
        F.col("event_type").alias("check"), level.alias("severity"), F.concat(F.lit("event "), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("message"),
    )


def seen_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings again, where every target is probed from several vantages: the event's number says which."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("event "), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("message"))
    own = findings(spark, sf_dir).drop("vantage").join(e, "message")
    return own.withColumn("vantage", F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string"))).drop("event_id")


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as polls of a key: sequence floor(value / 10), edge the event's own second."""
    e = table(spark, sf_dir, "events")
    return e.select("ts", F.col("event_id").alias("fetch_id"), F.col("user_id").alias("target"), F.col("event_type").alias("variant"), F.floor(F.col("value") / 10).alias("sequence"), "value")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of each order numbered from 0 in a total order, with disc: another line status than the one before."""
    own = table(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    own = own.withColumn("ord", F.row_number().over(w) - 1)
    return own.withColumn("disc", F.coalesce(F.lag("l_linestatus").over(w) != F.col("l_linestatus"), F.lit(False)))


def hls_media_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A playlist for each order: a segment for each line item with its quantity, date, key by return flag, discontinuity."""
    key = F.when(F.col("l_returnflag") == "N", "#EXT-X-KEY:METHOD=NONE").otherwise(F.concat(F.lit('#EXT-X-KEY:METHOD=AES-128,URI="https://k.example/'), "l_returnflag", F.lit('?a=1,2"')))
    text = F.concat_ws(
        "\n", key, F.when(F.col("disc"), "#EXT-X-DISCONTINUITY"), F.concat(F.lit("#EXT-X-PROGRAM-DATE-TIME:"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("#EXTINF:"), F.col("l_quantity").cast("string"), F.lit(",")), F.concat(F.lit("seg-"), F.col("ord").cast("string"), F.lit(".ts")),
    )
    own = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("ord", text.alias("text")))).alias("t"))
    head = F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:6\n#EXT-X-TARGETDURATION:50\n#EXT-X-MEDIA-SEQUENCE:"), F.col("l_orderkey").cast("string"), F.lit("\n"))
    end = F.when(F.col("l_orderkey") % 2 == 0, "\n#EXT-X-ENDLIST").otherwise("")
    return own.select(F.col("l_orderkey").alias("fetch_id"), F.concat(head, F.array_join(F.transform("t", lambda x: x["text"]), "\n"), end).alias("body"))


def hls_master_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master for each part size and stretch of part keys: parts are variants with a group by brand; parts of even number declare some groups."""
    p = table(spark, sf_dir, "part").withColumn("stretch", F.floor(F.col("p_partkey") / STRETCH))
    inf = F.concat(F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), (F.col("p_partkey") * 1000).cast("string"), F.lit(',CODECS="avc1.64001f,mp4a.40.2",RESOLUTION='), (F.col("p_size") * 16).cast("string"), F.lit("x"), (F.col("p_size") * 9).cast("string"), F.lit(',AUDIO="'), "p_brand", F.lit('"\nv/'), F.col("p_partkey").cast("string"), F.lit(".m3u8"))
    variants = p.groupBy("p_size", "stretch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", inf.alias("t")))), lambda x: x["t"]), "\n").alias("vs"))
    media = F.concat(F.lit('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="'), "p_brand", F.lit('",NAME="'), "p_type", F.lit('",LANGUAGE="en",DEFAULT=YES,URI="a.m3u8"'))
    declared = p.filter(F.col("p_partkey") % 2 == 0).select("p_size", "stretch", "p_brand", "p_type", media.alias("m")).distinct()
    groups = declared.groupBy("p_size", "stretch").agg(F.array_join(F.array_sort(F.collect_list("m")), "\n").alias("ms"))
    own = variants.join(groups, ["p_size", "stretch"], "left")
    return own.select(F.concat_ws("-", "p_size", "stretch").alias("fetch_id"), F.concat_ws("\n", F.lit("#EXTM3U"), "ms", "vs").alias("body"))


def hls_low_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A low-latency playlist for each order: line items returned or accepted are segments, each with a map by supplier, those neither are
    parts of the segment in production, with a hint at the next; orders whose key divides by three declare no part target."""
    own, k = lines(spark, sf_dir), F.col("l_orderkey")
    join = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    part = F.col("l_returnflag") == "N"
    segment = join('#EXT-X-MAP:URI="m-', F.col("l_suppkey") % 2, '.mp4",BYTERANGE="', F.col("l_linenumber") % 3, '@0"\n#EXTINF:', F.col("l_quantity"), ",\nseg-", F.col("ord"), ".m4s")
    whole = F.when(F.col("l_linestatus") == "O", ",INDEPENDENT=YES").otherwise("")
    piece = join("#EXT-X-PART:DURATION=", F.col("l_quantity"), ',URI="p-', F.col("ord"), '.m4s"', whole)
    text = F.when(part, piece).otherwise(segment)
    own = own.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(part.alias("late"), "ord", text.alias("text")))).alias("t"))
    target = F.when(k % 3 != 0, join("\n#EXT-X-PART-INF:PART-TARGET=", k % 4)).otherwise("")
    head = join("#EXTM3U\n#EXT-X-VERSION:", k % 7 + 3, "\n#EXT-X-TARGETDURATION:", k % 50 + 1, target, "\n")
    hint = join('\n#EXT-X-PRELOAD-HINT:TYPE=part,URI="next-', k, '.m4s",BYTERANGE-START=', k % 11)
    return own.select(k.alias("fetch_id"), F.concat(head, F.array_join(F.transform("t", lambda x: x["text"]), "\n"), hint).alias("body"))


def hls_session_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master for each nation and stretch of supplier keys, with a session key for each supplier, every fourth of method NONE."""
    own = table(spark, sf_dir, "supplier").withColumn("stretch", F.floor(F.col("s_suppkey") / STRETCH))
    key = F.when(F.col("s_suppkey") % 4 == 0, "#EXT-X-SESSION-KEY:METHOD=NONE").otherwise(
        F.concat(F.lit('#EXT-X-SESSION-KEY:METHOD=SAMPLE-AES,URI="skd://'), F.col("s_suppkey").cast("string"), F.lit('",KEYFORMAT="'), F.lower("s_name"), F.lit('",KEYFORMATVERSIONS="1/2"'))
    )
    own = own.groupBy("s_nationkey", "stretch").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", key.alias("k")))).alias("t"))
    tail = "#EXT-X-STREAM-INF:BANDWIDTH=1\nv.m3u8"
    return own.select(F.concat_ws("-", "s_nationkey", "stretch").alias("fetch_id"), F.concat_ws("\n", F.lit("#EXTM3U"), F.array_join(F.transform("t", lambda x: x["k"]), "\n"), F.lit(tail)).alias("body"))


def mpd_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static MPD for each nation and stretch of supplier keys: suppliers are representations under one of five systems by key, or under
    a scheme that names none (key modulo 6 is 5)."""
    own = table(spark, sf_dir, "supplier").withColumn("stretch", F.floor(F.col("s_suppkey") / STRETCH))
    k = F.col("s_suppkey").cast("string")
    scheme = F.when(F.col("s_suppkey") % 6 == 5, "urn:mpeg:dash:mp4protection:2011").otherwise(F.concat(F.lit("urn:UUID:0000000"), (F.col("s_suppkey") % 6).cast("string"), F.lit("-0000-0000-0000-00000000000A")))
    rep = F.concat(F.lit('<Representation id="s'), k, F.lit('" bandwidth="1"><ContentProtection schemeIdUri="'), scheme, F.lit('"/></Representation>'))
    own = own.groupBy("s_nationkey", "stretch").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", rep.alias("r")))).alias("t"))
    head = '<MPD type="static" mediaPresentationDuration="PT8S"><Period start="PT0S"><AdaptationSet contentType="video"><SegmentTemplate duration="4" media="$Number$.m4s"/>'
    body = F.concat(F.lit(head), F.array_join(F.transform("t", lambda x: x["r"]), ""), F.lit("</AdaptationSet></Period></MPD>"))
    return own.select(F.concat_ws("-", "s_nationkey", "stretch").alias("fetch_id"), F.lit("https://o.example/m.mpd").alias("url"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), body.alias("body"))


def mpd_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static MPD for each order with one timeline: d of the quantity in seconds, r of the line number; each third run jumps by 5 s."""
    own = lines(spark, sf_dir)
    w = Window.partitionBy("l_orderkey").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    jump = F.when(F.col("ord") % 3 == 2, 5000).otherwise(0)
    ticks = (F.col("l_quantity") * 1000).cast("long") * (F.col("l_linenumber") + 1)
    own = own.withColumn("before", F.coalesce(F.sum(ticks).over(w), F.lit(0))).withColumn("jumps", F.sum(jump).over(Window.partitionBy("l_orderkey").orderBy("ord")))
    t = F.when(F.col("ord") % 3 == 2, F.concat(F.lit(' t="'), (F.col("before") + F.col("jumps")).cast("string"), F.lit('"'))).otherwise("")
    s = F.concat(F.lit("<S"), t, F.lit(' d="'), (F.col("l_quantity") * 1000).cast("long").cast("string"), F.lit('" r="'), F.col("l_linenumber").cast("string"), F.lit('"/>'))
    runs = own.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("ord", s.alias("s")))).alias("t"))
    head = '<?xml version="1.0"?><MPD xmlns="urn:mpeg:dash:schema:mpd:2011" type="static"><Period id="p0" start="PT0S"><SegmentTemplate timescale="1000" media="$RepresentationID$/$Number%05d$-$Time$.m4s"/><AdaptationSet mimeType="video/mp4" lang="en"><Representation id="v" bandwidth="1000"><SegmentTemplate startNumber="7"><SegmentTimeline>'
    tail = "</SegmentTimeline></SegmentTemplate></Representation></AdaptationSet></Period></MPD>"
    return runs.select(F.col("l_orderkey").alias("fetch_id"), F.lit("https://o.example/live/m.mpd").alias("url"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.concat(F.lit(head), F.array_join(F.transform("t", lambda x: x["s"]), ""), F.lit(tail)).alias("body"))


def mpd_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dynamic, number-addressed MPD for each market segment and stretch of customer keys: customers are representations in sets by nation."""
    c = table(spark, sf_dir, "customer").withColumn("stretch", F.floor(F.col("c_custkey") / STRETCH))
    rep = F.concat(F.lit('<Representation id="c'), F.col("c_custkey").cast("string"), F.lit('" bandwidth="'), (F.col("c_custkey") * 10 + 1).cast("string"), F.lit('" codecs="avc1"/>'))
    sets = c.groupBy("c_mktsegment", "stretch", "c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", rep.alias("r")))).alias("t"))
    text = F.concat(F.lit('<AdaptationSet contentType="video" lang="n'), F.col("c_nationkey").cast("string"), F.lit('">'), F.array_join(F.transform("t", lambda x: x["r"]), ""), F.lit("</AdaptationSet>"))
    docs = sets.groupBy("c_mktsegment", "stretch").agg(F.array_sort(F.collect_list(F.struct("c_nationkey", text.alias("a")))).alias("t"))
    head = '<MPD type="dynamic" availabilityStartTime="2024-01-01T00:00:00Z" timeShiftBufferDepth="PT30S" minimumUpdatePeriod="PT2S"><BaseURL>https://cdn.example/a/</BaseURL><Period start="PT10S"><SegmentTemplate timescale="10" duration="40" startNumber="3" media="../$RepresentationID$-$Number$.m4s"/>'
    return docs.select(F.concat_ws("-", "c_mktsegment", "stretch").alias("fetch_id"), F.lit("https://o.example/m.mpd").alias("url"), F.lit("2024-01-01 00:01:33").cast("timestamp").alias("ts"), F.concat(F.lit(head), F.array_join(F.transform("t", lambda x: x["a"]), ""), F.lit("</Period></MPD>")).alias("body"))


def mpd_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static MPD of 100 seconds for each part size and stretch of part keys: parts are representations, addressed by a list (key modulo 3
    is 0), as a single file with an initialisation section (1) or by number (2)."""
    p = table(spark, sf_dir, "part").withColumn("stretch", F.floor(F.col("p_partkey") / STRETCH))
    k = F.col("p_partkey").cast("string")
    join = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    urls = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 5), lambda i: join('<SegmentURL media="l', k, "-", i.cast("string"), '.m4s"/>')), "")
    inner = (
        F.when(F.col("p_partkey") % 3 == 0, join('<SegmentList timescale="10" duration="40" startNumber="5"><Initialization sourceURL="li', k, '.mp4"/>', urls, "</SegmentList>"))
        .when(F.col("p_partkey") % 3 == 1, join("<BaseURL>b", k, '.mp4</BaseURL><SegmentBase><Initialization sourceURL="bi', k, '.mp4"/></SegmentBase>'))
        .otherwise(join('<SegmentTemplate timescale="1" duration="25" media="n', k, '-$Number$.m4s" initialization="ni-$RepresentationID$.mp4"/>'))
    )
    rep = join('<Representation id="p', k, '" bandwidth="1">', inner, "</Representation>")
    docs = p.groupBy("p_size", "stretch").agg(F.array_sort(F.collect_list(F.struct("p_partkey", rep.alias("r")))).alias("t"))
    head = '<MPD type="static" mediaPresentationDuration="PT100S"><BaseURL>https://cdn.example/a/</BaseURL><Period start="PT0S"><AdaptationSet contentType="video">'
    body = join(head, F.array_join(F.transform("t", lambda x: x["r"]), ""), "</AdaptationSet></Period></MPD>")
    return docs.select(F.concat_ws("-", "p_size", "stretch").alias("fetch_id"), F.lit("https://o.example/m.mpd").alias("url"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), body.alias("body"))


#: Faults of transport streams, by order key: none, a partial packet, a corrupt one, a lost sync byte, no PAT, no PMT, no sync at all, a grid that begins late.
TS_FAULTS = 8
PAT = "0000b00d0001c100000001e10000000000"
PMT = "0002b0120001c10000e020f0001be020f00000000000"


def packet(pid: Column | int, cc: Column | int = 0, flags: int = 0, payload: str = "", sync: str = "47") -> Column:
    """Hex of a packet with a payload; flags: the bits above the PID."""
    number = lambda x: F.lit(x) if isinstance(x, int) else x
    head = F.concat(F.lit(sync), F.lpad(F.hex((number(pid) + flags * 256).cast("long")), 4, "0"), F.lit("1"), F.hex(number(cc).cast("long")))
    return F.concat(head, F.rpad(F.lit(payload), 368, "f" if payload else "0"))


def ts_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transport stream for each order, with the fault of its key: a PAT, a PMT, three null packets, and a packet for each line item,
    PID by supplier, counter by line number."""
    own = lines(spark, sf_dir)
    each = packet((F.col("l_suppkey") % 3 + 32).cast("int"), (F.col("l_linenumber") % 16).cast("int"))
    packets = own.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("ord", each.alias("h")))).alias("t"))
    f = F.col("l_orderkey") % TS_FAULTS
    text = F.concat(
        F.when(f == 7, "000000").otherwise(""), F.when(f == 4, "").otherwise(packet(0, flags=0x40, payload=PAT)), F.when(f == 5, "").otherwise(packet(256, flags=0x40, payload=PMT)),
        *(packet(8191) for _ in range(3)), F.array_join(F.transform("t", lambda x: x["h"]), ""), F.when(f == 2, packet(100, flags=0x80)).when(f == 3, packet(101, sync="00")).otherwise(""),
        F.when(f == 1, "47" + "00" * 9).otherwise(""),
    )
    return packets.select(F.col("l_orderkey").alias("fetch_id"), F.unhex(F.when(f == 6, F.repeat(F.lit("00"), F.length(text).cast("int"))).otherwise(text)).alias("data"))


def windows(spark: SparkSession) -> DataFrame:
    """Three maintenance windows: a one-off, a night on weekdays in Berlin, and a daily one for one check."""
    return spark.sql(
        "SELECT * FROM VALUES "
        "(0, 'move', array('1','2','3','4','5'), CAST(NULL AS array<string>), 'UTC', TIMESTAMP'2024-01-05 00:00:00', TIMESTAMP'2024-01-08 00:00:00', CAST(NULL AS int), CAST(NULL AS int), CAST(NULL AS array<int>)), "
        "(1, 'night', CAST(NULL AS array<string>), CAST(NULL AS array<string>), 'Europe/Berlin', NULL, NULL, 1380, 300, array(1,2,3,4,5)), "
        "(2, 'noon', CAST(NULL AS array<string>), array('error'), 'America/New_York', NULL, NULL, 720, 780, NULL) "
        "AS t(ord, name, targets, checks, tz, start, `end`, daily_start_min, daily_end_min, days)"
    )
