"""Column functions and decoders: what fires and what stays silent."""

import base64

from pyspark.sql import functions as F

from playwatch.functions import columns as C
from playwatch.operators import dash, hls, rules, transport


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_urls_templates_and_durations(spark):
    resolve = lambda b, r: value(spark, C.resolve_url(F.lit(b), F.lit(r)))
    assert resolve("https://a.b/c/d?q", "../e/./f.m4s") == "https://a.b/e/f.m4s"
    assert resolve("https://a.b/c/d", "//x/y") == "https://x/y"
    assert resolve("https://a.b/c/d?q", "?z") == "https://a.b/c/d?z"
    assert resolve("https://a.b/c/d", "http://q/") == "http://q/"
    expand = lambda t: value(spark, C.expand_template(F.lit(t), F.lit("r1"), F.lit(42), F.lit(900), F.lit(5)))
    assert expand("$RepresentationID$/$Number%05d$-$Time$.m4s") == "r1/00042-900.m4s"
    assert expand("$$a$Foo$ $Number%999d$ $open") == "$a$Foo$ 42 $open"
    ns = lambda s: value(spark, C.xs_duration_ns(F.lit(s)))
    assert ns("PT1H2M3.5S") == 3_723_500_000_000 and ns("P1DT0,5S") == 86_400_500_000_000 and ns("-PT1S") == -1_000_000_000
    assert ns("P") is None and ns("PT") is None and ns("1S") is None and ns("P1H") is None


def test_prepared_templates_fill_in_what_expanded_ones_do(spark):
    ends = ["$RepresentationID$/$Number%05d$-$Time$.m4s", "$$a$Foo$ $Number%999d$ $open", "x", "", "$Number%03d$$Number%3d$$Time%012d$", "$Bandwidth%06d$$Bandwidth$", "a\x01b$Number$\x01", "$Number%x$$Time%d$"]
    values = [(t, i, n, m, b) for t in ends for i, n, m, b in (("r", 42, 900, 5), (None, -3, 0, None), ("$\x01", 123456, 10**13, -1))]
    df = spark.createDataFrame(values, "t string, i string, n long, m long, b long")
    whole = C.expand_template(F.col("t"), F.col("i"), F.col("n"), F.col("m"), F.col("b"))
    steps = C.filled_template(C.prepared_template(F.col("t"), F.col("i"), F.col("b")), F.col("n"), F.col("m"))
    assert [r for r in df.select("*", whole.alias("w"), steps.alias("s")).collect() if r.w != r.s] == []


def test_cache_headers(spark):
    info = lambda h: tuple(value(spark, C.cache_info(F.create_map(*(F.lit(x) for kv in h.items() for x in kv)))))
    assert info({"age": "7", "X-Cache": "HIT, MISS"}) == (7, "MISS")
    assert info({"Age": "-1", "CF-Cache-Status": "UPDATING"}) == (None, "STALE")
    assert info({"x": "y"}) == (None, "")


def test_pssh_boxes(spark):
    good = (36).to_bytes(4, "big") + b"pssh" + bytes(4) + bytes(range(16)) + (4).to_bytes(4, "big") + b"abcd"
    box = lambda b: value(spark, C.pssh(F.lit(bytearray(b))))
    assert box(good)["error"] is None and box(good)["data_size"] == 4 and box(good)["system_id"].startswith("00010203-0405")
    assert [box(b)["error"] for b in (good[:20], good[:4] + b"xxxx" + good[8:], good + b"z", good[:28] + (9).to_bytes(4, "big") + good[32:])] == ["short", "signature", "size", "data"]
    uri = "data:text/plain;base64," + base64.b64encode(good).decode()
    assert bytes(value(spark, C.data_uri_bytes(F.lit(uri)))) == good


MEDIA = """#EXTM3U
#EXT-X-TARGETDURATION:6
#EXT-X-MEDIA-SEQUENCE:10
#EXT-X-KEY:METHOD=AES-128,URI="k?a,b",URI="k2"
#EXT-X-MAP:URI="i.mp4"
#EXT-X-PROGRAM-DATE-TIME:2024-01-01T00:00:00Z
#EXTINF:6.0,title
a.ts
stray.ts
#EXT-X-KEY:METHOD=NONE
#EXTINF:bad,
#EXT-X-DISCONTINUITY
skipped.ts
#EXTINF:4,
b.ts
#EXT-X-PART:URI="p1",DURATION=1.0,INDEPENDENT=YES
"""


def test_hls_media(spark):
    df = spark.createDataFrame([(1, MEDIA), (2, ""), (3, None)], "fetch_id int, body string")
    got = [(r.uri, r.duration, r.pdt is not None, r.discontinuity, r.key and r.key.uri, r.map.uri) for r in hls.hls_segments(df).orderBy("ord").collect()]
    assert got == [("a.ts", 6.0, True, False, "k2", "i.mp4"), ("b.ts", 4.0, False, True, None, "i.mp4")]
    assert [(r.uri, r.independent) for r in hls.hls_parts(df).collect()] == [("p1", True)]
    head = hls.hls_media(df).first()
    assert (head.target_duration, head.media_sequence, head.endlist) == (6, 10, False)
    assert hls.live_edge(hls.hls_segments(df)).first()["edge"].isoformat() == "2024-01-01T00:00:10"


MPD = """<?xml version="1.0"?><MPD type="static" mediaPresentationDuration="PT30S"><Period>%s</Period></MPD>"""
LIVE = '<AdaptationSet mimeType="video/mp4"><SegmentTemplate timescale="1000" media="$Number$.m4s"><SegmentTimeline>%s</SegmentTimeline></SegmentTemplate><Representation id="v" bandwidth="1"/></AdaptationSet>'


def reps(spark, body):
    df = spark.createDataFrame([(1, "https://o/x/m.mpd", body)], "fetch_id int, url string, body string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    return dash.representations(dash.adaptation_sets(dash.periods(dash.mpd(df))))


def test_timeline_gap_and_open_run(spark):
    got = reps(spark, MPD % (LIVE % '<S t="0" d="4000" r="1"/><S t="12000" d="4000"/>'))
    assert [(r.at_ns, r.delta_ns, r.number) for r in dash.timeline_breaks(got).collect()] == [(8_000_000_000, 4_000_000_000, 3)]
    assert [r.number for r in dash.dash_segments(got).orderBy("n").collect()] == [1, 2, 3]
    assert dash.timeline_breaks(reps(spark, MPD % (LIVE % '<S t="0" d="4000" r="-1"/><S t="12000" d="4000"/>'))).count() == 0


def test_static_number_addressing_rounds_up(spark):
    body = MPD % '<AdaptationSet contentType="video"><SegmentTemplate duration="4" media="v0/seg-$Number%05d$.m4s"/><Representation id="v"/></AdaptationSet>'
    uris = [r.uri for r in dash.dash_segments(reps(spark, body)).orderBy("n").collect()]
    assert len(uris) == 8 and uris[-1] == "https://o/x/v0/seg-00008.m4s"


def test_bad_documents_are_errors(spark):
    df = spark.createDataFrame([(1, "<html/>"), (2, MPD % '<AdaptationSet><Representation bandwidth="x"/></AdaptationSet>'), (3, MPD % "")], "fetch_id int, body string")
    assert [r.error for r in dash.parsed(df).orderBy("fetch_id").collect()] == ["root", "number", None]


def packet(cc, pid=100, flags=0x10, payload=b""):
    return bytes([0x47, pid >> 8, pid & 255, flags | cc]) + payload.ljust(184, b"\0")


def errors(spark, packets):
    df = spark.createDataFrame([(1, bytearray(b"".join(packets)))], "fetch_id int, data binary")
    return transport.ts_analysis(df).first()


def test_transport_counters(spark):
    assert errors(spark, [packet(c % 16) for c in range(14, 20)]).continuity_errors == 0
    assert errors(spark, [packet(1), packet(3)]).continuity_errors == 1
    assert errors(spark, [packet(1), packet(1), packet(2)]).continuity_errors == 0
    assert errors(spark, [packet(1), packet(1), packet(1), packet(1)]).continuity_errors == 1
    reset = packet(9, flags=0x30, payload=bytes([1, 0x80]))
    assert errors(spark, [packet(1), reset, packet(10)]).continuity_errors == 0
    assert not errors(spark, [b"x" * 188]).aligned
    odd = errors(spark, [b"ab", packet(1), packet(2), packet(3), packet(4), b"z"])
    assert odd.aligned and odd.truncated and odd.packets == 4


def test_transport_tables(spark):
    pat = bytes([0, 0, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE1, 0x00, 0, 0, 0, 0])
    pmt = bytes([0, 2, 0xB0, 18, 0, 1, 0xC1, 0, 0, 0xE0, 101, 0xF0, 0, 0x1B, 0xE0, 101, 0xF0, 0, 0, 0, 0, 0])
    start = lambda pid, body: bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10]) + body.ljust(184, b"\xff")
    df = spark.createDataFrame([(1, bytearray(start(0, pat) + start(256, pmt) + packet(1, 101) + packet(5, 101)))], "fetch_id int, data binary")
    streams = transport.ts_streams(df)
    assert [(r.pid, r.type, r.pcr_pid) for r in streams.collect()] == [(101, 27, 101)]
    got = transport.ts_analysis(df).first()
    assert got.has_pat and got.has_pmt and got.continuity_errors == 1
    assert [(r.i, r.pid, r.pusi, r.cc) for r in transport.ts_packets(df).orderBy("i").collect()] == [(0, 0, True, 0), (1, 256, True, 0), (2, 101, False, 1), (3, 101, False, 5)]
    # a program map before the table that names its PID does not count
    early = spark.createDataFrame([(1, bytearray(start(256, pmt) + start(0, pat) + packet(1, 101)))], "fetch_id int, data binary")
    assert transport.ts_streams(early).count() == 0 and not transport.ts_analysis(early).first().has_pmt
    worst = transport.worst_pid(transport.name_pid(transport.ts_pid_stats(df), streams)).first()
    assert (worst.pid, worst.name) == (101, "H.264")


def test_rules_fire_and_stay_silent(spark):
    poll = "fetch_id int, poll_id int, vantage string, target string, variant string, kind string, ts timestamp, url string, status int, error string, body string, body_len long"
    rows = [(i, i, "v", "t", "", "manifest", None, "u", s, e, "#EXTINF", 9) for i, (s, e) in enumerate([(200, None), (404, None), (200, "refused")])]
    found = rules.run_rules(["manifest_fetch"], {"fetches": spark.createDataFrame(rows, poll)}).collect()
    assert sorted(r.message for r in found) == ["refused for u", "status 404 for u"]
    bodies = spark.createDataFrame([(1, MEDIA)], "fetch_id int, body string")
    fetches = spark.createDataFrame([(1, 1, "v", "t", "", "media", None, "u", 200, None, "", 9)], poll)
    media = rules.with_poll(hls.hls_media(bodies).join(hls.segment_summary(bodies), "fetch_id"), fetches)
    targets = spark.createDataFrame([("t", True, 60.0)], "name string, expect_live boolean, min_window_s double")
    got = rules.run_rules(["targetduration_missing", "hls_no_segments", "hls_short_window", "unexpected_endlist"], {"media": media, "targets": targets}).collect()
    assert [r.check for r in got] == ["short_window"]
    assert len({n for n, _, _ in rules.RULES.values()}) >= 70
