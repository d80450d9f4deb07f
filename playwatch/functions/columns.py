"""Column functions: strings, clocks, numbers, codecs, keys, cache headers, URLs and templates. Columns in, a column out."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000

# DRM system ids, codec families, stream types, cache headers and weekdays.
DRM = {
    "edef8ba9-79d6-4ace-a3c8-27dcd51d21ed": "Widevine",
    "9a04f079-9840-4286-ab92-e65be0885f95": "PlayReady",
    "94ce86fb-07ff-4f43-adb8-93d2fa968ca2": "FairPlay",
    "1077efec-c0b2-4d02-ace3-3c1e52e2fb4b": "Common Encryption",
}
CODECS = {
    "avc1": "h264", "avc3": "h264", "hvc1": "hevc", "hev1": "hevc", "dvh1": "hevc", "dvhe": "hevc", "vp09": "vp9", "vp08": "vp8", "av01": "av1",
    "mp4a": "aac", "ac-3": "ac3", "ec-3": "eac3", "opus": "opus", "flac": "flac",
}
KINDS = {"h264": "video", "hevc": "video", "av1": "video", "vp9": "video", "vp8": "video", "aac": "audio", "ac3": "audio", "eac3": "audio", "opus": "audio", "flac": "audio"}
HIT_HEADERS = ["x-cache", "x-cached", "cf-cache-status", "x-cache-status", "x-cache-remote"]
WEEKDAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
RANKS = {"critical": 0, "warning": 1}


def lookup(table: dict, key: Column) -> Column:
    """A literal table; null where it lacks the key."""
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items()))), key)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# Numbers and strings


def safe_float(c: Column) -> Column:
    """A number, 0 where there is none."""
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0))


def safe_int(c: Column) -> Column:
    """A whole number, a fraction cut off, 0 where there is none."""
    return F.coalesce(F.trim(c).try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def fmt1(c: Column) -> Column:
    return F.format_string("%.1f", c.cast("double"))


def pct(c: Column) -> Column:
    return F.concat(F.format_string("%.0f", c.cast("double") * 100), F.lit("%"))


def quote(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def named_or_position(name: Column, ord: Column) -> Column:
    return F.coalesce(blank_to_null(name), F.concat(F.lit("#"), ord.cast("string")))


def describe_track(kind: Column, lang: Column) -> Column:
    return F.concat_ws(" ", blank_to_null(kind), blank_to_null(lang))


def blocking_query(url: Column, msn: Column, part: Column) -> Column:
    """The URL that asks a server to hold its answer until that part exists; no part below 0."""
    mark = F.when(url.contains("?"), "&").otherwise("?")
    own = F.concat(url, mark, F.lit("_HLS_msn="), msn.cast("string"))
    return F.when(part >= 0, F.concat(own, F.lit("&_HLS_part="), part.cast("string"))).otherwise(own)


def short_name(name: Column, prefix: str) -> Column:
    return F.regexp_replace(name, f"^{prefix}", "")


def hex4(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(c), 4, "0")))


def hex2(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(c), 2, "0")))


def series_key(name: Column, labels: Column) -> Column:
    """name{k="v",...} with labels in order; the bare name without labels."""
    own = F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, F.concat(name, F.lit("{"), own, F.lit("}"))).otherwise(name)


# Clocks


def clock_minutes(c: Column) -> Column:
    """Minutes of a clock HH:MM; null where it is none."""
    hour, minute = (F.regexp_extract(c, r"^(\d{1,2}):(\d{2})$", i).try_cast("int") for i in (1, 2))
    return F.when((hour < 24) & (minute < 60), hour * 60 + minute)


def weekday_no(c: Column) -> Column:
    """0 for Sunday to 6 of a weekday's name or its first three letters in any case; null otherwise."""
    low = F.lower(F.trim(c))
    full = {n: i for i, n in enumerate(["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"])}
    return lookup(full | {n: i for i, n in enumerate(WEEKDAYS)}, low)


def local_minute(ts: Column, tz: Column) -> Column:
    own = F.from_utc_timestamp(ts, tz)
    return F.hour(own) * 60 + F.minute(own)


def local_weekday(ts: Column, tz: Column) -> Column:
    return F.dayofweek(F.from_utc_timestamp(ts, tz)) - 1


def parse_pdt(c: Column) -> Column:
    """A wall-clock stamp with an offset, Z or no zone (UTC); null where it is none."""
    return F.when(F.trim(c).rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)?$"), F.try_to_timestamp(F.trim(c)))


def xs_datetime(c: Column) -> Column:
    own = F.trim(c)
    return F.when(own.rlike(r"^\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?)?$"), F.try_to_timestamp(own))


def _rounded(size: int) -> Callable[[Column, Column], Column]:
    return lambda a, x: a + F.round(x.cast("double") * float(size)).cast("long")


def xs_duration_ns(c: Column) -> Column:
    """Nanoseconds of an xs:duration (a year is 365 days, a month 30); null where it is none. Fields may stand in any order."""
    own = F.replace(F.trim(c), F.lit(","), F.lit("."))
    body = F.regexp_extract(own, r"^[+-]?P(.*)$", 1)
    number = r"(?:\d+\.?\d*|\.\d+)"
    valid = own.rlike(rf"^[+-]?P(?:{number}[YMWD])*(?:T(?:{number}[HMS]|{number}[YWD])*)?$") & own.rlike(rf"{number}[YMWDHS]")
    date, time = F.split_part(body, F.lit("T"), F.lit(1)), F.split_part(body, F.lit("T"), F.lit(2))
    day = 86_400 * NS
    dates = {"Y": 365 * day, "M": 30 * day, "W": 7 * day, "D": day}
    times = {"H": 3600 * NS, "M": 60 * NS, "S": NS, "Y": 365 * day, "W": 7 * day, "D": day}

    def total(part: Column, units: dict[str, int]) -> Column:
        sums = F.lit(0).cast("long")
        for unit, size in units.items():
            every = F.regexp_extract_all(part, F.lit(rf"({number}){unit}"), F.lit(1))
            sums += F.aggregate(every, F.lit(0).cast("long"), _rounded(size))
        return sums

    amount = total(date, dates) + total(time, times)
    return F.when(valid, F.when(own.startswith("-"), -amount).otherwise(amount))


def ticks_to_ns(ticks: Column, timescale: Column) -> Column:
    scale = F.when(timescale == 0, 1).otherwise(timescale).cast("double")
    return (ticks.cast("double") / scale * float(NS)).cast("long")


def ns_to_ticks(ns: Column, timescale: Column) -> Column:
    return (ns.cast("double") / float(NS) * timescale.cast("double")).cast("long")


# Severities and thresholds


def severity_rank(c: Column) -> Column:
    return F.coalesce(lookup(RANKS, c), F.lit(2))


def parse_severity(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("critical", "crit"), "critical").when(low.isin("warning", "warn"), "warning").otherwise("info")


def severity_for(size: Column, bar: Column) -> Column:
    """Critical from the bar on, else a warning; the sign of the size does not count."""
    return F.when(F.abs(size) >= bar, "critical").otherwise("warning")


def stall_ns(segment_ns: Column, update_ns: Column) -> Column:
    return F.greatest(F.lit(6 * NS), 3 * F.coalesce(segment_ns, F.lit(0)), 3 * F.coalesce(update_ns, F.lit(0)))


def staleness_ns(segment_ns: Column, latency_max_ms: Column, latency_target_ms: Column, delay_ns: Column) -> Column:
    """How old an edge may be: the declared maximum, or twice the target, or the suggested delay, with four segments' slack."""
    four = 4 * F.coalesce(segment_ns, F.lit(0)).cast("long")
    delay = F.coalesce(delay_ns, F.lit(0)).cast("long")
    latency_max_ms, latency_target_ms = latency_max_ms.cast("long"), latency_target_ms.cast("long")
    by_target = F.greatest(2 * latency_target_ms * 1_000_000, four)
    plain = F.greatest(F.lit(30 * NS), four, F.when(delay > 0, delay + four).otherwise(0))
    return F.when(latency_max_ms > 0, latency_max_ms * 1_000_000).when(latency_target_ms > 0, by_target).otherwise(plain)


def content_fraction(run: Column, seconds: Column) -> Column:
    """Part of a segment that a run covers, half a second of it aside, between 0 and 1."""
    return F.when((seconds > 0) & (run > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), run / F.greatest(seconds - 0.5, F.lit(1e-9))))).otherwise(0.0)


def is_silent(has_audio: Column, peak: Column) -> Column:
    return F.coalesce(has_audio & (peak <= -60), F.lit(False))


def period_end(start: Column, duration: Column) -> Column:
    return F.when(duration > 0, start + duration)


def or_default(c: Column, other: Column) -> Column:
    return F.coalesce(c, other)


def display_format(kind: Column) -> Column:
    return F.coalesce(blank_to_null(F.lower(F.trim(kind))), F.lit("auto"))


def is_down(up: Column) -> Column:
    return F.coalesce(~up, F.lit(False))


def bool_of(gauges: Column, name: str) -> Column:
    """A 0/1 gauge of a map as true, false or null (not observed)."""
    return F.try_element_at(gauges, F.lit(name)) != 0


def bool_gauge(c: Column) -> Column:
    return c.cast("double")


# Arrays


def has_role(roles: Column, role: str) -> Column:
    return F.coalesce(F.exists(roles, lambda r: F.lower(r) == role.lower()), F.lit(False))


def type_wanted(wanted: Column, kind: Column) -> Column:
    return (F.coalesce(F.size(wanted), F.lit(0)) < 1) | F.coalesce(F.exists(wanted, lambda w: F.lower(w) == F.lower(kind)), F.lit(False))


def scope_contains(scope: Column, value: Column) -> Column:
    return (F.coalesce(F.size(scope), F.lit(0)) < 1) | F.coalesce(F.array_contains(scope, value), F.lit(False))


def id_list(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != "")


def kinds(streams: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(streams, lambda s: s["codec_type"])))


def separate_kinds(audio_group: Column, video_group: Column) -> Column:
    return F.array_compact(F.array(F.when(blank_to_null(audio_group).isNotNull(), "audio"), F.when(blank_to_null(video_group).isNotNull(), "video")))


def first_of_kind(streams: Column, kind: str) -> Column:
    return F.get(F.filter(streams, lambda s: s["codec_type"] == kind), F.lit(0))


# Codecs, keys, boxes


def codec_family(c: Column) -> Column:
    low = F.lower(F.trim(c))
    special = F.when(low == "mp4a.a5", "ac3").when(low == "mp4a.a6", "eac3")
    return F.coalesce(special, lookup(CODECS, F.split_part(low, F.lit("."), F.lit(1))))


def codec_kind(family: Column) -> Column:
    return lookup(KINDS, family)


def parse_resolution(c: Column, part: int) -> Column:
    return F.regexp_extract(F.trim(c), r"^(\d+)[xX](\d+)$", part).try_cast("int")


def display_width(width: Column, sar: Column) -> Column:
    num, den = (F.split_part(sar, F.lit(":"), F.lit(i)).try_cast("long") for i in (1, 2))
    return F.when((num > 0) & (den > 0), F.floor((width * num + F.floor(den / 2)) / den)).otherwise(width).cast("int")


def drm_name(system: Column) -> Column:
    return F.coalesce(lookup(DRM, F.lower(system)), F.concat(F.lit("unknown ("), system, F.lit(")")))


def valid_kid(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit("")).rlike("^[0-9a-fA-F]{32}$")


def valid_iv(c: Column) -> Column:
    return (F.coalesce(c, F.lit("")) == "") | c.rlike("^0[xX][0-9a-fA-F]{32}$")


def key_flags(method: Column, uri: Column, keyformat: Column) -> Column:
    """encrypted, identity, drm (name or null) and fetchable of a key's attributes."""
    own = F.coalesce(keyformat, F.lit(""))
    encrypted = ~F.coalesce(method, F.lit("")).isin("", "NONE")
    identity = own.isin("", "identity")
    bare = F.lower(F.regexp_replace(own, "^urn:uuid:", ""))
    drm = F.when(own == "com.apple.streamingkeydelivery", "FairPlay").when(own == "com.microsoft.playready", "PlayReady").otherwise(lookup(DRM, bare))
    scheme = F.lower(F.regexp_extract(F.coalesce(uri, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    fetchable = (F.coalesce(uri, F.lit("")) != "") & scheme.isin("", "http", "https")
    return F.struct(encrypted.alias("encrypted"), identity.alias("identity"), drm.alias("drm"), fetchable.alias("fetchable"))


def data_uri_bytes(uri: Column) -> Column:
    """The payload of a base64 data URI; null where it is none."""
    return F.try_to_binary(blank_to_null(F.regexp_extract(F.coalesce(uri, F.lit("")), r"^data:[^,]*;base64,(.*)$", 1)), F.lit("base64"))


def be32(data: Column, at: Column) -> Column:
    """The big-endian number of four bytes from a 0-based place on."""
    return F.conv(F.hex(F.substr(data, at + 1, F.lit(4))), 16, 10).cast("long")


def uuid_text(data: Column, at: Column) -> Column:
    h = F.lower(F.hex(F.substr(data, at + 1, F.lit(16))))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def looks_like_pssh(data: Column) -> Column:
    return (F.length(data) >= 8) & (F.hex(F.substring(data, 5, 4)) == "70737368")


def pssh(data: Column) -> Column:
    """version, system_id, kids, data_size and error of a protection box; the first defect found in reading order is the error."""
    size = F.length(data).cast("long")
    zero = lambda n: F.lit(n).cast("long")
    version = F.conv(F.hex(F.substring(data, 9, 1)), 16, 10).cast("int")
    n_kids = F.when(version > 0, be32(data, zero(28))).otherwise(0)
    after = F.when(version > 0, 32 + 16 * n_kids).otherwise(28)
    data_size = be32(data, after)
    error = (
        F.when(size < 32, "short").when(~looks_like_pssh(data), "signature").when(be32(data, zero(0)) != size, "size")
        .when((version > 0) & (size < 32 + 16 * n_kids), "kids").when(size < after + 4, "truncated").when(size < after + 4 + data_size, "data")
    )
    kids = F.when((version > 0) & (n_kids > 0), F.transform(F.sequence(F.lit(0).cast("long"), n_kids - 1), lambda i: uuid_text(data, 32 + 16 * i)))
    ok = error.isNull() & data.isNotNull()
    return F.struct(
        F.when(ok, version).alias("version"), F.when(ok, uuid_text(data, zero(12))).alias("system_id"),
        F.when(ok, F.coalesce(kids, F.array().cast("array<string>"))).alias("kids"), F.when(ok, data_size).alias("data_size"), error.alias("error"),
    )


# Cache headers


def normalise_hit(c: Column) -> Column:
    """STALE, MISS, HIT or the empty text by the last of a header's elements, in that order."""
    last = F.lower(F.trim(F.try_element_at(F.split(F.coalesce(c, F.lit("")), ","), F.lit(-1))))
    return F.when(last.rlike("stale|updating"), "STALE").when(last.rlike("miss|expired|bypass"), "MISS").when(last.rlike("hit|revalidated"), "HIT").otherwise("")


def cache_info(headers: Column) -> Column:
    """age_s (null without a valid Age header) and hit of response headers."""
    low = F.transform_keys(headers, lambda k, _: F.lower(k))
    age = F.trim(F.try_element_at(low, F.lit("age")))
    hits = [blank_to_null(normalise_hit(F.try_element_at(low, F.lit(h)))) for h in HIT_HEADERS]
    return F.struct(F.when(age.rlike(r"^[+]?\d+$"), age.try_cast("long")).alias("age_s"), F.coalesce(*hits, F.lit("")).alias("hit"))


def _cached(*parts: Column) -> Column:
    return F.concat(F.lit(" [cache: "), F.concat_ws(", ", *parts))


def _age(age: Column) -> Column:
    return F.concat(F.lit("Age "), fmt1(age), F.lit("s"))


def cache_describe(age: Column, hit: Column) -> Column:
    nothing = age.isNull() & (hit == "")
    return F.when(nothing, "").otherwise(F.concat(_cached(_age(age), blank_to_null(hit)), F.lit("]")))


def cache_explain(age: Column, hit: Column, unchanged_s: Column) -> Column:
    """Which layer the evidence points to when a manifest has been unchanged for so long."""
    stale = F.concat(_cached(F.lit("STALE"), _age(age)), F.lit(" -- the edge serves expired content]"))
    blind = F.when(hit == "HIT", " [cache: HIT, no Age header -- perhaps a stale edge]").otherwise(cache_describe(age, hit))
    base = _cached(_age(age), blank_to_null(hit))
    judged = F.when(age >= unchanged_s, F.concat(base, F.lit(" -- old enough to explain the freeze]"))).otherwise(F.concat(base, F.lit(" -- fresher than the freeze]")))
    return F.when(hit == "STALE", stale).when(age.isNull(), blind).otherwise(judged)


def cache_lag(age: Column, behind_s: Column) -> Column:
    """A lag split in two: cache_s, and packager_s for what was missing when the response was made. Null without an age."""
    # least and greatest skip nulls, so the age is tested by itself
    cached = F.when(age.isNotNull(), F.greatest(F.lit(0.0), F.least(age.cast("double"), behind_s)))
    return F.struct(cached.alias("cache_s"), (F.greatest(behind_s, F.lit(0.0)) - cached).alias("packager_s"))


def cache_attribute_lag(age: Column, hit: Column, behind_s: Column) -> Column:
    base = _cached(_age(age), blank_to_null(hit))
    own = behind_s - age
    split = (
        F.when(age <= 0, F.concat(base, F.lit(" -- fetched fresh: all of it is the packager]")))
        .when(own <= 0, F.concat(base, F.lit(" -- the cache's age explains all of it]")))
        .otherwise(F.concat(base, F.lit(" -- of that the packager was behind by "), fmt1(own), F.lit("s]")))
    )
    return F.when((hit == "STALE") & age.isNull(), " [cache: STALE -- the edge serves expired content]").when(age.isNull(), cache_describe(age, hit)).otherwise(split)


# URLs and templates


def resolve_url(base: Column, ref: Column) -> Column:
    """A URL reference against its base: scheme, authority, path (dot segments removed) and query."""
    whole = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"
    bs, ba, bp, bq = (F.regexp_extract(F.coalesce(base, F.lit("")), whole, i) for i in (1, 2, 3, 4))
    own = F.trim(F.coalesce(ref, F.lit("")))
    rs, ra, rp, rq = (F.regexp_extract(own, whole, i) for i in (1, 2, 3, 4))
    joined = F.when(rp.startswith("/"), rp).otherwise(F.concat(F.regexp_replace(bp, "[^/]*$", ""), rp))
    joined = F.when((ba != "") & ~joined.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)
    parts = F.split(joined, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.least(F.size(a), F.lit(1))))).otherwise(F.concat(a, F.array(x))),
    )
    path = F.array_join(kept, "/")
    path = F.when(F.try_element_at(parts, F.lit(-1)).isin(".", "..") & ~path.endswith("/"), F.concat(path, F.lit("/"))).otherwise(path)
    head = F.concat(F.when(bs != "", F.concat(bs, F.lit(":"))).otherwise(""), F.when(ba != "", F.concat(F.lit("//"), ba)).otherwise(""))
    same = F.when(rp == "", F.concat(head, bp, F.when(rq != "", rq).otherwise(bq))).otherwise(F.concat(head, path, rq))
    return F.when(rs != "", own).when(ra != "", F.concat(bs, F.lit(":"), own)).otherwise(same)


def expand_template(template: Column, rep_id: Column, number: Column, time: Column, bandwidth: Column) -> Column:
    """$RepresentationID$, $Number$, $Time$ and $Bandwidth$ filled in, with %0Nd for at most two digits of width; $$ is a dollar.

    Unknown identifiers stay, as does an unterminated dollar with all after it.
    """
    parts = F.split(template, r"\$")
    n = F.size(parts)

    def filled(token: Column) -> Column:
        name, tag = F.split_part(token, F.lit("%"), F.lit(1)), F.regexp_extract(token, r"^[^%]*(%.*)$", 1)
        value = F.when(name == "Number", F.greatest(number, F.lit(0))).when(name == "Time", time).when(name == "Bandwidth", F.greatest(bandwidth, F.lit(0)))
        text = value.cast("string")
        width = F.coalesce(F.regexp_extract(tag, r"^%0?(\d{0,2})d$", 1).try_cast("int"), F.lit(0))
        filler = F.when(tag.startswith("%0"), "0").otherwise(" ")
        wide = F.concat(F.repeat(filler, F.greatest(width - F.length(text), F.lit(0))), text)
        return (
            F.when(token == "", "$").when(name == "RepresentationID", F.coalesce(rep_id, F.lit("")))
            .when(value.isNotNull(), wide).otherwise(F.concat(F.lit("$"), token, F.lit("$")))
        )

    # odd places are tokens, but for a last one that no dollar ends
    open_end = n % 2 == 0
    done = F.transform(parts, lambda p, i: F.when(open_end & (i == n - 1), F.concat(F.lit("$"), p)).when(i % 2 == 1, filled(p)).otherwise(p))
    return F.when(template.contains("$"), F.array_join(done, "")).otherwise(template)


#: Stands around what a prepared template leaves open.
_OPEN = "\x01"


def prepared_template(template: Column, rep_id: Column, bandwidth: Column) -> Column:
    """A template with all filled in that a representation has once; ``filled_template`` puts in a segment's number and time.

    Together they are ``expand_template``, whose patterns would otherwise be matched for each segment.
    """
    text = lambda c: F.replace(c, F.lit(_OPEN), F.lit(f"{_OPEN}={_OPEN}"))

    def token(t: Column) -> Column:
        name, tag = F.split_part(t, F.lit("%"), F.lit(1)), F.regexp_extract(t, r"^[^%]*(%.*)$", 1)
        width = F.coalesce(F.regexp_extract(tag, r"^%0?(\d{0,2})d$", 1).try_cast("int"), F.lit(0))
        filler = F.when(tag.startswith("%0"), "0").otherwise(" ")
        own = F.greatest(bandwidth, F.lit(0)).cast("string")
        later = F.concat(F.lit(_OPEN), F.substring(name, 1, 1), F.when(width > 0, F.concat(filler, width.cast("string"))).otherwise(""), F.lit(_OPEN))
        return (
            F.when(t == "", "$").when(name == "RepresentationID", text(F.coalesce(rep_id, F.lit("")))).when(name.isin("Number", "Time"), later)
            .when(name == "Bandwidth", F.concat(F.repeat(filler, F.greatest(width - F.length(own), F.lit(0))), own)).otherwise(text(F.concat(F.lit("$"), t, F.lit("$"))))
        )

    def made(parts: Column) -> Column:
        n = F.size(parts)
        return F.array_join(F.transform(parts, lambda p, i: F.when((n % 2 == 0) & (i == n - 1), text(F.concat(F.lit("$"), p))).when(i % 2 == 1, token(p)).otherwise(text(p))), "")

    # an array of one element, so that the template is split once
    return F.get(F.transform(F.array(F.split(template, r"\$")), made), F.lit(0))


def filled_template(prepared: Column, number: Column, time: Column) -> Column:
    """See prepared_template. number and time are not null."""
    plain = F.greatest(number, F.lit(0)).cast("string"), time.cast("string")

    def wide(p: Column) -> Column:
        text = F.when(p.startswith("N"), plain[0]).otherwise(plain[1])
        return F.concat(F.repeat(F.substring(p, 2, 1), F.greatest(F.substring(p, 3, 2).cast("int") - F.length(text), F.lit(0))), text)

    each = lambda p, i: F.when(i % 2 == 0, p).when(p == "N", plain[0]).when(p == "T", plain[1]).when(p == "=", _OPEN).otherwise(wide(p))
    return F.array_join(F.transform(F.split(prepared, _OPEN), each), "")


def byte_range(c: Column) -> Column:
    """length and offset (null without one) of n[@o]; null where it is none."""
    pattern = r"^(\d+)(?:@(\d+))?$"
    length, offset = (blank_to_null(F.regexp_extract(F.trim(c), pattern, i)).try_cast("long") for i in (1, 2))
    return F.when(length.isNotNull(), F.struct(length.alias("length"), offset.alias("offset")))


def template_defaults(timescale: Column, start_number: Column, offset: Column, ato: Column) -> Column:
    return F.struct(
        F.coalesce(F.nullif(timescale, F.lit(0)), F.lit(1)).cast("long").alias("timescale"), F.coalesce(start_number, F.lit(1)).cast("long").alias("start_number"),
        F.coalesce(offset, F.lit(0)).cast("long").alias("pto"), F.coalesce(ato, F.lit(0.0)).alias("ato"),
    )
