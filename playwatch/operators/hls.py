"""HLS playlists decoded to tables. Input: fetch_id and body; every table is keyed by fetch_id and an ordinal.

A playlist is one row, and all of it is decoded within that row: the body becomes its trimmed, non-empty lines, one array, and every
table is a transformation of that array that is exploded at the end, so decoding moves no data between tasks. A URI line becomes a
segment if a valid EXTINF stands between the URI line before and itself; date and discontinuity wait for the next accepted segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playwatch.functions.columns import blank_to_null, parse_pdt, safe_float, safe_int

#: Columns of a fetch that tables carry along where they are there.
POLL = ["poll_id", "vantage", "target", "variant", "ts", "url"]
BLANKS = "\t\n\x0b\x0c\r \x85\xa0"


def playlist_type(body: Column) -> Column:
    return F.when(body.contains("#EXT-X-STREAM-INF"), "master").when(body.contains("#EXTINF"), "media").otherwise("unknown")


def hls_attrs(c: Column) -> Column:
    """The attributes of a tag as entries (key, value); commas within quotes are kept, quotes are not. See ``attr``."""
    pair = r'([^=,]+)=("[^"]*"|[^,]*)'
    keys = F.transform(F.regexp_extract_all(c, F.lit(pair), F.lit(1)), F.trim)
    values = F.transform(F.regexp_extract_all(c, F.lit(pair), F.lit(2)), lambda v: F.trim(F.regexp_replace(F.trim(v), '^"|"$', "")))
    return F.arrays_zip(keys.alias("key"), values.alias("value"))


def attr(attrs: Column, name: str) -> Column:
    """The last value of an attribute; the empty text without one."""
    return F.coalesce(F.try_element_at(F.filter(attrs, lambda e: e["key"] == name), F.lit(-1))["value"], F.lit(""))


# Lines within a row


def with_lines(df: DataFrame) -> DataFrame:
    """df with ls: the trimmed, non-empty lines of its bodies."""
    if "ls" in df.columns:
        return df
    return df.withColumn("ls", body_lines(F.col("body")))


def body_lines(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a column that steps of a row refer to within their loops might be put in there whole."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _has(tag: str, line: Column) -> Column:
    """Whether a line carries a tag, with a value or bare."""
    return line.startswith(tag + ":") | (line == tag)


def _value(line: Column) -> Column:
    return F.when(line.contains(":"), F.regexp_replace(line, "^[^:]*:", "")).otherwise("")


def _last(found: Column) -> Column:
    """The last element that is not null."""
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(-1))


def _places(lines: Column, holds) -> Column:
    """0-based places of the lines of which ``holds`` is true."""
    return F.filter(F.transform(lines, lambda x, i: F.when(holds(x), i)), lambda i: i.isNotNull())


def _between(lines: Column, after: Column, until: Column) -> Column:
    """The lines after one place (null: from the start) and before another."""
    start = F.coalesce(after + 1, F.lit(0))
    return F.slice(lines, start + 1, F.greatest(until - start, F.lit(0)))


def _values(tag: str) -> Column:
    """Values of the lines that carry a tag, in order."""
    return F.transform(F.filter("ls", lambda x: _has(tag, x)), _value)


def carried(df: DataFrame) -> list[str]:
    return ["fetch_id", *(c for c in POLL if c in df.columns)]


def _table(df: DataFrame, rows: Column, *cols: Column) -> DataFrame:
    """A row for each element of ``rows``, numbered from 0 by ord; ``cols`` read the element as e."""
    own = carried(df)
    return exploded(df.select(*own, F.posexplode_outer(rows).alias("ord", "e"))).select(*own, "ord", *cols)


def exploded(df: DataFrame) -> DataFrame:
    """Without the rows that an empty array left. A plain explode would have Spark test the array for being empty in a filter below
    all the steps that make it, and so make it several times."""
    return df.filter("ord IS NOT NULL")


def _tagged(df: DataFrame, tag: str, *cols: Column) -> DataFrame:
    """A row for each line of a tag; ``cols`` read its attributes as a."""
    own = with_lines(df).select(*carried(df), F.posexplode_outer(_values(tag)).alias("ord", "v"))
    return exploded(own).select(*carried(df), "ord", hls_attrs(F.col("v")).alias("a")).select(*carried(df), "ord", *cols)


def _yes(c: Column) -> Column:
    return F.upper(c) == "YES"


def _a(name: str) -> Column:
    return attr(F.col("a"), name)


# Masters


def with_variants(df: DataFrame) -> DataFrame:
    """df with ls and infs: URI and the attributes in force of every variant, in order."""

    def variants(v: Column) -> Column:
        inf = lambda p, k: _last(F.transform(_between(v["ls"], F.get(v["uris"], k - 1), p), lambda x: F.when(_has("#EXT-X-STREAM-INF", x), _value(x))))
        each = F.transform(v["uris"], lambda p, k: F.struct(F.get(v["ls"], p).alias("uri"), inf(p, k).alias("inf")))
        return F.filter(each, lambda x: x["inf"].isNotNull())

    return with_lines(df).withColumn("infs", let(F.col("ls"), lambda ls: let(_with_uris(ls), variants)))


def _with_uris(ls: Column) -> Column:
    """ls and uris: the lines, and the places of those that are no tags."""
    return F.struct(ls.alias("ls"), _places(ls, lambda x: ~x.startswith("#")).alias("uris"))


def hls_variants(df: DataFrame) -> DataFrame:
    own = _table(with_variants(df), F.col("infs"), F.col("e.uri").alias("uri"), hls_attrs(F.col("e.inf")).alias("a"))
    return own.select(
        *carried(df), "ord", "uri", safe_int(_a("BANDWIDTH")).alias("bandwidth"), safe_int(_a("AVERAGE-BANDWIDTH")).alias("avg_bandwidth"),
        _a("RESOLUTION").alias("resolution"), _a("CODECS").alias("codecs"), safe_float(_a("FRAME-RATE")).alias("frame_rate"), _a("AUDIO").alias("audio_group"),
        _a("VIDEO").alias("video_group"), _a("SUBTITLES").alias("subtitle_group"), _a("CLOSED-CAPTIONS").alias("closed_captions"),
    )


def hls_renditions(df: DataFrame) -> DataFrame:
    return _tagged(
        df, "#EXT-X-MEDIA", F.upper(_a("TYPE")).alias("type"), _a("GROUP-ID").alias("group_id"), _a("NAME").alias("name"), _a("LANGUAGE").alias("language"),
        _a("URI").alias("uri"), _yes(_a("DEFAULT")).alias("is_default"), _yes(_a("AUTOSELECT")).alias("autoselect"), _yes(_a("FORCED")).alias("forced"),
        _a("CHANNELS").alias("channels"), _a("INSTREAM-ID").alias("instream_id"),
    )


_KEY = {"METHOD": "method", "URI": "uri", "IV": "iv", "KEYFORMAT": "keyformat", "KEYFORMATVERSIONS": "keyformatversions"}


def hls_session_keys(df: DataFrame) -> DataFrame:
    return _tagged(df, "#EXT-X-SESSION-KEY", *(_a(n).alias(c) for n, c in _KEY.items()))


# Media playlists


def hls_keys(df: DataFrame) -> DataFrame:
    return _tagged(df, "#EXT-X-KEY", *(_a(n).alias(c) for n, c in _KEY.items()))


def hls_maps(df: DataFrame) -> DataFrame:
    return _tagged(df, "#EXT-X-MAP", _a("URI").alias("uri"), _a("BYTERANGE").alias("byterange"))


def hls_preload_hints(df: DataFrame) -> DataFrame:
    return _tagged(df, "#EXT-X-PRELOAD-HINT", F.upper(_a("TYPE")).alias("type"), _a("URI").alias("uri"), _a("BYTERANGE-START").alias("byterange"))


def hls_media(df: DataFrame, *more: Column) -> DataFrame:
    """One header row for each fetch with lines, and ``more`` columns of its row; of repeated tags the last counts."""
    names = {"VERSION": "v", "TARGETDURATION": "td", "MEDIA-SEQUENCE": "ms", "PART-INF": "pi", "SERVER-CONTROL": "sc", "SKIP": "sk"}
    own = with_lines(df).filter(F.size("ls") > 0)
    own = own.select(*carried(df), *(_last(_values(f"#EXT-X-{t}")).alias(c) for t, c in names.items()), F.exists("ls", lambda x: x == "#EXT-X-ENDLIST").alias("endlist"), *more)
    at = lambda c, n: attr(hls_attrs(F.col(c)), n)
    known = [*carried(df), *names.values(), "endlist"]
    return own.select(
        *carried(df), *(c for c in own.columns if c not in known), safe_int(F.col("v")).alias("version"), safe_int(F.col("td")).alias("target_duration"), safe_int(F.col("ms")).alias("media_sequence"), "endlist",
        safe_float(at("pi", "PART-TARGET")).alias("part_target"), safe_int(at("sk", "SKIPPED-SEGMENTS")).alias("skipped"), F.col("sc").isNotNull().alias("has_control"),
        F.coalesce(_yes(at("sc", "CAN-BLOCK-RELOAD")), F.lit(False)).alias("can_block_reload"), safe_float(at("sc", "PART-HOLD-BACK")).alias("part_hold_back"),
        safe_float(at("sc", "HOLD-BACK")).alias("hold_back"), safe_float(at("sc", "CAN-SKIP-UNTIL")).alias("can_skip_until"),
    )


def with_accepted(df: DataFrame) -> DataFrame:
    """df with ls and acc: place, duration and the lines since the accepted segment before, of every accepted segment."""
    if "acc" in df.columns:
        return df
    number = lambda x: F.when(_has("#EXTINF", x), F.trim(F.split_part(_value(x), F.lit(","), F.lit(1))).try_cast("double"))

    def accepted(v: Column) -> Column:
        duration = lambda p, k: _last(F.transform(_between(v["ls"], F.get(v["uris"], k - 1), p), number))
        timed = F.filter(F.transform(v["uris"], lambda p, k: F.struct(p.alias("p"), duration(p, k).alias("d"))), lambda s: s["d"].isNotNull())
        own = lambda found: F.transform(found, lambda s, j: F.struct(s["p"].alias("p"), s["d"].alias("d"), _between(v["ls"], F.get(found, j - 1)["p"], s["p"]).alias("own")))
        return let(timed, own)

    return with_lines(df).withColumn("acc", let(F.col("ls"), lambda ls: let(_with_uris(ls), accepted)))


def with_segments(df: DataFrame) -> DataFrame:
    """df with segs: uri, duration, pdt, discontinuity, key and map (in force, null for none) of every segment, in order."""
    if "segs" in df.columns:
        return df
    tagged = lambda ls, tag, row: F.filter(F.transform(ls, lambda x, i: F.when(_has(tag, x), row(hls_attrs(_value(x)), i))), lambda r: r.isNotNull())

    def key(a: Column, i: Column) -> Column:
        found = F.struct(*(attr(a, n).alias(c) for n, c in list(_KEY.items())[:4]))
        return F.struct(i.alias("p"), F.when(~F.upper(attr(a, "METHOD")).isin("", "NONE"), found).alias("key"))

    maps = lambda a, i: F.struct(i.alias("p"), F.struct(attr(a, "URI").alias("uri"), attr(a, "BYTERANGE").alias("byterange")).alias("map"))
    # tags in blocks of about the root of their number: a segment looks at the blocks' first ones, then into one block
    before = lambda c, s, p: F.try_element_at(F.filter(c, lambda x: p(x) < s["p"]), F.lit(-1))
    in_force = lambda c, s: before(before(c, s, lambda b: F.get(b, 0)["p"]), s, lambda k: k["p"])
    pdt = lambda s: _last(F.transform(s["own"], lambda x: F.when(_has("#EXT-X-PROGRAM-DATE-TIME", x), parse_pdt(_value(x)))))

    def segments(v: Column) -> Column:
        return F.transform(
            v["acc"],
            lambda s: F.struct(
                F.get(v["ls"], s["p"]).alias("uri"), s["d"].alias("duration"), pdt(s).alias("pdt"), F.exists(s["own"], lambda x: x == "#EXT-X-DISCONTINUITY").alias("discontinuity"),
                in_force(v["ks"], s)["key"].alias("key"), in_force(v["ms"], s)["map"].alias("map"),
            ),
        )

    own = with_accepted(df)
    both = F.struct("ls", "acc")

    def blocks(tags: Column) -> Column:
        size = lambda t: F.ceil(F.sqrt(F.size(t))).cast("int")
        return let(tags, lambda t: F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1)), F.greatest(size(t), F.lit(1))), lambda i: F.slice(t, i, size(t)))))

    known = lambda v: F.struct(v["ls"].alias("ls"), v["acc"].alias("acc"), blocks(tagged(v["ls"], "#EXT-X-KEY", key)).alias("ks"), blocks(tagged(v["ls"], "#EXT-X-MAP", maps)).alias("ms"))
    return own.withColumn("segs", let(both, lambda v: let(known(v), segments)))


def hls_segments(df: DataFrame) -> DataFrame:
    """fetch_id, ord, uri, duration, pdt, discontinuity, key and map (in force, null for none) of every segment."""
    return _table(with_segments(df), F.col("segs"), "e.*")


def with_parts(df: DataFrame) -> DataFrame:
    """df with parts: attributes of the parts after the last segment, which are those of the segment in production."""
    if "parts" in df.columns:
        return df
    own = with_accepted(df)
    last = F.coalesce(F.try_element_at("acc", F.lit(-1))["p"], F.lit(-1))
    late = let(last, lambda p: F.filter(F.transform("ls", lambda x, i: F.when((i > p) & _has("#EXT-X-PART", x), hls_attrs(_value(x)))), lambda v: v.isNotNull()))
    part = lambda a: F.struct(
        attr(a, "URI").alias("uri"), safe_float(attr(a, "DURATION")).alias("duration"), _yes(attr(a, "INDEPENDENT")).alias("independent"), attr(a, "BYTERANGE").alias("byterange"),
        _yes(attr(a, "GAP")).alias("gap"),
    )
    return own.withColumn("parts", F.transform(late, part))


def hls_parts(df: DataFrame) -> DataFrame:
    """Parts after the last segment: those of the segment in production."""
    return _table(with_parts(df), F.col("parts"), "e.*")


def _seconds(rows: Column | str) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda a, s: a + s["duration"])


def part_columns() -> list[Column]:
    """n_parts, part_s and independent of rows with parts."""
    return [F.size("parts").cast("long").alias("n_parts"), _seconds("parts").alias("part_s"), F.exists("parts", lambda p: p["independent"]).alias("independent")]


def summary_columns() -> list[Column]:
    """window_s, clear, encrypted, discontinuities and edge (see live_edge) of rows with segs."""
    dated = F.array_max(_places(F.col("segs"), lambda s: s["pdt"].isNotNull()))
    tail = F.slice("segs", dated + 1, F.size("segs"))
    edge = F.unix_micros(F.get("segs", dated)["pdt"]) + F.round(_seconds(tail) * 1e6).cast("long")
    count = lambda holds: F.size(F.filter("segs", holds)).cast("long")
    return [
        _seconds("segs").alias("window_s"), count(lambda s: s["key"].isNull()).alias("clear"), F.exists("segs", lambda s: s["key"].isNotNull()).alias("encrypted"),
        count(lambda s: s["discontinuity"]).alias("discontinuities"), F.when(dated.isNotNull(), F.timestamp_micros(edge)).alias("edge"),
    ]


def segment_summary(df: DataFrame) -> DataFrame:
    """fetch_id, n_segments and summary_columns of every playlist with segments, within its row."""
    own = with_segments(df)
    sums = F.struct(F.size("segs").cast("long").alias("n_segments"), *summary_columns())
    # an exploded row is made once, where a filter would have its array made again below
    own = own.select(*carried(df), F.explode_outer(F.array(F.when(F.size("segs") > 0, sums))).alias("e")).filter("e IS NOT NULL")
    return own.select(*carried(df), "e.*")


def rendition_label(kind: Column, group: Column, name: Column, language: Column) -> Column:
    return F.concat_ws("/", F.lower(kind), group, F.coalesce(blank_to_null(name), blank_to_null(language)))


def variant_label(resolution: Column, bandwidth: Column) -> Column:
    return F.coalesce(blank_to_null(resolution), F.when(bandwidth > 0, F.concat(bandwidth.cast("string"), F.lit("bps"))), F.lit("v"))


# Aggregates and selections over the tables


def window_seconds(segments: DataFrame) -> DataFrame:
    return segments.groupBy("fetch_id").agg(F.sum("duration").alias("window_s"), F.count(F.lit(1)).alias("n_segments"))


def clear_segments(segments: DataFrame) -> DataFrame:
    return segments.groupBy("fetch_id").agg(F.count_if(F.col("key").isNull()).alias("clear"), F.bool_or(F.col("key").isNotNull()).alias("encrypted"))


def parts_summary(parts: DataFrame, media: DataFrame) -> DataFrame:
    """n_parts, part_s, independent and low_latency (parts, or a part target above 0) of every playlist, those without parts too."""
    sums = parts.groupBy("fetch_id").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("duration").alias("part_s"), F.bool_or("independent").alias("independent"))
    own = media.select("fetch_id", "part_target").join(sums, "fetch_id", "left").na.fill({"n_parts": 0, "part_s": 0.0, "independent": False})
    return own.withColumn("low_latency", (F.col("n_parts") > 0) | F.coalesce(F.col("part_target") > 0, F.lit(False)))


def distinct_keys(keys: DataFrame) -> DataFrame:
    """Encrypting keys once each by method, uri and format, at their first place."""
    own = keys.filter(~F.upper("method").isin("", "NONE"))
    return own.groupBy("fetch_id", "method", "uri", "keyformat").agg(F.min("ord").alias("ord"), F.min_by("iv", "ord").alias("iv"))


def distinct_maps(maps: DataFrame) -> DataFrame:
    return maps.groupBy("fetch_id", "uri", "byterange").agg(F.min("ord").alias("ord"))


def rendition_groups(renditions: DataFrame) -> DataFrame:
    return renditions.groupBy("fetch_id", "type", "group_id").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("members"))


def live_edge(segments: DataFrame) -> DataFrame:
    """fetch_id and edge: the last dated segment's date and all durations from it on; null without a date."""
    w = Window.partitionBy("fetch_id")
    own = segments.withColumn("dated", F.max(F.when(F.col("pdt").isNotNull(), F.col("ord"))).over(w)).filter(F.col("ord") >= F.col("dated"))
    own = own.groupBy("fetch_id").agg(F.max_by("pdt", F.when(F.col("pdt").isNotNull(), F.col("ord"))).alias("p"), F.sum("duration").alias("s"))
    return own.select("fetch_id", F.timestamp_micros(F.unix_micros("p") + F.round(F.col("s") * 1e6).cast("long")).alias("edge"))


def first_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each fetch (0: all)."""
    if not n:
        return df
    w = Window.partitionBy("fetch_id").orderBy(*(order or (F.col("ord"),)))
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def select_variants(variants: DataFrame, n: int = 0) -> DataFrame:
    return first_n(variants, n)


def select_renditions(renditions: DataFrame, types: list[str] | None = None, n: int = 0) -> DataFrame:
    own = renditions.filter("uri <> ''")
    return first_n(own.filter(F.lower("type").isin([t.lower() for t in types])) if types else own, n)


def sample_segments(segments: DataFrame, n: int) -> DataFrame:
    """The newest n segments of each fetch."""
    return first_n(segments, n, F.desc("ord"))
