"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

A source's share is its weight's part of the wanted total; shares above ``max_epochs`` times the source's size are clamped,
and the excess goes to the others by weight until none is above. A source then repeats all its documents whole as often as
its target covers it, and once more the documents first in a seeded order whose sizes fill the rest.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playwatch.llm.common import ranked, word_count, written

#: Documents that a bin of the seeded order is to hold about; a source's fractional repetition is cut within one bin.
BIN_DOCS = 4096


def water_filled(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Adds target to ``sources`` (size, weight). Each round is one aggregation; sums come to the driver, never sources."""
    full = F.lit(False)
    level_parts: tuple[float, float] = (0.0, 1.0)
    cap = F.col("size") * F.lit(float(max_epochs))
    while True:
        row = sources.agg(
            F.sum(F.when(full, cap)).alias("used"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        used, weight = row["used"] or 0.0, row["weight"] or 0
        if not weight:
            return sources.withColumn("target", cap)
        level_parts = (max(total - used, 0.0), float(weight))
        share = F.lit(level_parts[0]) * F.col("weight") / F.lit(level_parts[1])
        # a source that was full stays full, as the level only rises
        now = full | (share > cap)
        if sources.filter(now & ~full).limit(1).count() == 0:
            return sources.withColumn("target", F.when(full, cap).otherwise(share))
        full = now


def seeded(seed: int) -> Column:
    """A row's draw: the MD5 of seed and doc_id; where that is null, of seed and text."""
    by_text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), by_text))))


def mixed(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    of_total: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 7,
    source: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted), whole and draw of every document.

    Sources in ascending code-point order (null last, a source of its own) take ``weights`` in turn; all targets together are
    ``of_total`` of all words unless caps forbid. Size is the number of words, 0 for a null or empty text. A document is taken
    whole: floor(target / source_size) times, and once more if the middle of its words, in the order of its source's draws,
    lies within the rest. So a source misses its target by half a document at most. Draws are MD5 of seed and doc_id (of seed and
    text, where that is null); rows of one draw stand in order of size, so reruns agree. A source without words has target 0. whole is how
    often the source is taken whole. A very long text is one document like any other: it is taken whole or not. An empty table gives
    no rows. Columns other than doc_id, text and the source are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col(source).cast("string").alias("source"), "text")
    rows = written(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), seeded(seed).alias("draw")), "sizes")
    # leading hex digits of the draw that make a bin: more with more documents
    digits = max(1, math.ceil(math.log(max(1, rows.count() / BIN_DOCS), 16)))
    rows = rows.withColumn("bin", F.substring("draw", 1, digits))
    bins = written(rows.groupBy("source", "bin").agg(F.sum("size").alias("size")), "bins")
    sources = ranked(bins.groupBy("source").agg(F.sum("size").alias("size")), "source", "place")
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = written(sources.withColumn("weight", turn), "sources")
    total = (sources.agg(F.sum("size")).first()[0] or 0) * float(of_total)
    plan = water_filled(sources, total, max_epochs)
    times = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    plan = plan.select(
        F.col("source").alias("its"),
        F.col("size").alias("source_size"),
        "target",
        F.floor(times).alias("whole"),
        (F.col("target") - F.floor(times) * F.col("size")).alias("rest"),
    )
    # a row for each bin of a source: at most 16 for each BIN_DOCS documents
    order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    bins = bins.join(plan, F.col("source").eqNullSafe(F.col("its"))).select(
        F.col("its").alias("s"), F.col("bin").alias("b"), "source_size", "target", "whole", "rest", "before", (F.col("before") + F.col("size")).alias("after")
    )
    placed = rows.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    # only the bin in which the rest ends is ordered row by row
    cut = (F.col("before") < F.col("rest")) & (F.col("after") > F.col("rest"))
    out = ["doc_id", "source", "size", "source_size", "target", "taken", "whole", "draw"]
    plain = placed.filter(~cut).withColumn("taken", F.col("size") * (F.col("whole") + (F.col("after") <= F.col("rest")).cast("long")))
    inner = Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0)) + F.col("size") / 2
    fine = placed.filter(cut).withColumn("taken", F.col("size") * (F.col("whole") + (middle <= F.col("rest")).cast("long")))
    return plain.select(*out).unionByName(fine.select(*out))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, repeated as often as taken. Columns may have any names.

    Documents without words are taken as often as their source whole. Rows that agree in draw (so in doc_id, or without one in text),
    source and size are taken together as often as ``mixed`` takes them: where some of them are taken once more and others not, those of
    smaller digests of the whole row are, so totals meet their targets and reruns agree.
    """
    source, seed = options.get("source", "source"), options.get("seed", 7)
    plain = docs.select("doc_id", "text", F.col(f"`{source}`").alias("source"))
    picks = mixed(plain, **{**options, "source": "source"})
    picks = picks.groupBy("draw", "source", "size").agg(
        F.first("whole").alias("whole"), F.sum(F.when(F.col("size") > 0, F.col("taken") / F.col("size") - F.col("whole")).otherwise(0)).cast("long").alias("more"), F.count(F.lit(1)).alias("rows")
    )
    # draw is kept under names that clash with none of the struct that rows travel in
    picks = picks.select(F.col("draw").alias("its_draw"), F.col("source").alias("its_source"), F.col("size").alias("its_size"), "whole", "more", "rows").filter("whole + more > 0")
    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"),
    )
    own = own.select("row", "source", "size", seeded(seed).alias("draw"))
    same = lambda p: (F.col("draw") == p["its_draw"]) & F.col("source").eqNullSafe(p["its_source"]) & (F.col("size") == p["its_size"])
    picks = written(picks, "picks")
    torn = F.col("more").between(1, F.col("rows") - 1)
    alike = picks.filter(~torn).withColumn("times", F.col("whole") + (F.col("more") > 0).cast("long")).filter("times > 0").select("its_draw", "its_source", "its_size", "times")
    taken = own.join(alike, same(alike)).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
    # a source's rest ends in one draw, so at most one group of a source is torn: its rows are counted by digest, and like rows are one
    # written apart, so that Spark knows how few they are and broadcasts them, where else it would shuffle all documents once more
    torn_picks = written(picks.filter(torn), "torn-picks")
    rows = own.join(torn_picks, same(torn_picks)).withColumn("digest", F.md5(F.to_json("row").cast("binary")))
    kinds = written(rows.groupBy("its_draw", "its_source", "its_size", "digest").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("n"), F.first("whole").alias("whole"), F.first("more").alias("more")), "torn")
    order = Window.partitionBy("its_draw", "its_source", "its_size").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    before = kinds.select("its_draw", "its_source", "its_size", "digest", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    before = before.withColumnsRenamed({c: f"b_{c}" for c in ("its_draw", "its_source", "its_size", "digest")})
    met = (F.col("its_draw") == F.col("b_its_draw")) & F.col("its_source").eqNullSafe(F.col("b_its_source")) & (F.col("its_size") == F.col("b_its_size")) & (F.col("digest") == F.col("b_digest"))
    times = F.col("n") * F.col("whole") + F.least(F.col("n"), F.greatest(F.lit(0), F.col("more") - F.col("before")))
    some = kinds.join(before, met).withColumn("times", times.cast("long")).filter("times > 0")
    return taken.unionByName(some.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*"))
