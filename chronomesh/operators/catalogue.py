"""What modes are made of and how they vary: members by region, channel and scale, and one row for each mode.

Members are pairs of a channel and a scale with the mode they belong to and their distance
from its centre. Both results come from counts that each task takes before the shuffle, so
a mode that holds most members costs no more than others, and nothing larger than a row for
each (mode, scale, region) is carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomesh.operators.ordinal import parse_tag
from chronomesh.sources.shared import materialize

#: Region and kind of a channel that the sensors don't list. Fixed values.
UNKNOWN, USUAL_KIND = "Unknown", "meg"


def enriched(members: DataFrame, sensors: DataFrame) -> DataFrame:
    """members (mode, channel, tag, dist) with scale (seconds) and order_m from the tag, roi and kind from sensors (channel, roi, kind).

    Channels are matched without blanks; of sensors that then share a name, the first by region counts. A tag that
    names no scale gives scale 0 and order 0.
    """
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    of = sensors.groupBy(bare("channel").alias("_bare")).agg(F.min(F.struct("roi", "kind")).alias("_of"))
    seconds, order = parse_tag(F.col("tag"))
    rows = members.withColumns({"scale": F.coalesce(seconds, F.lit(0.0)), "order_m": F.coalesce(order, F.lit(0)), "_bare": bare("channel")})
    found = {"roi": F.coalesce("_of.roi", F.lit(UNKNOWN)), "kind": F.coalesce("_of.kind", F.lit(USUAL_KIND))}
    return rows.join(of, "_bare", "left").withColumns(found).drop("_bare", "_of")


def composition(members: DataFrame) -> DataFrame:
    """enriched members → (mode, level, roi, channel, kind, scale, order_m, n, channels, low, mean_dist): a row for every region, channel and scale of every mode.

    level tells which of them a row is about; columns of the others are null.
    """
    keys = ["mode", "roi", "channel", "kind", "scale", "order_m"]
    each = members.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("dist").alias("_sum"), F.count("dist").alias("_known"), F.min("dist").alias("_low"))
    names = each.withColumn("_channel", F.col("channel"))  # stays where the key is null
    sets = [["mode", "roi"], ["mode", "roi", "channel", "kind"], ["mode", "scale", "order_m"]]
    level = F.when(F.grouping("channel") == 0, "channel").when(F.grouping("roi") == 0, "roi").otherwise("scale")
    sums = {"n": F.sum("_n"), "channels": F.countDistinct("_channel"), "low": F.min("_low"), "mean_dist": F.sum("_sum") / F.sum("_known")}
    found = names.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(level.alias("level"), *[c.alias(name) for name, c in sums.items()])
    return found.select("mode", "level", *keys[1:], *sums)


def spread(n: str, bins: Column) -> Column:
    """Shannon entropy of the counts n of a group, over that of equal counts in all bins; 0 if there is one bin only."""
    bits = F.log2(F.sum(n)) - F.sum(F.col(n) * F.log2(n)) / F.sum(n)
    return F.when(bins > 1, bits / F.log2(bins)).otherwise(F.lit(0.0))


def catalogue(members: DataFrame, k: int | None = None) -> DataFrame:
    """enriched members → (mode, total, dominant_scale, dominant_roi, archetype, low, scale_entropy, roi_entropy), a row for each mode.

    The dominant scale and region have most members (the first of equals), the archetype is the channel of the member
    nearest the centre. Entropies are over all scales and known regions that occur in any mode. With k, modes 0 to
    k - 1 are all listed: those without members have total 0, entropies 0 and nulls. A mode without a known region has
    region null and entropy 0.
    """
    near = F.min(F.when(F.col("dist").isNotNull(), F.struct("dist", "channel"))).alias("near")
    counts = materialize(members.groupBy("mode", "scale", "roi").agg(F.count("*").alias("n"), near), "catalogue-counts")
    known = counts.where(F.col("roi") != UNKNOWN)
    bins = counts.agg(F.countDistinct("scale").alias("_scales"), F.countDistinct(F.when(F.col("roi") != UNKNOWN, F.col("roi"))).alias("_rois"))

    def side(rows: DataFrame, by: str, every: str) -> DataFrame:
        sums = rows.groupBy("mode", by).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(bins))  # one row
        first = F.min(F.struct(-F.col("n"), F.col(by)))[by]
        return sums.groupBy("mode").agg(first.alias(f"dominant_{by}"), spread("n", F.max(every)).alias(f"{by}_entropy"))

    whole = counts.groupBy("mode").agg(F.sum("n").alias("total"), F.min("near").alias("near"))
    found = whole.join(side(counts, "scale", "_scales"), "mode", "left").join(side(known, "roi", "_rois"), "mode", "left")
    if k is not None:
        found = members.sparkSession.range(k).select(F.col("id").alias("mode")).join(found, "mode", "left")
    found = found.na.fill({"total": 0, "scale_entropy": 0.0, "roi_entropy": 0.0})
    return found.select("mode", "total", "dominant_scale", "dominant_roi", F.col("near.channel").alias("archetype"), F.col("near.dist").alias("low"), "scale_entropy", "roi_entropy")
