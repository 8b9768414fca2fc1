"""Queries that summarise: counts, densities, quantiles, entropies, event-related means, correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronomesh.functions import columns as C
from chronomesh.operators import aggregates as A
from chronomesh.operators import joins as J
from chronomesh.operators import sequences as S
from chronomesh.operators.ranges import quantiles
from chronomesh.operators.tasks import grouped
from chronomesh.plans.carriers import LONG_SIGNAL, MEMBERS, SIGNAL, long_signal, members, points, signal, table
from chronomesh.plans.joining import EPOCHS
from chronomesh.plans.registry import query

H = C.half_even


@query("agg_01_roi_summary", f"WITH {MEMBERS} SELECT mode, roi, count(*) AS n, count(DISTINCT channel) AS channels, round_even(avg(dist), 7) AS mean_dist FROM members GROUP BY 1, 2")
def agg_01(spark: SparkSession, sf: str) -> DataFrame:
    return members(spark, sf).groupBy("mode", "roi").agg(F.count("*").alias("n"), F.countDistinct("channel").alias("channels"), H(F.avg("dist"), 7).alias("mean_dist"))


@query("agg_02_channel_summary", f"WITH {MEMBERS} SELECT mode, roi, channel, count(*) AS n, min(dist) AS low, round_even(avg(dist), 7) AS mean_dist FROM members GROUP BY 1, 2, 3")
def agg_02(spark: SparkSession, sf: str) -> DataFrame:
    return members(spark, sf).groupBy("mode", "roi", "channel").agg(F.count("*").alias("n"), F.min("dist").alias("low"), H(F.avg("dist"), 7).alias("mean_dist"))


@query("agg_03_scale_summary", f"WITH {MEMBERS} SELECT mode, scale, count(*) AS n, count(DISTINCT roi) AS rois, round_even(avg(dist), 7) AS mean_dist FROM members GROUP BY 1, 2")
def agg_03(spark: SparkSession, sf: str) -> DataFrame:
    return members(spark, sf).groupBy("mode", "scale").agg(F.count("*").alias("n"), F.countDistinct("roi").alias("rois"), H(F.avg("dist"), 7).alias("mean_dist"))


@query("agg_04_value_shares", "SELECT event_type, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def agg_04(spark: SparkSession, sf: str) -> DataFrame:
    return A.shares(table(spark, sf, "events"), ["event_type"]).select("event_type", "n", H(F.col("share")).alias("share"))


@query("agg_05_occupancy", f"WITH {MEMBERS}, m AS (SELECT * FROM members WHERE dist > 50000), a AS (SELECT DISTINCT mode FROM m), b AS (SELECT DISTINCT scale FROM m) SELECT a.mode, b.scale, count(m.mode) AS n FROM a CROSS JOIN b LEFT JOIN m ON m.mode = a.mode AND m.scale = b.scale GROUP BY 1, 2")
def agg_05(spark: SparkSession, sf: str) -> DataFrame:
    return A.occupancy(members(spark, sf).where("dist > 50000"), "mode", "scale").select("mode", "scale", "n")


@query("agg_06_row_shares", f"WITH {MEMBERS}, c AS (SELECT mode, scale, count(*) AS n FROM members GROUP BY 1, 2) SELECT mode, scale, round_even(n / sum(n) OVER (PARTITION BY mode), 6) AS p FROM c")
def agg_06(spark: SparkSession, sf: str) -> DataFrame:
    return A.normalised(members(spark, sf).groupBy("mode", "scale").agg(F.count("*").alias("n")), "mode").select("mode", "scale", H(F.col("p")).alias("p"))


@query("agg_07_topology", f"WITH {MEMBERS} SELECT channel, max(mode) FILTER (scale = 1) AS s1, max(mode) FILTER (scale = 2) AS s2, max(mode) FILTER (scale = 3) AS s3 FROM members GROUP BY 1")
def agg_07(spark: SparkSession, sf: str) -> DataFrame:
    wide = members(spark, sf).groupBy("channel").pivot("scale", [1, 2, 3]).agg(F.max("mode"))
    return wide.select("channel", *[F.col(str(k)).alias(f"s{k}") for k in (1, 2, 3)])


@query("agg_08_last_value", "SELECT l_suppkey, max_by(l_discount, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS last FROM lineitem GROUP BY 1")
def agg_08(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_discount", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")).alias("last"))


@query("agg_10_cell_sizes", f"WITH {MEMBERS} SELECT CAST(k AS BIGINT) AS k, count(mode) AS n FROM range(25) r(k) LEFT JOIN members ON mode = k GROUP BY 1")
def agg_10(spark: SparkSession, sf: str) -> DataFrame:
    sizes = members(spark, sf).groupBy(F.col("mode").alias("k")).agg(F.count("*").alias("n"))
    return spark.range(25).select(F.col("id").alias("k")).join(sizes, "k", "left").na.fill(0, ["n"])


@query("agg_11_barycentres", "SELECT CAST(label AS BIGINT) AS k, CAST(i - 1 AS INTEGER) AS i, round_even(avg(CAST(embedding[i] AS DOUBLE)), 6) AS centre FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2")
def agg_11(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.operators.partition import means

    cells = means(points(spark, sf).select("v", F.col("label").cast("long").alias("k")))
    return cells.select("k", F.posexplode("centre").alias("i", "centre")).select("k", "i", H(F.col("centre")).alias("centre"))


@query("agg_13_reaction_times", "SELECT o_orderpriority, round_even(avg(o_totalprice), 4) AS mean, median(o_totalprice) AS median, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def agg_13(spark: SparkSession, sf: str) -> DataFrame:
    x = "o_totalprice"
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(H(F.avg(x), 4).alias("mean"), F.median(x).alias("median"), F.min(x).alias("low"), F.max(x).alias("high"))


@query("agg_14_quantiles", f"WITH {SIGNAL} SELECT state, " + ", ".join(f"round_even(quantile_cont(x, {q}::DOUBLE), 5) AS q{n}" for q, n in ((0.5, "50"), (0.75, "75"), (0.9, "90"), (0.95, "95"), (0.99, "99"), (0.999, "999"))) + " FROM signal GROUP BY 1")
def agg_14(spark: SparkSession, sf: str) -> DataFrame:
    at = [(0.5, "50"), (0.75, "75"), (0.9, "90"), (0.95, "95"), (0.99, "99"), (0.999, "999")]
    found = quantiles(signal(spark, sf), ["state"], "x", [q for q, _ in at])
    return found.groupBy("state").agg(*[H(F.max(F.when(F.col("q") == q, F.col("x"))), 5).alias(f"q{n}") for q, n in at])


@query("agg_15_histogram", f"""WITH {SIGNAL}, b AS (SELECT state, 0.0::DOUBLE AS lo, 500.0::DOUBLE AS hi, x FROM signal), c AS (SELECT state, least(CAST(floor((x - lo) / (hi - lo) * 20) AS BIGINT), 19) AS bin, count(*) AS n FROM b GROUP BY 1, 2),
s AS (SELECT state, sum(n) AS total FROM c GROUP BY 1) SELECT s.state, CAST(r.bin AS BIGINT) AS bin, (r.bin + 0.5::DOUBLE) * 25 AS centre, round_even(coalesce(c.n, 0) / (total * 25.0::DOUBLE), 8) AS density FROM s CROSS JOIN range(20) r(bin) LEFT JOIN c ON c.state = s.state AND c.bin = r.bin""")
def agg_15(spark: SparkSession, sf: str) -> DataFrame:
    h = A.histogram(signal(spark, sf), ["state"], "x", F.lit(0.0), F.lit(500.0), 20)
    return h.select("state", "bin", "centre", H(F.col("density"), 8).alias("density"))


@query("agg_16_integer_histogram", "WITH c AS (SELECT l_returnflag AS state, CAST(l_quantity AS BIGINT) AS d, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY state) AS p FROM c) SELECT a.d, round_even(a.p - b.p, 6) AS a_minus_r FROM p a JOIN p b ON a.state = 'A' AND b.state = 'R' AND a.d = b.d")
def agg_16(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("state"), F.col("l_quantity").cast("long").alias("d")).agg(F.count("*").alias("n"))
    p = A.normalised(c, "state")
    a, b = p.where("state = 'A'").select("d", F.col("p").alias("pa")), p.where("state = 'R'").select("d", F.col("p").alias("pb"))
    return a.join(b, "d").select("d", H(F.col("pa") - F.col("pb")).alias("a_minus_r"))


PEDESTAL = """h AS (SELECT state, least(CAST(floor(x / 500 * 20) AS BIGINT), 19) AS bin, count(*) AS n FROM signal GROUP BY 1, 2), ped AS (SELECT state, (min_by(bin, (-n, bin)) + 0.5::DOUBLE) * 25 AS pedestal FROM h GROUP BY 1)"""


@query("agg_17_pedestal", f"WITH {SIGNAL}, {PEDESTAL} SELECT state, pedestal FROM ped")
def agg_17(spark: SparkSession, sf: str) -> DataFrame:
    h = A.histogram(signal(spark, sf), ["state"], "x", F.lit(0.0), F.lit(500.0), 20)
    return A.first_best(h, ["state"], "centre", "n", "bin").select("state", F.col("centre").alias("pedestal"))


@query("agg_18_quiet_share", f"WITH {SIGNAL}, {PEDESTAL} SELECT state, round_even(avg(CASE WHEN x <= 1.3::DOUBLE * pedestal THEN 1.0::DOUBLE ELSE 0 END), 6) AS quiet, round_even(max(x) / max(pedestal), 6) AS top FROM signal JOIN ped USING (state) GROUP BY 1")
def agg_18(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf).join(agg_17(spark, sf), "state")
    return s.groupBy("state").agg(H(F.avg((F.col("x") <= 1.3 * F.col("pedestal")).cast("double"))).alias("quiet"), H(F.max("x") / F.max("pedestal")).alias("top"))


@query("agg_20_event_related", f"WITH {SIGNAL}, {EPOCHS} SELECT CAST(o AS INTEGER) AS o, round_even(avg(x), 6) AS mean, round_even(stddev_samp(x) / sqrt(count(*)), 6) AS sem, count(*) AS n FROM ep GROUP BY 1")
def agg_20(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf)
    ep = J.epochs(s.select("channel", "i", "x"), s.where("state = 'purchase'").select("channel", F.col("i").alias("centre")), "channel", "i", "centre", 4, 4)
    return A.event_related(ep.withColumnRenamed("offset", "o"), ["o"], "x").select("o", H(F.col("mean")).alias("mean"), H(F.col("sem")).alias("sem"), "n")


@query("agg_20b_event_related_half_open", f"WITH {SIGNAL}, {EPOCHS} SELECT CAST(o AS INTEGER) AS o, round_even(avg(x), 6) AS mean, round_even(stddev_pop(x) / sqrt(count(*)), 6) AS sem, count(*) AS n FROM ep WHERE o < 4 GROUP BY 1")
def agg_20b(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf)
    ep = J.epochs(s.select("channel", "i", "x"), s.where("state = 'purchase'").select("channel", F.col("i").alias("centre")), "channel", "i", "centre", 4, 4)
    return A.event_related(ep.where("offset < 4").withColumnRenamed("offset", "o"), ["o"], "x", ddof=0).select("o", H(F.col("mean")).alias("mean"), H(F.col("sem")).alias("sem"), "n")


@query("agg_21_block_rms", f"WITH {SIGNAL}, c AS (SELECT *, x - avg(x) OVER (PARTITION BY channel) AS c FROM signal) SELECT channel, i, round_even(c / sqrt(avg(c * c) OVER (PARTITION BY channel % 3)), 6) AS scaled FROM c")
def agg_21(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf).withColumn("kind", F.col("channel") % 3)
    return A.block_scaled(s, "channel", "kind", "x").select("channel", "i", H(F.col("scaled")).alias("scaled"))


@query("agg_22_zscore", f"WITH {SIGNAL} SELECT channel, i, round_even((x - avg(x) OVER (PARTITION BY channel)) / stddev_pop(x) OVER (PARTITION BY channel), 6) AS z FROM signal")
def agg_22(spark: SparkSession, sf: str) -> DataFrame:
    return A.zscored(signal(spark, sf), "channel", "x").select("channel", "i", H(F.col("z")).alias("z"))


@query("agg_23_occupancy_entropy", f"WITH {MEMBERS}, c AS (SELECT roi, mode, count(*) AS n FROM members GROUP BY 1, 2), p AS (SELECT roi, n / sum(n) OVER (PARTITION BY roi) AS p FROM c) SELECT roi, round_even(-sum(p * log2(p + 1e-12)), 6) AS entropy FROM p GROUP BY 1")
def agg_23(spark: SparkSession, sf: str) -> DataFrame:
    c = members(spark, sf).groupBy("roi", "mode").agg(F.count("*").alias("n"))
    return A.entropy(c, ["roi"]).select("roi", H(F.col("entropy")).alias("entropy"))


@query("agg_24_diversity", f"WITH {MEMBERS}, c AS (SELECT mode, scale, count(*) AS n FROM members WHERE dist > 50000 GROUP BY 1, 2), p AS (SELECT mode, n / sum(n) OVER (PARTITION BY mode) AS p FROM c) SELECT mode, round_even(-sum(p * log2(p)) / log2(7.0::DOUBLE), 6) AS diversity FROM p GROUP BY 1")
def agg_24(spark: SparkSession, sf: str) -> DataFrame:
    c = members(spark, sf).where("dist > 50000").groupBy("mode", "scale").agg(F.count("*").alias("n"))
    return A.diversity(c, ["mode"], 7).select("mode", H(F.col("diversity")).alias("diversity"))


@query("agg_26_pearson", "SELECT l_suppkey, round_even(CASE WHEN stddev_pop(l_quantity) > 0 AND stddev_pop(l_extendedprice) > 0 THEN corr(l_quantity, l_extendedprice) ELSE 0 END, 6) AS r, count(*) AS n FROM lineitem GROUP BY 1")
def agg_26(spark: SparkSession, sf: str) -> DataFrame:
    return A.correlation(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice").select("l_suppkey", H(F.col("r")).alias("r"), "n")


@query("agg_27_correlation_matrix", f"WITH {LONG_SIGNAL}, s AS (SELECT channel % 12 AS k, i, avg(x) AS x FROM long_signal GROUP BY 1, 2) SELECT a.k AS a, b.k AS b, round_even(corr(a.x, b.x), 5) AS r FROM s a JOIN s b ON a.i = b.i AND a.k <= b.k GROUP BY 1, 2")
def agg_27(spark: SparkSession, sf: str) -> DataFrame:
    # mean trajectories of twelve cells of channels, over all samples
    s = long_signal(spark, sf).groupBy((F.col("channel") % 12).alias("k"), "i").agg(F.avg("x").alias("x"))
    a, b = s.select("i", F.col("k").alias("a"), F.col("x").alias("xa")), s.select("i", F.col("k").alias("b"), F.col("x").alias("xb"))
    return a.join(b, "i").where("a <= b").groupBy("a", "b").agg(H(F.corr("xa", "xb"), 5).alias("r"))


LAGGED = """z AS (SELECT channel, i, (x - avg(x) OVER (PARTITION BY channel)) / stddev_pop(x) OVER (PARTITION BY channel) AS z FROM signal),
l AS (SELECT a.channel, b.i - a.i AS lag, round_even(avg(a.z * b.z), 6) AS c FROM z a JOIN z b ON b.channel = a.channel AND b.i - a.i BETWEEN 0 AND 6 GROUP BY 1, 2)"""


@query("agg_28_peak_lag", f"WITH {SIGNAL}, {LAGGED} SELECT channel, max(c) AS peak, min_by(lag, (-c, lag)) AS lag FROM l WHERE lag > 0 GROUP BY 1")
def agg_28(spark: SparkSession, sf: str) -> DataFrame:
    z = A.zscored(signal(spark, sf), "channel", "x").select("channel", "i", "z")
    met = J.lagged(z, z.withColumnRenamed("z", "s"), "channel", "i", 1, 6)
    c = met.groupBy("channel", F.col("lag").cast("long").alias("lag")).agg(H(F.avg(F.col("z") * F.col("s"))).alias("c"))
    return A.first_best(c, ["channel"], "lag", "c", "lag").select("channel", F.col("c").alias("peak"), "lag")


@query("agg_29_dominant", f"WITH {MEMBERS}, c AS (SELECT mode, roi, count(*) AS n FROM members GROUP BY 1, 2), d AS (SELECT mode, min_by(roi, (-n, roi)) AS roi, max(n) AS n FROM c GROUP BY 1), a AS (SELECT mode, min_by(channel, (dist, l_orderkey)) AS archetype FROM members GROUP BY 1) SELECT mode, roi, n, archetype FROM d JOIN a USING (mode)")
def agg_29(spark: SparkSession, sf: str) -> DataFrame:
    m = members(spark, sf)
    d = A.first_best(m.groupBy("mode", "roi").agg(F.count("*").alias("n")), ["mode"], "roi", "n", "roi")
    return d.join(m.groupBy("mode").agg(F.min_by("channel", F.struct("dist", "l_orderkey")).alias("archetype")), "mode")


@query("agg_30_top_counts", "SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_quantity LIMIT 7")
def agg_30(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_quantity").limit(7)


@query("agg_31_distinct_gate", "SELECT conv_id, count(DISTINCT role) AS roles FROM conversations GROUP BY 1 HAVING count(DISTINCT role) >= 2")
def agg_31(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.countDistinct("role").alias("roles")).where("roles >= 2")


@query("agg_32_state_metrics", f"WITH {SIGNAL} SELECT state, round_even(avg(x), 6) AS mean, round_even(stddev_pop(x), 6) AS sd, count(*) AS n FROM signal GROUP BY 1")
def agg_32(spark: SparkSession, sf: str) -> DataFrame:
    return signal(spark, sf).groupBy("state").agg(H(F.avg("x")).alias("mean"), H(F.stddev_pop("x")).alias("sd"), F.count("*").alias("n"))


@query("agg_33_state_coverage", "SELECT lang, count(*) AS n, round_even(100.0::DOUBLE * count(quality) / count(*), 6) AS known, min(doc_id) AS first, max(doc_id) AS last FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def agg_33(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("n"), H(F.lit(100.0) * F.count("quality") / F.count("*")).alias("known"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("agg_34_ordinal_match", f"""WITH {LONG_SIGNAL}, q AS (SELECT channel, i, price AS x, round_even(price / 40000, 0) * 40000 AS y FROM long_signal),
t AS (SELECT channel, x, lead(x) OVER w AS x1, lead(x, 2) OVER w AS x2, y, lead(y) OVER w AS y1, lead(y, 2) OVER w AS y2 FROM q WINDOW w AS (PARTITION BY channel ORDER BY i)),
c AS (SELECT channel, abs(x - y) AS e, ((x > x1)::INT + (x > x2)::INT) * 2 + (x1 > x2)::INT = ((y > y1)::INT + (y > y2)::INT) * 2 + (y1 > y2)::INT AS same FROM t WHERE x2 IS NOT NULL)
SELECT channel, round_even(100.0::DOUBLE * avg(same::INT), 4) AS match, round_even(max(e), 4) AS max_error FROM c GROUP BY 1""")
def agg_34(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.operators.ordinal import patterns

    q = long_signal(spark, sf).select("channel", "i", F.col("price").alias("x"), (F.bround(F.col("price") / 40000) * 40000).alias("y"))
    a = patterns(q, "channel", "i", "x", 3).withColumnRenamed("code", "cx")
    b = patterns(q, "channel", "i", "y", 3).withColumnRenamed("code", "cy")
    met = a.join(b, ["channel", "i"]).join(q, ["channel", "i"])
    return met.groupBy("channel").agg(H(F.lit(100.0) * F.avg((F.col("cx") == F.col("cy")).cast("double")), 4).alias("match"), H(F.max(F.abs(F.col("x") - F.col("y"))), 4).alias("max_error"))


@query("agg_35_leverage", "WITH d AS (SELECT vec_id, i - 1 AS pos, CAST(embedding[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE) AS g FROM embeddings, range(1, 65) r(i)), s AS (SELECT vec_id, sum(g) AS tr FROM d GROUP BY 1), m AS (SELECT pos, avg(g / tr) AS l FROM d JOIN s USING (vec_id) GROUP BY 1) SELECT CAST(pos % 16 AS INTEGER) AS channel, round_even(avg(l), 8) AS leverage FROM m GROUP BY 1")
def agg_35(spark: SparkSession, sf: str) -> DataFrame:
    g = points(spark, sf).select(F.transform("v", lambda x: x * x).alias("g"))
    each = g.select(F.posexplode(F.transform("g", lambda x: x / C.total(F.col("g")))).alias("pos", "l"))
    return each.groupBy("pos").agg(F.avg("l").alias("l")).groupBy((F.col("pos") % 16).alias("channel")).agg(H(F.avg("l"), 8).alias("leverage"))


@query("agg_36_unit_sum", "WITH s AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l_suppkey, round_even(CASE WHEN sum(q) OVER () > 0 THEN q / sum(q) OVER () ELSE q END, 8) AS share FROM s")
def agg_36(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    whole = F.sum("q").over(Window.partitionBy())
    return s.select("l_suppkey", H(F.when(whole > 0, F.col("q") / whole).otherwise(F.col("q")), 8).alias("share"))


@query("agg_37_validation_summary", "SELECT o_orderstatus, round_even(avg(o_totalprice), 4) AS bias, round_even(CASE WHEN count(*) > 1 THEN stddev_samp(o_totalprice) ELSE 0 END, 4) AS sd FROM orders GROUP BY 1")
def agg_37(spark: SparkSession, sf: str) -> DataFrame:
    x = "o_totalprice"
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(H(F.avg(x), 4).alias("bias"), H(F.when(F.count("*") > 1, F.stddev_samp(x)).otherwise(0.0), 4).alias("sd"))


@query("agg_38_concordance", f"WITH {MEMBERS} SELECT mode, round_even(median(dist) / (median(scale) + 1e-12), 4) AS ratio, count(*) AS n FROM members GROUP BY 1")
def agg_38(spark: SparkSession, sf: str) -> DataFrame:
    return members(spark, sf).groupBy("mode").agg(H(F.median("dist") / (F.median("scale") + 1e-12), 4).alias("ratio"), F.count("*").alias("n"))


@query("agg_39_task_groups", "WITH g AS (SELECT o_totalprice, o_orderstatus, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) % 13 AS grp FROM orders) SELECT grp, round_even(sum(o_totalprice), 2) AS cost, max(o_totalprice) AS top, count(*) FILTER (o_orderstatus = 'F') AS done FROM g GROUP BY 1")
def agg_39(spark: SparkSession, sf: str) -> DataFrame:
    o = grouped(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.col("o_totalprice").alias("cost")), 13, ["o_orderkey"])
    return o.groupBy("grp").agg(H(F.sum("o_totalprice"), 2).alias("cost"), F.max("o_totalprice").alias("top"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("done"))


@query("agg_40_rate_from_data", f"WITH {SIGNAL} SELECT channel, round_even(count(*) / ((max(us) - min(us)) / 1e6), 10) AS rate FROM signal GROUP BY 1")
def agg_40(spark: SparkSession, sf: str) -> DataFrame:
    return signal(spark, sf).groupBy("channel").agg(H(F.count("*") / ((F.max("us") - F.min("us")) / 1e6), 10).alias("rate"))


@query("qc_36_state_contrast", f"WITH {SIGNAL}, n AS (SELECT channel, i // 3 AS sec, max_by(state, event_id) AS note FROM signal GROUP BY 1, 2) SELECT note, round_even(avg(x), 6) AS mean, round_even(stddev_samp(x) / sqrt(count(*)), 6) AS sem, count(*) AS n FROM signal s JOIN n ON n.channel = s.channel AND n.sec = s.i // 3 WHERE note IN ('click', 'error', 'view') GROUP BY 1")
def qc_36(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf)
    notes = s.select("channel", F.floor(F.col("i") / 3).alias("second"), F.col("state").alias("note"), "event_id")
    met = J.bucketed(s.select("channel", "i", "x"), notes, "channel", "i", 3, "second", "note", "event_id").where(F.col("note").isin("click", "error", "view"))
    return A.event_related(met, ["note"], "x").select("note", H(F.col("mean")).alias("mean"), H(F.col("sem")).alias("sem"), "n")


@query("qc_38_sync_diagnosis", f"""WITH {SIGNAL}, e AS (SELECT channel, count(*) AS triggers FROM signal WHERE state = 'purchase' GROUP BY 1), l AS (SELECT o_custkey AS channel, count(*) AS trials FROM orders GROUP BY 1)
SELECT channel, triggers, trials, triggers = trials AS agree, round_even(100.0::DOUBLE * abs(triggers - trials) / greatest(triggers, trials), 6) > 5 AS flagged FROM e JOIN l USING (channel)""")
def qc_38(spark: SparkSession, sf: str) -> DataFrame:
    e = signal(spark, sf).where("state = 'purchase'").groupBy("channel").agg(F.count("*").alias("triggers"))
    log = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("channel")).agg(F.count("*").alias("trials"))
    off = F.lit(100.0) * F.abs(F.col("triggers") - F.col("trials")) / F.greatest("triggers", "trials")
    return e.join(log, "channel").select("channel", "triggers", "trials", (F.col("triggers") == F.col("trials")).alias("agree"), (H(off) > 5).alias("flagged"))
