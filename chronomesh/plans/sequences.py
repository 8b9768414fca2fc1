"""Queries over ordered samples: differences, edges, runs, refractory filters, peaks, curves, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronomesh.functions.columns import half_even
from chronomesh.operators import sequences as S
from chronomesh.plans.carriers import LONG_SIGNAL, SIGNAL, long_signal, signal, table
from chronomesh.plans.registry import query


@query("win_01_first_difference", f"""WITH {SIGNAL}
SELECT channel, i, round_even(x - coalesce(lag(x) OVER (PARTITION BY channel ORDER BY i), 0), 6) AS dx FROM signal""")
def win_01(spark: SparkSession, sf: str) -> DataFrame:
    return S.first_difference(signal(spark, sf), "channel", "i", "x").select("channel", "i", half_even(F.col("dx")).alias("dx"))


@query("win_02a_rising_edges", f"""WITH {SIGNAL}, p AS (SELECT *, state = 'purchase' AS hit, lag(state = 'purchase') OVER (PARTITION BY channel ORDER BY i) AS was FROM signal)
SELECT channel, i FROM p WHERE hit AND NOT coalesce(was, false)""")
def win_02a(spark: SparkSession, sf: str) -> DataFrame:
    return S.edges(signal(spark, sf), "channel", "i", F.col("state") == "purchase", True).select("channel", "i")


@query("win_02b_rising_edges_inside", f"""WITH {SIGNAL}, p AS (SELECT *, state = 'purchase' AS hit, lag(state = 'purchase') OVER (PARTITION BY channel ORDER BY i) AS was FROM signal)
SELECT channel, i FROM p WHERE hit AND NOT coalesce(was, true)""")
def win_02b(spark: SparkSession, sf: str) -> DataFrame:
    return S.edges(signal(spark, sf), "channel", "i", F.col("state") == "purchase", False).select("channel", "i")


RUNS = """p AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY channel ORDER BY i) THEN 1 ELSE 0 END AS new FROM signal),
b AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY i) AS block FROM p),
r AS (SELECT channel, CAST(block AS BIGINT) AS block, min(i) AS start, max(i) AS stop, count(*) AS n, min_by(state, i) AS state FROM b GROUP BY channel, block)"""


@query("win_05_run_length", f"WITH {SIGNAL}, {RUNS} SELECT channel, block, start, stop, n, state FROM r")
def win_05(spark: SparkSession, sf: str) -> DataFrame:
    return S.runs(signal(spark, sf), "channel", "i", ["state"])


@query("win_03_min_duration", f"WITH {SIGNAL}, {RUNS} SELECT channel, start, n, state FROM r WHERE n >= 2")
def win_03(spark: SparkSession, sf: str) -> DataFrame:
    return S.runs(signal(spark, sf), "channel", "i", ["state"]).where("n >= 2").select("channel", "start", "n", "state")


@query("agg_09_block_summary", f"WITH {SIGNAL}, {RUNS} SELECT channel, block, start, stop, stop - start + 1 AS duration, state FROM r")
def agg_09(spark: SparkSession, sf: str) -> DataFrame:
    r = S.runs(signal(spark, sf), "channel", "i", ["state"])
    return r.select("channel", "block", "start", "stop", (F.col("stop") - F.col("start") + 1).alias("duration"), "state")


GAP = 36 * 3_600_000_000


@query("win_04_refractory", f"""WITH RECURSIVE {SIGNAL}, e AS (SELECT DISTINCT channel, us FROM signal),
f AS (SELECT channel, min(us) AS us FROM e GROUP BY channel
  UNION ALL SELECT f.channel, (SELECT min(e.us) FROM e WHERE e.channel = f.channel AND e.us >= f.us + {GAP}) FROM f
  WHERE EXISTS (SELECT 1 FROM e WHERE e.channel = f.channel AND e.us >= f.us + {GAP}))
SELECT channel, us FROM f""")
def win_04(spark: SparkSession, sf: str) -> DataFrame:
    return S.refractory(signal(spark, sf).select("channel", "us").distinct(), "channel", "us", GAP)


@query("win_06_calibration_end", f"""WITH {LONG_SIGNAL}, s AS (SELECT channel, i, CAST(x AS BIGINT) % 8 AS code FROM long_signal),
p AS (SELECT *, lead(code) OVER (PARTITION BY channel ORDER BY i) AS next FROM s)
SELECT channel, max(i) AS calibration_end FROM p WHERE i <= 75 AND (next = code + 1 OR (code = 7 AND next = 0)) GROUP BY channel""")
def win_06(spark: SparkSession, sf: str) -> DataFrame:
    s = long_signal(spark, sf).select("channel", "i", (F.col("x").cast("long") % 8).alias("code")).where("i <= 76")
    p = S.framed(s, "channel", "i", 0, 1, lambda w: {"next": F.lead("code").over(w)})
    step = (F.col("next") == F.col("code") + 1) | ((F.col("code") == 7) & (F.col("next") == 0))
    return p.where((F.col("i") <= 75) & step).groupBy("channel").agg(F.max("i").alias("calibration_end"))


@query("win_07_sentences", r"""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, unnest(string_split_regex(text, '[.!?]')) AS part FROM conversations),
s AS (SELECT conv_id, turn, trim(part) AS sentence FROM c)
SELECT conv_id, turn, sentence, CAST(len(string_split_regex(sentence, '\s+')) AS BIGINT) AS n_words FROM s WHERE length(sentence) > 3""")
def win_07(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split("text", "[.!?]")).alias("part")).select("conv_id", "turn", F.trim("part").alias("sentence"))
    return c.where(F.length("sentence") > 3).withColumn("n_words", F.size(F.split("sentence", r"\s+")).cast("long"))


@query("win_08_tuples", f"""WITH {SIGNAL}, p AS (SELECT channel, i, x, lead(x) OVER w AS x1, lead(x, 2) OVER w AS x2 FROM signal WINDOW w AS (PARTITION BY channel ORDER BY i))
SELECT channel, i, x, x1, x2 FROM p WHERE x2 IS NOT NULL""")
def win_08(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf).select("channel", "i", "x")
    return S.framed(s, "channel", "i", 0, 2, lambda w: {"x1": F.lead("x").over(w), "x2": F.lead("x", 2).over(w)}).where("x2 IS NOT NULL")


@query("win_09_prefix_counts", f"""WITH {SIGNAL} SELECT channel, i, state, count(*) OVER (PARTITION BY channel, state ORDER BY i) AS n FROM signal""")
def win_09(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf).withColumn("key", F.concat_ws("|", "channel", "state"))
    return S.running_sum(s, "key", "i", F.lit(1).cast("long"), "n").select("channel", "i", "state", "n")


@query("join_13_window_sums", f"""WITH {SIGNAL} SELECT channel, i, round_even(sum(x) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 10 PRECEDING AND 3 PRECEDING), 4) AS left_sum,
round_even(sum(x) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), 4) AS right_sum FROM signal""")
def join_13(spark: SparkSession, sf: str) -> DataFrame:
    sums = lambda w: {"left_sum": half_even(F.sum("x").over(w.rowsBetween(-10, -3)), 4), "right_sum": half_even(F.sum("x").over(w.rowsBetween(0, 7)), 4)}
    return S.framed(signal(spark, sf).select("channel", "i", "x"), "channel", "i", 10, 7, sums).drop("x")


@query("win_11_cumulative_energy", f"""WITH {SIGNAL} SELECT channel, i, round_even(sum(x * x) OVER (PARTITION BY channel ORDER BY i) / sum(x * x) OVER (PARTITION BY channel), 6) AS share FROM signal""")
def win_11(spark: SparkSession, sf: str) -> DataFrame:
    return S.cumulative_energy(signal(spark, sf), "channel", "i", "x").select("channel", "i", half_even(F.col("share")).alias("share"))


@query("agg_19_energy_localisation", f"""WITH {SIGNAL}, c AS (SELECT channel, i, sum(x * x) OVER (PARTITION BY channel ORDER BY i) / sum(x * x) OVER (PARTITION BY channel) AS share FROM signal),
t AS (SELECT channel, (share + lag(share) OVER (PARTITION BY channel ORDER BY i)) / 2 AS a FROM c), g AS (SELECT channel, avg(a) AS area FROM t GROUP BY channel)
SELECT channel, round_even(greatest(0, least(1, 1 - 2 * least(area, 1 - area))), 6) AS localisation FROM g""")
def agg_19(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.operators.aggregates import energy_localisation

    out = energy_localisation(S.cumulative_energy(signal(spark, sf), "channel", "i", "x"), "channel", "i")
    return out.select("channel", half_even(F.col("localisation")).alias("localisation"))


PEAKS = """n AS (SELECT channel, i, x, lag(x) OVER w AS p, lead(x) OVER w AS q FROM signal WINDOW w AS (PARTITION BY channel ORDER BY i)), peaks AS (SELECT channel, i, x FROM n WHERE x > 50 AND x >= p AND x > q)"""


@query("win_12_local_maxima", f"WITH {SIGNAL}, {PEAKS} SELECT channel, i, x FROM peaks")
def win_12(spark: SparkSession, sf: str) -> DataFrame:
    return S.local_maxima(signal(spark, sf).select("channel", "i", "x"), "channel", "i", "x", 50.0)


@query("win_12_spaced_peaks", f"""WITH RECURSIVE {SIGNAL}, {PEAKS}, o AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY i) AS r FROM peaks),
f AS (SELECT channel, r, i, x, FALSE AS closed, i AS li, x AS lx FROM o WHERE r = 1
  UNION ALL SELECT o.channel, o.r, o.i, o.x, o.i - f.li >= 5, CASE WHEN o.i - f.li >= 5 OR o.x > f.lx THEN o.i ELSE f.li END, CASE WHEN o.i - f.li >= 5 OR o.x > f.lx THEN o.x ELSE f.lx END
  FROM f JOIN o ON o.channel = f.channel AND o.r = f.r + 1),
g AS (SELECT *, lead(closed) OVER (PARTITION BY channel ORDER BY r) AS next_closed FROM f)
SELECT channel, li AS i, lx AS x FROM g WHERE coalesce(next_closed, true)""")
def win_12b(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf).select("channel", "i", "x")
    return S.spaced_peaks(S.local_maxima(s, "channel", "i", "x", 50.0), "channel", "i", "x", 5)


@query("win_13_half_widths", f"""WITH {SIGNAL}, {PEAKS}, b AS (SELECT channel, round_even(median(x), 6) AS pedestal FROM signal GROUP BY 1),
m AS (SELECT p.channel, p.i AS peak, s.i, s.x <= pedestal + 0.5::DOUBLE * (p.x - pedestal) AS low FROM peaks p JOIN b ON b.channel = p.channel JOIN signal s ON s.channel = p.channel),
a AS (SELECT channel, peak, max(CASE WHEN low AND i <= peak THEN i END) AS l, min(CASE WHEN low AND i >= peak THEN i END) AS r, min(i) AS lo, max(i) AS hi FROM m GROUP BY channel, peak),
w AS (SELECT channel, peak AS i, peak - coalesce(l, lo) AS rise, coalesce(r, hi) - peak AS decay FROM a)
SELECT channel, i, rise, decay, rise + decay AS width, CASE WHEN decay = 0 THEN 1 ELSE round_even(rise / decay, 6) END AS asymmetry FROM w""")
def win_13(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf).select("channel", "i", "x")
    pedestal = s.groupBy("channel").agg(half_even(F.median("x"), 6).alias("pedestal"))
    peaks = S.local_maxima(s, "channel", "i", "x", 50.0).join(pedestal, "channel")
    out = S.half_widths(s, peaks, "channel", "i", "x", F.col("pedestal"), 4)
    return out.withColumn("asymmetry", half_even(F.col("asymmetry"), 6))


@query("win_19_synthetic_clock", """WITH t AS (SELECT o_custkey AS channel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n, o_totalprice / 100000 AS rt FROM orders),
c AS (SELECT *, 5 + coalesce(sum(0.5::DOUBLE + rt + 0.02::DOUBLE) OVER (PARTITION BY channel ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM t)
SELECT channel, n, round_even(begin + 0.5::DOUBLE, 8) AS t_stim, round_even(begin + 0.5::DOUBLE + rt, 8) AS t_resp FROM c""")
def win_19(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    t = table(spark, sf, "orders").select(F.col("o_custkey").alias("channel"), n.cast("long").alias("n"), (F.col("o_totalprice") / 100000).alias("rt"))
    out = S.clock(t, "channel", "n", F.col("rt"), 5.0, 0.5, 0.02)
    return out.select("channel", "n", half_even(F.col("t_stim"), 8).alias("t_stim"), half_even(F.col("t_resp"), 8).alias("t_resp"))


@query("win_20_ecdf", f"WITH {SIGNAL} SELECT channel, i, round_even(row_number() OVER (PARTITION BY channel ORDER BY x, i) / count(*) OVER (PARTITION BY channel), 6) AS ecdf FROM signal")
def win_20(spark: SparkSession, sf: str) -> DataFrame:
    return S.ecdf(signal(spark, sf), "channel", "x", "i").select("channel", "i", half_even(F.col("ecdf")).alias("ecdf"))


@query("win_21_rank_listing", "SELECT l_suppkey AS mode, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_shipdate) AS rank FROM lineitem")
def win_21(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("mode"), "l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).cast("long").alias("rank"))


@query("win_22_sampling_step", f"""WITH {SIGNAL}, d AS (SELECT channel, us - lag(us) OVER (PARTITION BY channel ORDER BY i) AS d FROM signal)
SELECT channel, median(d) AS dt_us FROM d GROUP BY channel""")
def win_22(spark: SparkSession, sf: str) -> DataFrame:
    d = S.framed(signal(spark, sf), "channel", "i", 1, 0, lambda w: {"d": F.col("us") - F.lag("us").over(w)})
    return d.groupBy("channel").agg(F.median("d").alias("dt_us"))


@query("win_23_state_transitions", f"""WITH {SIGNAL}, k AS (SELECT channel, i, CASE WHEN state <> 'signup' THEN state END AS state FROM signal),
p AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM k)
SELECT channel, i, was, state FROM p WHERE state IS NOT NULL AND was IS NOT NULL AND state <> was""")
def win_23(spark: SparkSession, sf: str) -> DataFrame:
    k = signal(spark, sf).where(F.col("state") != "signup").select("channel", "i", "state")
    w = Window.partitionBy("channel").orderBy("i")
    return k.withColumn("was", F.lag("state").over(w)).where(F.col("state") != F.col("was")).select("channel", "i", "was", "state")


@query("win_24_batches", f"WITH {SIGNAL} SELECT channel, i // 16 AS batch, min(i) AS first, max(i) + 1 AS stop FROM signal GROUP BY channel, i // 16")
def win_24(spark: SparkSession, sf: str) -> DataFrame:
    return signal(spark, sf).groupBy("channel", F.floor(F.col("i") / 16).alias("batch")).agg(F.min("i").alias("first"), (F.max("i") + 1).alias("stop"))


@query("win_14_savitzky_golay")
def win_14(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.operators.filters import smoothed

    return smoothed(long_signal(spark, sf).select("channel", "i", "x"), "channel", "i", "x", 11)


@query("win_15_gaussian_bumps", f"""WITH {SIGNAL}, o AS (SELECT unnest(range(-8, 9)) AS o), n AS (SELECT channel, i + o AS i, sum(exp(-0.5 * pow(o / 2.0, 2))) AS v FROM signal, o WHERE state = 'purchase' GROUP BY 1, 2),
r AS (SELECT s.channel, s.i, coalesce(n.v, 0) AS v FROM signal s LEFT JOIN n USING (channel, i)), t AS (SELECT *, max(v) OVER (PARTITION BY channel) AS top FROM r)
SELECT channel, i, round_even(CASE WHEN top > 0 THEN v / top ELSE 0 END, 6) AS regressor FROM t""")
def win_15(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.operators.filters import bumps

    s = signal(spark, sf)
    out = bumps(s.where("state = 'purchase'"), s, "channel", "i", "i", 2.0)
    return out.select("channel", "i", half_even(F.col("regressor")).alias("regressor"))


@query("win_16_band_pass")
def win_16(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.operators.filters import band_pass

    return band_pass(long_signal(spark, sf).select("channel", "i", "x"), "channel", "i", "x", 100.0, 1.0, 45.0, 31)
