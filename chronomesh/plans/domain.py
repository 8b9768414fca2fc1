"""Queries of the domain operators: ordinal entropy, set partition, dimension estimates, spectra, task grids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronomesh.functions.columns import half_even, total
from chronomesh.operators import estimators as E
from chronomesh.operators import ordinal as O
from chronomesh.operators import partition as P
from chronomesh.operators.ranges import quantiles
from chronomesh.operators.sweep import Swept, swept
from chronomesh.plans.carriers import LONG_SIGNAL, SPECTRUM, long_signal, points, spectrum, table
from chronomesh.plans.registry import query

H = half_even


def _codes(m: int, value: str) -> str:
    """SQL of the pattern codes of order m."""
    leads = ", ".join(f"lead({value}, {k}) OVER w AS x{k}" for k in range(1, m))
    terms = []
    for j in range(m - 1):
        inversions = " + ".join(f"(x{j} > x{k})::INT" for k in range(j + 1, m))
        terms.append(f"({inversions}) * {math.factorial(m - 1 - j)}")
    return f"""t AS (SELECT channel, i, {value} AS x0, {leads} FROM long_signal WINDOW w AS (PARTITION BY channel ORDER BY i)),
codes AS (SELECT channel, i, {" + ".join(terms)} AS code FROM t WHERE x{m - 1} IS NOT NULL)"""


def _features(m: int, value: str, window: int, stride: int) -> str:
    """SQL of entropy and complexity on both sides of every centre."""
    n, q0 = math.factorial(m), O.q0(math.factorial(m))
    u = 1 / n
    unseen = -0.5 * u * math.log2(0.5 * u + 1e-13)
    return f"""WITH {LONG_SIGNAL}, {_codes(m, value)}, sizes AS (SELECT channel, max(i) + 1 AS n FROM long_signal GROUP BY 1),
centres AS (SELECT channel, unnest(range({window}, n - {window}, {stride})) AS centre FROM sizes),
counts AS (SELECT c.channel, c.centre, 'left' AS side, code, count(*) AS k FROM centres c JOIN codes o ON o.channel = c.channel AND o.i BETWEEN c.centre - {window} AND c.centre - {m} GROUP BY ALL
  UNION ALL SELECT c.channel, c.centre, 'right', code, count(*) FROM centres c JOIN codes o ON o.channel = c.channel AND o.i BETWEEN c.centre AND c.centre + {window - m} GROUP BY ALL),
p AS (SELECT channel, centre, side, k / {float(window - m + 1)}::DOUBLE AS p FROM counts),
h AS (SELECT channel, centre, side, sum(-p * log2(p + 1e-13)) AS h, sum(-((p + {u}::DOUBLE) / 2) * log2((p + {u}::DOUBLE) / 2 + 1e-13)) + ({n} - count(*)) * {unseen}::DOUBLE AS mixed FROM p GROUP BY 1, 2, 3),
e AS (SELECT channel, centre, side, h / {math.log2(n)}::DOUBLE AS pe, (mixed - h / 2 - {math.log2(n) / 2}::DOUBLE) * (h / {math.log2(n)}::DOUBLE) * {q0}::DOUBLE AS sc FROM h)
SELECT channel, centre, round_even(max(CASE WHEN side = 'left' THEN pe END), 5) AS pe_left, round_even(max(CASE WHEN side = 'left' THEN sc END), 5) AS sc_left,
  round_even(max(CASE WHEN side = 'right' THEN pe END), 5) AS pe_right, round_even(max(CASE WHEN side = 'right' THEN sc END), 5) AS sc_right FROM e GROUP BY 1, 2"""


SIDES = ["channel", "centre", "pe_left", "sc_left", "pe_right", "sc_right"]


@query("ec_06_features_m3", _features(3, "x", 40, 10))
def ec_06(spark: SparkSession, sf: str) -> DataFrame:
    return O.features(long_signal(spark, sf).select("channel", "i", "x"), "channel", "i", "x", [40], 10).select(*SIDES)


@query("ec_06_features_m4", _features(4, "price", 130, 20))
def ec_06b(spark: SparkSession, sf: str) -> DataFrame:
    s = long_signal(spark, sf).select("channel", "i", F.col("price").alias("x"))
    return O.features(s, "channel", "i", "x", [130], 20).select(*SIDES)


@query("ec_08_multi_scale")
def ec_08(spark: SparkSession, sf: str) -> DataFrame:
    s = long_signal(spark, sf).select("channel", "i", F.col("price").alias("x"))
    return O.features(s, "channel", "i", "x", [30, 60, 120, 200], 20)


@query("ec_10_deltas", f"WITH f AS ({_features(3, 'x', 40, 10)}) SELECT channel, centre, round_even(abs(pe_left - pe_right), 6) AS d_pe, round_even(abs(sc_left - sc_right), 6) AS d_sc, round_even(abs(pe_left - pe_right) + abs(sc_left - sc_right), 6) AS delta_ec FROM f")
def ec_10(spark: SparkSession, sf: str) -> DataFrame:
    f = O.features(long_signal(spark, sf).select("channel", "i", "x"), "channel", "i", "x", [40], 10)
    return f.select("channel", "centre", *[H(F.col(c)).alias(c) for c in ("d_pe", "d_sc", "delta_ec")])


@query("ec_03_pattern_codes", f"WITH {LONG_SIGNAL}, {_codes(4, 'x')} SELECT channel, i, CAST(code AS BIGINT) AS code FROM codes")
def ec_03(spark: SparkSession, sf: str) -> DataFrame:
    return O.patterns(long_signal(spark, sf).select("channel", "i", "x"), "channel", "i", "x", 4)


@query("ec_05_permutation_entropy", f"WITH {LONG_SIGNAL}, {_codes(3, 'x')}, c AS (SELECT channel, code, count(*) AS n FROM codes GROUP BY 1, 2), p AS (SELECT channel, n / sum(n) OVER (PARTITION BY channel) AS p FROM c) SELECT channel, round_even(-sum(p * log2(p + 1e-13)) / log2(6.0::DOUBLE), 6) AS pe FROM p GROUP BY 1")
def ec_05(spark: SparkSession, sf: str) -> DataFrame:
    counts = O.patterns(long_signal(spark, sf).select("channel", "i", "x"), "channel", "i", "x", 3).groupBy("channel", "code").agg(F.count("*").alias("n"))
    return O.entropy_complexity(counts, ["channel"], 3).select("channel", H(F.col("pe")).alias("pe"))


@query("ec_01_order_selection", "SELECT p_partkey, CAST(CASE WHEN w >= 3600 THEN 6 WHEN w >= 600 THEN 5 WHEN w >= 120 THEN 4 ELSE 3 END AS INTEGER) AS m FROM (SELECT p_partkey, p_size * 100 AS w FROM part)")
def ec_01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", O.order_column(F.col("p_size") * 100).alias("m"))


@query("ec_02_q0", "SELECT p_partkey, round_even(-2 / (((n + 1) / n) * log2(n + 1) + log2(n) - 2 * log2(2 * n)), 9) AS q0 FROM (SELECT p_partkey, CAST(p_size + 1 AS DOUBLE) AS n FROM part)")
def ec_02(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.col("p_size") + 1).cast("double")
    return table(spark, sf, "part").select("p_partkey", H(O.q0_column(n), 9).alias("q0"))


@query("ec_09_window_grid", """WITH g AS (SELECT p_partkey, k, CAST(round_even((0.2::DOUBLE + k * 4.8::DOUBLE / 49) * (p_size * 20), 0) AS BIGINT) AS w FROM part, range(50) r(k))
SELECT p_partkey, k, w, CAST(CASE WHEN w >= 3600 THEN 6 WHEN w >= 600 THEN 5 WHEN w >= 120 THEN 4 ELSE 3 END AS INTEGER) AS m FROM g""")
def ec_09(spark: SparkSession, sf: str) -> DataFrame:
    recordings = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 20).cast("double").alias("rate"))
    rows = O.with_windows(recordings, "rate", [0.2 + k * 4.8 / 49 for k in range(50)])
    k = F.round((F.col("seconds") - 0.2) * 49 / 4.8).cast("long")
    return rows.select("p_partkey", k.alias("k"), "w", "m")


@query("ec_11_tags", "SELECT p_partkey, 'w_' || CASE WHEN s < 1 THEN printf('%.3f', s) ELSE printf('%.1f', s) END || 's_m' || 3 AS tag FROM (SELECT p_partkey, p_size / 7 AS s FROM part)")
def ec_11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", O.tag(F.col("p_size") / 7, F.lit(3)).alias("tag"))


@query("orm_04_tag_parse", r"SELECT p_partkey, CAST(regexp_extract(t, '^w_([0-9.]+)s_m([0-9]+)$', 1) AS DOUBLE) AS seconds, CAST(regexp_extract(t, '^w_([0-9.]+)s_m([0-9]+)$', 2) AS INTEGER) AS m FROM (SELECT p_partkey, 'w_' || printf('%.1f', p_size / 5) || 's_m' || (3 + p_size % 4) AS t FROM part)")
def orm_04(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("w_"), F.format_string("%.1f", F.col("p_size") / 5), F.lit("s_m"), 3 + F.col("p_size") % 4)
    seconds, m = O.parse_tag(F.col("t"))
    return table(spark, sf, "part").select("p_partkey", t.alias("t")).select("p_partkey", seconds.alias("seconds"), m.alias("m"))


@query("orm_06_displacement", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(sqrt(l_discount * l_discount + l_tax * l_tax) * sqrt((l_quantity + 30 - 3 + 1) / 6), 6) AS v FROM lineitem")
def orm_06(spark: SparkSession, sf: str) -> DataFrame:
    v = O.displacement(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") + 30, F.lit(3))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", H(v).alias("v"))


@query("orm_03_complexity_ratio", f"SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_tax / {O.largest_complexity(3)!r}::DOUBLE, 6) AS ratio FROM lineitem")
def orm_03(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", H(F.col("l_tax") / O.largest_complexity(3)).alias("ratio"))


@query("orm_07_trajectories", f"WITH {LONG_SIGNAL} SELECT channel, list(x ORDER BY i) AS v FROM long_signal GROUP BY 1")
def orm_07(spark: SparkSession, sf: str) -> DataFrame:
    s = long_signal(spark, sf).groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    return s.select("channel", F.transform("s", lambda p: p["x"]).alias("v"))


@query("orm_08_energy", "SELECT vec_id AS id, round_even(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS energy FROM embeddings")
def orm_08(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("id", H(P.energy(F.col("v"))).alias("energy"))


ENERGY = "e AS (SELECT vec_id AS id, embedding AS v, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS e FROM embeddings), r AS (SELECT *, row_number() OVER (ORDER BY e, id) - 1 AS r, count(*) OVER () AS m FROM e)"
CENTRES = f"{ENERGY}, c AS (SELECT CAST(k AS BIGINT) AS k, r.v AS c FROM range(10) q(k) JOIN r ON r.r = CAST(floor(k * (m - 1) / 9) AS BIGINT))"
DISTANCES = f"""{CENTRES}, d AS (SELECT vec_id AS id, k, list_sum(list_transform(list_zip(embedding, c), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS dist FROM embeddings, c),
a AS (SELECT id, min_by(k, (dist, k)) AS k, min(dist) AS dist FROM d GROUP BY 1)"""


@query("orm_09_initial_centres", f"WITH {CENTRES} SELECT k, round_even(CAST(c[1] AS DOUBLE), 6) AS first, round_even(CAST(c[64] AS DOUBLE), 6) AS last FROM c")
def orm_09(spark: SparkSession, sf: str) -> DataFrame:
    c = P.initial_centres(points(spark, sf), 10)
    return c.select("k", H(F.element_at("centre", 1)).alias("first"), H(F.element_at("centre", -1)).alias("last"))


@query("orm_11_assignment", f"WITH {DISTANCES} SELECT id, k, round_even(dist, 6) AS dist FROM a")
def orm_11(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return P.assign(p, P.initial_centres(p, 10)).select("id", "k", H(F.col("dist")).alias("dist"))


@query("orm_12_functional", f"WITH {DISTANCES} SELECT round_even(sum(a.dist), 5) AS functional, round_even(1 - sum(a.dist) / (SELECT sum(e) FROM e), 6) AS r2, count(DISTINCT k) AS cells FROM a")
def orm_12(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    a = P.assign(p, P.initial_centres(p, 10))
    j, e = F.sum("dist"), F.sum(P.energy(F.col("v")))
    return a.agg(H(j, 5).alias("functional"), H(1 - j / e).alias("r2"), F.countDistinct("k").alias("cells"))


@query("orm_14_farthest", f"WITH {DISTANCES} SELECT id, round_even(dist, 6) AS dist FROM a ORDER BY a.dist DESC, id LIMIT 5")
def orm_14(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return P.assign(p, P.initial_centres(p, 10)).orderBy(F.desc("dist"), "id").limit(5).select("id", H(F.col("dist")).alias("dist"))


@query("orm_17_canonical_order", "WITH c AS (SELECT CAST(label AS BIGINT) AS k, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2), e AS (SELECT k, sum(x * x) AS e FROM c GROUP BY 1) SELECT k, row_number() OVER (ORDER BY e, k) - 1 AS name FROM e")
def orm_17(spark: SparkSession, sf: str) -> DataFrame:
    return P.canonical(P.means(points(spark, sf).select("v", F.col("label").cast("long").alias("k")))).select("k", "name")


@query("orm_18_partition")
def orm_18(spark: SparkSession, sf: str) -> DataFrame:
    return P.partition(points(spark, sf), 8)[0]


#: The numbers of cells that are swept.
K_GRID = (20, 35, 45, 50, 60, 65, 70, 80, 90, 100, 150, 200, 250, 300)


def _swept(spark: SparkSession, sf: str) -> Swept:
    return swept(points(spark, sf), list(K_GRID))


@query("orm_19_sweep")
def orm_19(spark: SparkSession, sf: str) -> DataFrame:
    found = _swept(spark, sf)
    own = found.history.groupBy("k_clusters").agg(F.sum("compared").alias("compared"), F.min("cells").alias("fewest_cells"))
    return found.summary.join(own, "k_clusters")


@query("orm_19_memberships")
def orm_19_memberships(spark: SparkSession, sf: str) -> DataFrame:
    found = _swept(spark, sf)
    return found.memberships.join(found.trajectories.select("k_clusters", "k", P.energy(F.col("centre")).alias("centre_energy")), ["k_clusters", "k"])


@query("qc_22_threshold", f"WITH {SPECTRUM} SELECT id, len(list_filter(ev, lambda x: x > 0.5)) AS d FROM spectrum")
def qc_22(spark: SparkSession, sf: str) -> DataFrame:
    return spectrum(spark, sf).select("id", E.threshold_dimension(F.col("ev")).alias("d"))


@query("qc_23_ratio_gap", f"WITH {SPECTRUM}, q AS (SELECT id, ev, list_transform(range(1, len(ev)), lambda i: ev[i] / (ev[i + 1] + {E.TINY!r}::DOUBLE)) AS q FROM spectrum) SELECT id, CASE WHEN ev[1] > 10 * {E.TINY!r}::DOUBLE THEN CAST(list_position(q, list_max(q)) AS BIGINT) ELSE 0 END AS d FROM q")
def qc_23(spark: SparkSession, sf: str) -> DataFrame:
    return spectrum(spark, sf).select("id", E.ratio_gap_dimension(F.col("ev")).alias("d"))


@query("qc_24_noise_threshold", f"WITH {SPECTRUM}, s AS (SELECT id, list_transform(ev, lambda x: sqrt(x)) AS s FROM spectrum), m AS (SELECT id, s, list_sort(s[33:64]) AS b FROM s) SELECT id, len(list_filter(s, lambda x: x > (b[16] + b[17]) / 2 * {E.hard_threshold(64 / 306) / E.noise_median(64 / 306)!r}::DOUBLE)) AS d FROM m")
def qc_24(spark: SparkSession, sf: str) -> DataFrame:
    return spectrum(spark, sf).select("id", E.noise_dimension(F.col("ev"), 64, 306).alias("d"))


@query("qc_27_participation", f"WITH {SPECTRUM} SELECT id, round_even(pow(list_sum(ev), 2) / (list_sum(list_transform(ev, lambda x: x * x)) + 1e-12), 6) AS pr FROM spectrum")
def qc_27(spark: SparkSession, sf: str) -> DataFrame:
    return spectrum(spark, sf).select("id", H(E.participation_ratio(F.col("ev"))).alias("pr"))


@query("qc_21_rank_bound", f"WITH {SPECTRUM} SELECT id, len(list_filter(ev, lambda x: x > 1e-5)) > 46 AS broken FROM spectrum")
def qc_21(spark: SparkSession, sf: str) -> DataFrame:
    return spectrum(spark, sf).select("id", E.rank_bound_broken(F.col("ev"), 24).alias("broken"))


@query("qc_15_residual", "SELECT a.vec_id AS id, round_even(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))), 6) AS residual FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def qc_15(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    near = p.select((F.col("id") - 1).alias("id"), F.col("v").alias("y"))
    return p.join(near, "id").select("id", H(F.sqrt(P.squared_distance(F.col("v"), F.col("y")))).alias("residual"))


@query("qc_02_takens_vectors", "WITH e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding AS v FROM embeddings), t AS (SELECT label, i, list_concat(list_concat(v, lag(v, 2) OVER w), lag(v, 4) OVER w) AS v FROM e WINDOW w AS (PARTITION BY label ORDER BY i)) SELECT label, i, list_transform(v, lambda x: CAST(x AS DOUBLE)) AS v FROM t WHERE i >= 4")
def qc_02(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.operators.joins import takens

    i = F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1
    p = points(spark, sf).select(F.col("label").cast("long").alias("label"), i.cast("long").alias("i"), "v")
    return takens(p, "label", "i", "v", 3, 2)


def _features_of(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("id", F.col("v").alias("features"))


@query("qc_34_spectra")
def qc_34(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.operators import spectral

    out = spectral.spectra(_features_of(spark, sf), spectral.initial_operators(64, 6, 42))
    return out.select("id", "eigenvalues", "metric_trace", "residual", "local_variance", "ground_eigenvalue", "first_gap", E.ratio_gap_dimension(F.col("eigenvalues")).alias("d"))


@query("qc_19_trace_identity")
def qc_19(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.operators import spectral

    out = spectral.spectra(_features_of(spark, sf), spectral.initial_operators(64, 6, 42))
    return out.select("id", (F.abs(total(F.col("eigenvalues")) - F.col("metric_trace")) <= 1e-6 * F.col("metric_trace")).alias("holds"))


@query("qc_31_training")
def qc_31(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.operators import spectral

    losses = spectral.fit(_features_of(spark, sf), 4, 5)[1]
    return spark.createDataFrame(list(enumerate(losses)), "step int, loss double")


@query("qc_33_validation_history")
def qc_33(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.operators import spectral

    # every fifth point by hash is held out
    both = _features_of(spark, sf).withColumn("held", F.pmod(F.xxhash64("id"), F.lit(5)) == 0)
    history = spectral.train(both.where("NOT held"), both.where("held"), 4, 4, variance_weight=0.1, commutator_weight=0.01)[1]
    return spark.createDataFrame([tuple(r.values()) for r in history], "step int, loss double, held_loss double, held_residual double")


@query("orc_05_task_grid", """WITH d AS (SELECT DISTINCT c_nationkey AS source, length(c_mktsegment) AS states, m FROM customer, unnest([1, 2, 4, 6]) b(m)),
c AS (SELECT *, 3000.0::DOUBLE * m * states * states / (6 * 48 * 48) AS cost FROM d)
SELECT source, states, m, round_even(cost, 6) AS cost, (row_number() OVER (ORDER BY cost DESC, source, states, m) - 1) % 7 AS grp FROM c""")
def orc_05(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.operators.tasks import cost, grouped, with_options

    sources = table(spark, sf, "customer").select(F.col("c_nationkey").alias("source"), F.length("c_mktsegment").cast("long").alias("states"))
    rows = with_options(sources.distinct(), {"m": [1, 2, 4, 6]})
    rows = grouped(rows.withColumn("cost", cost(F.lit(40_000), F.col("m"), F.col("states"))), 7, ["source", "states", "m"])
    return rows.select("source", "states", "m", H(F.col("cost")).alias("cost"), "grp")


@query("orc_05_task_families", """WITH s AS (
  SELECT n_name AS source, 'recorded' AS kind, n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) AS ref, 0 AS samples FROM nation
  UNION ALL SELECT r_name, 'synthetic', r_name < 'B', 2000 + 1000 * (r_regionkey % 2) FROM region
), t AS (
  SELECT source, kind, samples, 48 AS states, 6 AS delays, 25.0 AS delay_ms, 'block_rms' AS scaling, 0.005 AS variance_weight, false AS fixed_states FROM s WHERE kind = 'recorded'
  UNION SELECT source, kind, samples, 48, 6, 25.0, 'channel_zscore', 0.005, false FROM s WHERE kind = 'recorded'
  UNION SELECT source, kind, samples, 48, 1, 0.0, 'block_rms', 0.005, false FROM s WHERE kind = 'synthetic'
  UNION SELECT source, kind, samples, n, 1, 0.0, 'block_rms', 0.005, false FROM s, unnest([8, 12, 16, 24, 32, 48]) u(n) WHERE kind = 'synthetic' AND ref
  UNION SELECT source, kind, samples, 48, 6, d, 'block_rms', 0.005, false FROM s, unnest([10.0, 25.0, 50.0]) u(d) WHERE kind = 'recorded' AND ref
  UNION SELECT source, kind, samples, 48, 6, 25.0, 'block_rms', 0.01, false FROM s WHERE kind = 'recorded' AND ref
  UNION SELECT source, kind, samples, n, 1, 0.0, 'block_rms', 0.005, false FROM s, unnest([20, 24, 28, 32, 36, 40, 48, 56, 64]) u(n) WHERE kind = 'recorded' AND ref
  UNION SELECT source, kind, samples, n, 6, 25.0, 'block_rms', 0.005, false FROM s, unnest([24, 28, 32, 36, 40, 44, 48, 52, 56, 64, 80]) u(n) WHERE kind = 'recorded' AND ref
  UNION SELECT source, kind, samples, 48, 6, 25.0, 'block_rms', 0.005, true FROM s WHERE kind = 'recorded' AND ref
), n AS (
  SELECT *, CAST(CASE WHEN kind = 'synthetic' THEN 300 * greatest(1, ceil(samples / 2048)) ELSE floor(40000 * (states / 48) * sqrt(delays / 6.0::DOUBLE)) END AS BIGINT) AS steps FROM t
)
SELECT source, states, delays, CAST(delay_ms AS DOUBLE) AS delay_ms, scaling, CAST(variance_weight AS DOUBLE) AS variance_weight, fixed_states, steps,
  CAST(floor(3000.0::DOUBLE * (steps * delays * states * states) / (40000::DOUBLE * 6 * 48 * 48)) AS BIGINT) AS cost FROM n""")
def orc_05_families(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.operators.tasks import planned

    first = F.col("n_nationkey") == F.min("n_nationkey").over(Window.partitionBy("n_regionkey"))
    recorded = table(spark, sf, "nation").select(F.col("n_name").alias("source"), F.lit("recorded").alias("kind"), first.alias("reference"), F.lit(0).alias("samples"))
    synthetic = table(spark, sf, "region").select(F.col("r_name").alias("source"), F.lit("synthetic").alias("kind"), (F.col("r_name") < "B").alias("reference"), (2000 + 1000 * (F.col("r_regionkey") % 2)).alias("samples"))
    return planned(recorded.unionByName(synthetic)).drop("kind", "samples")


DIMENSION = f"{SPECTRUM}, q AS (SELECT id, ev, list_transform(range(1, len(ev)), lambda i: ev[i] / (ev[i + 1] + {E.TINY!r}::DOUBLE)) AS q FROM spectrum), dims AS (SELECT id, CASE WHEN ev[1] > 10 * {E.TINY!r}::DOUBLE THEN CAST(list_position(q, list_max(q)) AS BIGINT) ELSE 0 END AS d FROM q)"


@query("qc_35_event_related_dimension", f"WITH {DIMENSION}, b AS (SELECT min(id) AS lo, max(id) AS hi FROM dims), ep AS (SELECT s.id - e.id AS o, s.d FROM dims e CROSS JOIN b JOIN dims s ON s.id BETWEEN e.id - 3 AND e.id + 3 WHERE e.id % 10 = 0 AND e.id - 3 >= lo AND e.id + 3 <= hi) SELECT CAST(o AS INTEGER) AS o, round_even(avg(d), 6) AS mean, round_even(stddev_samp(d) / sqrt(count(*)), 6) AS sem, count(*) AS n FROM ep GROUP BY 1")
def qc_35(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.operators.aggregates import event_related
    from chronomesh.operators.joins import epochs

    dims = spectrum(spark, sf).select(F.lit(1).alias("channel"), F.col("id").alias("i"), E.ratio_gap_dimension(F.col("ev")).alias("d"))
    events = dims.where("i % 10 = 0").select("channel", F.col("i").alias("centre"))
    rows = event_related(epochs(dims, events, "channel", "i", "centre", 3, 3).withColumnRenamed("offset", "o"), ["o"], "d")
    return rows.select("o", H(F.col("mean")).alias("mean"), H(F.col("sem")).alias("sem"), "n")


@query("qc_37_comparison_frames", f"WITH {DIMENSION}, c AS (SELECT 'even' AS grp, id, d FROM dims WHERE id % 2 = 0 UNION ALL SELECT 'odd', id, d FROM dims WHERE id % 2 = 1), n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS r, greatest(1, count(*) OVER (PARTITION BY grp) // 100) AS step FROM c) SELECT grp, d, count(*) AS n FROM n WHERE r % step = 0 GROUP BY 1, 2")
def qc_37(spark: SparkSession, sf: str) -> DataFrame:
    dims = spectrum(spark, sf).select("id", E.ratio_gap_dimension(F.col("ev")).alias("d"))
    both = dims.where("id % 2 = 0").withColumn("grp", F.lit("even")).unionByName(dims.where("id % 2 = 1").withColumn("grp", F.lit("odd")))
    r = F.row_number().over(Window.partitionBy("grp").orderBy("id")) - 1
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.count("*").over(Window.partitionBy("grp")) / 100))
    return both.withColumns({"r": r, "step": step}).where("r % step = 0").groupBy("grp", "d").agg(F.count("*").alias("n"))


@query("orm_20_anatomy", f"WITH {LONG_SIGNAL}, c AS (SELECT channel, i, price, sum(price * price) OVER (PARTITION BY channel ORDER BY i) / sum(price * price) OVER (PARTITION BY channel) AS share FROM long_signal), t AS (SELECT channel, (share + lag(share) OVER (PARTITION BY channel ORDER BY i)) / 2 AS a FROM c), g AS (SELECT channel, avg(a) AS area FROM t GROUP BY 1), q AS (SELECT channel, quantile_cont(price, 0.5::DOUBLE) AS q50, quantile_cont(price, 0.99::DOUBLE) AS q99, max(price) AS top FROM long_signal GROUP BY 1) SELECT channel, round_even(q50, 5) AS q50, round_even(q99, 5) AS q99, top, round_even(greatest(0, least(1, 1 - 2 * least(area, 1 - area))), 6) AS localisation FROM q JOIN g USING (channel)")
def orm_20(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.operators.aggregates import energy_localisation
    from chronomesh.operators.sequences import cumulative_energy

    s = long_signal(spark, sf).select("channel", "i", "price")
    at = lambda q: F.max(F.when(F.col("q") == q, F.col("x")))
    q = quantiles(s, ["channel"], "price", [0.5, 0.99, 1.0]).groupBy("channel").agg(H(at(0.5), 5).alias("q50"), H(at(0.99), 5).alias("q99"), at(1.0).alias("top"))
    g = energy_localisation(cumulative_energy(s, "channel", "i", "price"), "channel", "i")
    return q.join(g, "channel").withColumn("localisation", H(F.col("localisation")))


@query("orm_21_stimulus_correlation")
def orm_21(spark: SparkSession, sf: str) -> DataFrame:
    """Per channel: the trimmed, smoothed signal against bumps at its large samples, at the lags 0 to 8, and the lag of the peak."""
    from chronomesh.operators.aggregates import correlation, first_best
    from chronomesh.operators.filters import bumps, smoothed
    from chronomesh.operators.joins import lagged

    s = long_signal(spark, sf).select("channel", "i", "x")
    s = s.join(s.groupBy("channel").agg(F.max("i").alias("m")), "channel").where("i <= m - 50").drop("m")
    regressor = bumps(s.where("x >= 49"), s, "channel", "i", "i", 2.0)
    met = lagged(smoothed(s, "channel", "i", "x", 11), regressor, "channel", "i", 0, 8)
    r = correlation(met, ["channel", "lag"], "x", "regressor")
    best = first_best(r, ["channel"], "lag", "r", "lag").withColumnsRenamed({"lag": "peak_lag", "r": "peak"})
    return best.join(r.where("lag = 0").select("channel", F.col("r").alias("zero_lag")), "channel")


@query("orc_06_costs", "SELECT p_partkey, round_even(3000.0::DOUBLE * (40000.0::DOUBLE * (1 + p_size % 6) * p_size * p_size) / (40000.0::DOUBLE * 6 * 48 * 48), 6) AS cost FROM part")
def orc_06(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.operators.tasks import cost

    size = F.col("p_size").cast("double")
    return table(spark, sf, "part").select("p_partkey", H(cost(F.lit(40_000.0), 1 + F.col("p_size") % 6, size)).alias("cost"))
