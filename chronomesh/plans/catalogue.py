"""Queries of the mode catalogue, cell repair, divergence, written tables and the scan grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.functions.columns import half_even as H
from chronomesh.operators import catalogue as K
from chronomesh.operators import ordinal as O
from chronomesh.operators import partition as P
from chronomesh.operators.sweep import load, save, swept
from chronomesh.operators.tasks import SCAN, planned
from chronomesh.plans.carriers import LONG_SIGNAL, MEMBERS, long_signal, members, points, table
from chronomesh.plans.domain import DISTANCES, _codes
from chronomesh.plans.registry import query
from chronomesh.sources.arrays import footers
from chronomesh.sources.shared import shared_path
from chronomesh.sources.signals import manifold_on, read_log, write_report, write_signal

MODES = 25

ENRICHED = f"""{MEMBERS}, sensors AS (SELECT 'MEG' || n_nationkey AS channel, 'R' || n_regionkey AS roi, CASE WHEN n_nationkey % 3 = 0 THEN 'mag' ELSE 'grad' END AS kind FROM nation),
e AS (SELECT mode, scale * 0.5::DOUBLE AS scale, CAST(3 + scale % 4 AS INTEGER) AS order_m, 'MEG ' || m.channel AS channel, coalesce(s.roi, 'Unknown') AS roi, coalesce(s.kind, 'meg') AS kind, dist
  FROM members m LEFT JOIN sensors s ON s.channel = 'MEG' || m.channel)"""


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Members with scale tags and channel names that have a blank, which the sensors (nations) haven't; half the channels aren't listed."""
    tags = O.tag(F.col("scale") * 0.5, 3 + F.col("scale") % 4)
    rows = members(spark, sf).select("mode", F.concat(F.lit("MEG "), "channel").alias("channel"), tags.alias("tag"), "dist")
    kind = F.when(F.col("n_nationkey") % 3 == 0, "mag").otherwise("grad")
    sensors = table(spark, sf, "nation").select(F.concat(F.lit("MEG"), "n_nationkey").alias("channel"), F.concat(F.lit("R"), "n_regionkey").alias("roi"), kind.alias("kind"))
    return K.enriched(rows, sensors)


@query(
    "orm_22_composition",
    f"""WITH {ENRICHED} SELECT mode, CASE WHEN grouping(channel) = 0 THEN 'channel' WHEN grouping(roi) = 0 THEN 'roi' ELSE 'scale' END AS level,
roi, channel, kind, scale, order_m, count(*) AS n, count(DISTINCT name) AS channels, min(dist) AS low, CAST(floor(avg(dist) * 100 + 1e-6::DOUBLE) AS BIGINT) AS mean_cents
FROM (SELECT *, channel AS name FROM e) GROUP BY GROUPING SETS ((mode, roi), (mode, roi, channel, kind), (mode, scale, order_m))""",
)
def orm_22_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Prices are in cents, so means are given as whole cents: rounded digits would meet exact ties of sums over powers of two."""
    found = K.composition(enriched(spark, sf))
    return found.withColumn("mean_cents", F.floor(F.col("mean_dist") * 100 + 1e-6)).drop("mean_dist")


@query(
    "orm_22_catalogue",
    f"""WITH {ENRICHED}, t AS (SELECT mode, count(*) AS total, min_by(channel, (dist, channel)) AS archetype, min(dist) AS low FROM e GROUP BY 1),
a AS (SELECT mode, scale, count(*) AS n FROM e GROUP BY 1, 2), b AS (SELECT mode, roi, count(*) AS n FROM e WHERE roi <> 'Unknown' GROUP BY 1, 2),
pa AS (SELECT *, n / sum(n) OVER (PARTITION BY mode) AS p FROM a), pb AS (SELECT *, n / sum(n) OVER (PARTITION BY mode) AS p FROM b),
sa AS (SELECT mode, min_by(scale, (-n, scale)) AS dominant_scale, -sum(p * log2(p)) / (SELECT log2(count(DISTINCT scale)) FROM a) AS h FROM pa GROUP BY 1),
sb AS (SELECT mode, min_by(roi, (-n, roi)) AS dominant_roi, -sum(p * log2(p)) / (SELECT log2(count(DISTINCT roi)) FROM b) AS h FROM pb GROUP BY 1)
SELECT CAST(k AS BIGINT) AS mode, coalesce(total, 0) AS total, dominant_scale, dominant_roi, archetype, low, round_even(coalesce(sa.h, 0), 6) AS scale_entropy, round_even(coalesce(sb.h, 0), 6) AS roi_entropy
FROM range({MODES}) r(k) LEFT JOIN t ON t.mode = k LEFT JOIN sa ON sa.mode = k LEFT JOIN sb ON sb.mode = k""",
)
def orm_22_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each of 25 modes, of which 20 have members."""
    return K.catalogue(enriched(spark, sf), MODES).withColumns({c: H(F.col(c)) for c in ("scale_entropy", "roi_entropy")})


@query(
    "orm_14_repair",
    f"""WITH {DISTANCES}, m AS (SELECT k, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM a JOIN embeddings ON vec_id = id, range(1, 65) r(i) GROUP BY 1, 2),
far AS (SELECT embedding AS v, row_number() OVER (ORDER BY dist DESC, id) AS r FROM a JOIN embeddings ON vec_id = id)
SELECT k, round_even(sum(x * x), 5) AS energy, round_even(max(x) FILTER (i = 1), 6) AS first FROM m GROUP BY 1
UNION ALL SELECT CAST(9 + r AS BIGINT), round_even(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5), round_even(CAST(v[1] AS DOUBLE), 6) FROM far WHERE r <= 2""",
)
def orm_14_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Centres after a step in which two of twelve, far from everything, were nobody's nearest."""
    p = points(spark, sf)
    centres = P.initial_centres(p, 10)
    away = centres.where("k = 9").select(F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.transform("centre", lambda x, s=s: x * s).alias("centre")) for k, s in ((10, 1000), (11, -1000))])).alias("c")).select("c.*")
    assigned = P.assign(p, centres.unionByName(away))
    found = P.repaired(assigned, P.means(assigned), 12)
    return found.select("k", H(P.energy(F.col("centre")), 5).alias("energy"), H(F.element_at("centre", 1)).alias("first"))


@query(
    "orm_01_divergence",
    f"""WITH {LONG_SIGNAL}, {_codes(3, "x")}, c AS (SELECT channel, code, count(*) AS n FROM codes GROUP BY 1, 2), g AS (SELECT channel, CAST(q AS BIGINT) AS code FROM (SELECT DISTINCT channel FROM c), range(6) r(q)),
p AS (SELECT channel, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY channel) AS p FROM g LEFT JOIN c USING (channel, code)), m AS (SELECT channel, p, (p + 1 / 6::DOUBLE) / 2 AS m FROM p)
SELECT channel, round_even(-sum(m * log2(m)) + coalesce(sum(p * log2(p)) FILTER (p > 0), 0) / 2 - log2(6::DOUBLE) / 2, 6) AS divergence FROM m GROUP BY 1""",
)
def orm_01(spark: SparkSession, sf: str) -> DataFrame:
    """Divergence of every channel's patterns of order 3 from equal shares."""
    counts = O.patterns(long_signal(spark, sf), "channel", "i", "x", 3).groupBy("channel", "code").agg(F.count("*").alias("n"))
    n = F.map_from_entries(F.collect_list(F.struct("code", "n")))
    rows = counts.groupBy("channel").agg(n.alias("n"), F.sum("n").alias("total"))
    p = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda c: F.coalesce(F.try_element_at("n", c.cast("long")), F.lit(0)) / F.col("total"))
    return rows.select("channel", H(O.jensen_shannon(p, F.array_repeat(F.lit(1 / 6), 6))).alias("divergence"))


CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("src_08_byte_order_mark", f"SELECT {', '.join(CUSTOMER)} FROM customer")
def src_08(spark: SparkSession, sf: str) -> DataFrame:
    """A report whose files begin with a byte-order mark, read by the names and types found in it."""
    path = shared_path(spark, "marked")
    rows = table(spark, sf, "customer").select(*CUSTOMER)
    write_report(rows.withColumnRenamed(CUSTOMER[0], "﻿" + CUSTOMER[0]), path)
    return read_log(spark, path).select(*[F.col(c).cast(rows.schema[c].dataType) for c in CUSTOMER])


@query("snk_06_bounded_files", "SELECT l_linenumber AS channel, count(*) AS n_rows, CAST(ceil(count(*) / 50000.0) AS BIGINT) AS n_files, least(max(CAST(50000 AS BIGINT)), count(*)) AS largest FROM lineitem GROUP BY 1")
def snk_06(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and files of each channel of a signal table written in files of at most 50,000 rows, by their footers."""
    path = shared_path(spark, "bounded")
    lines = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("channel"), F.col("l_orderkey").alias("i"), F.col("l_quantity").alias("x"))
    kind = lines.schema["channel"].dataType
    write_signal(lines, path, "channel", "i", rows_per_file=50_000)
    files = footers(spark, path).where("readable").withColumn("channel", F.regexp_extract("path", r"/channel=(\d+)/", 1).cast(kind))
    return files.where("channel IS NOT NULL").groupBy("channel").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_files"), F.max("n_rows").alias("largest"))


@query("snk_07_snapshots", "SELECT name, CAST(k AS BIGINT) AS k_clusters, CASE name WHEN 'summary' THEN 1 WHEN 'trajectories' THEN CAST(k AS BIGINT) ELSE (SELECT count(*) FROM embeddings) END AS n FROM unnest(['summary', 'trajectories', 'memberships']) a(name), unnest([4, 8]) b(k)")
def snk_07(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by number of cells of a sweep's tables, written and read back."""
    path = shared_path(spark, "snapshots")
    save(swept(points(spark, sf), [4, 8], max_steps=6), path)
    found, out = load(spark, path), None
    for name in ("summary", "trajectories", "memberships"):
        rows = getattr(found, name).groupBy("k_clusters").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "k_clusters", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def _draw(place: int) -> str:
    return f"(CAST(('0x' || substr(md5('42:{place}:' || vec_id), 1, 8))::BIGINT AS DOUBLE) + 0.5) / 4294967296.0::DOUBLE"


def _normal(place: int) -> str:
    return f"sqrt(-2 * ln({_draw(place)})) * cos(2 * pi() * {_draw(place + 1)})"


@query(
    "src_18_manifolds",
    f"""WITH d AS (SELECT vec_id AS id, {_draw(0)} AS u, {_draw(1)} AS v, {_normal(2)} AS g0, {_normal(4)} AS g1, {_normal(6)} AS g2 FROM embeddings),
t AS (SELECT *, 2 * pi() * u AS a, 2 * pi() * v AS b, 1.5 * pi() * (1 + 2 * u) AS roll, 3 * pi() * (u - 0.5) AS bend, sqrt(g0 * g0 + g1 * g1 + g2 * g2) AS g FROM d),
f AS (SELECT 'sphere' AS kind, id, [g0 / g, g1 / g, g2 / g] AS f FROM t UNION ALL SELECT 'torus', id, [(1 + 0.3 * cos(b)) * cos(a), (1 + 0.3 * cos(b)) * sin(a), 0.3 * sin(b)] FROM t
UNION ALL SELECT 'swiss_roll', id, [roll * cos(roll), 21 * v, roll * sin(roll)] FROM t UNION ALL SELECT 's_curve', id, [sin(bend), 2 * v, sign(bend) * (cos(bend) - 1)] FROM t
UNION ALL SELECT 'circle', id, [cos(a), sin(a)] FROM t UNION ALL SELECT 'figure_eight', id, [sin(a), sin(a) * cos(a)] FROM t)
SELECT kind, id, round_even(f[1], 6) AS x, round_even(f[2], 6) AS y, round_even(f[3], 6) AS z FROM f""",
)
def src_18(spark: SparkSession, sf: str) -> DataFrame:
    """A point on each surface and curve for every vector's id."""
    ids, out = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), None
    for kind in ("sphere", "torus", "swiss_roll", "s_curve", "circle", "figure_eight"):
        rows = manifold_on(ids, kind).select(F.lit(kind).alias("kind"), "id", *[H(F.get("features", k)).alias(c) for k, c in enumerate("xyz")])
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "orc_04_scan_grid",
    """WITH s AS (SELECT s_name AS source, s_suppkey < 3 AS control FROM supplier), t AS (SELECT source, n FROM s, unnest([12, 16, 24, 32, 48, 64, 100]) u(n) WHERE control UNION ALL SELECT source, n FROM s, unnest([24, 48]) u(n) WHERE NOT control)
SELECT source, n AS states, CAST(floor(40000 * (n / 48)) AS BIGINT) AS steps FROM t""",
)
def orc_04(spark: SparkSession, sf: str) -> DataFrame:
    """The scan of states: control sources at seven values, all others at two."""
    kind = F.when(F.col("s_suppkey") < 3, "control").otherwise("other")
    sources = table(spark, sf, "supplier").select(F.col("s_name").alias("source"), kind.alias("kind"), F.lit(False).alias("reference"), F.lit(0).alias("samples"))
    return planned(sources, SCAN).select("source", "states", "steps")
