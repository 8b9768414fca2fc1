"""Queries that align tables: scans, predicates, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronomesh.functions import columns as C
from chronomesh.operators import joins as J
from chronomesh.operators.ranks import ranked
from chronomesh.operators.tasks import grouped
from chronomesh.plans.carriers import LONG_SIGNAL, MEMBERS, SIGNAL, long_signal, members, points, signal, table
from chronomesh.plans.registry import query
from chronomesh.sources.shared import shared_path
from chronomesh.sources.signals import found, in_batches, parameters, read_log, write_report, write_signal

H = C.half_even


@query("src_03_single_channel", f"WITH {SIGNAL} SELECT channel, i, x FROM signal WHERE channel = 7")
def src_03(spark: SparkSession, sf: str) -> DataFrame:
    return signal(spark, sf, 7).select("channel", "i", "x")


@query("src_05_channel_resolution", """WITH p AS (SELECT c_nationkey AS session, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'FURNITURE' THEN 3 ELSE 4 END AS prio, c_custkey FROM customer)
SELECT session, arg_min(name, (prio, c_custkey)) AS stim FROM p GROUP BY session""")
def src_05(spark: SparkSession, sf: str) -> DataFrame:
    prio = F.when(F.col("c_mktsegment") == "BUILDING", 1).when(F.col("c_mktsegment") == "MACHINERY", 2).when(F.col("c_mktsegment") == "FURNITURE", 3).otherwise(4)
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("session")).agg(F.min_by("c_name", F.struct(prio, "c_custkey")).alias("stim"))


@query("src_12_row_counts", "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders")
def src_12(spark: SparkSession, sf: str) -> DataFrame:
    out = [table(spark, sf, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("events", "lineitem", "orders")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("src_16_name_parameters", r"SELECT page_id, regexp_extract(url, '://([^/]*)/', 1) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, TRY_CAST(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) AS BIGINT) AS number FROM pages")
def src_16(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf, "pages").select("page_id", part("://([^/]*)/").alias("host"), part("/([a-z]{2})/").alias("lang"), F.expr("try_cast(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) AS BIGINT)").alias("number"))


@query("src_17_registry", """SELECT o_orderkey, coalesce(t.rank, 0) AS rank, coalesce(t.name, 'unknown') AS name
FROM orders LEFT JOIN (VALUES ('F', 1, 'finished'), ('O', 2, 'open'), ('P', 3, 'partial')) t(code, rank, name) ON t.code = o_orderstatus""")
def src_17(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.sources.signals import registered

    registry = [("F", 1, "finished"), ("O", 2, "open"), ("P", 3, "partial")]
    rows = registered(table(spark, sf, "orders"), registry, "o_orderstatus", "code string, rank int, name string")
    return rows.select("o_orderkey", F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("name", F.lit("unknown")).alias("name"))


@query("snk_01_quantised", """SELECT l_orderkey, l_linenumber, l_partkey, round_even(round_even(l_extendedprice / (2 * e.eps), 0) * 2 * e.eps, 6) AS price
FROM lineitem JOIN (VALUES ('A', 0.5::DOUBLE), ('N', 0.25::DOUBLE), ('R', 0.125::DOUBLE)) e(kind, eps) ON e.kind = l_returnflag""")
def snk_01(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.sources.signals import quantised

    bounds = spark.createDataFrame([("A", 0.5), ("N", 0.25), ("R", 0.125)], "l_returnflag string, eps double")
    rows = quantised(table(spark, sf, "lineitem"), bounds, "l_returnflag", "l_extendedprice")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", H(F.col("l_extendedprice")).alias("price"))


@query("snk_03_provenance", "SELECT o_orderkey, o_orderpriority AS bigrams, o_totalprice < 100000 AS is_synthetic FROM orders")
def snk_03(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", C.first_existing(o, ["bigrams", "o_orderpriority"]).alias("bigrams"), (F.col("o_totalprice") < 100000).alias("is_synthetic"))


@query("snk_11_pending", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09)")
def snk_11(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "lineitem").where("l_quantity > 49 AND l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey"))
    return J.complete(table(spark, sf, "supplier").select("s_suppkey"), done, ["s_suppkey"])


@query("prj_01_pick_kinds", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')")
def prj_01(spark: SparkSession, sf: str) -> DataFrame:
    kinds = table(spark, sf, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13")).select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(kinds, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("prj_02_complement", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2))")
def prj_02(spark: SparkSession, sf: str) -> DataFrame:
    picked = table(spark, sf, "nation").where("n_regionkey IN (1, 2)").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, sf, "supplier").join(picked, "s_nationkey", "left_anti").select("s_suppkey", "s_name")


@query("prj_03_fixed_order", "SELECT n_nationkey, row_number() OVER (ORDER BY CASE WHEN n_regionkey = 1 THEN 0 ELSE 1 END, n_nationkey) - 1 AS ordinal FROM nation")
def prj_03(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.orderBy(F.when(F.col("n_regionkey") == 1, 0).otherwise(1), "n_nationkey")
    return table(spark, sf, "nation").select("n_nationkey", (F.row_number().over(w) - 1).cast("long").alias("ordinal"))


@query("prj_04_event_code", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def prj_04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", "user_id")


@query("prj_05_bits", "SELECT event_id, user_id & 255 AS low, (user_id & 8) = 8 AS button FROM events")
def prj_05(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf, "events").select("event_id", u.bitwiseAND(255).alias("low"), (u.bitwiseAND(8) == 8).alias("button"))


@query("prj_06_complete_trials", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def prj_06(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "quality", "toxic")


@query("prj_07_08_first_existing", "SELECT o_orderkey, o_orderpriority AS label FROM orders WHERE o_orderstatus IS NOT NULL")
def prj_07(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.where(C.first_existing(o, ["started", "o_orderstatus"]).isNotNull()).select("o_orderkey", C.first_existing(o, ["state", "name", "o_orderpriority"]).alias("label"))


@query("prj_09_guarded_drop", """WITH t AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)
SELECT o_custkey, o_orderkey FROM t WHERE NOT (c >= 12 AND n BETWEEN 5 AND 7)""")
def prj_09(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("c", F.count("*").over(Window.partitionBy("o_custkey")))
    return J.drop_positions(o, "o_custkey", ["o_orderkey"], 5, 7, F.col("c") >= 12).select("o_custkey", "o_orderkey")


@query("prj_10_three_states", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error', 'view')")
def prj_10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where(F.col("event_type").isin("click", "error", "view")).select("event_id", "event_type")


@query("prj_11_canonical_states", "SELECT event_id, CASE lower(trim(event_type)) WHEN 'click' THEN 'press' WHEN 'error' THEN 'miss' ELSE lower(trim(event_type)) END AS state FROM events")
def prj_11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", C.canonical(F.col("event_type"), {"click": "press", "error": "miss"}).alias("state"))


@query("prj_12_slice", f"WITH {MEMBERS} SELECT mode, scale, channel, dist FROM members WHERE mode = 7 AND scale = 3")
def prj_12(spark: SparkSession, sf: str) -> DataFrame:
    return members(spark, sf).where("mode = 7 AND scale = 3").select("mode", "scale", "channel", "dist")


@query("prj_13_zoom", f"WITH {LONG_SIGNAL} SELECT channel, i, x FROM long_signal WHERE i BETWEEN 100 AND 120")
def prj_13(spark: SparkSession, sf: str) -> DataFrame:
    return long_signal(spark, sf).where("i BETWEEN 100 AND 120").select("channel", "i", "x")


@query("prj_14_tail_trim", f"WITH {LONG_SIGNAL} SELECT channel, i FROM long_signal QUALIFY i <= max(i) OVER (PARTITION BY channel) - 500")
def prj_14(spark: SparkSession, sf: str) -> DataFrame:
    s = long_signal(spark, sf).select("channel", "i")
    return s.join(s.groupBy("channel").agg(F.max("i").alias("m")), "channel").where("i <= m - 500").select("channel", "i")


@query("prj_15_ascii", "WITH c AS (SELECT item_id, ascii(c) AS code FROM (SELECT item_id, unnest(string_split(text, '')) AS c FROM benchmark) WHERE c <> '') SELECT item_id, CAST(code AS BIGINT) AS code, count(*) AS n FROM c WHERE code IN (10, 13) OR code BETWEEN 32 AND 122 GROUP BY ALL")
def prj_15(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", "")).alias("c")).where("c <> ''").select("item_id", F.ascii("c").cast("long").alias("code"))
    return c.where("code IN (10, 13) OR code BETWEEN 32 AND 122").groupBy("item_id", "code").agg(F.count("*").alias("n"))


@query("prj_16_finite_or_zero", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN 0 ELSE round_even(l_tax / l_discount, 6) END AS ratio FROM lineitem")
def prj_16(spark: SparkSession, sf: str) -> DataFrame:
    ratio = F.try_divide("l_tax", "l_discount")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", H(C.finite_or_zero(ratio)).alias("ratio"))


@query("prj_17_finite_sum", "SELECT l_suppkey, round_even(sum(CASE WHEN l_discount > 0 THEN l_tax / l_discount END), 4) AS total, count(CASE WHEN l_discount > 0 THEN 1 END) AS n FROM lineitem GROUP BY l_suppkey")
def prj_17(spark: SparkSession, sf: str) -> DataFrame:
    ratio = F.try_divide("l_tax", "l_discount")
    finite = F.when(C.is_finite(ratio), ratio)
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(H(F.sum(finite), 4).alias("total"), F.count(finite).alias("n"))


@query("prj_18_decimation", f"WITH {LONG_SIGNAL}, c AS (SELECT *, greatest(1, count(*) OVER (PARTITION BY channel) // 50) AS step FROM long_signal) SELECT channel, i, x FROM c WHERE i % step = 0")
def prj_18(spark: SparkSession, sf: str) -> DataFrame:
    s = long_signal(spark, sf)
    n = s.groupBy("channel").agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count("*") / 50)).alias("step"))
    return s.join(n, "channel").where("i % step = 0").select("channel", "i", "x")


@query("prj_19_seeded_sample")
def prj_19(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy(F.xxhash64("o_orderkey", F.lit(42)), "o_orderkey").limit(500).select("o_orderkey", "o_totalprice")


@query("prj_20_seeded_order")
def prj_20(spark: SparkSession, sf: str) -> DataFrame:
    h = F.xxhash64("vec_id", F.lit(7))
    batch = F.pmod(h, F.lit(16)).alias("batch")
    return table(spark, sf, "embeddings").select("vec_id", batch, h.alias("place"))


@query("prj_21_tail_split", f"WITH {LONG_SIGNAL}, c AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM long_signal) SELECT channel, i, i >= n - least(200, greatest(32, CAST(floor(n * 0.1::DOUBLE) AS BIGINT))) AS validation FROM c")
def prj_21(spark: SparkSession, sf: str) -> DataFrame:
    s = long_signal(spark, sf).select("channel", "i")
    size = s.groupBy("channel").agg(F.count("*").alias("n"))
    held = F.least(F.lit(200), F.greatest(F.lit(32), F.floor(F.col("n") * 0.1)))
    return s.join(size, "channel").select("channel", "i", (F.col("i") >= F.col("n") - held).alias("validation"))


@query("prj_22_unpivot", """WITH w AS (SELECT l_returnflag AS flag, sum(l_quantity) FILTER (l_linenumber = 1) AS tau_1, sum(l_quantity) FILTER (l_linenumber = 2) AS tau_2, sum(l_quantity) FILTER (l_linenumber = 10) AS tau_10 FROM lineitem GROUP BY 1)
SELECT flag, 1::BIGINT AS k, tau_1 AS v FROM w UNION ALL SELECT flag, 2, tau_2 FROM w UNION ALL SELECT flag, 10, tau_10 FROM w""")
def prj_22(spark: SparkSession, sf: str) -> DataFrame:
    sums = [F.sum(F.when(F.col("l_linenumber") == k, F.col("l_quantity"))).alias(f"tau_{k}") for k in (10, 2, 1)]
    wide = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(*sums)
    long = wide.unpivot("flag", C.numbered(wide, "tau_"), "name", "v")
    return long.select("flag", F.regexp_extract("name", "([0-9]+)$", 1).cast("long").alias("k"), "v")


@query("prj_23_clamp", "SELECT c_custkey, greatest(0, least(1, c_acctbal / 5000)) AS share FROM customer")
def prj_23(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", C.clamp(F.col("c_acctbal") / 5000, 0.0, 1.0).alias("share"))


@query("prj_24_half_even", "SELECT p_partkey, round_even(p_retailprice / 8, 2) AS eighth FROM part")
def prj_24(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", H(F.col("p_retailprice") / 8, 2).alias("eighth"))


@query("prj_25_literals_casts", "SELECT p_partkey, 'part' AS kind, CAST(p_size AS DOUBLE) AS size, CAST(p_partkey AS VARCHAR) AS name FROM part")
def prj_25(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.lit("part").alias("kind"), F.col("p_size").cast("double").alias("size"), F.col("p_partkey").cast("string").alias("name"))


@query("join_01_positional", """WITH t AS (SELECT user_id AS channel, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events WHERE event_type = 'purchase'),
l AS (SELECT o_custkey AS channel, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders)
SELECT channel, n, event_id, o_orderkey FROM t JOIN l USING (channel, n)""")
def join_01(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("channel"), "event_id", "ts")
    log = table(spark, sf, "orders").select(F.col("o_custkey").alias("channel"), "o_orderkey", "o_orderdate")
    return J.positional(t, log, "channel", ["ts", "event_id"], ["o_orderdate", "o_orderkey"]).select("channel", "n", "event_id", "o_orderkey")


@query("join_02_second_bucket", f"""WITH {SIGNAL}, n AS (SELECT channel, i // 3 AS sec, max_by(state, event_id) AS note FROM signal WHERE i % 4 <> 1 GROUP BY 1, 2)
SELECT s.channel, s.i, note FROM signal s LEFT JOIN n ON n.channel = s.channel AND n.sec = s.i // 2""")
def join_02(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf)
    notes = s.where("i % 4 <> 1").select("channel", F.floor(F.col("i") / 3).alias("second"), F.col("state").alias("note"), "event_id")
    return J.bucketed(s.select("channel", "i"), notes, "channel", "i", 2, "second", "note", "event_id")


@query("join_03_contains", """SELECT p_partkey, (SELECT min_by(r_name, r_regionkey) FROM region WHERE contains(lower(p_name), lower(substr(r_name, 1, 2)))) AS subject FROM part""")
def join_03(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "region").select(F.lower(F.substring("r_name", 1, 2)).alias("_n"), F.col("r_name").alias("subject"), "r_regionkey")
    stems = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("stem"))
    return J.containing(stems, names, "stem", "_n", "subject", "r_regionkey").select("p_partkey", "subject")


@query("join_04_left_last", """WITH last AS (SELECT l_suppkey, max_by(l_tax, (l_orderkey, l_linenumber, l_partkey, l_shipdate)) AS r2 FROM lineitem WHERE l_quantity > 30 AND l_suppkey % 3 = 0 GROUP BY 1)
SELECT s_suppkey, r2 FROM supplier LEFT JOIN last ON l_suppkey = s_suppkey""")
def join_04(spark: SparkSession, sf: str) -> DataFrame:
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    last = table(spark, sf, "lineitem").where("l_quantity > 30 AND l_suppkey % 3 = 0").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max_by("l_tax", order).alias("r2"))
    return table(spark, sf, "supplier").select("s_suppkey").join(last, "s_suppkey", "left")


@query("join_05_fallback_lookup", """WITH d AS (SELECT n_name AS name, 'region ' || n_regionkey AS roi FROM nation WHERE n_nationkey % 2 = 0),
r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN replace(n_name, ' ', '') ELSE n_name END AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT s_suppkey, r.name, coalesce(d.roi, e.roi, 'Unknown') AS roi FROM r LEFT JOIN d ON d.name = r.name LEFT JOIN d e ON replace(e.name, ' ', '') = replace(r.name, ' ', '')""")
def join_05(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    d = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.concat(F.lit("region "), "n_regionkey").alias("roi"))
    s = table(spark, sf, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    rows = s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.translate("n_name", " ", "")).otherwise(F.col("n_name")).alias("name"))
    return J.looked_up(rows, d, "name", "roi", "Unknown").select("s_suppkey", "name", "roi")


@query("join_06_full_key", "SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, b.p_retailprice FROM lineitem a JOIN part b ON b.p_partkey = a.l_partkey AND b.p_size = a.l_linenumber")
def join_06(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return a.join(b, (b["p_partkey"] == a["l_partkey"]) & (b["p_size"] == a["l_linenumber"])).select("l_orderkey", "l_linenumber", "l_partkey", "p_retailprice")


@query("join_07_one_to_many", "SELECT r_regionkey, s.subject FROM region, unnest([r_regionkey, r_regionkey + 10, r_regionkey + 20]) AS s(subject)")
def join_07(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("r_regionkey")
    return table(spark, sf, "region").select("r_regionkey", F.explode(F.array(r, r + 10, r + 20)).alias("subject"))


EPOCHS = """ev AS (SELECT channel, i AS centre FROM signal WHERE state = 'purchase'), b AS (SELECT channel, min(i) AS lo, max(i) AS hi FROM signal GROUP BY 1),
ep AS (SELECT e.channel, e.centre, s.i, s.i - e.centre AS o, s.x FROM ev e JOIN b USING (channel) JOIN signal s ON s.channel = e.channel AND s.i BETWEEN e.centre - 4 AND e.centre + 4 WHERE e.centre - 4 >= lo AND e.centre + 4 <= hi)"""


@query("join_08_epochs", f"WITH {SIGNAL}, {EPOCHS} SELECT channel, centre, CAST(o AS INTEGER) AS o, i, x FROM ep")
def join_08(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf)
    ev = s.where("state = 'purchase'").select("channel", F.col("i").alias("centre"))
    return J.epochs(s.select("channel", "i", "x"), ev, "channel", "i", "centre", 4, 4).select("channel", "centre", F.col("offset").alias("o"), "i", "x")


@query("join_09_next_sample", f"""WITH {SIGNAL}, e AS (SELECT channel, us - 3600000000 AS t FROM signal WHERE state = 'error')
SELECT DISTINCT e.channel, (SELECT min(s.i) FROM signal s WHERE s.channel = e.channel AND s.us >= e.t) AS i FROM e""")
def join_09(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf)
    ev = s.where("state = 'error'").select("channel", (F.col("us") - 3_600_000_000).alias("t"))
    return J.next_sample(ev, s.select("channel", "i", "us"), "channel", "t", "us", "i")


@query("join_11_lagged_products", f"WITH {SIGNAL} SELECT a.channel, b.i - a.i AS lag, round_even(sum(b.x * a.x), 4) AS product FROM signal a JOIN signal b ON b.channel = a.channel AND b.i - a.i BETWEEN -2 AND 5 GROUP BY 1, 2")
def join_11(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf).select("channel", "i", "x")
    met = J.lagged(s, s.withColumnRenamed("x", "s"), "channel", "i", -2, 5)
    return met.groupBy("channel", F.col("lag").cast("long").alias("lag")).agg(H(F.sum(F.col("x") * F.col("s")), 4).alias("product"))


@query("join_12_takens", f"""WITH {SIGNAL}, t AS (SELECT channel, i, [x, lag(x, 3) OVER w, lag(x, 6) OVER w] AS v FROM signal WINDOW w AS (PARTITION BY channel ORDER BY i)) SELECT channel, i, v FROM t WHERE i >= 6""")
def join_12(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf).select("channel", "i", F.array("x").alias("v"))
    return J.takens(s, "channel", "i", "v", 3, 3)


@query("join_15_existence", "SELECT s_suppkey, coalesce(c.name, '') AS path FROM supplier LEFT JOIN (SELECT DISTINCT c_nationkey, 'nation' || c_nationkey AS name FROM customer WHERE c_acctbal > 9000) c ON c.c_nationkey = s_nationkey")
def join_15(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("s_nationkey"), F.concat(F.lit("nation"), "c_nationkey").alias("name")).distinct()
    return table(spark, sf, "supplier").join(c, "s_nationkey", "left").select("s_suppkey", F.coalesce("name", F.lit("")).alias("path"))


@query("srt_02_parsed_key", "SELECT p_partkey, row_number() OVER (ORDER BY TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT), p_partkey) AS place FROM part")
def srt_02(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.expr("try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS long)").alias("number"))
    return ranked(p, [F.col("number"), F.col("p_partkey")], "place").drop("number")


@query("srt_03_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def srt_03(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("srt_04_both_ends", "(SELECT 'up' AS side, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 3) UNION ALL (SELECT 'down', c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 3)")
def srt_04(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    up = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(3).withColumn("side", F.lit("up"))
    return up.unionByName(c.orderBy("c_acctbal", "c_custkey").limit(3).withColumn("side", F.lit("down"))).select("side", "c_custkey", "c_acctbal")


@query("srt_07_round_robin", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) % 13 AS grp FROM orders WHERE o_orderstatus = 'F'")
def srt_07(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_totalprice").alias("cost"))
    return grouped(o, 13, ["o_orderkey"]).drop("cost")


@query("srt_08_strongest", f"WITH {SIGNAL} SELECT channel, arg_max(i, (x, -i)) AS i, max(x) AS x FROM signal GROUP BY channel")
def srt_08(spark: SparkSession, sf: str) -> DataFrame:
    return signal(spark, sf).groupBy("channel").agg(F.max_by("i", F.struct("x", -F.col("i"))).alias("i"), F.max("x").alias("x"))


@query("set_01_union_all", "SELECT o_orderkey AS id, 'order' AS kind FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer")
def set_01(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"))
    return o.unionByName(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")))


@query("set_02_union_distinct", "SELECT n_regionkey AS id FROM nation UNION SELECT r_regionkey FROM region")
def set_02(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_regionkey").alias("id")).union(table(spark, sf, "region").select("r_regionkey")).distinct()


@query("set_03_difference", "SELECT user_id FROM events EXCEPT SELECT o_custkey FROM orders")
def set_03(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id").distinct().join(table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")), "user_id", "left_anti")


@query("set_04_distinct_values", "SELECT DISTINCT p_brand, p_size FROM part")
def set_04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_brand", "p_size").distinct()


@query("set_05_first_occurrence", "SELECT l_suppkey, l_returnflag, l_linestatus, l_linenumber, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2, 3, 4")
def set_05(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber"]
    return table(spark, sf, "lineitem").groupBy(*keys).agg(F.min("l_orderkey").alias("first"))


@query("set_06_grid", "SELECT r_name, m, n, m * n * n AS cost FROM region, unnest([1, 2, 4, 6]) t(m), unnest([8, 24, 48]) u(n)")
def set_06(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").select("r_name").withColumn("m", F.explode(F.array(*map(F.lit, (1, 2, 4, 6))))).withColumn("n", F.explode(F.array(*map(F.lit, (8, 24, 48)))))
    return r.withColumn("cost", F.col("m") * F.col("n") * F.col("n"))


@query("join_10_distances", """WITH c AS (SELECT vec_id AS k, embedding AS c FROM embeddings WHERE vec_id < 8)
SELECT vec_id AS id, k, round_even(list_sum(list_transform(list_zip(embedding, c), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), 6) AS dist FROM embeddings, c""")
def join_10(spark: SparkSession, sf: str) -> DataFrame:
    from chronomesh.operators.partition import squared_distance

    p = points(spark, sf)
    centres = p.where("id < 8").select(F.col("id").alias("k"), F.col("v").alias("c"))
    return p.crossJoin(F.broadcast(centres)).select("id", "k", H(squared_distance(F.col("v"), F.col("c"))).alias("dist"))


@query("srt_01_multi_key", f"WITH {SIGNAL} SELECT channel, i, x, row_number() OVER (ORDER BY channel, x DESC, i) AS place FROM signal")
def srt_01(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(signal(spark, sf).select("channel", "i", "x"), [F.col("channel"), F.desc("x"), F.col("i")], "place")


@query("srt_10_top_annotated", f"WITH {SIGNAL} SELECT channel, count(*) AS n FROM signal WHERE state = 'error' GROUP BY 1 ORDER BY n DESC, channel LIMIT 10")
def srt_10(spark: SparkSession, sf: str) -> DataFrame:
    n = signal(spark, sf).where("state = 'error'").groupBy("channel").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "channel").limit(10)


@query("src_04_header", "SELECT column_name AS name, CAST(row_number() OVER () - 1 AS INTEGER) AS place FROM (DESCRIBE lineitem)")
def src_04(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "lineitem").columns  # of the file's footer; no rows are read
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, names))).alias("place", "name"))


CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("src_06_csv_report", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src_06(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "report")
    write_report(table(spark, sf, "customer"), path)
    return read_log(spark, path, CUSTOMER).drop("_corrupt_record")


@query("src_07_bad_cells", "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, c_custkey % 7 = 0 AS bad FROM customer")
def src_07(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "log")
    text = F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    write_report(table(spark, sf, "customer").select("c_custkey", text.alias("c_acctbal")), path)
    rows = read_log(spark, path, "c_custkey long, c_acctbal double")
    return rows.select("c_custkey", "c_acctbal", F.col("_corrupt_record").isNotNull().alias("bad"))


@query("src_11_chunked_scan", "SELECT count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, sum(CAST(l_quantity AS BIGINT)) AS whole FROM lineitem")
def src_11(spark: SparkSession, sf: str) -> DataFrame:
    parts = in_batches(table(spark, sf, "lineitem"), "l_quantity", 50_000)
    return parts.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("whole").cast("long").alias("whole"))


@query("src_15_discovery", "SELECT DISTINCT c_mktsegment AS segment FROM customer")
def src_15(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "tree")
    table(spark, sf, "customer").write.partitionBy("c_mktsegment").parquet(path)
    return found(spark, path, "*.parquet").select(*parameters(F.url_decode("path"), {"segment": r"c_mktsegment=([^/]+)/"})).distinct()


@query("snk_05_signal_table", f"WITH {SIGNAL} SELECT channel, i, x FROM signal")
def snk_05(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "signal")
    write_signal(signal(spark, sf).select("channel", "i", "x"), path, "channel", "i")
    return spark.read.schema("channel long, i long, x double").parquet(path)
