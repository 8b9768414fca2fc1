"""Queries of training in batches, its committed state, directions of the metric and artefact projectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.functions.columns import half_even
from chronomesh.operators import modes as M
from chronomesh.operators import projectors as P
from chronomesh.operators import spectral as S
from chronomesh.operators import training as T
from chronomesh.plans.carriers import points, table
from chronomesh.plans.registry import query
from chronomesh.sources.arrays import Archives, footers
from chronomesh.sources.shared import shared_path
from chronomesh.sources.states import States

DIMENSION, BATCH, SEED = 64, 128, 11


def H(x: str | Column, digits: int = 6) -> Column:
    return half_even(F.col(x) if isinstance(x, str) else x, digits)


def features(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("id", F.col("v").alias("features"))


def split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Points to train on and, every fifth by hash, points held out."""
    held = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    return features(spark, sf).where(~held), features(spark, sf).where(held)


EPOCHS, N_BATCHES = 3, 8
PLACES = ", ".join(f"({epoch}, {b}, {c})" for epoch in range(EPOCHS) for b, own in enumerate(T.batches(N_BATCHES, SEED, epoch)) for c in own)


@query("qc_31_epoch_batches", f"WITH o(epoch, batch, cell) AS (VALUES {PLACES}), p AS (SELECT vec_id, CAST(('0x' || substr(md5('{SEED}:' || vec_id), 1, 8))::BIGINT % {N_BATCHES * T.CELLS} AS INTEGER) AS cell FROM embeddings) SELECT epoch, batch, count(*) AS n, min(vec_id) AS first_id, CAST(sum(vec_id) AS BIGINT) AS ids FROM o JOIN p USING (cell) GROUP BY 1, 2")
def qc_31_batches(spark: SparkSession, sf: str) -> DataFrame:
    places = [(epoch, b, c) for epoch in range(EPOCHS) for b, own in enumerate(T.batches(N_BATCHES, SEED, epoch)) for c in own]
    order = spark.createDataFrame(places, "epoch int, batch int, cell int")
    dealt = features(spark, sf).select("id", T.cell(F.col("id"), N_BATCHES * T.CELLS, SEED).alias("cell"))
    return dealt.join(order, "cell").groupBy("epoch", "batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.sum("id").alias("ids"))


@query("qc_31_minibatch_training")
def qc_31_minibatch(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out points under operators trained for two epochs, beside the same under the operators they started from."""
    train, held = split(spark, sf)
    raw, _ = T.train_in_batches(train, None, 4, BATCH, epochs=2, rate=0.05, variance_weight=0.1, commutator_weight=0.01, seed=SEED)
    after = S.spectra(held, raw).select("id", H("residual").alias("residual"), H("local_variance").alias("local_variance"))
    return after.join(S.spectra(held, S.initial_operators(DIMENSION, 4, SEED)).select("id", H("residual").alias("residual_before")), "id")


@query("snk_09_training_state")
def snk_09(spark: SparkSession, sf: str) -> DataFrame:
    """The committed table of a run with a step budget: operators and both moments."""
    store = States(spark, shared_path(spark, "training"))
    T.train_in_batches(split(spark, sf)[0], None, 3, BATCH, target_steps=6, seed=SEED, store=store, every=2)
    return store.read("operators").select("operator", F.lit(store.latest()).alias("step"), "re", "im", "m_re", "m_im", "v_re", "v_im")


@query("src_14_resumed_training")
def src_14(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a run that ended between commits and was resumed has the same bits as a whole one, by operator."""
    train = split(spark, sf)[0]
    run = lambda **how: T.train_in_batches(train, None, 3, BATCH, target_steps=6, seed=SEED, every=2, **how)
    whole, stopped = States(spark, shared_path(spark, "training")), States(spark, shared_path(spark, "training"))
    run(store=whole)
    run(store=stopped, stop_after=3)
    run(store=stopped)
    names = ("re", "im", "m_re", "m_im", "v_re", "v_im")
    resumed = stopped.read("operators").select("operator", *[F.col(c).alias(f"_{c}") for c in names])
    same = F.lit(True)
    for c in names:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return whole.read("operators").join(resumed, "operator").select("operator", same.alias("same"), F.size("re").alias("numbers"))


@query("qc_28_projector_leverage")
def qc_28(spark: SparkSession, sf: str) -> DataFrame:
    found = M.channel_leverage(M.modes(features(spark, sf), S.initial_operators(DIMENSION, 6, 42), 4))
    return found.select("component", H("leverage").alias("leverage"), H("share").alias("share"))


@query("qc_29_tangent_basis")
def qc_29(spark: SparkSession, sf: str) -> DataFrame:
    """The first directions at every point, a row for each, and whether its ground state is apart from the next."""
    found = M.modes(features(spark, sf), S.initial_operators(DIMENSION, 6, 42), 4)
    return found.select("id", "rank", "regular", F.posexplode("tangents").alias("direction", "tangent"))


PLANTED = "(1 + {i} % 3) * (({c} * 7) % 11 - 5)"


@query(
    "win_18_projectors",
    f"""WITH RECURSIVE s AS (SELECT vec_id AS i, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
ep AS (SELECT s.i + o AS i FROM s, unnest([-1, 0, 1]) t(o) WHERE label = 3), near AS (SELECT DISTINCT i FROM ep),
x AS (SELECT s.i, CASE WHEN near.i IS NULL THEN v ELSE list_transform(range({DIMENSION}), lambda c: v[c + 1] + {PLANTED.format(i="s.i", c="c")}) END AS v FROM s LEFT JOIN near ON near.i = s.i),
g AS (SELECT x.i, unnest(range({DIMENSION})) AS c, unnest(v) AS x FROM x),
k AS (SELECT i, count(*) AS n FROM ep GROUP BY 1),
m AS (SELECT a.c AS r, b.c AS c, sum(a.x * b.x * k.n) AS x FROM g a JOIN g b ON a.i = b.i JOIN k ON k.i = a.i GROUP BY 1, 2),
l AS (SELECT list(row ORDER BY r) AS l FROM (SELECT r, list(x ORDER BY c) AS row FROM m GROUP BY 1)),
p(n, u) AS (SELECT 0, list_transform(range({DIMENSION}), lambda c: 1.0::DOUBLE + c) UNION ALL
  SELECT n + 1, list_transform(w, lambda y: y / sqrt(list_sum(list_transform(w, lambda z: z * z)))) FROM (SELECT n, list_transform(l.l, lambda r: list_dot_product(r, u)) AS w FROM p, l WHERE n < 50)),
u AS (SELECT u FROM p WHERE n = 50),
y AS (SELECT v, list_dot_product(v, u) AS along, u FROM x, u),
e AS (SELECT unnest(range({DIMENSION})) AS component, unnest(list_transform(v, lambda a: a * a)) AS before, unnest(list_transform(range(1, {DIMENSION + 1}), lambda c: pow(v[c] - along * u[c], 2))) AS after FROM y)
SELECT CAST(component AS INTEGER) AS component, round_even(sum(before), 4) AS before, round_even(sum(after), 4) AS after FROM e GROUP BY 1""",
)
def win_18(spark: SparkSession, sf: str) -> DataFrame:
    """Energy of every component before and after the leading direction of epochs with a planted artefact is projected out."""
    p = points(spark, sf)
    events = p.where("label = 3").select(F.col("id").alias("i"))
    near = events.select(F.explode(F.sequence(F.col("i") - 1, F.col("i") + 1)).alias("i")).distinct().withColumn("near", F.lit(True))
    planted = F.transform("v", lambda x, c: x + (1 + F.col("i") % 3) * ((c * 7) % 11 - 5))
    samples = p.select(F.col("id").alias("i"), "v").join(near, "i", "left").select("i", F.when(F.col("near"), planted).otherwise(F.col("v")).alias("v"))
    clean, _ = P.without_artefact(samples, events, DIMENSION, 1, 2)
    energy = lambda df, name: df.select(F.posexplode("v").alias("component", "x")).groupBy("component").agg(H(F.sum(F.col("x") * F.col("x")), 4).alias(name))
    return energy(samples, "before").join(energy(clean, "after"), "component")


@query("src_13_npz_round_trip", "SELECT vec_id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings")
def src_13(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings written to array archives and read back in slices."""
    spark.dataSource.register(Archives)
    path = shared_path(spark, "archives")
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows.where("label IS NOT NULL").write.format("npz").mode("append").save(path)
    return spark.read.format("npz").schema(rows.schema).load(path)


TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query("src_12_footers", " UNION ALL ".join(f"SELECT '{t}' AS name, true AS readable, count(*) AS n_rows FROM {t}" for t in TABLES))
def src_12_footers(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every table by its files' footers; no data page is read."""
    name = F.regexp_extract("path", r"/([a-z]+)\.parquet(/[^/]*)?$", 1)
    found = footers(spark, sf).withColumn("name", name).where(F.col("name").isin(*TABLES) & ~F.element_at(F.split("path", "/"), -1).startswith("_"))
    return found.groupBy("name").agg(F.min("readable").alias("readable"), F.sum("n_rows").alias("n_rows"))
