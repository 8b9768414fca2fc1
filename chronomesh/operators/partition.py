"""Deterministic set partition of feature trajectories: k centres, farthest-point repair, canonical order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.functions.columns import total
from chronomesh.operators.ranges import at_places
from chronomesh.sources.shared import materialize

MAX_STEPS, TOLERANCE = 400, 1e-5


def energy(v: Column) -> Column:
    return total(v, lambda x: x * x)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def initial_centres(objects: DataFrame, k: int) -> DataFrame:
    """(k, centre): objects at evenly spaced places of the order by energy, places cut to whole numbers."""
    m = objects.count()
    places = sorted({int(j * (m - 1) / (k - 1)) if k > 1 else 0 for j in range(k)})
    order = at_places(objects.select("id", energy(F.col("v")).alias("e")), [F.col("e"), F.col("id")], places, "place").select("id", F.col("place").cast("int").alias("r"))
    numbers = {r: j for j, r in enumerate(places)}
    number = F.element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), F.col("r"))
    chosen = order.select("id", number.cast("long").alias("k"))  # as many rows as centres
    return objects.join(F.broadcast(chosen), "id").select("k", F.col("v").alias("centre"))


def assign(objects: DataFrame, centres: DataFrame) -> DataFrame:
    """objects with the nearest centre k (the first of equals) and dist, squared. centres has k rows, a parameter, so it is broadcast."""
    rows = centres.agg(F.array_sort(F.collect_list(F.struct("k", "centre"))).alias("_c"))
    near = F.array_min(F.transform("_c", lambda c: F.struct(squared_distance(F.col("v"), c["centre"]).alias("dist"), c["k"].alias("k"))))
    return objects.crossJoin(F.broadcast(rows)).withColumn("_n", near).withColumns({"k": F.col("_n.k"), "dist": F.col("_n.dist")}).drop("_c", "_n")


def means(assigned: DataFrame) -> DataFrame:
    """(k, centre, n): barycentre of each cell."""
    parts = assigned.select("k", F.posexplode("v").alias("i", "x")).groupBy("k", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return parts.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centre"), F.max("n").alias("n"))


def repaired(assigned: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """Centres with the empty cells refilled: the farthest objects, in order of distance, become their centres."""
    spark = assigned.sparkSession
    every = spark.range(k).select(F.col("id").alias("k"))
    empty = every.join(centres, "k", "left_anti").withColumn("r", F.row_number().over(Window.orderBy("k")))
    far = assigned.orderBy(F.desc("dist"), "id").limit(k).select("v", F.row_number().over(Window.orderBy(F.desc("dist"), "id")).alias("r"))
    filled = empty.join(far, "r").select("k", F.col("v").alias("centre"))
    return centres.select("k", "centre").unionByName(filled)


def canonical(centres: DataFrame) -> DataFrame:
    """(k, centre, name): cells renumbered by the energy of their centres."""
    return centres.withColumn("name", (F.row_number().over(Window.orderBy(energy(F.col("centre")), "k")) - 1).cast("long"))


def partition(objects: DataFrame, k: int, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(memberships, centres, history) of the partition of objects (id, v) into k cells.

    Stops when the functional changes by less than the tolerance, relatively, after the
    second step. Memberships and distances belong to the centres of the last assignment.
    Objects and centres are written to the shared folder in every step; the driver sees
    one row of sums for each.
    """
    objects = materialize(objects.select("id", "v"), "partition-objects")
    centres = materialize(initial_centres(objects, k), "partition-centres")
    history: list[dict] = []
    e = objects.agg(F.sum(energy(F.col("v")))).first()[0] or 0.0
    assigned = objects
    for step in range(max_steps):
        assigned = materialize(assign(objects, centres), "partition-assigned")
        row = assigned.agg(F.sum("dist").alias("j"), F.countDistinct("k").alias("cells")).first()
        j = row["j"] or 0.0
        history.append({"step": step, "functional": j, "r2": 1 - j / e if e else 0.0, "cells": row["cells"]})
        centres = materialize(repaired(assigned, means(assigned), k), "partition-centres")
        if step > 2 and abs(history[-2]["functional"] - j) / (history[-2]["functional"] + 1e-12) < tolerance:
            break
    named = canonical(centres)
    members = assigned.join(F.broadcast(named.select("k", "name")), "k").select("id", F.col("name").alias("k"), "dist")
    return members, named.select(F.col("name").alias("k"), "centre"), history
