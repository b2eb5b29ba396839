"""What belongs to a session but comes on its own: climbs, context, routes.

Children may come before their parents, in any order and again.  All that came is kept in
one table; what they say is laid over the parents that are there, so any order of batches
gives the same parents, and a child without a parent waits for one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators.matching import best_overlap


def parents_of(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``child_id`` and ``parent_id``: the session with the child's uuid, or else the one
    that it overlaps best.  Children of both tables have id, uuid, source, start_s, end_s."""
    own = children.dropDuplicates(["id"])
    named = own.where("uuid is not null").join(parents.where("uuid is not null").groupBy("uuid").agg(F.min("id").alias("parent_id")), "uuid").select(F.col("id").alias("child_id"), "parent_id")
    rest = own.join(named, F.col("id") == F.col("child_id"), "left_anti")
    return named.unionByName(best_overlap(rest, parents).select(F.col("item_id").alias("child_id"), "parent_id"))


def attached(parents: DataFrame, children: DataFrame, fields: list[str], origin: str = "origin", label: str = "device") -> DataFrame:
    """Parents with what their children say: a field that a parent has stays, one that it
    lacks comes from its first child that has it; ``origin`` tells when any did."""
    said = parents_of(children, parents).join(children.dropDuplicates(["id"]).select(F.col("id").alias("child_id"), *fields), "child_id")
    first = said.groupBy(F.col("parent_id").alias("id")).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("child_id"))).alias(f"__{f}") for f in fields])
    joined = parents.join(first, "id", "left")
    fills = [F.col(f).isNull() & F.col(f"__{f}").isNotNull() for f in fields]
    new = fills[0]
    for more in fills[1:]:
        new = new | more
    filled = {f: F.coalesce(f, f"__{f}") for f in fields}
    return joined.withColumn(origin, F.when(new, label).otherwise(F.col(origin))).withColumns(filled).select(*parents.columns)


def orphans(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Children that wait for a parent, each once."""
    return children.dropDuplicates(["id"]).join(parents_of(children, parents), F.col("id") == F.col("child_id"), "left_anti")


def climbs(parents: DataFrame, derived: DataFrame) -> DataFrame:
    """``id``, ``ascended``, ``descended`` and ``basis``: the device's totals where it gave
    either, or else those of the route, or none with a reason.

    ``derived``: id, ascended, descended, n_used of the routes; too few points are refused."""
    route = derived.select("id", F.col("ascended").alias("r_up"), F.col("descended").alias("r_down"), "n_used")
    joined = parents.select("id", "ascended", "descended").join(route, "id", "left")
    device = F.col("ascended").isNotNull() | F.col("descended").isNotNull()
    few = F.col("n_used") < LEAST_POINTS
    basis = F.when(device, "device").when(F.col("n_used").isNull(), "no_route").when(few, "too_few_points").otherwise("route")
    pick = lambda own, other: F.when(device, F.col(own)).when(F.col("basis") == "route", F.col(other))
    return joined.withColumn("basis", basis).select("id", pick("ascended", "r_up").alias("ascended"), pick("descended", "r_down").alias("descended"), "basis")


#: Fixed value: points of a route below which no climb is told.
LEAST_POINTS = 10
