"""All -> project -> description: totals and share intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelens.operators.running import running_total


def hierarchy_sum(groups: DataFrame) -> DataFrame:
    """Totals of all three levels from group totals; a parent is the sum of its children.

    ``depth`` is 0 for the root, 1 for projects, 2 for descriptions.
    """
    return (
        groups.rollup("project", "description")
        .agg(
            (2 - F.grouping("project") - F.grouping("description")).cast("int").alias("depth"),
            F.sum("totalTime").alias("total"),
        )
        .select("depth", "project", "description", "total")
    )


def share_extents(groups: DataFrame, extent: float = 1.0) -> DataFrame:
    """Interval ``[x0, x1)`` of every node inside ``[0, extent)``.

    Siblings lie side by side by descending total, then name. Intervals come
    from exact integer running totals, divided once by the grand total. Runs jobs
    when called, and reads ``groups`` several times: give it a stored table.
    """
    projects = groups.groupBy("project").agg(F.sum("totalTime").alias("total"))
    placed_projects = running_total(
        projects.withColumn("root", F.lit(0)),
        ["root"],
        [F.desc("total"), F.asc("project")],
        "total",
        "before",
    ).drop("root")
    placed = running_total(
        groups.withColumnRenamed("totalTime", "total"),
        ["project"],
        [F.desc("total"), F.asc("description")],
        "total",
        "before",
    )
    # A project without time has no width, whatever its descriptions add up to.
    leaves = placed.join(
        placed_projects.select(
            "project",
            F.col("before").alias("project_before"),
            F.col("total").alias("project_total"),
        ),
        "project",
    )
    width = F.when(F.col("project_total") == 0, 0).otherwise(F.col("total"))
    inside = F.when(F.col("project_total") == 0, 0).otherwise(F.col("before"))
    name = F.col("description")
    leaves = leaves.select(
        F.lit(2).alias("depth"),
        "project",
        name,
        "total",
        (F.col("project_before") + inside).alias("before"),
        width.alias("width"),
    )
    inner = placed_projects.select(
        F.lit(1).alias("depth"),
        "project",
        F.lit(None).cast("string").alias("description"),
        "total",
        "before",
        F.col("total").alias("width"),
    )
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("bigint")
    root = projects.agg(F.sum("total").alias("total")).select(
        F.lit(0).alias("depth"),
        none.alias("project"),
        none.alias("description"),
        "total",
        zero.alias("before"),
        F.col("total").alias("width"),
    )
    whole = projects.agg(F.sum("total").alias("whole")).scalar()
    nodes = root.unionByName(inner).unionByName(leaves).withColumn("whole", whole)

    def position(units):
        scaled = F.try_divide(F.lit(float(extent)) * units, F.col("whole"))
        return F.coalesce(scaled, F.lit(0.0))

    return nodes.select(
        "depth",
        "project",
        "description",
        "total",
        position(F.col("before")).alias("x0"),
        position(F.col("before") + F.col("width")).alias("x1"),
    )
