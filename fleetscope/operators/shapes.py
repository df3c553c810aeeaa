"""Constraint shapes over triples: target class, least count, datatype, value list and pattern. A violation is (focus, shape, path, constraint)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .triples import ROS


@dataclass(frozen=True)
class Shape:
    target: str
    path: str
    min_count: int = 0
    datatype: str = ""
    values: tuple[str, ...] = ()
    pattern: str = ""


SHAPES = (
    Shape("LaunchDescription", "hasLaunchFileId", 1, "string"),
    Shape("LaunchDescription", "hasFormat", 1, "", ("python", "xml", "yaml")),
    Shape("LaunchDescription", "hasAction", 1),
    Shape("LaunchAction", "hasActionId", 1, "string", (), "^la:[^:]+:[0-9a-f]{8}#[0-9]+$"),
    Shape("NodeAction", "hasPackage", 1, "string"),
    Shape("NodeAction", "hasExecutable", 1, "string"),
    Shape("DeclareArgumentAction", "hasArgumentName", 1, "string"),
    Shape("SetParameterAction", "hasParameter", 1),
    Shape("IncludeAction", "includesLaunch", 1),
    Shape("Remapping", "remapFrom", 1, "string"),
    Shape("Remapping", "remapTo", 1, "string"),
    Shape("Parameter", "hasParameterName", 1, "string"),
)


def _checks(shape: Shape) -> dict[str, Column]:
    """Constraint and what breaks it in one of the path's values."""
    here = F.col("p") == shape.path
    bad: dict[str, Column] = {}
    if shape.datatype:
        bad["datatype"] = here & ~F.coalesce(F.col("dtype") == shape.datatype, F.lit(False))
    if shape.values:
        bad["in"] = here & ~F.col("o").isin(*shape.values)
    if shape.pattern:
        bad["pattern"] = here & ~F.col("o").rlike(shape.pattern)
    return bad


def report(triples: DataFrame, shapes: tuple[Shape, ...] = SHAPES) -> DataFrame:
    """All shapes in one pass: conditional aggregates by subject, combined before the only shuffle, then the broken constraints of its classes."""
    parts = []
    targets = sorted({s.target for s in shapes})
    of_target = {t: F.max(F.col("p").isin("type", "hasSpecificType") & (F.col("o") == ROS + t)).alias(f"is{i}") for i, t in enumerate(targets)}
    counted = []
    for i, shape in enumerate(shapes):
        counted.append(F.count_if(F.col("p") == shape.path).alias(f"n{i}"))
        counted += [F.count_if(c).alias(f"{k}{i}") for k, c in _checks(shape).items()]
        broken = {"minCount": F.col(f"n{i}") < shape.min_count, **{k: F.col(f"{k}{i}") > 0 for k in _checks(shape)}}
        for k, c in broken.items():
            said = F.struct(F.lit(shape.target).alias("shape"), F.lit(shape.path).alias("path"), F.lit(k).alias("constraint"))
            parts.append(F.when(F.col(f"is{targets.index(shape.target)}") & c, said))
    paths = {s.path for s in shapes}
    facts = triples.where(F.col("p").isin("type", "hasSpecificType", *sorted(paths)) & F.col("o").isNotNull()).groupBy("graph", F.col("s").alias("focus")).agg(*of_target.values(), *counted)
    found = facts.where(F.array_contains(F.array(*(F.col(f"is{i}") for i in range(len(targets)))), True))
    return found.select("graph", "focus", F.explode(F.array_compact(F.array(*parts))).alias("v")).select("graph", "focus", "v.*")


def violations(triples: DataFrame, shape: Shape) -> DataFrame:
    return report(triples, (shape,))


def conforms(triples: DataFrame, shapes: tuple[Shape, ...] = SHAPES) -> bool:
    return report(triples, shapes).isEmpty()
