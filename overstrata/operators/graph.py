"""Dependency graphs: order repair, availability, load-order checks; and closures by frontier loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import semver
from ..model import PackageError
from .tables import Table


@F.udf(T.BooleanType(), useArrow=True)
def semver_matches(requirement, version):
    """Whether a version meets a requirement; null where either can't be read. Dimension tables only."""
    try:
        return None if requirement is None or version is None else semver.matches(requirement, version)
    except PackageError:
        return None


def repair_order(order: Sequence, dependencies: dict) -> tuple[list, list[tuple]]:
    """(order, moves (package, from, to)). Again and again the first package with a dependency at or after it moves to just behind its last one.

    The list of packages is short (a few thousand by the format), and each move depends on the ones before it.
    """
    now, moves, seen = list(order), [], {tuple(order)}
    known = set(now)
    for p in now:
        for d in dependencies.get(p, ()):
            if d not in known:
                raise PackageError("MissingDependency", package=p, dependency=d)
    while True:
        place = {p: i for i, p in enumerate(now)}
        late = next(((i, max(place[d] for d in dependencies[p])) for i, p in enumerate(now) if dependencies.get(p) and max(place[d] for d in dependencies[p]) >= i), None)
        if late is None:
            return now, moves
        i, j = late
        p = now.pop(i)
        now.insert(j, p)
        moves.append((p, i, j))
        if tuple(now) in seen:
            raise PackageError("DependencyCycle", package=p)
        seen.add(tuple(now))


def availability(packages: DataFrame, dependencies: DataFrame, incompatibilities: DataFrame | None = None) -> DataFrame:
    """(package_id, code, severity, related) of every package, whatever its place: missing or mismatched dependencies,
    incompatible packages (a warning), and what is unavailable because a dependency is. packages: package_id, package_version.
    """
    have = packages.select(F.col("package_id").alias("related"), F.col("package_version").alias("have"))
    deps = dependencies.select("package_id", F.col("dep_package_id").alias("related"), "requirement")
    met = deps.join(have, "related", "left")
    issue = lambda df, code, sev: df.select("package_id", F.lit(code).alias("code"), F.lit(sev).alias("severity"), "related")
    out = issue(met.filter("have is null"), "MissingDependency", "Error")
    out = out.union(issue(met.filter(F.col("have").isNotNull() & F.col("requirement").isNotNull() & ~F.coalesce(semver_matches("requirement", "have"), F.lit(False))), "DependencyVersionMismatch", "Error"))
    if incompatibilities is not None:
        bad = incompatibilities.select("package_id", F.col("inc_package_id").alias("related"), "requirement").join(have, "related")
        out = out.union(issue(bad.filter(F.col("requirement").isNull() | F.coalesce(semver_matches("requirement", "have"), F.lit(False))), "IncompatiblePackage", "Warning"))
    first = Table(out.distinct(), "availability")
    edges = Table(deps.select("package_id", "related").join(have.select("related"), "related"), "edges").df
    bad = first.df.filter("severity = 'Error'").select("package_id").distinct()
    reached = closure(edges.select(F.col("related").alias("a"), F.col("package_id").alias("b")), bad.select(F.col("package_id").alias("node")))
    all_bad = reached.select(F.col("node").alias("related"))
    spread = issue(edges.join(all_bad, "related"), "DependencyUnavailable", "Error")
    return first.df.union(spread.distinct())


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node) reachable along edges (a, b) from start (node), itself among them.

    Each step joins only the newest nodes and drops those known; every frontier is a written table, and cycles end.
    """
    seen = Table(start.select("node").distinct(), "closure")
    new = seen.df
    while True:
        step = edges.join(new.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node")).distinct()
        frontier = Table(step.join(seen.df, "node", "left_anti"), "frontier")
        if frontier.df.limit(1).count() == 0:
            return seen.df
        seen, new = Table(seen.df.union(frontier.df), "closure"), frontier.df


def ancestry(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth): all pairs along edges (node, parent), the least depth of each; not the trivial ones."""
    pairs = Table(edges.select("node", F.col("parent").alias("ancestor")).distinct().withColumn("depth", F.lit(1)), "ancestry")
    new, depth = pairs.df, 1
    while True:
        depth += 1
        step = new.select("node", F.col("ancestor").alias("mid")).join(edges.select(F.col("node").alias("mid"), F.col("parent").alias("ancestor")), "mid").select("node", "ancestor").distinct()
        frontier = Table(step.join(pairs.df, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.df.limit(1).count() == 0:
            return pairs.df
        pairs, new = Table(pairs.df.union(frontier.df), "ancestry"), frontier.df


def load_order_violations(packages: DataFrame, dependencies: DataFrame, incompatibilities: DataFrame, strict: bool = True) -> DataFrame:
    """(package_index, rank, code, related) of all violations; strict loading stops at the least (package_index, rank).

    packages: package_index, package_id, package_version; relations: package_index, ord, package_id, requirement.
    """
    p = packages.select(F.col("package_index").alias("at"), F.col("package_id").alias("related"), F.col("package_version").alias("have"))
    again = packages.join(packages.select(F.col("package_index").alias("other"), "package_id"), "package_id").filter("other < package_index")
    out = again.select("package_index", F.lit(0).alias("rank"), F.lit("DuplicatePackage").alias("code"), F.col("package_id").alias("related")).distinct()
    met = dependencies.withColumnRenamed("package_id", "related").join(p, "related", "left")
    missing = met.groupBy("package_index", "ord", "related").agg(F.min("at").alias("at")).filter("at is null or at >= package_index")
    out = out.union(missing.select("package_index", F.col("ord") * 2 + 10, F.lit("MissingDependency"), "related"))
    wrong = met.filter(F.col("requirement").isNotNull() & F.col("have").isNotNull() & ~F.coalesce(semver_matches("requirement", "have"), F.lit(False)) & (F.col("at") < F.col("package_index")))
    out = out.union(wrong.select("package_index", F.col("ord") * 2 + 11, F.lit("DependencyVersionMismatch"), "related"))
    if strict:
        clash = incompatibilities.withColumnRenamed("package_id", "related").join(p, "related").filter(F.col("requirement").isNull() | F.coalesce(semver_matches("requirement", "have"), F.lit(False)))
        # Found only once all packages are in their slots.
        out = out.union(clash.select(F.col("package_index") + 1_000_000, "ord", F.lit("IncompatiblePackages"), "related"))
    return out


def require(violations: DataFrame) -> None:
    """Raise the first violation, if there is one."""
    first = violations.orderBy("package_index", "rank").limit(1).collect()
    if first:
        raise PackageError(first[0].code, package=first[0].package_index % 1_000_000, related=bytes(first[0].related).hex())
