"""Catalog operators over project, version and user tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave.functions.lines import non_empty
from sourceweave.session import both_sided

# --- fixed values -------------------------------------------------------------------
PROJECT_STATUSES = ["indexing", "ready", "error", "failed"]


def paginate(projects: DataFrame, page: int = 1, page_size: int = 10, owner_id=None) -> DataFrame:
    """One page, newest first; the sort keeps only ``offset + page_size`` rows per task."""
    rows = projects if owner_id is None else projects.where(F.col("owner_id") == owner_id)
    return rows.orderBy(F.desc("created_at"), "project_id").offset((page - 1) * page_size).limit(page_size)


def total(projects: DataFrame, owner_id=None) -> DataFrame:
    rows = projects if owner_id is None else projects.where(F.col("owner_id") == owner_id)
    return rows.agg(F.count("*").alias("total"))


def point_lookup(table: DataFrame, key: str, value) -> DataFrame:
    """First row with ``key = value``; the equality reaches the scan."""
    return table.where(F.col(key) == value).limit(1)


def cascade_delete(projects: DataFrame, children: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Projects and every child table without the deleted projects."""
    ids = gone.select("project_id").distinct()
    tables = {"projects": projects, **children}
    return {name: df.join(both_sided(ids), "project_id", "left_anti") for name, df in tables.items()}


def visible_projects(projects: DataFrame, users: DataFrame) -> DataFrame:
    """``(user_id, project_id)`` pairs of the owners among ``users``; admins see every project and need no pairs."""
    owners = users.where(~F.col("is_admin")).select(F.col("user_id").alias("owner_id"))
    return projects.join(owners, "owner_id").select(F.col("owner_id").alias("user_id"), "project_id")


def projects_for(projects: DataFrame, user_id=None, is_admin: bool = False) -> DataFrame:
    """Projects one user may see: own ones, or all for an admin or nobody signed in."""
    return projects if is_admin or user_id is None else projects.where(F.col("owner_id") == user_id)


def status_update(projects: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ``updates(project_id, new_status)``; returns the projects and the rejected updates."""
    valid = updates.where(F.col("new_status").isin(PROJECT_STATUSES))
    known = projects.select("project_id")
    rejected = updates.where(~F.coalesce(F.col("new_status").isin(PROJECT_STATUSES), F.lit(False))).unionByName(valid.join(known, "project_id", "left_anti"))
    rest = [c for c in projects.columns if c != "status"]
    applied = projects.join(valid, "project_id", "left").select(*rest, F.coalesce("new_status", "status").alias("status"))
    return applied, rejected


def description_pick(projects: DataFrame) -> DataFrame:
    """First non-empty of summary, stored README and README file, else empty."""
    pick = F.coalesce(*[non_empty(F.col(c)) for c in ("summary", "readme_stored", "readme_file")], F.lit(""))
    return projects.select("project_id", pick.alias("description"))


def analysis_flags(projects: DataFrame) -> DataFrame:
    """Which analysis results a project has, and the sizes of its JSON lists."""

    def present(name: str) -> Column:
        return F.coalesce(F.length(name) > 0, F.lit(False)).alias(f"has_{name}")

    def count(name: str, path: str, label: str) -> Column:
        return F.coalesce(F.json_array_length(F.get_json_object(name, path)), F.lit(0)).alias(label)

    return projects.select(
        "project_id",
        present("architecture"),
        present("summary"),
        present("data_flow"),
        count("tech_stack", "$", "tech_stack_count"),
        count("api_info", "$.apis", "api_count"),
        count("key_modules", "$.modules", "modules_count"),
    )
