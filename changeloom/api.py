"""One place for the listings of a review: named tables in, DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.operators import catalogs, contracts, review, snapshots

SEVERITIES = ["critical", "high", "medium", "low"]


@dataclass
class Review:
    """tables: findings (id, target, component, file, severity, resolved_at, responses), component_files (component, file),
    changed_files (target, file, additions, deletions, patch), endpoints, resources, variables, schema_tables, edges, repos, and what the changes of each catalog are taken from; those that a call needs."""

    tables: dict[str, DataFrame]

    def _of(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"this review has no table {name}")
        return self.tables[name]

    def list_repos(self) -> DataFrame:
        """The repositories (id, name, provider, default_branch, url) by name."""
        return self._of("repos").select("id", "name", "provider", "default_branch", "url").orderBy("name", "id")

    def list_reviews(self) -> DataFrame:
        return self._of("findings").groupBy("target").agg(F.count("*").alias("findings"), F.count_if(F.col("resolved_at").isNull()).alias("open"))

    def get_review(self, target: str, *, resolved: bool = False) -> DataFrame:
        """Findings of a target by component, worst first; only open ones unless told."""
        rows = self._of("findings").where(F.col("target") == target)
        rows = rows if resolved else rows.where("resolved_at IS NULL")
        place = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
        return rows.orderBy("component", F.when(place > 0, place).otherwise(len(SEVERITIES) + 1), "id")

    def changed_components(self, target: str) -> DataFrame:
        """Components of the changed files with their sums; files that no component owns are under null."""
        files = self._of("changed_files").where(F.col("target") == target).join(self._of("component_files"), "file", "left")
        return files.groupBy("component").agg(F.count("*").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))

    def component_diff(self, target: str, component: str) -> DataFrame:
        mine = self._of("component_files").where(F.col("component") == component)
        return self._of("changed_files").where(F.col("target") == target).join(mine, "file", "left_semi").orderBy("file")

    def file_diff(self, target: str, file: str) -> DataFrame:
        return self._of("changed_files").where((F.col("target") == target) & (F.col("file") == file))

    def _filtered(self, table: str, query: str | None, on: list[str], **equal) -> DataFrame:
        rows = self._of(table)
        for column, value in equal.items():
            rows = rows.where(F.col(column) == value) if value is not None else rows
        if query:
            found: Column = F.lit(False)
            for column in on:
                found = found | F.lower(column).contains(query.lower())
            rows = rows.where(found)
        return rows

    def list_endpoints(self, *, kind: str | None = None, query: str | None = None) -> DataFrame:
        return self._filtered("endpoints", query, ["path", "handler"], kind=kind)

    def get_api_changes(self) -> DataFrame:
        """endpoints against base_endpoints: id, status, before_id, aspects, breaking."""
        return snapshots.endpoint_diff(self._of("base_endpoints"), self._of("endpoints")).orderBy("id")

    def get_infra_changes(self) -> DataFrame:
        """resources and their attributes (id, name, value) against those of the base: before_id, after_id, action; resource_moves are those written down."""
        return snapshots.resource_diff(self._of("base_resources"), self._of("resources"), self._of("base_attributes"), self._of("attributes"), self._of("resource_moves"))

    def get_env_changes(self) -> DataFrame:
        """Facts of variables (name, part, key, value) against those of the base: name, status, and how many of each part differ."""
        return review.env_changes(self._of("base_variable_facts"), self._of("variable_facts")).orderBy("name")

    def get_schema_changes(self) -> DataFrame:
        """schema_columns against base_schema_columns: table, column, status, aspects, renamed_from; table_renames are those that migrations name."""
        return snapshots.schema_diff(self._of("base_schema_columns"), self._of("schema_columns"), self._of("table_renames"))

    def schema_change_counts(self) -> DataFrame:
        """How many columns were added, removed and changed, and how many of these can lose data."""
        changes = self.get_schema_changes()
        count = lambda status: F.count_if(F.col("status") == status)
        return changes.agg(count("added").alias("added"), count("removed").alias("removed"), count("changed").alias("changed"), F.count_if((F.col("status") == "removed") | F.col("aspects").contains("type")).alias("destructive"))

    def list_infra(self, *, tool: str | None = None, query: str | None = None) -> DataFrame:
        return self._filtered("resources", query, ["id", "address"], tool=tool)

    def list_env(self, *, tag: str | None = None, query: str | None = None) -> DataFrame:
        rows = self._filtered("variables", query, ["name"])
        return rows.where(F.array_contains("tags", tag)) if tag else rows

    def list_tables(self, *, database: str | None = None, query: str | None = None) -> DataFrame:
        return self._filtered("schema_tables", query, ["table"], database=database)

    def get_contracts(self, target: str) -> DataFrame:
        """What the patches of a target change, remove or move of what others depend on (changed_files with status)."""
        return contracts.changed_contracts(self._of("changed_files").where(F.col("target") == target).select(F.col("file").alias("path"), "status", "patch"))

    def left_behind(self, target: str) -> DataFrame:
        """Lines (code_lines: path, line, content) that use a changed contract of the target and were not edited along (edited_lines: target, path, line)."""
        edited = self._of("edited_lines").where(F.col("target") == target)
        return contracts.left_behind(self.get_contracts(target), self._of("code_lines"), edited)

    def list_commits(self, repo: str, n: int = 50, before: tuple | None = None) -> DataFrame:
        """A page of the commits (repo, sha, authored_at) of a repository, newest first; before: authored_at and sha of the last one seen."""
        rows = self._of("commits").where(F.col("repo") == repo)
        last = None if before is None else rows.select("repo").limit(1).select("repo", F.lit(before[0]).alias("authored_at"), F.lit(before[1]).alias("sha"))
        return catalogs.history_page(rows, n, last).orderBy("nth")

    def history(self, path: str, n: int = 20) -> DataFrame:
        """The newest commits (touched: sha, authored_at, file) that touch a file or a folder."""
        touched = self._of("touched")
        return catalogs.path_history(touched, touched.sparkSession.createDataFrame([(path,)], "path string"), n).orderBy("nth")

    def callers(self, declaration: str) -> DataFrame:
        return self._of("edges").where(F.col("dst") == declaration).orderBy("src")

    def callees(self, declaration: str) -> DataFrame:
        return self._of("edges").where(F.col("src") == declaration).orderBy("dst")

    def respond_to_finding(self, finding: str, response: str) -> DataFrame:
        """The findings with a response added to one of them."""
        added = F.array_append(F.coalesce("responses", F.array().cast("array<string>")), F.lit(response))
        return self._of("findings").withColumn("responses", F.when(F.col("id") == finding, added).otherwise(F.col("responses")))
