"""Change detection, dependencies between files, cache reuse, and diagnostics."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Both (path, content_hash) to (path, change): added, deleted, modified or unchanged."""
    old = previous.select("path", F.col("content_hash").alias("old"), F.lit(1).alias("was"))
    new = current.select("path", F.col("content_hash").alias("new"), F.lit(1).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("modified")
    return new.join(old, "path", "full_outer").select("path", change.alias("change"))


def file_dependencies(references: DataFrame, declarations: DataFrame) -> DataFrame:
    """(dependent, dependency, kind): files whose references name declarations of other files."""
    named = declarations.select(F.col("name").alias("identifier"), F.col("file").alias("dependency")).distinct()
    used = references.select(F.col("file").alias("dependent"), "identifier", F.col("context").alias("kind")).distinct()
    return used.join(named, "identifier").where("dependent <> dependency").select("dependent", "dependency", "kind").distinct()


def dependency_statistics(dependencies: DataFrame) -> DataFrame:
    """One row: dependencies, files on either side, mean dependencies a dependent file."""
    return dependencies.agg(
        F.count("*").alias("dependencies"), F.countDistinct("dependent").alias("dependents"), F.countDistinct("dependency").alias("files_used"),
        F.round(F.count("*") / F.nullif(F.countDistinct("dependent"), F.lit(0)), 9).alias("mean"),
    )


def refreshed(cached: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of a cache keyed by file, with the changed files' rows replaced by fresh ones (none for deleted ones)."""
    return cached.join(changed.select(F.col("path").alias("file")), "file", "left_anti").select(*cached.columns).unionByName(fresh.select(*cached.columns))


def hit_statistics(all_changes: DataFrame) -> DataFrame:
    """One row: files, cached files, hit rate in percent, milliseconds saved (10 a hit)."""
    hit = F.count(F.when(F.col("change") == "unchanged", 1))
    files = F.count(F.when(F.col("change") != "deleted", 1))
    return all_changes.agg(files.alias("files"), hit.alias("hits"), F.round(F.coalesce(hit * 100.0 / F.nullif(files, F.lit(0)), F.lit(0.0)), 6).alias("hit_rate"), (hit * 10).alias("saved_ms"))


#: Order of severities, and what counts as the same diagnostic at each level.
SEVERITY_RANK = {"note": 0, "remark": 1, "warning": 2, "error": 3}
LEVELS = {"exact": ["file", "line", "col", "severity", "message"], "location": ["file", "line", "col"], "line": ["file", "line", "severity"], "message": ["file", "message"]}
_ORDER = ["file", "line", "col", "severity", "message"]


def deduplicated(diagnostics: DataFrame, level: str = "exact") -> DataFrame:
    """First diagnostic in order of each group that the level holds for the same."""
    order = Window.partitionBy(*LEVELS[level]).orderBy(*_ORDER)
    return diagnostics.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def merged(*sources: DataFrame) -> DataFrame:
    """All rows of the sources, by file, line and column."""
    return reduce(DataFrame.unionByName, sources).orderBy("file", "line", "col")


def capped(diagnostics: DataFrame, limit: int) -> DataFrame:
    """At most `limit` diagnostics a file; one more row tells how many there are besides."""
    by_file = Window.partitionBy("file")
    numbered = diagnostics.withColumn("__n", F.row_number().over(by_file.orderBy(*[c for c in _ORDER]))).withColumn("__all", F.count("*").over(by_file))
    over = F.col("__n") == limit + 1
    note = F.format_string("%d more diagnostics are not shown", F.col("__all") - limit)
    kept = numbered.where(F.col("__n") <= limit + 1)
    return kept.withColumn("message", F.when(over, note).otherwise(F.col("message"))).withColumn("severity", F.when(over, "note").otherwise(F.col("severity"))).drop("__n", "__all")


def with_notes(diagnostics: DataFrame, lines: int = 5) -> DataFrame:
    """Diagnostics of lower severity within `lines` lines of an earlier, graver one of the file become its notes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for row in pdf.sort_values(["line", "col", "severity", "message"]).to_dict("records"):
            head = next((r for r in reversed(out) if abs(row["line"] - r["line"]) <= lines and SEVERITY_RANK.get(row["severity"], 0) < SEVERITY_RANK.get(r["severity"], 0)), None)
            if head is None:
                out.append(row | {"notes": []})
            else:
                head["notes"].append(row["message"])
        return pd.DataFrame(out, columns=["file", "line", "col", "severity", "message", "notes"])

    schema = "file string, line int, col int, severity string, message string, notes array<string>"
    return diagnostics.select("file", "line", "col", "severity", "message").groupBy("file").applyInPandas(run, schema)


def compiler_lines(diagnostics: DataFrame) -> DataFrame:
    """file:line:col: severity: message"""
    return diagnostics.select("file", "line", "col", F.format_string("%s:%d:%d: %s: %s", "file", "line", "col", "severity", "message").alias("text"))


def compact_by_file(findings: DataFrame) -> DataFrame:
    """A row a file: its findings by line as `line: message` lines."""
    items = F.sort_array(F.collect_list(F.struct("line", "message")))
    return findings.groupBy("file").agg(items.alias("items")).select("file", F.array_join(F.transform("items", lambda x: F.concat(x["line"].cast("string"), F.lit(": "), x["message"])), "\n").alias("report"))
