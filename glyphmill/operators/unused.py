"""Unused declarations: by name, by reachability, by symbol; filters, confidence, reasons, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns
from .graph import access_rank, unreachable

#: Order of confidences.
CONFIDENCE_RANK = {"low": 0, "medium": 1, "high": 2}


def confidence(access: Column) -> Column:
    return F.when(access.isin("private", "fileprivate"), "high").when(access.isin("internal", "package"), "medium").otherwise("low")


def confidence_rank(name: Column) -> Column:
    return F.when(name == "high", 2).when(name == "medium", 1).otherwise(0)


def unused_by_name(declarations: DataFrame, references: DataFrame) -> DataFrame:
    """Declarations whose name no reference has."""
    used = references.select(F.col("identifier").alias("name")).where("name is not null").distinct()
    return declarations.join(used, "name", "left_anti").select(*declarations.columns)


def unused_imports(imports: DataFrame, references: DataFrame) -> DataFrame:
    """Imports whose module is no reference's identifier or qualifier, of low confidence."""
    used = references.select(F.explode(F.array_compact(F.array("identifier", "qualifier"))).alias("name")).distinct()
    return imports.join(used, "name", "left_anti").withColumn("confidence", F.lit("low"))


def unused_by_reach(declarations: DataFrame, edges: DataFrame, roots: DataFrame, least: str = "medium") -> DataFrame:
    """Declarations that no root reaches, from a confidence on, surest first."""
    found = declarations.join(unreachable(declarations.select("id"), edges, roots), "id", "left_semi").withColumn("confidence", confidence(F.col("access")))
    return found.where(confidence_rank(F.col("confidence")) >= CONFIDENCE_RANK[least]).orderBy(confidence_rank(F.col("confidence")).desc(), "id")


def reason(kind: Column, reads: Column, writes: Column) -> Column:
    """Why a declaration counts as unused. reads, writes: references of its name in these contexts."""
    variable = kind.isin("constant", "variable")
    return (
        F.when(variable & (reads == 0) & (writes > 0), "onlyAssigned").when(kind == "parameter", "parameterUnused").when(kind == "import", "importNotUsed").otherwise("neverReferenced")
    )


def suggestion(why: Column, kind: Column, name: Column) -> Column:
    """Fixed texts of suggestions by reason."""
    return (
        F.when(why == "onlyAssigned", F.format_string("Variable '%s' is assigned but never read", name))
        .when(why == "onlySelfReferenced", F.format_string("'%s' is only used within its own implementation", name))
        .when(why == "importNotUsed", F.format_string("Import '%s' is not used", name))
        .when(why == "parameterUnused", F.format_string("Parameter '%s' is never used; consider renaming to '_'", name))
        .otherwise(F.format_string("Consider removing unused %s '%s'", kind, name))
    )


def should_check(variables=True, functions=True, types=True, parameters=True, ignore_public=True, ignored: list[str] | None = None) -> Column:
    """Which declarations simple mode looks at. Reads name, kind, access, attributes."""
    kind = F.col("kind")
    off = [k for on, ks in ((variables, ["constant", "variable"]), (functions, ["function", "method"]), (types, ["class", "enum", "protocol", "struct"]), (parameters, ["parameter"])) if not on for k in ks]
    out = (F.col("name") != "_") & ~kind.isin("import", *off)
    if ignore_public:
        out &= access_rank(F.col("access")) < 4
    entry = F.array(*[F.lit(a) for a in ("main", "UIApplicationMain", "NSApplicationMain")])
    return out & ~F.coalesce(F.arrays_overlap("attributes", entry), F.lit(False)) & ~patterns.any_matches(F.col("name"), ignored or [])


def excluded(paths: list[str] | None = None, names: list[str] | None = None, imports=True, deinit=True, backticked=True, test_suites=True) -> Column:
    """Findings that a report leaves out. Reads name, kind, file, ignore_directives."""
    name = F.col("name")
    out = (name == "_") | ignored(F.col("ignore_directives"), F.col("kind"))
    if imports:
        out |= F.col("kind") == "import"
    if deinit:
        out |= name == "deinit"
    if backticked:
        out |= patterns.is_backticked(name)
    if test_suites:
        out |= patterns.is_test_suite(name)
    return out | patterns.matches_glob(F.col("file"), *(paths or [])) | patterns.any_matches(name, names or [])


def ignored(directives: Column, kind: Column) -> Column:
    """Whether the directives hold `all`, `unused` or the kind's category (- and _ alike)."""
    tidy = F.transform(F.coalesce(directives, F.array().cast("array<string>")), lambda x: F.replace(x, F.lit("-"), F.lit("_")))
    category = F.when(kind == "enumCase", "unused_cases").otherwise(F.concat(F.lit("unused_"), kind, F.lit("s")))
    return F.array_contains(tidy, "all") | F.array_contains(tidy, "unused") | F.coalesce(F.array_contains(tidy, category), F.lit(False))


def symbol_usage(occurrences: DataFrame, definition: int, reference: int) -> DataFrame:
    """occurrences(usr, file, roles) by symbol: references, and whether all of them are in files that define it."""
    is_def, is_ref = F.col("roles").bitwiseAND(F.lit(definition)) != 0, F.col("roles").bitwiseAND(F.lit(reference)) != 0
    by = occurrences.groupBy("usr").agg(
        F.count(F.when(is_def, 1)).alias("definitions"), F.count(F.when(is_ref, 1)).alias("uses"),
        F.collect_set(F.when(is_def, F.col("file"))).alias("def_files"), F.collect_set(F.when(is_ref, F.col("file"))).alias("ref_files"),
    )
    own = (F.col("uses") > 0) & (F.size(F.array_except("ref_files", "def_files")) == 0)
    return by.select("usr", "definitions", "uses", own.alias("only_self"))


def name_usage(declarations: DataFrame, references: DataFrame) -> DataFrame:
    """Incremental mode: neverReferenced without references, onlySelfReferenced with a single one in the own file."""
    counts = references.groupBy(F.col("identifier").alias("name")).agg(F.count("*").alias("uses"), F.min("file").alias("ref_file"))
    joined = declarations.join(counts, "name", "left")
    why = F.when(F.col("uses").isNull(), "neverReferenced").when((F.col("uses") == 1) & (F.col("ref_file") == F.col("file")), "onlySelfReferenced")
    return joined.withColumn("reason", why).where("reason is not null").select(*declarations.columns, "reason")


def merged(index: DataFrame, syntax: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of both; where both have one of the same identity, the index's row stays."""
    both = index.withColumn("__rank", F.lit(0)).unionByName(syntax.withColumn("__rank", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy("__rank", *[c for c in index.columns if c not in keys])
    return both.withColumn("__row", F.row_number().over(order)).where("__row = 1").drop("__rank", "__row")


def summary(findings: DataFrame) -> DataFrame:
    """Findings by kind, with a column for each confidence."""
    return findings.groupBy("kind").agg(*[F.count(F.when(F.col("confidence") == c, 1)).alias(c) for c in CONFIDENCE_RANK], F.count("*").alias("total"))


def without_calls(findings: DataFrame, call_counts: DataFrame) -> DataFrame:
    """Findings without those that have incoming calls. call_counts: id, calls (null where the count failed)."""
    return findings.join(call_counts.where("calls > 0").select("id"), "id", "left_anti")
