"""Compiler index: freshness, mode choice, detector, graph report; statistics of merged files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import reachable
from .unused import symbol_usage


def stale_files(sources: DataFrame, units: DataFrame) -> DataFrame:
    """sources, units (file, modified): sources that the index doesn't have or has of an earlier time. A source
    without a time is left out."""
    latest = units.groupBy("file").agg(F.max("modified").alias("indexed"))
    return sources.where("modified is not null").join(latest, "file", "left").where("indexed is null or modified > indexed").select("file")


def analysis_mode(preferred: str, index: str, hybrid: bool = False) -> tuple[str, str | None]:
    """(mode, why it isn't the index's) for a preferred mode and an index that is available, stale, notFound or failed.
    A stale index is still used."""
    if preferred in ("simple", "reachability"):
        return "reachability", "userRequested"
    if index in ("available", "stale"):
        return ("hybrid" if hybrid else "indexStore"), None
    return "reachability", "indexStoreFailed" if index == "failed" else "noIndexStore"


def skipped_symbol() -> Column:
    """Symbols that the index detector doesn't look at. Reads name, system."""
    name = F.col("name")
    return F.coalesce("system", F.lit(False)) | name.startswith("$") | name.startswith("_$") | name.isin("init", "deinit", "CodingKeys")


#: How suggestions call the kinds; others are a symbol.
KIND_WORDS = {"class": "class", "struct": "struct", "enum": "enum", "protocol": "protocol", "function": "function", "method": "function", "property": "variable", "variable": "variable", "parameter": "parameter"}


def index_unused(occurrences: DataFrame, symbols: DataFrame, definition: int, reference: int, test_file: Column | None = None, kinds: Column | None = None) -> DataFrame:
    """occurrences(usr, file, roles), symbols(usr, name, kind, system, file, line) to findings (usr, name, kind, file,
    line, reason, suggestion, confidence): symbols without references, or with such in defining files only.

    Symbols without a definition, skipped ones, tests (a name that starts with test in a file of test_file) and those
    outside `kinds` are left out. The index is exact, so confidence is high.
    """
    usage = symbol_usage(occurrences, definition, reference).where("definitions > 0 and (uses = 0 or only_self)")
    named = symbols.where(~skipped_symbol())
    named = named.where(~(test_file & F.col("name").startswith("test"))) if test_file is not None else named
    named = named.where(kinds) if kinds is not None else named
    word = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KIND_WORDS.items() for x in pair]), F.col("kind")), F.lit("symbol"))
    # fixed texts of suggestions
    advice = F.when(F.col("only_self"), F.format_string("'%s' is only referenced within its own definition", "name")).otherwise(F.format_string("Consider removing unused %s '%s'", word, F.col("name")))
    why = F.when(F.col("only_self"), "onlySelfReferenced").otherwise("neverReferenced")
    return named.join(usage, "usr").select("usr", "name", "kind", "file", "line", why.alias("reason"), advice.alias("suggestion"), F.lit("high").alias("confidence"))


def index_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id, kind, external, root_reason), edges(src, dst) to (part, name, value): totals, the share of what roots
    reach in percent of the symbols that aren't external (100 where there are none), unreachable ones by kind, roots by reason."""
    edges = edges.select("src", "dst").distinct()
    hit = reachable(edges, nodes.where("root_reason is not null").select("id")).select("id", F.lit(True).alias("hit"))
    marked = nodes.join(hit, "id", "left").withColumn("lost", F.col("hit").isNull() & ~F.col("external"))
    count = lambda c: F.count(F.when(c, 1)).cast("double")
    sums = marked.agg(
        F.count("*").cast("double").alias("symbols"), count(F.col("root_reason").isNotNull()).alias("roots"), count(F.col("hit")).alias("reachable"), count(F.col("lost")).alias("unreachable"), count(F.col("external")).alias("external")
    ).withColumn("percent", F.when(F.col("symbols") > F.col("external"), F.round(F.col("reachable") * 100 / (F.col("symbols") - F.col("external")), 6)).otherwise(100.0))
    names = ["symbols", "roots", "reachable", "unreachable", "external", "percent"]
    totals = sums.select(F.explode(F.array(*[F.struct(F.lit("total").alias("part"), F.lit(c).alias("name"), F.col(c).alias("value")) for c in names])).alias("r")).select("r.*")
    links = edges.agg(F.count("*").cast("double").alias("value")).select(F.lit("total").alias("part"), F.lit("edges").alias("name"), "value")
    by = lambda df, part, name: df.groupBy(F.col(name).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit(part).alias("part"), "name", "value")
    return reduce(DataFrame.unionByName, [totals, links, by(marked.where("lost"), "unreachable", "kind"), by(nodes.where("root_reason is not null"), "root", "root_reason")])


def corpus_statistics(files: DataFrame, declarations: DataFrame, references: DataFrame) -> DataFrame:
    """files(file, lines), declarations(file, kind), references(file) of all files, merged by union, to (name, value):
    files, lines, declarations, references, and declarations by kind as kind:<kind>."""
    one = lambda name, df, value: df.agg(value.cast("long").alias("value")).select(F.lit(name).alias("name"), "value")
    total = F.coalesce(F.sum("lines"), F.lit(0))
    parts = [one("files", files, F.count("*")), one("lines", files, total), one("declarations", declarations, F.count("*")), one("references", references, F.count("*"))]
    kinds = declarations.groupBy("kind").agg(F.count("*").alias("value")).select(F.concat(F.lit("kind:"), "kind").alias("name"), "value")
    return reduce(DataFrame.unionByName, [*parts, kinds])
