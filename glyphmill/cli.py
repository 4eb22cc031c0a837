"""Command line: python -m glyphmill.cli duplicates|unused|symbol|info PATH ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .functions.text import normalised
from .operators import clones, graph, symbols, unused
from .sources import files

#: Exit codes for no findings, findings, wrong use.
CLEAN, FOUND, USAGE = 0, 2, 64


def duplicates(spark: SparkSession, args, settings: config.Settings):
    size = settings.duplicates.min_tokens
    tokens = files.token_table(files.scan(spark, args.path, exclude=settings.exclude_paths))
    form = normalised(F.col("text"), F.col("kind")) if "near" in settings.duplicates.types else F.col("text")
    listed = tokens.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", form.alias("x")))), lambda t: t["x"]).alias("t"))
    kept = clones.without_overlaps(clones.repeated(clones.windows(listed, F.col("t"), size)), size)
    placed = kept.join(tokens.select("file", F.col("pos").alias("start"), "line"), ["file", "start"])
    groups = placed.groupBy("gram").agg(F.sort_array(F.collect_set(F.concat_ws(":", "file", F.col("line").cast("string")))).alias("locations")).where(F.size("locations") > 1)
    return clones.deduplicated(groups.withColumnRenamed("gram", "group")).select("locations").orderBy("locations")


def unused_code(spark: SparkSession, args, settings: config.Settings):
    found = files.scan(spark, args.path, exclude=settings.exclude_paths)
    declared = files.declaration_table(found).withColumn("id", F.concat_ws(":", "file", F.col("line").cast("string"), "name"))
    references = files.reference_table(files.token_table(found))
    if settings.unused.mode == "simple":
        out = unused.unused_by_name(declared, references).where(unused.should_check(ignore_public=settings.unused.ignore_public))
        out = out.withColumn("confidence", unused.confidence(F.col("access")))
    else:
        empty = F.array().cast("array<string>")
        rooted = declared.withColumn("documentation", F.lit(None).cast("string")).withColumn("conformances", empty).withColumn("wrappers", empty)
        roots = rooted.where(graph.root_reason().isNotNull()).select("id")
        out = unused.unused_by_reach(declared, graph.reference_edges(declared, references), roots, settings.unused.min_confidence)
    kept = out.where(~unused.excluded(list(settings.unused.exclude_paths), list(settings.unused.exclude_names)))
    return kept.select("file", "line", "name", "kind", "confidence").orderBy("file", "line")


def symbol(spark: SparkSession, args, settings: config.Settings):
    declared = files.declaration_table(files.scan(spark, args.path, exclude=settings.exclude_paths))
    scopes = declared.select("scope_id", "name", F.when(F.col("parent_id").endswith(":0"), None).otherwise(F.col("parent_id")).alias("parent_id"))
    chains = symbols.chains(scopes).select(F.col("scope_id").alias("parent_id"), "chain")
    ready = declared.join(chains, "parent_id", "left").withColumn("chain", F.coalesce("chain", F.array().cast("array<string>"))).withColumn("labels", F.lit(None).cast("array<string>")).withColumn("usr", F.lit(None).cast("string"))
    return symbols.find(ready, args.query, limit=args.limit).select("file", "line", "col", "name", "kind", "access")


def info(spark: SparkSession, args, settings: config.Settings):
    return files.codebase_info(files.scan(spark, args.path, exclude=settings.exclude_paths))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="glyphmill", exit_on_error=False)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("duplicates", "unused", "symbol", "info"):
        sub = commands.add_parser(name)
        if name == "symbol":
            sub.add_argument("query")
            sub.add_argument("--limit", type=int)
        sub.add_argument("path")
        sub.add_argument("--format", choices=("text", "json"), default="text")
        sub.add_argument("--mode", choices=config.MODES)
        sub.add_argument("--min-tokens", type=int)
    try:
        args = parser.parse_args(argv)
        found = config.find(args.path)
        settings = config.merged(config.load(found) if found else config.Settings(), unused_mode=args.mode, duplicates_min_tokens=args.min_tokens)
    except (argparse.ArgumentError, ValueError) as e:
        print(e, file=sys.stderr)
        return USAGE
    spark = SparkSession.builder.appName("glyphmill").getOrCreate()
    run = {"duplicates": duplicates, "unused": unused_code, "symbol": symbol, "info": info}[args.command]
    rows = [json.loads(r) for r in run(spark, args, settings).toJSON().collect()]
    print(json.dumps(rows, indent=2, sort_keys=True) if args.format == "json" else "\n".join("\t".join(map(str, r.values())) for r in rows))
    return FOUND if rows and args.command in ("duplicates", "unused") else CLEAN


if __name__ == "__main__":
    sys.exit(main())
