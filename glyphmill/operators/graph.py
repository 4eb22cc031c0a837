"""Graphs as tables: nodes(id), edges(src, dst): closure, components, paths, degrees, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import type_names
from .checkpoints import cut

#: Parts over which the methods of one name are dealt.
PARTS = 8


def reachable(edges: DataFrame, roots: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(id, depth) of what the roots reach, themselves included at depth 0.

    One join a level: the frontier meets the edges, and only new ids go on. Each level is checkpointed; a cyclic
    graph ends when a level finds nothing new.
    """
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    seen = cut(roots.select("id").where("id is not null").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, most_rounds + 1):
        step = frontier.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))
    raise RuntimeError(f"closure has not settled after {most_rounds} levels")


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(reachable(edges, roots).select("id"), "id", "left_anti")


def affected(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Everything that depends, directly or not, on the changed ids, those included. edges: dependent src on dst."""
    return reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), changed).select("id")


def paths(edges: DataFrame, roots: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(id, path): of the shortest paths from a root the first one in array order."""
    edges = cut(edges.select("src", "dst").distinct())
    seen = cut(roots.select("id").distinct().withColumn("path", F.array("id")))
    frontier = seen
    for _ in range(most_rounds):
        step = frontier.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.array_append("path", F.col("dst")).alias("path"))
        best = step.groupBy("id").agg(F.min("path").alias("path"))
        frontier = cut(best.join(seen.select("id"), "id", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))
    raise RuntimeError(f"paths have not settled after {most_rounds} levels")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) for undirected edges(u, v): the smallest node reachable. Alternating large-star and
    small-star; see connected components in map-reduce."""
    u, v = F.col("u"), F.col("v")
    edges = cut(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut(both.join(least, "u").where("v > u").select(v.alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(v.alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    roots = edges.select(v.alias("node"), v.alias("component")).distinct()
    return edges.select(u.alias("node"), v.alias("component")).unionByName(roots)


def degree_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean and largest out- and in-degree (means over all nodes)."""
    edges = edges.select("src", "dst").distinct()
    out = edges.groupBy("src").count().agg(F.sum("count").alias("n"), F.max("count").alias("m"))
    into = edges.groupBy("dst").count().agg(F.max("count").alias("k"))
    return (
        nodes.agg(F.count("*").alias("nodes")).crossJoin(out).crossJoin(into)  # three rows of one each
        .select("nodes", F.coalesce("n", F.lit(0)).alias("edges"), F.round(F.coalesce(F.col("n") / F.nullif("nodes", F.lit(0)), F.lit(0.0)), 9).alias("mean_degree"), F.coalesce("m", F.lit(0)).alias("max_out"), F.coalesce("k", F.lit(0)).alias("max_in"))
    )


def reach_report(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes(id, kind): by kind all, reachable and unreachable nodes and the reachable share in percent."""
    marked = nodes.join(reachable(edges, roots).select("id", F.lit(1).alias("hit")), "id", "left")
    hit = F.count("hit")
    return marked.groupBy("kind").agg(F.count("*").alias("nodes"), hit.alias("reachable"), (F.count("*") - hit).alias("unreachable"), F.round(hit * 100.0 / F.count("*"), 6).alias("percent"))


#: Order of access levels.
ACCESS_RANK = {"private": 0, "fileprivate": 1, "internal": 2, "package": 3, "public": 4, "open": 5}


def access_rank(access: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in ACCESS_RANK.items():
        out = F.when(access == name, rank).otherwise(out)
    return out


def _has(attribute: str) -> Column:
    return F.coalesce(F.array_contains("attributes", attribute), F.lit(False)) | F.coalesce(F.col("documentation").contains(f"@{attribute}"), F.lit(False))


def root_reason(public: bool = True, objc: bool = True, tests: bool = True, views: bool = True, wrappers: bool = True, previews: bool = True) -> Column:
    """First rule that makes a declaration a root; null for none. Reads name, kind, access, modifiers, attributes,
    documentation, conformances, wrappers."""
    is_a = lambda *names: F.coalesce(F.arrays_overlap("conformances", F.array(*[F.lit(n) for n in names])), F.lit(False))
    name, kind = F.col("name"), F.col("kind")
    rules: list[tuple[Column, str]] = [
        (_has("main"), "mainAttribute"), (_has("UIApplicationMain"), "uiApplicationMain"), (_has("NSApplicationMain"), "nsApplicationMain"),
        ((name == "main") & (kind == "function"), "mainFunction"), ((name == "main") & F.coalesce(F.array_contains("modifiers", "static"), F.lit(False)), "staticMain"),
    ]
    rules += [(access_rank(F.col("access")) >= ACCESS_RANK["public"], "publicAPI")] if public else []
    rules += [(_has("objc"), "objcExposed")] if objc else []
    rules += [(_has("IBAction") | _has("IBOutlet") | _has("IBInspectable") | _has("IBDesignable"), "interfaceBuilder")]
    rules += [(name.startswith("test") & kind.isin("function", "method"), "testMethod")] if tests else []
    rules += [((name == "CodingKeys") & (kind == "enum"), "codableRequirement"), (_has("dynamicMemberLookup") | _has("dynamicCallable"), "dynamicFeature")]
    rules += [(_has("_silgen_name"), "silgenName"), (_has("_cdecl"), "cdecl"), (_has("_dynamicReplacement"), "dynamicReplacement"), (_has("_objcRuntimeName"), "objcRuntimeName")]
    rules += [(is_a("App"), "swiftUIApp"), (is_a("View"), "swiftUIView")] if views else []
    rules += [(is_a("PreviewProvider"), "swiftUIPreview")] if previews else []
    rules += [(F.size(F.coalesce("wrappers", F.array().cast("array<string>"))) > 0, "swiftUIPropertyWrapper")] if wrappers else []
    rules += [((name == "body") & (kind == "variable"), "viewBody")] if views else []
    out = F.lit(None).cast("string")
    for rule, reason in reversed(rules):
        out = F.when(rule, reason).otherwise(out)
    return out


def reference_edges(declarations: DataFrame, references: DataFrame) -> DataFrame:
    """(src, dst, kind): a reference inside a declaration's lines links it with all declarations of that name.

    The range join meets on (file, block of lines), so that its equi key bounds what a task compares.
    """
    block = 64
    spans = declarations.select(
        F.col("id").alias("src"), "file", "line", "end_line", F.explode(F.sequence((F.col("line") / block).cast("int"), (F.col("end_line") / block).cast("int"))).alias("block")
    )
    at = references.select("file", F.col("line").alias("at"), "identifier", "context", (F.col("line") / block).cast("int").alias("block"))
    inside = spans.join(at, ["file", "block"]).where(F.col("at").between(F.col("line"), F.col("end_line")))
    named = declarations.select(F.col("id").alias("dst"), F.col("name").alias("identifier"))
    return inside.join(named, "identifier").where("src <> dst").select("src", "dst", F.col("context").alias("kind")).distinct()


def type_edges(declarations: DataFrame) -> DataFrame:
    """declarations(id, name, type) to (src, dst, kind): a declaration and all of the names in its type annotation,
    built-in ones left out; kind is typeReference."""
    used = declarations.select(F.col("id").alias("src"), F.explode(type_names(F.col("type"))).alias("name"))
    return used.join(declarations.select(F.col("id").alias("dst"), "name"), "name").select("src", "dst", F.lit("typeReference").alias("kind")).distinct()


def member_edges(declarations: DataFrame, compat_path_match: bool = False) -> DataFrame:
    """(src, dst, kind): a type calls its methods; a protocol's method refers to methods of its name and kind elsewhere.

    declarations: id, name, kind, scope_id, own_scope (the scope that a type opens). A method belongs to the type whose
    scope it is in; with compat_path_match to every type whose name its scope id contains.
    """
    types = declarations.where(F.col("kind").isin("class", "struct", "enum", "protocol", "actor", "extension")).select(F.col("id").alias("type_id"), F.col("name").alias("type_name"), F.col("kind").alias("type_kind"), "own_scope")
    methods = declarations.where(F.col("kind").isin("function", "method", "initializer")).select("id", "name", "kind", "scope_id")
    owns = F.col("scope_id").contains(F.col("type_name")) if compat_path_match else F.col("scope_id") == F.col("own_scope")
    owned = types.join(methods, owns)
    calls = owned.where("type_kind <> 'protocol'").select(F.col("type_id").alias("src"), F.col("id").alias("dst")).distinct().withColumn("kind", F.lit("call"))
    required = _keyed(owned.where("type_kind = 'protocol'").select("id", "name", "kind", "scope_id"), "src", "own")
    # few names may have all the methods, so one side of each is dealt over PARTS and the other goes to all of them
    required = required.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    other = _keyed(methods, "dst", "scopes").withColumn("part", F.pmod(F.xxhash64("dst"), F.lit(PARTS)).cast("int"))
    dealt = max(4 * declarations.sparkSession.sparkContext.defaultParallelism, PARTS)
    key = ["name", "of_kind", "part"]
    differ = (F.size("own") > 1) | (F.size("scopes") > 1) | (F.col("own")[0] != F.col("scopes")[0])
    met = required.repartition(dealt, *key).join(other.repartition(dealt, *key), key).where(differ)
    # ids of one name and kind each meet once
    twice = (F.col("src_keys") > 1) & (F.col("dst_keys") > 1)
    witnesses = met.where(~twice).select("src", "dst").unionByName(met.where(twice).select("src", "dst").distinct())
    return calls.unionByName(witnesses.withColumn("kind", F.lit("typeReference")))


def _keyed(methods: DataFrame, id: str, scopes: str) -> DataFrame:
    """A row an id, name and kind: its scopes, and how many names and kinds the id has."""
    rows = methods.where("name is not null and kind is not null and scope_id is not null").groupBy("id", "name", F.col("kind").alias("of_kind")).agg(F.collect_set("scope_id").alias(scopes))
    several = rows.groupBy("id").agg(F.count("*").alias(f"{id}_keys"))
    return rows.join(several, "id").withColumnRenamed("id", id)


def index_edges(occurrences: DataFrame, definition: int, reference: int) -> DataFrame:
    """occurrences(usr, container, roles) to edges from the containing symbol to the symbol it uses, where that is defined."""
    defined = occurrences.where(F.col("roles").bitwiseAND(F.lit(definition)) != 0).select("usr").distinct()
    used = occurrences.where((F.col("roles").bitwiseAND(F.lit(reference)) != 0) & F.col("container").isNotNull() & (F.col("container") != F.col("usr")))
    return used.join(defined, "usr", "left_semi").select(F.col("container").alias("src"), F.col("usr").alias("dst")).distinct()
