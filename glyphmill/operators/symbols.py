"""Symbol lookup: query strings, name, qualified, selector and pattern matching, usages, context."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import checked, required_trigrams
from ..functions.text import snippet, trigrams


@dataclass(frozen=True)
class Pattern:
    """kind: name, qualified, selector, qualified_selector, usr or regex."""

    kind: str
    name: str = ""
    types: tuple[str, ...] = ()
    labels: tuple[str | None, ...] = ()


def qualified_parts(text: str) -> list[str]:
    """Parts between dots outside of generic brackets; empty parts are left out."""
    parts, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "." and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return [p for p in parts if p]


def parse(query: str) -> Pattern:
    """The pattern that a query string stands for; ValueError for what is none."""
    q = query.strip()
    if not q:
        raise ValueError("empty query")
    if q.startswith(("s:", "c:")):
        return Pattern("usr", q)
    if len(q) > 2 and q[0] == q[-1] == "/":
        return Pattern("regex", checked(q[1:-1]))
    labels: tuple[str | None, ...] | None = None
    if "(" in q and q.endswith(")"):
        q, _, inside = q[:-1].partition("(")
        inside = inside.strip()
        if inside and not inside.endswith(":"):
            raise ValueError(f"invalid selector: {inside}")
        labels = tuple(None if x.strip() in ("", "_") else x.strip() for x in inside.split(":")[:-1]) if inside else ()
    parts = qualified_parts(q)
    if not parts:
        raise ValueError(f"invalid identifier: {query}")
    *types, name = parts
    if labels is None:
        return Pattern("qualified" if types else "name", name, tuple(types))
    return Pattern("qualified_selector" if types else "selector", name, tuple(types), labels)


def same_labels(labels: Column, wanted: tuple[str | None, ...]) -> Column:
    """Equal number of labels, each equal or both null; no labels wanted also fits a null array."""
    if not wanted:
        return labels.isNull() | (F.size(labels) == 0)
    each = [F.get(labels, i).eqNullSafe(F.lit(x)) for i, x in enumerate(wanted)]
    out = F.coalesce(F.size(labels) == len(wanted), F.lit(False))
    for x in each:
        out &= x
    return out


def condition(pattern: Pattern) -> Column:
    """Condition on declarations(name, chain: enclosing type names from the outermost, labels, usr)."""
    name = F.col("name")
    if pattern.kind == "usr":
        return F.col("usr") == pattern.name
    if pattern.kind == "regex":
        return name.rlike(f"^(?:{pattern.name})$")
    out = name == pattern.name
    if pattern.kind == "qualified":
        out &= F.col("chain") == F.array(*[F.lit(t) for t in pattern.types])
    if pattern.kind == "qualified_selector":
        out &= F.element_at("chain", -1) == pattern.types[-1]
    if "selector" in pattern.kind:
        out &= same_labels(F.col("labels"), pattern.labels)
    return F.coalesce(out, F.lit(False))


def find(declarations: DataFrame, query: str, kinds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Matches of a query, one a place (file, line, col), in that order, at most `limit` of them."""
    out = declarations.where(condition(parse(query)))
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    out = out.dropDuplicates(["file", "line", "col"]).orderBy("file", "line", "col")
    return out.limit(limit) if limit else out


def find_batch(declarations: DataFrame, queries: dict[str, str]) -> DataFrame:
    """Matches of several queries in one pass, with a column `query` (its key)."""
    hits = F.filter(F.array(*[F.when(condition(parse(q)), F.lit(k)) for k, q in queries.items()]), lambda x: x.isNotNull())
    return declarations.withColumn("query", F.explode(hits))


def trigram_index(names: DataFrame) -> DataFrame:
    """names(id, name) to (gram, id)."""
    return names.select(F.explode(trigrams(F.col("name"))).alias("gram"), "id")


def regex_search(names: DataFrame, index: DataFrame, pattern: str) -> DataFrame:
    """names whose name holds a match; the index rules out those without the pattern's required trigrams."""
    need = required_trigrams(checked(pattern))
    if need:
        ids = index.where(F.col("gram").isin(need)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(need)).select("id")
        names = names.join(ids, "id", "left_semi")
    return names.where(F.col("name").rlike(pattern))


def by_usr(occurrences: DataFrame, definition: int) -> DataFrame:
    """One occurrence a symbol: the first definition, else the first occurrence."""
    is_def = (F.col("roles").bitwiseAND(F.lit(definition)) != 0).cast("int")
    order = Window.partitionBy("usr").orderBy(is_def.desc(), "file", "line", "col")
    return occurrences.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def usage_kind(roles: Column, call: int, write: int, read: int) -> Column:
    """call before write before read before reference."""
    has = lambda bit: roles.bitwiseAND(F.lit(bit)) != 0
    return F.when(has(call), "call").when(has(write), "write").when(has(read), "read").otherwise("reference")


def chains(scopes: DataFrame, most_depth: int = 64) -> DataFrame:
    """scopes(scope_id, name, parent_id) to (scope_id, chain): names from the outermost scope inwards."""
    known = scopes.where("parent_id is null").select("scope_id", F.array("name").alias("chain"))
    frontier = known
    for _ in range(most_depth):
        frontier = scopes.join(frontier.select(F.col("scope_id").alias("parent_id"), F.col("chain").alias("above")), "parent_id").select("scope_id", F.array_append("above", F.col("name")).alias("chain"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def context(lines: DataFrame, matches: DataFrame, before: int, after: int) -> DataFrame:
    """lines(file, line, content), matches(file, line): the lines around each match, which itself is marked.

    Each match names its lines, so the join is one on (file, line).
    """
    near = F.explode(F.sequence(F.greatest(F.col("line") - before, F.lit(1)), F.col("line") + after))
    wanted = matches.select("file", F.col("line").alias("match"), near.alias("line"))
    return wanted.join(lines, ["file", "line"]).select("file", "match", "line", "content", (F.col("line") == F.col("match")).alias("highlighted"))


#: Marks anywhere in an identifier that tell the kind, the first that fits, and else the letter after
#: the first segment.
USR_KINDS = ((("vp",), "property"), (("fC", "fc"), "method"), (("cC", "cc"), "initializer"), (("FC",), "function"))
USR_TYPES = {"C": "type", "V": "struct", "O": "enum", "P": "protocol"}


def decode_usr(usr: str) -> dict:
    """Schema, context, name, kind and staticness of a symbol's identifier; a clang one is kept as it is."""
    if usr.startswith("c:"):
        return {"schema": "clang", "context": None, "name": usr, "kind": None, "static": False}
    if not usr.startswith("s:"):
        return {"schema": None, "context": None, "name": usr, "kind": None, "static": False}
    body, i, parts = usr[2:], 0, []
    while i < len(body):
        if m := re.match(r"[1-9][0-9]*", body[i:]):
            size, start = int(m[0]), i + len(m[0])
            if re.fullmatch(r"[A-Za-z_]\w*", body[start : start + size]) and start + size <= len(body):
                parts.append(body[start : start + size])
                i = start + size
                continue
        i += 1
    kind = next((k for marks, k in USR_KINDS if any(m in body for m in marks)), None)
    first = re.match(r"([1-9][0-9]*)", body)
    marker = body[len(first[0]) + int(first[0]) :][:1] if first else ""
    kind = kind or USR_TYPES.get(marker, "unknown")
    name = parts[1] if len(parts) > 1 else parts[-1] if parts else (re.findall(r"[A-Za-z_]\w*", body) or [None])[-1]
    return {"schema": "swift", "context": parts[0] if parts else None, "name": name, "kind": kind, "static": body.endswith("Z")}


def decoded_usr(usr: Column) -> Column:
    """decode_usr() of a column as a struct; null gives nulls. The lengths in front of the segments can't be read by a pattern."""

    def run(values: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(("schema", "context", "name", "kind", "static"))
        return pd.DataFrame([decode_usr(x) if x is not None else none for x in values], columns=list(none))

    # annotations as objects, which the kind of function is told by
    run.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "schema string, context string, name string, kind string, static boolean")(usr)


#: Access levels from the narrowest on.
ACCESS = ("private", "fileprivate", "internal", "package", "public", "open")


def search(declarations: DataFrame, query: str, regex: bool = False, kind: str | None = None, access: str | None = None, limit: int | None = None) -> DataFrame:
    """declarations whose name contains the query in any case (or matches the safe pattern), of this kind and at least
    this access level; the first `limit` by file and line. ValueError for a pattern that may backtrack without end."""
    hit = F.col("name").rlike(checked(query)) if regex else F.lower("name").contains(query.lower())
    out = declarations.where(hit)
    out = out.where(F.col("kind") == kind) if kind else out
    out = out.where(F.col("access").isin(*ACCESS[ACCESS.index(access) :])) if access else out
    return out.orderBy("file", "line", "name").limit(limit) if limit is not None else out


def function_snippets(declarations: DataFrame, files: DataFrame, least: int = 5, most: int = 60) -> DataFrame:
    """(file, name, line, end_line, snippet, tokens) of functions, methods and initializers of `least` to `most` lines; files(file,
    text). A token counts for four characters."""
    spans = declarations.where(F.col("kind").isin("function", "method", "initializer") & (F.col("end_line") - F.col("line") + 1).between(least, most))
    found = spans.join(files, "file").where("text is not null").withColumn("snippet", snippet(F.col("text"), F.col("line"), F.col("end_line")))
    return found.select("file", "name", "line", "end_line", "snippet", F.greatest(F.lit(1), F.floor(F.char_length("snippet") / 4)).cast("long").alias("tokens"))


def file_analysis(declarations: DataFrame, references: DataFrame, kinds: list[str] | None = None, imports: bool = False, most_references: int = 100) -> DataFrame:
    """(file, what, name, line): each file's declarations of these kinds, imports only if asked for, and its first references."""
    kept = declarations.where(F.col("kind").isin(kinds)) if kinds else declarations
    kept = kept if imports else kept.where("kind <> 'import'")
    order = Window.partitionBy("file").orderBy("line", "identifier")
    first = references.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most_references)
    row = lambda df, what, name: df.select("file", F.lit(what).alias("what"), F.col(name).alias("name"), "line")
    return row(kept, "declaration", "name").unionByName(row(first, "reference", "identifier"))
