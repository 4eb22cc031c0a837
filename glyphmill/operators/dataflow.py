"""Data-flow analyses of functions: live variables, reaching definitions, constants; each function is a small
graph, so functions are dealt to tasks and solved there.

statements(fn, block, idx, uses, defs), edges(fn, src, dst); for constants also (op, value, branch).
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_ENTRY = "entry"


def use_def(statements: DataFrame) -> DataFrame:
    """(fn, block, use, def): names a block reads before it writes them, and names it writes."""
    ordered = statements.groupBy("fn", "block").agg(F.sort_array(F.collect_list(F.struct("idx", "uses", "defs"))).alias("s"))
    empty = F.array().cast("array<string>")

    def step(a, x):
        return F.struct(F.array_union(a["use"], F.array_except(x["uses"], a["def"])).alias("use"), F.array_union(a["def"], x["defs"]).alias("def"))

    folded = F.aggregate("s", F.struct(empty.alias("use"), empty.alias("def")), step)
    return ordered.select("fn", "block", F.array_sort(folded["use"]).alias("use"), F.array_sort(folded["def"]).alias("def"))


def _grouped(statements: DataFrame, edges: DataFrame, run, schema: str) -> DataFrame:
    """run(fn, statements in order, edges) to rows, for every function; a batch holds many functions, each as one row."""
    packed = lambda df, name: df.select("fn", F.struct(*[c for c in df.columns if c != "fn"]).alias(name))
    both = packed(statements, "s").unionByName(packed(edges, "e"), allowMissingColumns=True)
    functions = both.groupBy("fn").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    into = to_arrow_schema(StructType.fromDDL(schema))

    def batches(found):
        for batch in found:
            rows = []
            for x in batch.to_pylist():
                code = sorted((Row(**r) for r in x["s"]), key=lambda r: (r.block, r.idx))
                rows += run(x["fn"], code, [Row(**r) for r in x["e"]])
            columns = zip(*rows, strict=True) if rows else [[] for _ in into]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, into, strict=True)], schema=into)

    return functions.mapInArrow(batches, schema)


def _fixpoint(blocks, before: dict, step) -> None:
    """Applies step(block) until nothing changes, from a work list."""
    after = defaultdict(list)
    for b, sources in before.items():
        for s in sources:
            after[s].append(b)
    todo = list(blocks)
    while todo:
        b = todo.pop()
        if step(b):
            todo += after[b]


def reverse_post_order(blocks: list[str], successors: dict[str, list[str]], entry: str) -> list[str]:
    """Blocks reachable from the entry, each before its successors but for loops."""
    seen, out, stack = {entry}, [], [(entry, iter(sorted(successors.get(entry, ()))))]
    while stack:
        block, rest = stack[-1]
        for s in rest:
            if s not in seen:
                seen.add(s)
                stack.append((s, iter(sorted(successors.get(s, ())))))
                break
        else:
            out.append(block)
            stack.pop()
    return out[::-1]


def control_flow(nodes: DataFrame) -> DataFrame:
    """nodes(fn, block, parent, slot, idx, kind), the statements of functions, to edges(fn, src, dst) from "entry" to "exit".

    Every statement is a block. parent is the statement around it (null: the function) and slot its place there: "then"
    and "else" of an if, "else" of a guard, "body" of for, while, repeat, do, case, default and catch, "case" of a switch
    (kinds case and default), "catch" of a do. Other kinds go on to what follows. A switch goes to its cases; a do
    to its body and, as anything in it may throw, to its catches; a throw to the catches of the nearest do around it.
    A guard whose else part runs out leaves the function, as do jumps without a target.
    """

    def run(fn, s: list[Row], e: list[Row]) -> list[tuple]:
        inside = defaultdict(list)
        for r in sorted(s, key=lambda r: (r.idx, r.block)):
            inside[r.parent, r.slot].append(r)
        edges = set()

        def part(r: Row, slot: str, then: str, to: dict) -> str:
            return sequence(inside[r.block, slot], then, to)

        def sequence(rows: list[Row], then: str, to: dict) -> str:
            """Links rows, of which the last goes on to `then`; the block where they begin. to: targets of jumps."""
            for r in reversed(rows):
                then = begin(r, then, to)
            return then

        def begin(r: Row, then: str, to: dict) -> str:
            at, targets = r.block, [then]
            if r.kind in ("return", "break", "continue", "fallthrough", "throw"):
                targets = to.get(r.kind, ["exit"])
            elif r.kind == "if":
                targets = [part(r, "then", then, to), part(r, "else", then, to)]
            elif r.kind == "guard":
                targets = [then, part(r, "else", "exit", to)]
            elif r.kind in ("for", "while", "repeat"):
                body = part(r, "body", at, to | {"break": [then], "continue": [at]})
                targets = [body, then]
                if r.kind == "repeat":
                    at = body
            elif r.kind == "switch":
                cases, following = [], then
                for c in reversed(inside[r.block, "case"]):
                    following = part(c, "body", then, to | {"break": [then], "fallthrough": [following]})
                    edges.add((fn, c.block, following))
                    cases.append(c.block)
                targets = cases or [then]
            elif r.kind == "do":
                catches = []
                for c in inside[r.block, "catch"]:
                    edges.add((fn, c.block, part(c, "body", then, to)))
                    catches.append(c.block)
                targets = [part(r, "body", then, to | {"throw": catches} if catches else to), *catches]
            edges.update((fn, r.block, t) for t in targets)
            return at

        edges.add((fn, _ENTRY, sequence(inside[None, None], "exit", {})))
        return sorted(edges)

    fn = nodes.schema["fn"].dataType.simpleString()
    rows = nodes.select("fn", "block", "parent", F.when(F.col("parent").isNotNull(), F.col("slot")).alias("slot"), "idx", "kind")
    none = rows.select("fn", F.col("block").alias("src"), F.col("block").alias("dst")).where("false")
    return _grouped(rows, none, run, f"fn {fn}, src string, dst string")


def live_variables(statements: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn, block, live_in, live_out), sorted names. Backwards: in = use + (out - def), out = union of successors' in."""

    def run(fn, s: list[Row], e: list[Row]) -> list[tuple]:
        use, define = defaultdict(set), defaultdict(set)
        for row in s:
            use[row.block] |= set(row.uses) - define[row.block]
            define[row.block] |= set(row.defs)
        blocks = sorted({r.block for r in s} | {r.src for r in e} | {r.dst for r in e})
        successors = defaultdict(list)
        for row in e:
            successors[row.src].append(row.dst)
        live_in: dict[str, set] = {b: set() for b in blocks}
        out = lambda b: set().union(*(live_in[x] for x in successors[b]))

        def step(b: str) -> bool:
            new = use[b] | (out(b) - define[b])
            changed = new != live_in[b]
            live_in[b] = new
            return changed

        _fixpoint(blocks, {b: successors[b] for b in blocks}, step)
        return [(fn, b, sorted(live_in[b]), sorted(out(b))) for b in blocks]

    return _grouped(statements, edges, run, "fn long, block string, live_in array<string>, live_out array<string>")


def dead_stores(statements: DataFrame, live: DataFrame) -> DataFrame:
    """(fn, block, idx, name): definitions that no later statement of the block reads and that are not live out of
    it, or are overwritten first."""
    joined = statements.join(live.select("fn", "block", "live_out"), ["fn", "block"])
    rows = joined.groupBy("fn", "block").agg(F.sort_array(F.collect_list(F.struct("idx", "uses", "defs"))).alias("s"), F.first("live_out").alias("live_out"))

    def tail(state, x):
        # from the last statement to the first: names live after x, and dead (idx, name) pairs
        dead = F.transform(F.filter(x["defs"], lambda d: ~F.array_contains(state["live"], d)), lambda d: F.struct(x["idx"].alias("idx"), d.alias("name")))
        return F.struct(F.array_union(F.array_except(state["live"], x["defs"]), x["uses"]).alias("live"), F.concat(state["dead"], dead).alias("dead"))

    start = F.struct(F.col("live_out").alias("live"), F.array().cast("array<struct<idx:int,name:string>>").alias("dead"))
    return rows.select("fn", "block", F.explode(F.aggregate(F.reverse("s"), start, tail)["dead"]).alias("d")).select("fn", "block", "d.idx", "d.name")


def reaching_definitions(statements: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn, block, reaching): definitions name@block:idx that reach the block's begin, sorted."""

    def run(fn, s: list[Row], e: list[Row]) -> list[tuple]:
        gen: dict[str, dict[str, str]] = defaultdict(dict)
        for row in s:
            for name in row.defs:
                gen[row.block][name] = f"{name}@{row.block}:{row.idx}"
        blocks = sorted({r.block for r in s} | {r.src for r in e} | {r.dst for r in e})
        before = defaultdict(list)
        for row in e:
            before[row.dst].append(row.src)
        out: dict[str, set] = {b: set(gen[b].values()) for b in blocks}
        into = lambda b: set().union(*(out[x] for x in before[b]))

        def step(b: str) -> bool:
            new = set(gen[b].values()) | {d for d in into(b) if d.split("@")[0] not in gen[b]}
            changed = new != out[b]
            out[b] = new
            return changed

        _fixpoint(blocks, {b: before[b] for b in blocks}, step)
        return [(fn, b, sorted(into(b))) for b in blocks]

    return _grouped(statements, edges, run, "fn long, block string, reaching array<string>")


def uninitialised_uses(statements: DataFrame, reaching: DataFrame) -> DataFrame:
    """(fn, block, name): names that a block reads before writing them and that no definition reaches."""
    used = use_def(statements).select("fn", "block", F.explode("use").alias("name"))
    names = F.transform("reaching", lambda d: F.split(d, "@")[0])
    return used.join(reaching.select("fn", "block", names.alias("names")), ["fn", "block"]).where(~F.array_contains("names", F.col("name"))).select("fn", "block", "name")


def def_use_chains(statements: DataFrame, reaching: DataFrame) -> DataFrame:
    """(fn, definition, block): blocks that read what the definition wrote, before writing it themselves."""
    used = use_def(statements).select("fn", "block", F.explode("use").alias("name"))
    each = reaching.select("fn", "block", F.explode("reaching").alias("definition"))
    return used.join(each, ["fn", "block"]).where(F.split("definition", "@")[0] == F.col("name")).select("fn", "definition", "block")


def constants(statements: DataFrame, edges: DataFrame, entry: str = _ENTRY) -> DataFrame:
    """(fn, block, reachable, values): sparse conditional constant propagation.

    statements also has op (`const`, `copy`, `add`, `not`, `other`, `branch`) and value (a literal int or true/false for
    const). A `branch` on a name that is constantly true takes the block's successor of label 'true', else 'false'; edges
    have such a label or null. values: map of names that are one constant at the block's begin.
    """
    top, bottom = object(), object()

    def meet(a, b):
        return b if a is top else a if b is top else a if a == b and type(a) is type(b) else bottom

    def run(fn, s: list[Row], e: list[Row]) -> list[tuple]:
        code, outward = defaultdict(list), defaultdict(list)
        for row in s:
            code[row.block].append(row)
        for row in e:
            outward[row.src].append((row.dst, row.label))
        blocks = sorted({r.block for r in s} | {r.src for r in e} | {r.dst for r in e})
        state: dict[str, dict] = {entry: {}}
        todo = [entry]
        while todo:
            b = todo.pop()
            env, taken = dict(state[b]), None
            value = lambda n, env=env: env.get(n, bottom)
            for row in code[b]:
                if row.op == "branch":
                    taken = value(row.uses[0])
                    continue
                if row.op == "const":
                    new = {"true": True, "false": False}.get(row.value, None)
                    new = int(row.value) if new is None else new
                elif row.op == "copy":
                    new = value(row.uses[0])
                elif row.op == "not":
                    new = value(row.uses[0])
                    new = (not new) if isinstance(new, bool) else bottom
                elif row.op == "add":
                    parts = [value(u) for u in row.uses]
                    new = sum(parts) if all(isinstance(p, int) and not isinstance(p, bool) for p in parts) else bottom
                else:
                    new = bottom
                for name in row.defs:
                    env[name] = new
            for to, label in outward[b]:
                if isinstance(taken, bool) and label in ("true", "false") and (label == "true") != taken:
                    continue
                old = state.get(to)
                new = env if old is None else {n: meet(old.get(n, bottom), env.get(n, bottom)) for n in set(old) | set(env)}
                if old is None or any(old.get(n, bottom) is not new[n] and old.get(n, bottom) != new[n] for n in new):
                    state[to] = dict(new)
                    todo.append(to)
        rows = []
        for b in blocks:
            known = {n: str(v).lower() if isinstance(v, bool) else str(v) for n, v in sorted(state.get(b, {}).items()) if v is not bottom}
            rows.append((fn, b, b in state, list(known.items())))
        return rows

    return _grouped(statements, edges, run, "fn long, block string, reachable boolean, values map<string,string>")


def dead_branches(constant: DataFrame) -> DataFrame:
    """Blocks that no execution reaches, as findings."""
    return constant.where("not reachable").select("fn", "block", F.lit("deadBranch").alias("reason"), F.lit("high").alias("confidence"))


def dependence_edges(statements: DataFrame, reaching: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn, src, dst, kind): data edges from defining to reading blocks and control edges between blocks."""
    data = def_use_chains(statements, reaching).select("fn", F.split(F.split("definition", "@")[1], ":")[0].alias("src"), F.col("block").alias("dst"), F.lit("data").alias("kind"))
    return data.unionByName(edges.select("fn", "src", "dst", F.lit("control").alias("kind"))).distinct()


def flow(statements: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn, block, live_in, live_out, reaching) of all blocks; empty arrays where nothing lives or reaches."""
    out = live_variables(statements, edges).join(reaching_definitions(statements, edges), ["fn", "block"], "left")
    return out.select("fn", "block", "live_in", "live_out", F.coalesce("reaching", F.array().cast("array<string>")).alias("reaching"))
