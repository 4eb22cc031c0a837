"""Report forms: static-analysis interchange JSON, signatures, documentation comments, property wrappers."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Version and schema of the interchange format.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/Schemata/sarif-schema-2.1.0.json"


def _place(**region: Column) -> Column:
    return F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(*[c.alias(n) for n, c in region.items()]).alias("region")).alias("physicalLocation")))


def clone_results(clones: DataFrame) -> DataFrame:
    """clones(type, occurrences, similarity, file, start_line, end_line): a result a member, as JSON."""
    message = F.format_string("Duplicate code (%s clone, %d occurrences, similarity %s)", F.col("type"), F.col("occurrences"), F.col("similarity").cast("string"))
    body = F.struct(F.concat(F.lit("duplicate-"), "type").alias("ruleId"), F.lit("warning").alias("level"), F.struct(message.alias("text")).alias("message"), _place(startLine=F.col("start_line"), endLine=F.col("end_line")).alias("locations"))
    return clones.select(F.to_json(body).alias("result"))


def unused_results(findings: DataFrame) -> DataFrame:
    """findings(kind, suggestion, file, line, col): a result each, as JSON."""
    body = F.struct(
        F.concat(F.lit("unused-"), "kind").alias("ruleId"), F.lit("warning").alias("level"), F.struct(F.coalesce("suggestion", F.lit("Unused declaration")).alias("text")).alias("message"),
        _place(startLine=F.col("line"), startColumn=F.col("col")).alias("locations"),
    )
    return findings.select(F.to_json(body).alias("result"))


def sarif(results: list[str], tool: str = "glyphmill") -> str:
    """The document around results that have been collected for a report file."""
    return f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":{{"name":"{tool}","rules":[]}}}},"results":[{",".join(results)}]}}]}}'


def parameter_text(p: Column) -> Column:
    """`label name: inout type...` of a parameter (label, name, type, is_inout, is_variadic); no label is _."""
    name = F.when(p["label"].isNull(), F.concat(F.lit("_ "), p["name"])).when(p["label"] != p["name"], F.concat(p["label"], F.lit(" "), p["name"])).otherwise(p["name"])
    return F.concat(name, F.lit(": "), F.when(p["is_inout"], "inout ").otherwise(""), p["type"], F.when(p["is_variadic"], "...").otherwise(""))


def selector_text(name: Column, parameters: Column) -> Column:
    """name(label:_:)"""
    return F.concat(name, F.lit("("), F.array_join(F.transform(parameters, lambda p: F.concat(F.coalesce(p["label"], F.lit("_")), F.lit(":"))), ""), F.lit(")"))


def wrapper(attribute: Column) -> Column:
    """(kind, arguments) of a property-wrapper attribute such as @State or @Published(x)."""
    return F.struct(F.regexp_extract(attribute, r"^@?(\w+)", 1).alias("kind"), F.nullif(F.regexp_extract(attribute, r"\((.*)\)\s*$", 1), F.lit("")).alias("arguments"))


def conformance_kind(name: Column) -> Column:
    """Last part of a dotted conformance, if it is a user-interface type."""
    last = F.element_at(F.split(name, r"\."), -1)
    return F.when(last.isin("App", "View", "PreviewProvider", "ViewModifier", "Scene", "Commands"), last)


#: How a field of a documentation comment begins, in lower case.
FIELDS = {"parameter": "- parameter [^:]*:", "returns": "- returns?:", "throws": "- throws:", "note": "- note:"}
#: Words that don't name a parameter of their own after the dash.
NO_NAMES = "- (?:parameter|return|throws|note)"


def documentation(comments: DataFrame) -> DataFrame:
    """comments(id, comment) to (id, summary, parameters, returns, throws, notes).

    Comment marks go. A line is a field or text; `- name: text` is a parameter too. The summary is the text before the
    first field and before the first blank line (a blank first line doesn't count); parameters are `name: text`
    strings; of several returns or throws the last one counts; a note goes on over all text until the next note.
    Lines are numbered, notes are counted by a running sum, and all is put together by one aggregate.
    """
    lines = comments.select("id", F.posexplode(F.split(F.coalesce("comment", F.lit("")), "\n", -1)).alias("n", "raw"))
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.trim("raw"), r"^(?:///|/\*\*)", "")), r"\*/$", "")
    lines = lines.select("id", "n", F.trim(F.regexp_replace(F.trim(bare), r"^\*", "")).alias("line"))
    low = F.lower("line")
    kind = F.lit("text")
    kind = F.when(low.rlike("^- [^:]*:") & ~low.rlike(f"^{NO_NAMES}"), "named").otherwise(kind)
    for name, start in FIELDS.items():
        kind = F.when(low.rlike(f"^{start}"), name).otherwise(kind)
    rest = F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    name = F.trim(F.regexp_extract("line", r"^- (?:(?i:parameter) )?([^:]*):", 1))
    lines = lines.select("id", "n", "line", kind.alias("kind"), rest.alias("rest"), name.alias("name"))
    upto = Window.partitionBy("id").orderBy("n")
    closing = (F.col("kind") != "text") | ((F.col("line") == "") & (F.col("n") > 0))
    lines = lines.withColumn("closed", F.max(closing.cast("int")).over(upto)).withColumn("note", F.sum((F.col("kind") == "note").cast("int")).over(upto))
    text = F.struct("n", F.when(F.col("kind") == "text", F.col("line")).otherwise(F.col("rest")).alias("x"))
    gathered = lambda wanted: F.sort_array(F.collect_list(F.when(wanted, text)))
    is_text = F.col("kind") == "text"
    # first the notes one by one, then the comment as a whole
    of_note = lines.groupBy("id", "note").agg(
        gathered(is_text & (F.col("closed") == 0)).alias("summary"), gathered((F.col("note") > 0) & F.col("kind").isin("text", "note")).alias("said"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isin("named", "parameter"), F.struct("n", F.concat("name", F.lit(": "), "rest").alias("x"))))).alias("parameters"),
        F.max(F.when(F.col("kind") == "returns", text)).alias("returns"), F.max(F.when(F.col("kind") == "throws", text)).alias("throws"),
    )
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["x"]), " ")
    out = of_note.groupBy("id").agg(
        F.max(F.when(F.col("note") == 0, F.nullif(F.trim(joined(F.col("summary"))), F.lit("")))).alias("summary"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("note", "parameters"))), lambda x: x["parameters"])).alias("p"),
        F.max("returns")["x"].alias("returns"), F.max("throws")["x"].alias("throws"), F.sort_array(F.collect_list(F.when(F.col("note") > 0, F.struct("note", joined(F.col("said")).alias("x"))))).alias("s"),
    )
    return out.select("id", "summary", F.transform("p", lambda x: x["x"]).alias("parameters"), "returns", "throws", F.transform("s", lambda x: x["x"]).alias("notes"))


#: Severity of a finding by its confidence.
SEVERITIES = {"high": "warning", "medium": "information", "low": "hint"}


def severity(confidence: Column) -> Column:
    """Severity that an editor shows for a finding of this confidence; null for another one."""
    return F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair])[confidence]


def symbols_text(matches: DataFrame) -> DataFrame:
    """matches(file, line, col, kind, name, generics, access, selector, context) to (file, report): a line a match, in
    order, and under it the lines of its context (array or null), further in. Null generics and selectors are left out."""
    generics = F.when(F.size("generics") > 0, F.concat(F.lit("<"), F.array_join("generics", ","), F.lit(">")))
    place = F.concat_ws(":", F.col("line").cast("string"), F.col("col").cast("string"))
    head = F.concat(F.lit("  "), F.concat_ws(" ", place, "kind", F.concat(F.col("name"), F.coalesce(generics, F.lit(""))), "access", "selector"))
    below = F.transform(F.coalesce("context", F.array().cast("array<string>")), lambda x: F.concat(F.lit("    "), x))
    text = F.array_join(F.concat(F.array(head), below), "\n")
    rows = F.sort_array(F.collect_list(F.struct("line", "col", text.alias("text"))))
    return matches.groupBy("file").agg(rows.alias("rows")).select("file", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("report"))


def usages_text(usages: DataFrame, width: int = 100) -> DataFrame:
    """usages(file, line, col, kind) to (file, report): places with the kind's first three letters, in order, in lines that
    break before an item that would pass `width` characters. A line starts with two spaces, an item ends with one.

    Where a line breaks hangs on all before it, so a file is one fold, which adds to its last line only.
    """
    kind = dict(usages.dtypes)["file"]
    places = usages.select("file", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), "kind")

    def run(rows: pa.Table) -> pa.Table:
        order = [(c, "ascending") for c in ("line", "col", "kind")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))
        lines, items, length = [], [], 2
        for line, col, name in zip(*[rows.column(c).to_pylist() for c in ("line", "col", "kind")], strict=True):
            item = "%s:%s(%s)" % tuple("null" if x is None else x for x in (line, col, name[:3] if name is not None else None))
            if length + len(item) > width:
                lines.append("  " + "".join(items))
                items, length = [], 2
            items.append(item + " ")
            length += len(item) + 1
        return pa.table({"file": rows.column("file")[:1], "report": pa.array(["\n".join([*lines, "  " + "".join(items)])], pa.string())})

    return places.groupBy("file").applyInArrow(run, f"file {kind}, report string")
