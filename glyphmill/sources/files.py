"""Source trees, lines, token tables and compiler text as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import matches_glob

#: Directories that a scan leaves out.
EXCLUDED_DIRS = (".build", "Build", "DerivedData", ".swiftpm", "Pods", "Carthage", ".git")
#: Files beyond this many bytes are listed but not counted.
MOST_BYTES = 64 << 20


def scan(spark: SparkSession, root: str, extension: str = "swift", exclude: tuple[str, ...] = ()) -> DataFrame:
    """(file, text) of the files below root (or of one file): by extension, without hidden and excluded directories."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{extension}")
    named = files.select(F.regexp_replace(F.url_decode(F.input_file_name()), "^file:/+", "/").alias("file"), F.col("value").alias("text"))
    inner = F.regexp_replace("file", f"^{re.escape(root.rstrip('/'))}", "")
    hidden = inner.rlike(r"/\.[^/]") | inner.rlike("/(" + "|".join(re.escape(d) for d in EXCLUDED_DIRS) + ")/")
    return named.where(~hidden & ~matches_glob(F.col("file"), *exclude))


def lines(files: DataFrame) -> DataFrame:
    """(file, line, content), lines from 1, split at line feeds."""
    return files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("n", "content")).select("file", (F.col("n") + 1).alias("line"), "content")


def codebase_info(files: DataFrame) -> DataFrame:
    """One row: files, bytes and lines (line feeds + 1) of files of at most MOST_BYTES."""
    counted = files.where(F.octet_length("text") <= MOST_BYTES)
    return counted.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.size(F.split("text", "\n", -1))), F.lit(0)).alias("lines"))


#: Keywords of the lexer, and those that begin a declaration, with its kind.
DECLARING = {"func": "function", "var": "variable", "let": "constant", "class": "class", "struct": "struct", "enum": "enum", "protocol": "protocol", "extension": "extension", "import": "import", "typealias": "typealias", "init": "initializer", "actor": "actor", "case": "enumCase"}
KEYWORDS = (*DECLARING, "return", "if", "else", "guard", "throws", "try", "await", "async", "private", "public", "internal", "fileprivate", "open", "static", "final", "where", "in", "for", "while", "do", "switch", "break", "continue", "self", "deinit", "true", "false", "nil", "as", "is", "throw", "default")
_ACCESS = ("private", "fileprivate", "internal", "package", "public", "open")
_LEX = re.compile(r'(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\])*")|(?P<number>\d[\d_]*(?:\.\d+)?)|(?P<word>@?[^\W\d]\w*|\$\d+)|(?P<op>->|[-+*/=<>!&|^~?%]+)|(?P<punct>[^\s])', re.S)


def lex(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, line, column) of the tokens; comments are left out."""
    line, start = 1, 0
    for m in _LEX.finditer(text):
        line += text.count("\n", start, m.start())
        start = m.start()
        kind = m.lastgroup
        if kind == "comment":
            continue
        word = m.group()
        named = {"string": "literal", "number": "literal", "op": "operator", "punct": "punctuation"}.get(kind) or ("keyword" if word in KEYWORDS else "identifier")
        yield named, word, line, m.start() - text.rfind("\n", 0, m.start())


def token_table(files: DataFrame) -> DataFrame:
    """(file, pos, kind, text, line, col)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(f, i, *t) for f, x in zip(part["file"], part["text"], strict=True) for i, t in enumerate(lex(x or ""))]
            yield pd.DataFrame(rows, columns=["file", "pos", "kind", "text", "line", "col"])

    return files.select("file", "text").mapInPandas(run, "file string, pos int, kind string, text string, line int, col int")


def declaration_table(files: DataFrame, directive: str = "analysis:ignore") -> DataFrame:
    """Declarations by keyword and brace depth: (file, name, kind, access, line, col, end_line, scope_id, parent_id,
    attributes, modifiers, ignore_directives). A lexical reading: no types, no macros. A comment that holds the directive
    (directive-name for one category) on the declaration's line or the one above makes it ignored."""
    marked = re.compile(re.escape(directive) + r"(?:-([\w-]+))?")


    def declared(file: str, text: str) -> list[tuple]:
        toks, out, stack = list(lex(text)), [], [(f"{file}:0", 0)]
        directives = {n: marked.findall(s) for n, s in enumerate(text.split("\n"), 1) if directive in s}
        attributes, modifiers, access, depth, open_scopes = [], [], "internal", 0, {}
        for i, (kind, word, line, col) in enumerate(toks):
            if word.startswith("@") and len(word) > 1:
                attributes.append(word[1:])
            elif word in _ACCESS and kind in ("keyword", "identifier") and i + 1 < len(toks) and toks[i + 1][0] != "operator":
                access = word
            elif word in ("static", "final", "override", "mutating"):
                modifiers.append(word)
            elif word in DECLARING and i + 1 < len(toks) and (toks[i + 1][0] == "identifier" or word == "init"):
                name = "init" if word == "init" else toks[i + 1][1]
                scope = f"{file}:{len(out) + 1}"
                ignore = sorted({d or "all" for n in (line, line - 1) for d in directives.get(n, [])})
                out.append([file, name, DECLARING[word], access, line, col, line, scope, stack[-1][0], attributes, modifiers, ignore])
                open_scopes[depth] = len(out) - 1
                attributes, modifiers, access = [], [], "internal"
            elif word == "{":
                owner = open_scopes.pop(depth, None)
                depth += 1
                stack.append((out[owner][7] if owner is not None else stack[-1][0], owner))
            elif word == "}" and len(stack) > 1:
                depth -= 1
                _, owner = stack.pop()
                if owner is not None and isinstance(owner, int) and owner < len(out):
                    out[owner][6] = line
        return [tuple(r) for r in out]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "name", "kind", "access", "line", "col", "end_line", "scope_id", "parent_id", "attributes", "modifiers", "ignore_directives"]
        for part in parts:
            yield pd.DataFrame([r for f, x in zip(part["file"], part["text"], strict=True) for r in declared(f, x or "")], columns=names)

    schema = "file string, name string, kind string, access string, line int, col int, end_line int, scope_id string, parent_id string, attributes array<string>, modifiers array<string>, ignore_directives array<string>"
    return files.select("file", "text").mapInPandas(run, schema)


def reference_table(tokens: DataFrame) -> DataFrame:
    """References among the tokens: identifiers that no declaring keyword precedes, with the context read, write or call."""
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy("pos")
    near = tokens.withColumn("before", F.lag("text").over(order)).withColumn("after", F.lead("text").over(order)).withColumn("owner", F.lag("text", 2).over(order))
    context = F.when(F.col("after") == "(", "call").when(F.col("after") == "=", "write").otherwise("read")
    found = near.where((F.col("kind") == "identifier") & ~F.coalesce(F.col("before").isin(*DECLARING), F.lit(False)))
    return found.select(F.col("text").alias("identifier"), "file", "line", "col", context.alias("context"), F.when(F.col("before") == ".", F.col("owner")).alias("qualifier"))


def intermediate_blocks(text_lines: DataFrame) -> DataFrame:
    """Compiler text (file, line, content) to (file, function, block, successor): blocks and where their branches go."""
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    function = F.last(F.nullif(F.regexp_extract("content", r"^sil .*@([\w$]+)", 1), F.lit("")), ignorenulls=True).over(order)
    block = F.last(F.nullif(F.regexp_extract("content", r"^(bb[0-9]+)", 1), F.lit("")), ignorenulls=True).over(order)
    jumps = F.when(F.col("content").rlike(r"^\s*(br|cond_br|switch_\w+|try_apply|checked_cast_br)\b"), F.regexp_extract_all("content", F.lit(r"\bbb[0-9]+"), F.lit(0)))
    return text_lines.withColumn("function", function).withColumn("block", block).select("file", "function", "block", F.explode(jumps).alias("successor")).distinct()
