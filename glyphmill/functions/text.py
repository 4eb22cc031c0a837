"""Column functions over text: tokens, lines, n-grams, sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: words, numbers, single symbols; classes are spelled out so that every engine reads them alike.
TOKEN_PATTERN = r"[\p{L}_][\p{L}0-9_]*|[0-9]+|[^ \t\n\r\f\p{L}0-9_]"


def tokens(text: Column) -> Column:
    """All tokens of the text, in order; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))


def ngrams(items: Column, n: int, stride: int = 1) -> Column:
    """Array of the n-element windows that start at 0, stride, 2 stride, ...; empty when there are too few items."""
    starts = F.sequence(F.lit(0), F.size(items) - n, F.lit(stride))
    return F.when(F.size(items) >= n, F.transform(starts, lambda i: F.slice(items, i + 1, n))).otherwise(F.array().cast("array<array<string>>"))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays taken as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))

#: Identifiers that normalisation keeps.
PRESERVED = (
    "String", "Int", "Double", "Float", "Bool", "Array", "Dictionary", "Set", "Optional", "Result", "Error", "Void", "Any", "AnyObject",
    "self", "Self", "super", "nil", "true", "false", "print", "fatalError", "precondition", "assert",
)

#: Words that identifier comparison leaves out.
STOP_WORDS = (
    "let", "var", "func", "return", "if", "else", "guard", "throws", "try", "await", "async", "private", "public", "internal", "fileprivate",
    "package", "static", "final", "class", "struct", "enum", "protocol", "actor", "extension", "case", "default", "where", "in", "for", "while",
    "do", "switch", "break", "continue", "self", "init", "deinit", "true", "false", "nil", "as", "is", "throw",
)

#: Single-symbol tokens that count as punctuation; other symbols are operators.
PUNCTUATION = "@\\`:,.<>{}()[]#;"


def token_kind(token: Column, keywords: tuple[str, ...] = ()) -> Column:
    """keyword, identifier, literal (numbers), punctuation or operator."""
    return (
        F.when(token.isin(*keywords) if keywords else F.lit(False), "keyword")
        .when(token.rlike(r"^[\p{L}_]"), "identifier")
        .when(token.rlike("^[0-9]"), "literal")
        .when(F.instr(F.lit(PUNCTUATION), token) > 0, "punctuation")
        .otherwise("operator")
    )


def normalised(token: Column, kind: Column, preserved: tuple[str, ...] = PRESERVED) -> Column:
    """Positionless placeholders: identifiers $ID (kept if preserved; $PARAM for $0, $1, ...), literals $NUM or $STR."""
    number = token.rlike(r"^[\p{N}.-]")
    return (
        F.when((kind == "identifier") & token.rlike(r"^\$\p{N}*$"), "$PARAM")
        .when((kind == "identifier") & ~token.isin(*preserved), "$ID")
        .when((kind == "literal") & number, "$NUM")
        .when(kind == "literal", "$STR")
        .otherwise(token)
    )


def positional(items: Column) -> Column:
    """Array of (kind, text) with identifiers as $ID0, $ID1, ... and literals as $LIT0, ... by first occurrence
    within the array; equal texts get equal numbers."""

    def first(kind: str, name: str) -> tuple[Column, str]:
        return F.array_distinct(F.transform(F.filter(items, lambda t: t["kind"] == kind), lambda t: t["text"])), name

    ids, lits = first("identifier", "$ID"), first("literal", "$LIT")
    number = lambda known, name, t: F.concat(F.lit(name), (F.array_position(known, t["text"]) - 1).cast("string"))

    def named(known: Column) -> Column:
        return F.transform(items, lambda t: F.when(t["kind"] == "identifier", number(known["ids"], ids[1], t)).when(t["kind"] == "literal", number(known["lits"], lits[1], t)).otherwise(t["text"]))

    # as an array of one, so that the known names are found once and not for each token
    return F.flatten(F.transform(F.array(F.struct(ids[0].alias("ids"), lits[0].alias("lits"))), named))


def char_grams(text: Column, k: int = 9) -> Column:
    """Distinct k-character substrings; none for shorter texts."""
    n = F.char_length(text)
    grams = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, F.lit(k)))
    return F.when(n >= k, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def trigrams(text: Column) -> Column:
    return char_grams(text, 3)


def plain_literals(text: Column) -> Column:
    """String literals as "$STR", numbers as $NUM, shorthand parameters as $X."""
    out = F.regexp_replace(text, r'"[^"]*"', r'"\$STR"')
    out = F.regexp_replace(out, r"\b[0-9]+(\.[0-9]+)?\b", r"\$NUM")
    return F.regexp_replace(out, r"\$[0-9]+", r"\$X")


def identifier_set(text: Column) -> Column:
    """Lower-cased words of letters, digits and _, without stop words."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.lower)
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOP_WORDS]))


def fused_score(cosine: Column, jaccard_score: Column, weight: float = 0.6) -> Column:
    w = min(max(weight, 0.0), 1.0)
    return F.lit(w) * cosine + F.lit(1 - w) * jaccard_score


def type_names(annotation: Column, built_in: tuple[str, ...] = PRESERVED) -> Column:
    """Capitalised names in a type annotation, without built-in ones."""
    names = F.filter(F.split(annotation, r"[^\p{L}0-9_]+"), lambda x: x.rlike("^[A-Z]"))
    return F.array_except(F.array_distinct(names), F.array(*[F.lit(w) for w in built_in]))


def snippet(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, both included), joined again; lines beyond the text are left out."""
    return F.array_join(F.slice(F.split(text, "\n", -1), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def module_key(path: Column, segments: int = 1) -> Column:
    """Last directory segments of a path."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.array_join(F.slice(dirs, F.greatest(F.size(dirs) - segments + 1, F.lit(1)), segments), "/")


def clean_path(path: Column) -> Column:
    """Control characters (but tab) as U+FFFD."""
    return F.regexp_replace(path, r"[\x00-\x08\x0A-\x1F\x7F]", "�")


def fnv1a(data: Column) -> Column:
    """64-bit FNV-1a of a binary column as a signed long. Long products must wrap: each step multiplies in two
    halves, so that it holds under ANSI arithmetic too."""
    offset, low = -3750763034362895579, 0x1B3
    # prime = 2^40 + 0x1b3: h * prime = (h << 40) + h * 0x1b3, the latter in 32-bit halves

    def step(h: Column, byte: Column) -> Column:
        x = h.bitwiseXOR(byte)
        lo, hi = x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)
        lo_product = lo * low
        hi_product = (hi * low + F.shiftrightunsigned(lo_product, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        plain = F.shiftleft(hi_product, 32).bitwiseOR(lo_product.bitwiseAND(F.lit(0xFFFFFFFF)))
        return _wrapped_sum(plain, F.shiftleft(x, 40))

    hexed = F.hex(data)
    n = F.length(data)
    codes = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(codes, F.lit(offset).cast("long"), step)


def _wrapped_sum(a: Column, b: Column) -> Column:
    mask = F.lit(0xFFFFFFFF)
    low = a.bitwiseAND(mask) + b.bitwiseAND(mask)
    high = (F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)).bitwiseAND(mask)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(mask))
