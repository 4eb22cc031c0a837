r"""Chat formatting in budgeted windows (DataFrame functions only).

A conversation becomes windows of whole turns. Prefix sums of turn tokens choose the spans: a window takes
turns while they fit the budget left by the system turn and the repeated history. Every window starts with
the leading system turn, then repeats up to HISTORY_TOKENS of the turns just before its span, then has
its own turns. The loss mask covers the assistant texts of own turns only, so each is learnt once.

A turn is `### <role>: <text></turn>\n`, a repeated one `### <role> (again): ...`. In roles and texts a
backslash is doubled, `###` is written `\h`, `</turn>` `\e`, and in roles also `:` `\c` and `(` `\p`. So the marks
never occur inside a text, and reading back is a split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BUDGET = 1024
HISTORY_TOKENS = 128
#: Turns whose spans are chosen in one row, and turn numbers that are counted by one window.
CHUNK_TURNS = 256
BUCKET = 1024
#: Fixed values of the template.
START, AGAIN, AFTER_ROLE, END = "### ", " (again)", ": ", "</turn>\n"
_ESCAPES = (("###", "\\h"), ("</turn>", "\\e"))
_ROLE_ESCAPES = (*_ESCAPES, (":", "\\c"), ("(", "\\p"))


def _lit(x: str) -> Column:
    return F.lit(x)


def escape(text: Column, pairs=_ESCAPES) -> Column:
    out = F.replace(text, _lit("\\"), _lit("\\\\"))
    for raw, written in pairs:
        out = F.replace(out, _lit(raw), _lit(written))
    return out


def unescape(text: Column, pairs=_ESCAPES) -> Column:
    """Inverse of escape(): pairs of backslashes are split off first, from the left."""

    def part(x: Column) -> Column:
        for raw, written in pairs:
            x = F.replace(x, _lit(written), _lit(raw))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def turn_tokens(text: Column) -> Column:
    """Estimated tokens of a turn: a quarter of its characters, rounded up, and 4 for its marks."""
    return (F.ceil(F.char_length(text) / 4) + 4).cast("long")


def _spans(turns: Column, system: Column, budget: int, history: int) -> Column:
    """Indices (from 1) at which windows begin. turns: array of tokens; system: tokens of the system turn.
    A turn that alone exceeds the room is a window of its own."""
    room = F.greatest(F.lit(1).cast("long"), F.lit(budget) - system - history)

    def step(state: Column, n: Column) -> Column:
        i = state["i"] + 1
        full = (state["sum"] > 0) & (state["sum"] + n > room)
        return F.struct(
            i.alias("i"), F.when(full, n).otherwise(state["sum"] + n).alias("sum"),
            F.when(full, F.concat(state["starts"], F.array(i))).otherwise(state["starts"]).alias("starts"),
        )

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("sum"), F.array(F.lit(1)).alias("starts"))
    return F.aggregate(turns, zero, step)["starts"]


def _numbered(turns: DataFrame) -> DataFrame:
    """conv (conv_id as a key that is never null), conv_id, index (from 0 in its conversation, in the order of turns),
    role, text and lead (text of the conversation's leading system turn; null without one).

    Numbers are counts in two levels: within BUCKET turn numbers, and over the buckets' counts, so a conversation
    of very many turns is many buckets.
    """
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(_lit("="), F.col("conv_id").cast("string")))
    rows = turns.select(
        key.alias("conv"), "conv_id", F.coalesce(F.floor(F.col("turn") / BUCKET).cast("long"), F.lit(2**63 - 1)).alias("bucket"),
        F.col("turn").isNull().alias("no_turn"), "turn", F.coalesce(F.col("role").cast("string"), _lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), _lit("")).alias("text"),
    )
    # Only a system turn's text is needed of a bucket's first turn.
    first = F.min(F.struct("no_turn", "turn", "role", F.when(F.col("role") == "system", F.col("text")).alias("text")))
    sums = rows.groupBy("conv", "bucket").agg(F.count("*").alias("n"), first.alias("first"))
    order = Window.partitionBy("conv").orderBy("bucket")
    sums = sums.select("conv", "bucket", (F.sum("n").over(order) - F.col("n")).alias("start"), F.first("first.text").over(order).alias("lead"))
    inner = F.row_number().over(Window.partitionBy("conv", "bucket").orderBy("no_turn", "turn", "role", "text")) - 1
    numbered = rows.withColumn("inner", inner).join(sums, ["conv", "bucket"])
    return numbered.select("conv", "conv_id", (F.col("start") + F.col("inner")).alias("index"), "role", "text", "lead")


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY_TOKENS, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """turns(conv_id, turn, role, text) to a row a window: conv_id, window (index from 0 of its first own turn),
    formatted, loss_spans (array of (start, length) in code points of formatted, 0-based), n_tokens (estimated) and
    over_budget (a single turn beyond the room).

    Null roles and texts count as empty. Turns are ordered by turn (a number; null last), role, text; repeated rows
    are turns of their own. Rows of a null conv_id are one conversation. Further columns are left out.

    Spans are chosen within chunks of chunk_turns turns, each a row of its own, so a chunk's first turn begins a
    window. A chunk also holds the turns before it that its history may repeat (a turn has 4 tokens at least).
    """
    tail = max(0, history) // 4
    chunk_turns = max(chunk_turns, tail + 1)
    chunk = F.floor(F.col("index") / chunk_turns).cast("long")
    both = F.when(F.col("index") % chunk_turns >= chunk_turns - tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    dealt = _numbered(turns).withColumn("chunk", F.explode(both))
    chunks = dealt.groupBy("conv", "conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("index", "role", "text"))).alias("turns"), F.first("lead").alias("lead"))
    # held: turns of the chunk before; a chunk that has only these is none
    chunks = chunks.withColumn("held", F.when(F.col("chunk") > 0, tail).otherwise(0)).where(F.size("turns") > F.col("held"))
    chunks = chunks.withColumn("tokens", F.transform("turns", lambda t: turn_tokens(t["text"])))
    chunks = chunks.withColumn("system", F.coalesce(turn_tokens(F.col("lead")), F.lit(0)).cast("long"))
    # prefix[i]: tokens of the first i turns
    prefix = F.aggregate("tokens", F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    own_tokens = F.slice("tokens", F.col("held") + 1, F.size("tokens"))
    starts = F.transform(_spans(own_tokens, F.col("system"), budget, history), lambda i: i + F.col("held"))
    chunks = chunks.withColumn("prefix", prefix).withColumn("starts", starts)
    # Turns that may be repeated begin here (from 1): not the leading system turn, which every window has.
    chunks = chunks.withColumn("first_free", F.when((F.col("chunk") == 0) & F.col("lead").isNotNull(), 2).otherwise(1))
    passed = F.transform("prefix", lambda p, i: F.struct(p.alias("p"), (i + 1).alias("next")))

    def span(start: Column, i: Column) -> Column:
        stop = F.coalesce(F.get("starts", i + 1), F.size("turns") + 1) - 1
        before = F.get("prefix", start - 1)
        # The longest tail of the earlier turns in the history's bound.
        again = F.size(F.filter(passed, lambda x: (x["next"] >= F.col("first_free")) & (x["next"] < start) & (before - x["p"] <= history)))
        return F.struct(
            (F.col("chunk") * chunk_turns + start - 1 - F.col("held")).alias("window"),
            F.slice("turns", start - again, again).alias("tail"), F.slice("turns", start, stop - start + 1).alias("own"),
            (F.get("prefix", stop) - F.get("prefix", start - 1 - again)).alias("n_tokens"),
        )

    windows = chunks.select("conv_id", "lead", "system", F.explode(F.transform("starts", span)).alias("span")).select("conv_id", "lead", "system", "span.*")
    repeat_system = F.col("lead").isNotNull() & (F.col("window") > 0)

    def piece(role: Column, text: Column, repeated: bool) -> Column:
        return F.struct(
            F.concat(_lit(START), escape(role, _ROLE_ESCAPES), _lit(AGAIN if repeated else ""), _lit(AFTER_ROLE)).alias("head"),
            escape(text).alias("body"), (F.lit(not repeated) & (role == "assistant")).alias("learn"),
        )

    system = F.transform(F.when(repeat_system, F.array("lead")).otherwise(F.array().cast("array<string>")), lambda x: piece(_lit("system"), x, True))
    tails = F.transform("tail", lambda t: piece(t["role"], t["text"], True))
    windows = windows.withColumn("pieces", F.concat(system, tails, F.transform("own", lambda t: piece(t["role"], t["text"], False))))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], _lit(END))), "")
    lengths = F.transform("pieces", lambda p: F.struct(F.char_length(p["head"]).alias("h"), F.char_length(p["body"]).alias("b"), p["learn"].alias("learn")))
    spans = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + p["h"] + p["b"] + len(END)).alias("at"),
            F.when(p["learn"], F.concat(s["spans"], F.array(F.struct((s["at"] + p["h"]).alias("start"), p["b"].alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )["spans"]
    total = F.col("n_tokens") + F.when(repeat_system, F.col("system")).otherwise(0)
    return windows.select("conv_id", "window", formatted.alias("formatted"), spans.alias("loss_spans"), total.alias("n_tokens"), (total > budget).alias("over_budget"))


def read_back(windows: DataFrame) -> DataFrame:
    """windows of format_windows() to a row a conversation: conv_id, turns (array of (role, text)) and learnt
    (array of the unescaped texts under the loss mask), both in order, and formatted_chars; repeated turns are left out.
    The result has a whole conversation in a row."""
    segments = F.filter(F.split("formatted", END, -1), lambda s: s != "")

    def turn(s: Column) -> Column:
        colon = F.instr(s, AFTER_ROLE)
        head = F.substring(s, F.lit(len(START) + 1), colon - (len(START) + 1))
        repeated = F.endswith(head, _lit(AGAIN))
        role = F.when(repeated, F.substring(head, F.lit(1), F.char_length(head) - len(AGAIN))).otherwise(head)
        return F.struct(repeated.alias("repeated"), unescape(role, _ROLE_ESCAPES).alias("role"), unescape(F.substring(s, colon + len(AFTER_ROLE), F.char_length(s))).alias("text"))

    own = F.transform(F.filter(F.transform(segments, turn), lambda t: ~t["repeated"]), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    learnt = F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["length"])))
    each = windows.select("conv_id", "window", own.alias("turns"), learnt.alias("learnt"), F.char_length("formatted").alias("chars"))
    parts = F.sort_array(F.collect_list(F.struct("window", "turns", "learnt")))
    whole = each.groupBy("conv_id").agg(parts.alias("parts"), F.sum("chars").cast("long").alias("formatted_chars"))
    return whole.select("conv_id", F.flatten(F.transform("parts", lambda p: p["turns"])).alias("turns"), F.flatten(F.transform("parts", lambda p: p["learnt"])).alias("learnt"), "formatted_chars")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), _lit(said).alias("text"))
    back = read_back(format_windows(turns.unionByName(own)))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], _lit("\n"), t["text"], _lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(written.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
