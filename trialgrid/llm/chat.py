"""Chat formatting in windows of a token budget, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.expressions import let
from trialgrid.operators.ordinal import running
from trialgrid.session import broadcast_if_small, cut_lineage

#: Tokens a window may have, and tokens of earlier turns it may repeat.
BUDGET, HISTORY = 1024, 128
#: Tokens of a turn's own marks.
MARKS = 4
#: Windows whose spans are chosen one after the other; a conversation of more is cut there.
BLOCK = 64
OPEN, CLOSE = "### ", "</turn>\n"
SYSTEM, ASSISTANT = "system", "assistant"


def count_tokens(text: Column) -> Column:
    """Words and single signs, an estimate that needs no vocabulary."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("bigint")


def escape(text: Column) -> Column:
    """The text without `#`, `<` and line breaks' look-alikes of marks: `\\` becomes `\\\\`, `#` `\\h`, `<` `\\l`."""
    slashed = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(slashed, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    parts = F.split(text, r"\\\\")  # pairs of backslashes, from the left: each was one
    plain = F.transform(
        parts,
        lambda p: F.replace(
            F.replace(F.replace(p, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n")
        ),
    )
    return F.array_join(plain, "\\")


def shortened(text: Column, tokens: int) -> Column:
    """The longest beginning of whole sentences within so many tokens, or of whole words if no sentence ends there."""
    words = F.regexp_extract(text, rf"(?s)^(?:\s*+(?:\w++|[^\w\s])){{0,{tokens}}}", 0)
    sentences = F.regexp_extract(words, r"(?s)^.*[.!?]", 0)
    return F.when(count_tokens(text) <= tokens, text).when(sentences != "", sentences).otherwise(words)


def _starts(spans: Column, free: Column, budget: int) -> Column:
    """Where windows start among turns (start, end): at a turn that no longer fits the window of the turns before it."""
    first = F.struct(F.array().cast("array<bigint>").alias("starts"), F.lit(-1).cast("bigint").alias("open"))

    def step(done: Column, turn: Column) -> Column:
        room = F.when(done["open"] == 0, F.lit(budget)).otherwise(free)  # a conversation's first window repeats nothing
        starts = F.concat(done["starts"], F.array(turn["start"]))
        new = F.struct(starts.alias("starts"), turn["start"].alias("open"))
        return F.when((done["open"] >= 0) & (turn["end"] - done["open"] <= room), done).otherwise(new)

    return F.aggregate(spans, first, step, lambda done: done["starts"])


def _header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))


def format_windows(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
) -> DataFrame:
    """(conv, window, formatted, n_repeated, loss): the windows of every conversation, numbered by the token they start at.

    Turns are `### role`, a line break, the escaped text, `</turn>` and a line break, in the order of `turn`; ties go by
    role and text hash. Tokens are summed along the conversation, and a window takes turns as long as their sum fits the budget;
    later windows keep room for what they repeat. Every later window first repeats a system turn that opens the
    conversation, shortened to whole sentences (or else words) within half of the budget, then those turns of the window
    before that lie within its last `history` tokens. A turn that needs that room is a window of its own, which repeats only
    what fits. So no window exceeds the budget but one of a single turn that does by itself, which is kept whole and repeats
    nothing. Spans are chosen in blocks of about BLOCK windows, at whose ends a window may stay short.

    `n_repeated` counts the repeated turns. `loss` holds the spans, in code points of `formatted`, of the escaped texts of
    assistant turns at their first appearance; repeated ones are masked. Null texts and roles are empty; a null
    conversation id is a conversation, a null turn comes first, and repeated rows are turns of their own. The sums are cut
    into ranges, so that a long conversation is not in one task; a task sees the spans of one block or the texts of one window.
    """
    history = min(history, budget // 4)
    base = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    base = base.withColumn("cost", count_tokens(F.col("text")) + MARKS)
    base = base.select("*", F.xxhash64("text").alias("tie"), F.col("cost").alias("end"), F.lit(1).cast("bigint").alias("seq"))
    placed = running(base, ["turn", "role", "tie"], {"end": "sum", "seq": "sum"}, by=["conv"])
    placed = placed.select(F.struct("conv").alias("conv"), "seq", "role", "text", "cost", "end")
    opens = (F.col("seq") == 1) & (F.col("role") == SYSTEM)
    systems = placed.filter(opens).select("conv", shortened(F.col("text"), budget // 2 - MARKS).alias("system"))
    systems = cut_lineage(systems.withColumn("system_cost", count_tokens(F.col("system")) + MARKS))

    costs = broadcast_if_small(systems.select("conv", "system_cost"))
    free = F.lit(budget - history) - F.coalesce("system_cost", F.lit(0))
    start = F.col("end") - F.col("cost")
    placed = placed.join(costs, "conv", "left").withColumn("free", free).withColumn("opens", opens).withColumn("start", start)
    placed = placed.withColumn("block", F.call_function("div", "start", F.col("free") * BLOCK))

    turns_of = F.array_sort(F.collect_list(F.struct("start", "end")))  # numbers only, and at most BLOCK * budget / MARKS turns
    blocks = placed.groupBy("conv", "block", "free").agg(turns_of.alias("turns"), F.max("end").alias("block_end"))
    starts = _starts(F.col("turns"), F.col("free"), budget)
    blocks = cut_lineage(blocks.select("conv", "block", starts.alias("starts"), "block_end"))
    placed = placed.join(broadcast_if_small(blocks.select("conv", "block", "starts")), ["conv", "block"])
    place = F.size(F.filter("starts", lambda at: at <= F.col("start")))
    placed = placed.withColumn("window", F.element_at("starts", place)).drop("starts")

    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array("block_end"))
    zipped = F.inline(F.arrays_zip(F.col("starts").alias("window"), ends.alias("last")))
    spans = cut_lineage(blocks.select("conv", zipped))
    after = spans.select("conv", F.col("window").alias("following"), (F.col("last") - F.col("window")).alias("next_cost"))
    linked = spans.join(after.withColumn("last", F.col("following")), ["conv", "last"])
    placed = placed.join(broadcast_if_small(cut_lineage(linked)), ["conv", "window"], "left")
    left = F.lit(budget) - F.coalesce("system_cost", F.lit(0)) - F.col("next_cost")
    again = (F.col("start") >= F.col("last") - F.least(F.lit(history), left)) & ~F.col("opens")
    shown = F.struct("window", F.lit(False).alias("repeated"))
    places = F.when(again, F.array(shown, F.struct(F.col("following").alias("window"), F.lit(True).alias("repeated"))))
    shared = placed.select("conv", "seq", "role", "text", "cost", "opens", F.explode(F.coalesce(places, F.array(shown))).alias("at"))

    turn_of = F.struct("seq", F.col("at.repeated").alias("repeated"), "role", "text")
    grouped = shared.groupBy("conv", F.col("at.window").alias("window")).agg(
        F.array_sort(F.collect_list(turn_of)).alias("turns"), F.bool_or("opens").alias("opens"), F.sum("cost").alias("taken")
    )
    heads = broadcast_if_small(systems)
    system = F.array(F.struct(F.lit(1).cast("bigint").alias("seq"), F.lit(True).alias("repeated"), F.lit(SYSTEM).alias("role"), F.col("system").alias("text")))
    repeats = F.col("system").isNotNull() & ~F.col("opens") & (F.col("taken") + F.col("system_cost") <= budget)
    whole = grouped.join(heads, "conv", "left").withColumn("turns", F.when(repeats, F.concat(system, "turns")).otherwise(F.col("turns")))

    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            _header(t["role"]).alias("head"),
            escape(t["text"]).alias("body"),
            ((t["role"] == ASSISTANT) & ~t["repeated"]).alias("learned"),
        ),
    )

    def rendered(p: Column) -> Column:
        return F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")

    def masked(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(done: Column, x: Column) -> Column:
            begin = done["at"] + F.length(x["head"])
            end = begin + F.length(x["body"])
            span = F.array(F.struct(begin.alias("start"), end.alias("end")))
            return F.struct(
                (end + len(CLOSE)).alias("at"), F.when(x["learned"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans")
            )

        return F.aggregate(p, start, step, lambda done: done["spans"])

    both = let(pieces, lambda p: F.struct(rendered(p).alias("formatted"), masked(p).alias("loss")))
    n_repeated = F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated")
    out = whole.select(F.col("conv.conv").alias(conv), "window", n_repeated, both.alias("out"))
    return out.select(conv, "window", "out.formatted", "n_repeated", "out.loss")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted window: array of (role, text), unescaped."""
    pattern = r"(?s)^### ([^\n]*)\n(.*)$"
    parts = F.split(formatted, CLOSE)
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(
            unescape(F.regexp_extract(p, pattern, 1)).alias("role"), unescape(F.regexp_extract(p, pattern, 2)).alias("text")
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )
