r"""Chat formatting with Spark expressions only: turns become one templated string a conversation, and back.

The turn structs of a conversation are collected and sorted, adjacent turns of one role form a block, and the blocks
are joined as `<|im_start|>role\n text <|im_sep|> text ... <|im_end|>\n` (without those spaces). Inside texts and roles
a backslash becomes `\0`, a line feed of a role `\1`, and `<|` becomes `<\2|`; so no control string can arise from a
text, and the formatted string gives back every turn exactly.

`loss_spans` says which characters count for the loss: the texts of assistant turns, one span each.

Null roles and texts count as empty. Turns with equal numbers are ordered by role, then text; a null number comes
first; repeated rows are repeated turns; a null conversation id is a conversation of its own. An empty table gives an
empty result. Columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def _replace(value: Column, old: str, new: str) -> Column:
    return F.replace(value, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return _replace(_replace(text, "\\", "\\0"), "<|", "<\\2|")


def unescape(text: Column) -> Column:
    return _replace(_replace(text, "\\2", ""), "\\0", "\\")


def _escape_role(role: Column) -> Column:
    return _replace(escape(role), "\n", "\\1")


def _unescape_role(role: Column) -> Column:
    return unescape(_replace(role, "\\1", "\n"))


def _split(value: Column, control: str) -> Column:
    return F.split(value, "\\Q" + control + "\\E", -1)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_blocks, formatted, loss_spans (`start` from 0 and `length`, in code points of `formatted`).

    `turns`: conv_id, turn, role, text.
    """
    sorted_turns = F.array_sort(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )))
    grouped = turns.groupBy("conv_id").agg(sorted_turns.alias("turns"))

    places = F.sequence(F.lit(1), F.size("turns"))
    is_first = lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"])
    grouped = grouped.withColumn("starts", F.filter(places, is_first))

    def block(start: Column, k: Column) -> Column:
        following = F.coalesce(F.get("starts", k + 1), F.size("turns") + 1)
        members = F.slice("turns", start, following - start)
        return F.struct(
            F.element_at("turns", start)["role"].alias("role"),
            F.transform(members, lambda t: escape(t["text"])).alias("texts"),
        )

    blocks = grouped.withColumn("blocks", F.transform("starts", block))

    def pieces(b: Column) -> Column:
        piece = lambda text, trained: F.struct(text.alias("text"), trained.alias("trained"))
        fixed = lambda text: piece(text, F.lit(False))
        inner = F.transform(b["texts"], lambda text, i: F.array(
            fixed(F.when(i > 0, SEPARATOR).otherwise("")), piece(text, b["role"] == TRAINED_ROLE)
        ))
        head = F.concat(F.lit(START), _escape_role(b["role"]), F.lit("\n"))
        return F.concat(F.array(fixed(head)), F.flatten(inner), F.array(fixed(F.lit(END))))

    laid = blocks.withColumn("pieces", F.flatten(F.transform("blocks", pieces)))
    empty_spans = F.array().cast("array<struct<start:int,length:int>>")

    def advance(state: Column, p: Column) -> Column:
        span = F.struct(state["at"].alias("start"), F.length(p["text"]).alias("length"))
        return F.struct(
            (state["at"] + F.length(p["text"])).alias("at"),
            F.when(p["trained"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    spans = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), empty_spans.alias("spans")), advance)
    return laid.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.size("blocks").cast("long").alias("n_blocks"),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        spans["spans"].alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string again: array<struct<role, text>>."""
    blocks = F.filter(_split(formatted, START), lambda b, i: i > 0)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(head) + 2, F.length(block) - F.length(head) - 1 - len(END))
        role = _unescape_role(head)
        return F.transform(_split(body, SEPARATOR), lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    under = F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))
    return F.array_join(under, "")
