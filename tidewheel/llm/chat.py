"""Relational chat formatting: turns to one training string a conversation, with Spark expressions only.

Turn structs are collected and sorted, adjacent turns of one role merged into a block by an
array aggregation, and blocks concatenated::

    <|im_start|>role\\nfirst text<|im_sep|>second text<|im_end|>\\n

Inside texts and roles a backslash goes into every ``<|`` (``<|`` becomes ``<\\|``, ``<\\|``
becomes ``<\\\\|``), so control strings of the template occur only where it wrote them, and
``parse_chats`` gives back every turn. In roles line breaks are escaped as well. The loss mask holds the code-point
spans of assistant texts.

An array that grows by one in an aggregation is copied at every step. Turns and pieces are therefore aggregated in
chunks of CHUNK, and texts under the mask are read from the output cut every CUT code points: the work grows with
the turns and characters of a conversation and not with their square.

Defined results: null text and null role are empty; turns sort by (turn, role, text), nulls first;
repeated rows are turns of their own; a null conv_id is a conversation; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CHUNK, CUT = 256, 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    plain = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return escape(plain)


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _chunks(array: str) -> Column:
    """The array (not empty) as an array of arrays of at most CHUNK elements."""
    last = ((F.size(array) - 1) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(array, c * CHUNK + 1, F.lit(CHUNK)))


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) of turns (conv_id, turn, role, text).

    loss_spans: array of (start, length) in code points, from 1, of each text of ``trained_role``.
    """
    one = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    blocks_type = "array<struct<role:string,texts:array<string>>>"

    def add(blocks: Column, t: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        text = escape(t["text"])
        joined = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(text)).alias("texts"))
        opened = F.array(F.struct(t["role"].alias("role"), F.array(text).alias("texts")))
        return F.when((F.size(blocks) > 0) & (last["role"] == t["role"]), F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(joined))).otherwise(F.concat(blocks, opened))

    merged = F.flatten(F.transform(_chunks("turns"), lambda part: F.aggregate(part, F.array().cast(blocks_type), add)))
    blocks = sorted_.select("conv_id", merged.alias("blocks"))
    # each piece is text to write and whether the loss covers it
    plain = lambda s: F.array(F.struct(s.alias("s"), F.lit(False).alias("loss")))
    opening = lambda b: plain(F.concat(F.lit(START), _escape_role(b["role"]), F.lit("\n")))
    body = lambda b: F.transform(b["texts"], lambda t, i: F.struct(F.when(i > 0, F.lit(SEPARATOR)).otherwise(F.lit("")).alias("s"), F.lit(False).alias("loss")))
    text = lambda b: F.transform(b["texts"], lambda t: F.struct(t.alias("s"), (b["role"] == trained_role).alias("loss")))
    woven = lambda b: F.flatten(F.transform(F.arrays_zip(body(b).alias("p"), text(b).alias("t")), lambda z: F.array(z["p"], z["t"])))

    def written(b: Column, i: Column) -> Column:
        # a block that a chunk's end cut in two is written as one
        goes_on = lambda other: F.get("blocks", other)["role"].eqNullSafe(b["role"])
        head = F.when(goes_on(i - 1), plain(F.lit(SEPARATOR))).otherwise(opening(b))
        tail = F.when(goes_on(i + 1), plain(F.lit(""))).otherwise(plain(F.lit(END + "\n")))
        return F.concat(head, woven(b), tail)

    laid = blocks.select("conv_id", F.flatten(F.transform("blocks", written)).alias("pieces"))
    laid = laid.select("conv_id", F.concat_ws("", F.transform("pieces", lambda p: p["s"])).alias("formatted"), _chunks("pieces").alias("parts"))
    totals = F.transform("parts", lambda part: F.aggregate(part, F.lit(0), lambda n, p: n + F.char_length(p["s"])))
    starts = F.aggregate(F.slice(totals, F.lit(1), F.size("parts") - 1), F.array(F.lit(1)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
    none = F.array().cast("array<struct<start:int,length:int>>")
    of_part = lambda z: F.aggregate(
        z["parts"],
        F.struct(z["starts"].alias("at"), none.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p["s"])).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.char_length(p["s"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    spans = F.flatten(F.transform(F.arrays_zip(F.col("parts").alias("parts"), starts.alias("starts")), of_part))
    return laid.select("conv_id", "formatted", spans.alias("loss_spans"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts): turns (role, text) and the texts under the loss mask, read back from ``formatted``."""
    inner = F.split("formatted", r"<\|im_end\|>\n", -1)
    blocks = F.filter(inner, lambda b: F.startswith(b, F.lit(START)))
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring(b, F.locate("\n", b) + 1, F.char_length(b)), r"<\|im_sep\|>", -1),
                lambda t: F.struct(_unescape_role(F.substring(b, F.lit(len(START) + 1), F.locate("\n", b) - len(START) - 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    cuts = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))

    def under_mask(cuts: Column, s: Column) -> Column:
        before = s["start"] - 1
        first, last = (before / CUT).cast("int"), ((before + s["length"] - 1) / CUT).cast("int")
        return F.substring(F.array_join(F.slice(cuts, first + 1, last - first + 1), ""), before - first * CUT + 1, s["length"])

    # a lambda over an array of one holds the cuts, so that they are made once a conversation
    loss = F.flatten(F.transform(F.array(cuts), lambda c: F.transform("loss_spans", lambda s: unescape(under_mask(c, s)))))
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_texts"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what ``parse_chats`` reads back."""
    read = parse_chats(formatted)
    loss = F.concat_ws("", "loss_texts")
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
