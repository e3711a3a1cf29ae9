"""Chat formatting with a grammar round trip.

    chat := turn*      turn := <|im_start|> role \\n text <|im_end|> \\n

Each conversation is rendered once with its texts as they are and parsed again by the
grammar. Where the recovered turns differ from the source, or a text could be read as a
control string, its contents are escaped and the render is parsed once more: in the run
``<``, any number of backslashes, ``|`` one backslash is added, so no control string is left
and taking one backslash out gives the text back. Line breaks in roles become ``<|nl|>``.
``ok`` says that the final parse equals the source; by construction it always does.

The loss mask covers the texts of assistant turns, without the control strings.

Turns are ordered by (turn, role, text), nulls first; null roles and texts are empty.
Repeated rows are turns of their own. Null conv_ids make one conversation. An empty table
gives no conversation. Only DataFrame functions run here. A conversation is one value of
the result, so its turns meet in one task; no other rows do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def render(turns: Column, escaped: bool) -> Column:
    """One text of an array of (role, text)."""

    def one(t: Column) -> Column:
        role = F.replace(escape(t["role"]), F.lit("\n"), F.lit(BREAK)) if escaped else t["role"]
        return F.concat(F.lit(START), role, F.lit("\n"), escape(t["text"]) if escaped else t["text"], F.lit(END + "\n"))

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """The array of (role, text) that the grammar finds; what stands outside of turns is ignored."""

    def one(piece: Column) -> Column:
        head = F.locate("\n", piece)
        role = F.when(head > 0, F.substr(piece, F.lit(1), head - 1)).otherwise(F.lit(""))
        rest = F.substr(piece, head + 1)
        stop = F.instr(rest, F.lit(END))
        text = F.when(stop > 0, F.substr(rest, F.lit(1), stop - 1)).otherwise(rest)
        return F.struct(unescape(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one)


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return grouped.select("conv_id", plain.alias("turns"))


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, turns, formatted text, the turns read back, whether they were escaped, and ok."""
    raw = conversations(rows).withColumn("raw", render(F.col("turns"), False))
    back = F.col("raw").contains(BREAK) | (parse(F.col("raw")) != F.col("turns"))
    marks = F.exists("turns", lambda t: F.concat(t["role"], F.lit(" "), t["text"]).rlike(r"<\\*\|"))
    tried = raw.withColumn("escaped", back | marks)
    shown = F.when(F.col("escaped"), render(F.col("turns"), True)).otherwise(F.col("raw"))
    shown = tried.withColumn("formatted", shown).drop("raw").withColumn("parsed", parse(F.col("formatted")))
    return shown.withColumn("ok", F.col("parsed") == F.col("turns"))


def digest(done: DataFrame) -> DataFrame:
    """What was read back, as counts and hashes."""
    every = F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    mine = F.transform(F.filter("parsed", lambda t: t["role"] == "assistant"), lambda t: t["text"])
    loss = done.withColumn("loss", F.array_join(mine, ""))
    return loss.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(F.array_join(every, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "ok",
    )
