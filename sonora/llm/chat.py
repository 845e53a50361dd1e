r"""Chat formatting in budgeted windows, by DataFrame functions only.

A conversation's turns, in order, are written as `### role: text</turn>` and a newline each. Prefix sums of turn
tokens choose turn-aligned spans: turns that begin and end within the same multiple of the budget are a span, and a
turn that reaches over a multiple is one of its own. So a span's turns keep to the budget together, unless it is a
single turn longer than that; a system turn that opens the conversation goes with the first span and does not count. A span's window
starts with what is repeated (the system turn, if the conversation opens with one, and up to HISTORY
turns before the span), then has the span's own turns. Only texts of assistant turns of the span itself
are under the loss mask, so every target is learned once.

Inside texts and roles the backslash, `</turn>` and `###` are written as `\b`, `\e` and `\h`, and in roles
`:` as `\c`; as those letters follow a backslash nowhere else, reading replaces them back in any text.

Null texts and roles are empty. Turns are ordered by turn, role and text, null turns first; rows that
repeat are turns of their own, and ties in all three are equal in what is written. A null conv_id is a conversation
like any other. Empty tables give no windows. Only conv_id, turn, role and text are read, so other columns may have any names.
Texts may be of any length: a span is whole in memory. A turn is never
cut, and what is repeated before a span comes on top of its budget. A span is collected into one row, a conversation only where the
query digests it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Tokens (words and markers) of a span, tokens that a turn's markers count for, and turns repeated before a span.
BUDGET, MARKER_TOKENS, HISTORY = 384, 4, 2
TARGET_ROLE, SYSTEM_ROLE = "assistant", "system"
_ESCAPES = (("\\", "\\b"), ("</turn>", "\\e"), ("###", "\\h"))


def escaped(text: Column) -> Column:
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _role_escaped(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\c"))


def _role_unescaped(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\c"), F.lit(":")))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, repeated (turns at its start that are not its own) and loss spans.

    loss: array of (start, length) in code points of text, start from 0, in order.
    """
    body = escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), _role_escaped(F.coalesce("role", F.lit(""))), F.lit(MIDDLE))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        head.alias("head"),
        body.alias("body"),
        (F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)) + MARKER_TOKENS).alias("tokens"),
    )
    order = W.partitionBy("conv_id").orderBy("turn", "role", "body")
    so_far = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.row_number().over(order))
    opens = (F.col("at") == 1) & (F.col("role") == SYSTEM_ROLE)
    own_tokens = F.when(opens, F.lit(0)).otherwise(F.col("tokens"))
    before = F.coalesce(F.sum(own_tokens).over(so_far), F.lit(0))
    begins, ends = F.floor(before / budget), F.floor((before + F.col("tokens") - 1) / budget)
    rows = rows.withColumn("cell", F.when(~opens, 2 * ends + (begins == ends).cast("int")))
    rows = rows.withColumn("first", F.coalesce(F.lag("cell").over(order) != F.col("cell"), F.col("at") == 1))
    rows = rows.withColumn("span", F.sum(F.col("first").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1)
    rows = rows.withColumn("system", F.when(F.col("first") & (F.col("at") > 1), F.first(F.when(F.col("role") == SYSTEM_ROLE, F.concat("head", "body"))).over(order)))
    later = [F.when(F.lead("first", h).over(order) & ~opens, F.lead("span", h).over(order)) for h in range(1, history + 1)]
    rows = rows.withColumn("later", F.array_compact(F.array(*later)) if later else F.array().cast("array<bigint>"))
    own = F.struct(F.col("span").alias("window"), F.lit(False).alias("again"))
    again = F.transform("later", lambda s: F.struct(s.alias("window"), F.lit(True).alias("again")))
    placed = rows.withColumn("place", F.explode(F.concat(F.array(own), again)))
    turn = F.struct(
        "at",
        F.col("place.again").alias("again"),
        F.when(~F.col("place.again"), F.col("system")).alias("system"),
        (~F.col("place.again") & (F.col("role") == TARGET_ROLE)).alias("target"),
        "head",
        "body",
    )
    grouped = placed.groupBy("conv_id", F.col("place.window").alias("window")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    system = F.array_compact(F.transform("turns", lambda t: t.system))
    lead = F.when(F.size(system) > 0, F.concat(system[0], F.lit(CLOSE))).otherwise(F.lit(""))
    grouped = grouped.withColumn("lead", lead)
    text = F.concat(F.col("lead"), F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t.body, F.lit(CLOSE))), ""))
    repeated = F.size(F.filter("turns", lambda t: t.again)) + F.when(F.length("lead") > 0, 1).otherwise(0)

    def step(acc: Column, t: Column) -> Column:
        start = acc.at + F.length(t["head"]).cast("long")
        span = F.struct(start.alias("start"), F.length(t.body).cast("long").alias("length"))
        loss = F.when(t.target, F.concat(acc.loss, F.array(span))).otherwise(acc.loss)
        return F.struct((start + F.length(t.body) + len(CLOSE)).alias("at"), loss.alias("loss"))

    zero = F.struct(F.length("lead").cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))
    return grouped.select("conv_id", "window", text.alias("text"), repeated.alias("repeated"), F.aggregate("turns", zero, step)["loss"].alias("loss"))


def read_turns(text: Column, repeated: Column) -> Column:
    """The (role, text) of a window's own turns, read from its text."""
    pieces = F.split(text, CLOSE, -1)
    own = F.slice(pieces, repeated + 1, F.size(pieces) - 1 - repeated)

    def turn(piece: Column) -> Column:
        middle = F.instr(piece, MIDDLE)
        role = F.substring(piece, F.lit(len(OPEN) + 1), middle - len(OPEN) - 1)
        return F.struct(_role_unescaped(role).alias("role"), unescaped(F.substring(piece, middle + len(MIDDLE), F.length(piece))).alias("text"))

    return F.transform(own, turn)


def read_loss(text: Column, loss: Column) -> Column:
    """The texts under a window's loss mask, unescaped."""
    return F.transform(loss, lambda s: unescaped(F.substring(text, (s.start + 1).cast("int"), s["length"].cast("int"))))


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation, all of it read back from the windows."""
    turns = read_turns(F.col("text"), F.col("repeated"))
    read = formatted.select(
        "conv_id",
        "window",
        F.size(turns).alias("n"),
        F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("turns"),
        F.array_join(read_loss(F.col("text"), F.col("loss")), "").alias("loss"),
        F.length("text").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("parts", lambda p: p["turns"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def probe(turns: DataFrame) -> DataFrame:
    """The conversation -7, whose texts hold the template's own control strings."""
    text = F.lit("\\### Assistant: </turn> ok")
    spark = turns.sparkSession
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), text.alias("text")
    )
