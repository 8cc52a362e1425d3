"""Chat formatting in budgeted windows, with built-in DataFrame functions only.

Turns are written `<|im_start|>role\\ntext<|im_end|>\\n`. In roles and texts a
backslash is doubled and `<|` becomes `<\\|` (in roles a line end becomes `<\\n`),
which is undone without loss, so no text can open or close a turn.

Prefix sums of turn tokens cut a conversation into spans of whole turns: the sum
before a turn and the sum after it fall into cells of so many tokens; turns that
lie within one cell make a span, one that straddles cells is a span of its own. A span is known from two
prefix sums, without walking the conversation, so a conversation of any length
is a running sum and not one task's array. A window is a span after the system
turn (the first, if its role is system) and up to HISTORY earlier turns of at most
HISTORY_TOKENS tokens. The loss mask covers the assistant texts of the span
alone: each once over all windows, repeated turns never.

The budget of TARGET tokens is for the whole window: a conversation's cells are what its system
turn and the history leave of it, LEAST_CELL at least. So a window keeps the budget unless one turn is longer
than a cell or the system turn leaves less than LEAST_CELL; such windows have `over` set. Tokens are
estimated, as no tokenizer is at hand in DataFrame functions: see token_count.

Null texts and roles are empty. Rows of one conversation go by turn, then role,
then text; null turns come first and a null conv_id is a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.runtime import plain

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TARGET, HISTORY, HISTORY_TOKENS, LEAST_CELL = 1024, 2, 256, 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def token_count(text: Column) -> Column:
    """Tokens of a turn for the budget: a quarter of its escaped characters, rounded up, and three for its marks."""
    return (F.ceil(F.char_length(escape(text)) / 4) + 3).cast("long")


def windows(conversations: DataFrame, target: int = TARGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """(conv_id, window, text, turns, loss, tokens, over): turns are structs (start, chars, fresh), loss are structs (start, chars) in text."""
    rows = plain(conversations, "conv_id", "turn", "role", "text")
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("tokens", token_count(F.col("text")))
    rows = rows.withColumns({"n": F.row_number().over(order), "after": F.sum("tokens").over(upto)})
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("system", (F.col("n") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("cell", F.greatest(F.lit(min(LEAST_CELL, target)), target - history_tokens * bool(history) - F.coalesce(F.max(F.when(F.col("system"), F.col("tokens"))).over(whole), F.lit(0))).cast("long"))
    rows = rows.withColumns({"lo": F.expr("(after - tokens) div cell"), "hi": F.expr("(after - 1) div cell")})
    fresh = F.coalesce((F.lag("lo").over(order) != F.col("lo")) | (F.lag("hi").over(order) != F.col("hi")), F.lit(True))
    rows = rows.withColumn("starts", fresh)
    rows = rows.withColumn("window", F.sum(F.col("starts").cast("int")).over(upto))
    last = F.max("window").over(whole)
    # a turn is history of those spans that begin within the next `history` turns and tokens
    later = [
        F.when(F.lead("starts", j).over(order) & (F.lead(F.col("after") - F.col("tokens"), j).over(order) - (F.col("after") - F.col("tokens")) <= history_tokens), F.lead("window", j).over(order))
        for j in range(1, history + 1)
    ]
    rows = rows.withColumns({"last": last, "later": F.array_compact(F.array(*later)) if later else F.array().cast("array<int>")})
    again = F.when(F.col("system"), F.when(F.col("last") > 1, F.sequence(F.lit(2), F.greatest(F.col("last"), F.lit(2)))).otherwise(F.array().cast("array<int>"))).otherwise(F.array_distinct("later"))
    to = F.concat(F.array(F.struct(F.col("window").cast("int").alias("window"), F.lit(True).alias("fresh"))), F.transform(again, lambda w: F.struct(w.cast("int").alias("window"), F.lit(False).alias("fresh"))))
    body = escape(F.col("text"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select("conv_id", "n", "role", "tokens", F.explode(to).alias("to"), head.alias("head"), body.alias("body"))
    piece = F.struct("n", F.concat("head", "body", F.lit(f"{CLOSE}\n")).alias("piece"), F.char_length("head").alias("head"), F.char_length("body").alias("body"), F.col("to.fresh").alias("fresh"), (F.col("role") == "assistant").alias("target"))
    out = rows.groupBy("conv_id", F.col("to.window").alias("window")).agg(F.sort_array(F.collect_list(piece)).alias("p"), F.sum("tokens").alias("tokens"))  # one window's turns
    out = out.select("conv_id", "window", "tokens", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"), "p", F.aggregate("p", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(x["piece"])))).alias("begin"))
    turns = F.transform("p", lambda x, i: F.struct(F.get("begin", i).alias("start"), F.char_length(x["piece"]).alias("chars"), x["fresh"].alias("fresh"), x["head"].alias("head"), x["body"].alias("body"), x["target"].alias("target")))
    out = out.select("conv_id", "window", "tokens", "text", turns.alias("t"))
    loss = F.transform(F.filter("t", lambda x: x["fresh"] & x["target"]), lambda x: F.struct((x["start"] + x["head"]).alias("start"), x["body"].alias("chars")))
    return out.select("conv_id", "window", "text", F.transform("t", lambda x: F.struct(x["start"], x["chars"], x["fresh"])).alias("turns"), loss.alias("loss"), "tokens", (F.col("tokens") > target).alias("over"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, turns, loss_text, formatted_chars) from the windows' texts and spans: fresh turns as (role, text)."""
    part = lambda s, start, chars: F.substring(s, start + 1, chars)
    pieces = F.transform(F.filter("turns", lambda t: t["fresh"]), lambda t: part(F.col("text"), t["start"] + len(OPEN), t["chars"] - (len(OPEN) + len(CLOSE) + 1)))
    turns = F.transform(pieces, lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.instr(p, "\n") + 1, F.char_length(p))).alias("text")))
    loss = F.array_join(F.transform("loss", lambda s: unescape(part(F.col("text"), s["start"], s["chars"]))), "")
    return formatted.select("conv_id", "window", turns.alias("turns"), loss.alias("loss_text"), F.char_length("text").alias("formatted_chars"))
