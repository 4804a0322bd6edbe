"""Chat formatting that survives being read back.

DataFrame functions only. Turns are rendered with control strings around them, the result is
parsed again and compared with the source; where that is not identical, the conversation is
rendered with its conflicting content escaped, and parsed again.

The grammar: any number of  <|im_start|> role LF text <|im_end|> LF . Escaping puts one more
backslash between ``<`` and ``|`` wherever only backslashes stand there, so an escaped text
never holds a control string; a role also has ``%`` and LF as %25 and %0A.

Defined results: a missing role or text is empty; rows are ordered by turn, rows without a turn
first, equal turns by role and text; repeated rows are repeated turns; conversations without id
form one; an empty table gives no rows. Other columns of the input are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings.
START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def render(turns: Column, escaped: bool) -> Column:
    """One text from an array of (role, text)."""
    def one(turn: Column) -> Column:
        role, text = turn["role"], turn["text"]
        if escaped:
            role, text = _escape_role(role), escape(text)
        return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def _pieces(formatted: Column) -> Column:
    """What follows each start string."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    return F.slice(pieces, F.lit(2), F.size(pieces))


def _content(piece: Column) -> Column:
    """The text of a piece, as it stands there."""
    role = F.length(F.substring_index(piece, "\n", 1))
    return F.substr(piece, role + 2, F.length(piece) - role - 2 - len(END))


def parse(formatted: Column) -> Column:
    """The array of (role, text) that the grammar finds; a piece that breaks it is NULL."""
    def one(piece: Column) -> Column:
        end = F.locate(END, piece)
        fits = piece.endswith(END + "\n") & (end == F.length(piece) - len(END)) & (F.locate("\n", piece) < end)
        turn = F.struct(_unescape_role(F.substring_index(piece, "\n", 1)).alias("role"),
                        unescape(_content(piece)).alias("text"))
        return F.when(fits, turn)
    return F.transform(_pieces(formatted), one)


def learned_spans(formatted: Column) -> Column:
    """Where the texts to learn from stand in a formatted conversation: (start, end) in code points."""
    def step(seen: Column, piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        start = seen["at"] + len(START) + F.length(role) + 1
        after = seen["at"] + len(START) + F.length(piece)
        span = F.array(F.struct(start.alias("start"), (after - len(END) - 1).alias("end")))
        return F.struct(after.alias("at"), F.when(
            _unescape_role(role) == LEARNED_ROLE, F.concat(seen["spans"], span)).otherwise(
                seen["spans"]).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(_pieces(formatted), none, step, lambda seen: seen["spans"])


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def format_chat(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (spans to learn from), escaped.

    A conversation is one text in the result, so its rows meet in one group.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    source = turns.select("conv_id", F.transform(
        "rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = source.withColumn("plain", render(F.col("source"), False))
    tried = plain.withColumn("escaped", ~F.coalesce(parse(F.col("plain")) == F.col("source"), F.lit(False)))
    chosen = tried.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(F.col("plain")))
    same = ~F.col("escaped") | F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False))
    checked = F.when(same, F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation cannot be read back from its escaped form")).cast("string"))
    return chosen.select("conv_id", checked.alias("formatted"), "escaped").withColumn(
        "loss", learned_spans(F.col("formatted")))
