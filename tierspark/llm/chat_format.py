"""Chat formatting with a grammar round trip, in DataFrame functions only.

The grammar of a formatted conversation::

    conversation = { turn }
    turn         = "<s>" role "[INST]" text "</s>"       (any role but assistant)
                 | "<s>" role "[/INST]" text "</s>"      (assistant: under the loss mask)

Control strings are ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``. Inside a
role or text, one is escaped by a backslash behind its first character, and
what already looks escaped gets one more, so that dropping one backslash of
each run restores the source. A text that the parser reads back as it is
stays untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE, _USER, _LOSS = "<s>", "</s>", "[INST]", "[/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2"), r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<\\(\\*)(/?s>)", "<$1$2"), r"\[\\(\\*)(/?INST\])", "[$1$2")


def render(role: Column, text: Column) -> Column:
    """One turn, with its contents as they are."""
    mark = F.when(role == "assistant", F.lit(_LOSS)).otherwise(F.lit(_USER))
    return F.concat(F.lit(_OPEN), role, mark, text, F.lit(_CLOSE))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: array of ``role, text, loss, raw``.

    Reads up to each ``</s>``; what lies before it must be ``<s>``, a role,
    the first mark and a text. Null where the string breaks the grammar.
    """
    pieces = F.split(formatted, _CLOSE, -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    pattern = r"(?s)\A<s>(.*?)\[(/?)INST\](.*)\z"
    control = r"</?s>|\[/?INST\]"
    fits = lambda p: p.rlike(pattern) & ~F.regexp_extract(p, pattern, 1).rlike(control) & ~F.regexp_extract(p, pattern, 3).rlike(control)
    read = F.transform(
        turns,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, pattern, 1)).alias("role"),
            unescape(F.regexp_extract(p, pattern, 3)).alias("text"),
            (F.regexp_extract(p, pattern, 2) == "/").alias("loss"),
            F.regexp_extract(p, pattern, 3).alias("raw"),
        ),
    )
    good = (F.element_at(pieces, -1) == "") & F.forall(turns, fits)
    return F.when(good, read)


def _same(parsed: Column, role: Column, text: Column) -> Column:
    """Whether a parsed string is exactly this one turn."""
    one = F.element_at(parsed, 1)
    return F.coalesce((F.size(parsed) == 1) & (one["role"] == role) & (one["text"] == text) & (one["loss"] == (role == "assistant")), F.lit(False))


def _differs(what: Column) -> Column:
    return F.raise_error(F.concat(F.lit("not read back as it was written: "), F.coalesce(what, F.lit("null")))).cast("string")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, formatted, turns, same``: a row per conversation.

    ``formatted`` is the text, ``turns`` what the parser reads back from it
    (array of ``role, text, loss, raw``: ``raw`` is the part of the formatted
    text that stands for ``text``, ``loss`` whether it is under the loss
    mask; ``loss_spans`` gives the places), ``same`` that it equals the
    source.

    Each turn makes its own round trip first, before any shuffle: rendered,
    parsed and compared with its source; where they differ its contents are
    escaped, and the result compared again. The whole conversation is then
    read back and compared with its source. What still differed would be an
    error of the query: nothing leaves that does not read back. Turns are ordered by number,
    then role, then text; null numbers come first; null roles and texts
    count as empty; a null conversation id is a conversation; repeated turns
    stay. Other columns are not read. An empty table gives no rows. A
    conversation is one row, so it must fit in memory, at any number of them.
    """
    role, text = F.col("_role"), F.col("_text")
    rows = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("_role"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    raw = render(role, text)
    # A source without '<' or '[' cannot hold a control string and needs no parser.
    plain = ~F.concat(role, text).rlike(r"[<\[]")
    escaped = render(escape(role), escape(text))
    kept = F.when(_same(parse(escaped), role, text), escaped).otherwise(_differs(role))
    rows = rows.withColumn("_piece", F.when(plain | _same(parse(raw), role, text), raw).otherwise(kept))
    packed = rows.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("_turn", "_role", "_text", "_piece"))).alias("_turns"))
    packed = packed.select("_conv", "_turns", F.array_join(F.col("_turns._piece"), "").alias("formatted"))
    packed = packed.withColumn("_read", parse(F.col("formatted")))
    source = F.transform("_turns", lambda t: F.struct(t["_role"].alias("role"), t["_text"].alias("text")))
    back = F.transform("_read", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    same = F.coalesce(back == source, F.lit(False))
    # the text leaves through the comparison, which no plan can then leave out
    return packed.select(F.col("_conv").alias(conv_col), F.when(same, F.col("formatted")).otherwise(_differs(F.col("_conv").cast("string"))).alias("formatted"), F.col("_read").alias("turns"), same.alias("same"))


def loss_spans(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv, turn_no, start, length``: the code-point spans of ``formatted`` under the loss mask."""
    from pyspark.sql import Window as W

    before = W.partitionBy("_row").orderBy("turn_no").rowsBetween(W.unboundedPreceding, -1)
    mark = F.when(F.col("t.loss"), F.lit(len(_LOSS))).otherwise(F.lit(len(_USER)))
    head = F.lit(len(_OPEN)) + F.char_length(F.regexp_extract(F.col("piece"), r"(?s)^<s>(.*?)\[/?INST\]", 1)) + mark
    return (
        formatted.select(F.col(conv_col), F.col(conv_col).alias("_row"), F.posexplode(F.arrays_zip("turns", F.slice(F.split("formatted", _CLOSE, -1), F.lit(1), F.size("turns")).alias("pieces"))).alias("turn_no", "z"))
        .select(conv_col, "_row", "turn_no", F.col("z.turns").alias("t"), F.col("z.pieces").alias("piece"))
        .withColumn("_at", F.coalesce(F.sum(F.char_length("piece") + len(_CLOSE)).over(before), F.lit(0)))
        .where("t.loss")
        .select(conv_col, "turn_no", (F.col("_at") + head).alias("start"), F.char_length("t.raw").cast("long").alias("length"))
    )


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Counts and digests of what is read back from the formatted text."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return formatted.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
