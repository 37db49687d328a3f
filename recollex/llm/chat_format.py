"""Chat formatting: a finite-state machine over roles and a declarative template, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template. `open` and `close` mark a turn; `loss` names the roles whose text is trained on. `moves` is the state
#: machine: from a state (the last role, or start) a role may follow.
TEMPLATE = {
    "open": "<turn ",
    "open_end": ">\n",
    "close": "</turn>\n",
    "loss": ("assistant",),
    "moves": {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
}
#: Reversible escapes: a backslash doubles, and a control string's first character becomes one of these pairs. Escaped
#: text holds no control string, so a formatted text splits at them without ambiguity.
BACKSLASH, ANGLE, NEWLINE = "\\", "\\l", "\\e"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit(BACKSLASH), F.lit(BACKSLASH * 2))
    for control in (TEMPLATE["open"], TEMPLATE["close"].rstrip("\n")):
        c = F.replace(c, F.lit(control), F.lit(ANGLE + control[1:]))
    return c


def escape_role(c: Column) -> Column:
    """A role stands in the turn's head, which ends at a line break; so its line breaks are escaped as well."""
    return F.replace(escape(c), F.lit("\n"), F.lit(NEWLINE))


def unescape(c: Column) -> Column:
    """Undoes escape and escape_role. Pairs of backslashes are split off from the left, so a pair never reads as an escape."""
    part = lambda x: F.replace(F.replace(x, F.lit(ANGLE), F.lit("<")), F.lit(NEWLINE), F.lit("\n"))
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), part), BACKSLASH)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id: segments (array of text, loss), formatted (their concatenation), valid and error_turn.

    turns has conv_id, turn, role, text. Rows are ordered by turn (nulls first); rows that share a turn by role, then
    text. Null role or text is empty; a null conv_id is a conversation of its own. An order of roles that the state
    machine doesn't allow (and an unknown role) is formatted all the same, with valid false and error_turn the 0-based
    place of the first turn it rejects. Extra columns are ignored; an empty table gives none. A conversation is one
    text, so its turns meet in one row by nature; conversations are dealt by conv_id.
    """
    row = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    convs = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    allowed = F.array(*[F.lit(f"{a}\x00{b}") for a, bs in TEMPLATE["moves"].items() for b in bs])
    before = F.concat(F.array(F.lit("start")), F.transform("turns", lambda t: t["role"]))
    bad = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: ~F.array_contains(allowed, F.concat(F.get(before, i), F.lit("\x00"), F.get(before, i + 1))))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        piece(F.concat(F.lit(TEMPLATE["open"]), escape_role(t["role"]), F.lit(TEMPLATE["open_end"])), F.lit(False)),
        piece(escape(t["text"]), t["role"].isin(*TEMPLATE["loss"])),
        piece(F.lit(TEMPLATE["close"]), F.lit(False)),
    )))
    return convs.select(
        "conv_id",
        segments.alias("segments"),
        F.array_join(F.transform(segments, lambda s: s["text"]), "").alias("formatted"),
        (F.size(bad) == 0).alias("valid"),
        F.get(bad, F.lit(0)).alias("error_turn"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (array of role, text) that a formatted text was made of."""
    body = F.filter(F.split(formatted, TEMPLATE["close"], -1), lambda x: x != "")
    head = lambda x: F.substring_index(x, TEMPLATE["open_end"], 1)
    return F.transform(body, lambda x: F.struct(
        unescape(F.substring(head(x), F.lit(len(TEMPLATE["open"]) + 1), F.length(x))).alias("role"),
        unescape(F.substring(x, F.length(head(x)) + len(TEMPLATE["open_end"]) + 1, F.length(x))).alias("text"),
    ))


#: The contract's extra conversation.
PROBE = r"\### Assistant: </turn> ok"


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    done = format_conversations(turns.unionByName(probe))
    back = done.select("conv_id", "valid", "formatted", read_back(F.col("formatted")).alias("turns"), F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])).alias("losses"))
    loss = F.array_join("losses", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"replace(replace(replace({0}, '\', '\\'), '<turn ', '\lturn '), '</turn>', '\l/turn>')"
OP9_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(replace({_ESC.format('role')}, chr(10), '\e')) + length({_ESC.format('text')}) + 8) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
