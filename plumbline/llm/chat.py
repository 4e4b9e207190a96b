"""Chat formatting by replay of a conversation log.

A log row is an event (conv_id, seq, target, kind, role, text): ``message`` opens message ``target``, ``delta`` appends
to it as it streams, ``edit`` replaces its text, ``regenerate`` discards what has been streamed and begins anew. A
message is what follows its last opening, edit or regeneration, joined in order of seq. Messages are folded by
(conv_id, target), so a long conversation is spread over tasks; only its finished messages meet, to be rendered in
order of target.

Template: ``### Role:`` and a line feed, the text, ``</turn>`` and a line feed. Inside roles and texts a backslash
becomes ``\\b``, ``<`` becomes ``\\l`` and ``#`` becomes ``\\h``, in roles a line feed ``\\n``; so neither mark can occur in a text, and splitting at
the end marks and undoing the three replacements gives back the turns. The loss mask lists, for each assistant turn, the
turn's number and the place and length of its text within the turn, in code points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only

HEAD, AFTER_ROLE, END = "### ", ":\n", "</turn>\n"
LEARNED = "assistant"
# Fixed values, in the order in which they are put in; taken out in the opposite order.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
OPENS = ("message", "edit", "regenerate")
PARTS = 4


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def fold(events: DataFrame, target: Sequence[str] = ("target",)) -> DataFrame:
    """(conv_id, *target, role, text): the final messages. ``target`` names a message within its conversation.

    Null texts and roles are empty; a message has the first role that any of its events gives. Events of a message that
    share a seq go by kind and text, openings last. Events of other kinds are ignored. Deltas before any opening count
    from the start.
    """
    opens = F.col("kind").isin(*OPENS)
    entry = F.struct("seq", opens.alias("opens"), "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    known = events.where(opens | (F.col("kind") == "delta"))
    grouped = known.groupBy("conv_id", *target).agg(F.sort_array(F.collect_list(entry)).alias("log"))
    at = F.sequence(F.lit(0), F.size("log") - 1)
    last = F.aggregate(at, F.lit(0), lambda found, i: F.when(F.get("log", i)["opens"], i).otherwise(found))
    placed = grouped.select("conv_id", *target, "log", last.alias("last"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r != "")
    said = F.transform(F.slice("log", F.col("last") + 1, F.size("log")), lambda e: e["text"])
    return placed.select("conv_id", *target, F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"), F.array_join(said, "").alias("text"))


def render(messages: DataFrame, target: Sequence[str] = ("target",)) -> DataFrame:
    """(conv_id, formatted, loss_mask) of every conversation of ``messages`` (conv_id, *target, role, text)."""
    head = F.concat(F.lit(HEAD), _escape_role(F.col("role")), F.lit(AFTER_ROLE))
    body = escape(F.col("text"))
    place = F.struct((F.col("role") == LEARNED).alias("learned"), (F.char_length(head) + 1).alias("start"), F.char_length(body).alias("length"))
    turn = F.struct(*target, F.concat(head, body, F.lit(END)).alias("shown"), place.alias("place"))
    ordered = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t["place"]["start"].alias("start"), t["place"]["length"].alias("length"), t["place"]["learned"].alias("learned")))
    mask = F.transform(F.filter(spans, lambda m: m["learned"]), lambda m: F.struct(m["turn"].alias("turn"), m["start"].alias("start"), m["length"].alias("length")))
    return ordered.select("conv_id", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    raw = F.filter(F.split(formatted, END), lambda t: t != "")
    after = len(HEAD)

    def parse(turn: Column) -> Column:
        role_end = F.locate(AFTER_ROLE, turn)
        role = F.substring(turn, F.lit(after + 1), role_end - F.lit(after + 1))
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substring(turn, role_end + F.lit(len(AFTER_ROLE)), F.char_length(turn))).alias("text"))

    return F.transform(raw, parse)


def masked(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the loss mask, in order and with nothing between."""
    turns = F.split(formatted, END)
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(F.get(turns, m["turn"]), m["start"], m["length"]))), "")


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as a log in which each row opens the message (turn, copy).

    Rows that share a turn stay apart, in order of role and text; a null turn comes first.
    """
    given = only(conversations, "conv_id", "turn", "role", "text")
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    return given.select("conv_id", "turn", copy.alias("copy"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def streamed_log(conversations: DataFrame, parts: int = PARTS) -> DataFrame:
    """A table of whole turns as the log of a client that streams: (conv_id, turn, copy, seq, kind, role, text).

    Each message opens with a draft, the first part of its text, and streams on by a delta of the part after next. An
    answer of the assistant is then regenerated and streamed whole, in ``parts`` deltas; any other message is edited, to the
    text's first part, and the other parts follow as deltas. Folding it gives the turns back.
    """
    size = F.greatest(F.ceil(F.char_length("text") / parts).cast("int"), F.lit(1))
    part = lambda i: F.substring(F.col("text"), F.lit(i) * size + 1, size)
    event = lambda kind, text, role=None: F.struct(F.lit(kind).alias("kind"), F.lit(role).cast("string").alias("role") if role is None else role.alias("role"), text.alias("text"))
    draft = [event("message", part(0), F.col("role")), event("delta", part(2))]
    rest = [event("delta", part(i)) for i in range(1, parts)]
    again = F.array(*draft, event("regenerate", F.lit(None).cast("string")), event("delta", part(0)), *rest)
    edited = F.array(*draft, event("edit", part(0)), *rest)
    turns = turns_as_events(conversations).withColumn("text", F.coalesce("text", F.lit("")))
    events = F.when(F.col("role") == LEARNED, again).otherwise(edited)
    rows = turns.select("conv_id", "turn", "copy", F.posexplode(events).alias("seq", "e"))
    return rows.select("conv_id", "turn", "copy", F.col("seq").cast("long").alias("seq"), "e.kind", "e.role", "e.text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """What can be read back from every formatted conversation of ``conversations`` (conv_id, turn, role, text).

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of each turn), loss_chars and loss_sha256 of the
    unescaped text under the loss mask, formatted_chars. The turns are replayed from ``streamed_log``, with drafts, deltas,
    edits and regenerations. A null conv_id is a conversation of its own. An empty table gives no rows.
    """
    target = ("turn", "copy")
    made = render(fold(streamed_log(conversations), target), target)
    back = made.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(role) + length(text) + 4 + 2 + 8
         + length(regexp_replace(role || text, '[^\\<#]', '', 'g')) + length(role) - length(replace(role, chr(10), '')) AS size
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
