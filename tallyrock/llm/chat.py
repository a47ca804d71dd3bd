"""Chat formatting from an event log. JVM only.

A log holds events of conversations: ``conv_id``, ``seq`` (order), ``message`` (number of the message in its conversation),
``kind``, ``role``, ``text``. Kinds: ``message`` begins a message anew with its role and text; ``delta`` appends streamed
text; ``edit`` replaces the text; ``regenerate`` empties it and takes back all that was logged before for later messages.
Folding keeps, for each message, its last beginning (message, edit or regenerate) and the deltas after it; the role is the
last one given. A message that has only deltas is their text.

Rendering: each message is ``<s>role[INST] text [/INST]</s>``. In roles and texts a backslash is doubled and one is put
after the first character of a control string, so no control string of the template can come from a text, and reading back
takes the character after each backslash literally.

Reading back gives each turn with the span of its escaped text, in code points of the formatted text. The loss mask is a list of
such spans with a flag, on for the roles in ``LEARNED``; the text that a trainer learns from is what lies under the mask, unescaped.

``events_of`` makes a log of finished conversations as a service would have written it: users' messages begin as a draft that
is edited when all is said, other messages are begun, regenerated and streamed in pieces.

Null texts and roles are empty; null kinds count as message; events with a null conv_id, seq or message sort first and form
conversations and messages of their own null key; equal events at one seq are ordered by kind, role and text; an empty log
gives no conversations. A conversation's messages meet in one row, as its formatted text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, running, table

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
OPEN, MIDDLE, CLOSE, END = "<s>", "[INST] ", " [/INST]", "</s>"
LEARNED = ("assistant",)
#: Pieces that a message is streamed in at most, and the least characters of one.
PIECES, PIECE_CHARS = 8, 64


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of a log."""
    kind = F.coalesce("kind", F.lit("message"))
    order = [F.col("seq").asc_nulls_first(), kind, "role", "text"]
    e = events.select("conv_id", "seq", "message", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    in_conv = Window.partitionBy("conv_id")
    # the last regeneration of an earlier message takes back what was logged before it
    before = in_conv.orderBy(F.col("message").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, -1)
    taken_back = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(before)
    e = e.withColumn("_back", taken_back).filter(F.col("_back").isNull() | (F.col("seq") > F.col("_back")))
    in_message = Window.partitionBy("conv_id", "message").orderBy(*order)
    begun = F.sum(F.when(F.col("kind") != "delta", 1).otherwise(0)).over(in_message)
    e = e.withColumn("_nth", F.row_number().over(in_message)).withColumn("_begun", begun)
    e = e.withColumn("_last", F.max("_begun").over(Window.partitionBy("conv_id", "message")))
    part = F.when((F.col("_begun") == F.col("_last")) & (F.col("kind") != "regenerate"), F.struct("_nth", "text"))
    folded = e.groupBy("conv_id", "message").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["text"]), "").alias("text"), F.max(F.when(F.col("role").isNotNull(), F.struct("_nth", "role"))).alias("_role"))
    return folded.select("conv_id", "message", F.coalesce("_role.role", F.lit("")).alias("role"), "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted) from (conv_id, message, role, text)."""
    line = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE), escape(F.col("text")), F.lit(CLOSE + END))
    return messages.select("conv_id", F.struct("message", line.alias("line")).alias("m")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda s: s["line"]), "").alias("formatted"))


def placed_lines(formatted: Column, body) -> Column:
    """body(lines) of the array of a formatted text's lines: struct (raw, at), without the end mark, and where each starts."""
    raw = F.filter(F.split(formatted, END, -1), lambda x: x != "")
    sized = lambda lines: F.transform(lines, lambda x: F.length(x) + len(END))
    with_place = lambda lines: let(sized(lines), lambda n: F.zip_with(lines, running(n), lambda x, at: F.struct(x.alias("raw"), at.alias("at"))))
    return body(let(raw, with_place))


def parse(formatted: DataFrame) -> DataFrame:
    """Reads rendered text back: adds turns, an array of (role, text, start, end): role and text unescaped, and the span of the
    escaped text in formatted (code points from 0, end exclusive)."""

    def turn(line: Column) -> Column:
        x, cut = line["raw"], F.locate(MIDDLE, line["raw"])
        begin, end = cut - 1 + len(MIDDLE), F.length(line["raw"]) - len(CLOSE)
        role = F.substring(x, len(OPEN) + 1, cut - 1 - len(OPEN))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(x, begin + 1, end - begin)).alias("text"), (line["at"] + begin).alias("start"), (line["at"] + end).alias("end"))

    return formatted.withColumn("turns", placed_lines(F.col("formatted"), lambda lines: F.transform(lines, turn)))


def loss_mask(turns: Column) -> Column:
    """An array of (start, end, learn), one for each turn: where its text lies, and whether it is learned from."""
    return F.transform(turns, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["role"].isin(*LEARNED).alias("learn")))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The texts under a loss mask, cut out of the formatted text and unescaped, one after the other."""
    cut = lambda line, m: F.when(m["learn"], unescape(F.substring(line["raw"], m["start"] - line["at"] + 1, m["end"] - m["start"]))).otherwise("")
    return F.array_join(placed_lines(formatted, lambda lines: F.zip_with(lines, mask, cut)), "")


def events_of(conversations: DataFrame) -> DataFrame:
    """A log of finished conversations (conv_id, turn, role, text); messages are numbered by turn, role and text."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    text = F.coalesce("text", F.lit(""))
    size = F.greatest(F.lit(PIECE_CHARS), F.ceil(F.length(text) / PIECES).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / size).cast("int")), lambda k: F.substring(text, k * size + 1, size))
    # the high half of a place in the log is the message's number, or lies beyond all of them
    seq = lambda message, k: F.shiftleft(message.cast("long"), 32) + k
    event = lambda place, kind, role, t: F.struct(place.alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), t.alias("text"))
    message, none, draft = F.col("message"), F.lit(None).cast("string"), F.lit("draft")
    edited = F.array(event(seq(message, 0), "message", F.col("role"), draft), event(seq(message + (1 << 30), 0), "edit", none, text))
    begun = F.array(event(seq(message, 0), "message", F.col("role"), draft), event(seq(message, 1), "delta", none, draft), event(seq(message, 2), "regenerate", none, none))
    streamed = F.concat(begun, F.transform(pieces, lambda t, k: event(seq(message, k + 3), "delta", none, t)))
    logged = F.when(F.col("role") == "user", edited).otherwise(streamed)
    numbered = conversations.select("conv_id", at.alias("message"), "role", "text")
    return numbered.select("conv_id", "message", F.explode(logged).alias("e")).select("conv_id", "e.seq", "message", "e.kind", "e.role", "e.text")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -1L AS conv_id, t.* FROM VALUES (0L, 'user', '</s>[INST] ok [/INST]'), (1L, 'assistant', '</s>[INST] ok [/INST]') AS t(turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = parse(render(fold(events_of(rows))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = read.withColumn("_mask", loss_mask(F.col("turns"))).withColumn("_loss", under_mask(F.col("formatted"), F.col("_mask")))
    return loss.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


ORACLE = r"""
WITH own(conv_id, turn, role, text) AS (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM own)),
turns AS (SELECT *,
  length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '<s>', ''))) / 3
  + (length(text) - length(replace(text, '</s>', ''))) / 4 + (length(text) - length(replace(text, '[INST]', ''))) / 6 + (length(text) - length(replace(text, '[/INST]', ''))) / 7
  + length(role) + 22 AS chars FROM rows),
convs AS (SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM convs
"""
