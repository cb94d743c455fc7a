r"""Chat formatting with a grammar round trip.

The template renders a turn as ``<|im_start|>role\ntext<|im_end|>\n``. The parser cuts the rendered
text at these control strings and takes one backslash off every ``<\|`` (``<\\|``, ...) that remains.
A conversation is first rendered as it is and parsed; the turns that come back are compared with the
source. Where they differ, the roles and texts of that conversation are escaped (one backslash more
in every ``<|``, ``<\|``, ...; a line break in a role becomes ``<|nl|>``), and the round trip repeats until it is
identical. Escaping is injective and leaves no control string, so the second round always agrees; a
conversation that never conflicts keeps its exact texts.

DataFrame functions only; nothing here leaves the JVM. One conversation is one row of the result, so
its turns meet in one task: the digest of a conversation needs them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"


def _escape(col: Column) -> Column:
    return F.regexp_replace(col, r"<(\\*)\|", r"<\\$1|")


def _unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"<\\(\\*)\|", r"<$1|")


def _escape_turn(t: Column) -> Column:
    return F.struct(F.replace(_escape(t["role"]), F.lit("\n"), F.lit(BREAK)).alias("role"), _escape(t["text"]).alias("text"))


def _render_turn(t: Column) -> Column:
    return F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render_turn), "")


def parse(formatted: Column) -> Column:
    """The turns in a rendered text, unescaped; null for a piece that is not a turn."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)

    def turn(piece: Column) -> Column:
        cut = F.locate("\n", piece)
        tail = F.lit(END + "\n")
        body = F.substring(piece, cut + 1, F.char_length(piece) - cut - F.char_length(tail))
        whole = (cut > 0) & F.endswith(piece, tail) & ~F.contains(body, F.lit(END))
        role = F.replace(F.substring(piece, F.lit(1), cut - 1), F.lit(BREAK), F.lit("\n"))
        return F.when(whole, F.struct(_unescape(role).alias("role"), _unescape(body).alias("text")))

    # the first piece is what stands before the first turn: it has to be empty
    turns = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
    return F.when(F.get(pieces, F.lit(0)) == "", turns)


def format_chats(rows: DataFrame, rounds: int = 4) -> DataFrame:
    """Render conversations for training, proved by a round trip.

    ``rows`` has ``conv_id, turn, role, text``; the result has one row per ``conv_id``: ``formatted``, its
    ``segments`` (per turn the code points of template before its text, those of the text as rendered, and
    whether the text is under the loss mask) and ``escaped`` (how often the texts had to be escaped). Turns come in order of ``turn``, nulls first; ties go
    by role, then text; repeated rows stay. A null text or role is empty, a null ``conv_id`` is one
    conversation. An empty table gives no row. Other columns are ignored.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    open_ = materialise(whole.select("conv_id", source.alias("source")), "chats").withColumn("turns", F.col("source"))
    done = []
    for n in range(rounds):
        tried = open_.withColumn("formatted", render(F.col("turns"))).withColumn("ok", parse(F.col("formatted")).eqNullSafe(F.col("source")))
        tried = materialise(tried, f"chats-round-{n}")
        done.append(tried.where("ok").select("conv_id", "turns", "formatted", F.lit(n).alias("escaped")))
        open_ = tried.where("not ok").select("conv_id", "source", F.transform("turns", _escape_turn).alias("turns"))
        if open_.isEmpty():
            break
    else:
        raise ValueError("some conversations do not survive the round trip")

    segments = F.transform(
        "turns",
        lambda t: F.struct(
            F.char_length(F.concat(F.lit(START + "\n"), t["role"])).alias("skip"),
            F.char_length(t["text"]).alias("size"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )
    return reduce(DataFrame.unionByName, done).select("conv_id", "formatted", segments.alias("segments"), "escaped")


def read_chats(formatted: DataFrame) -> DataFrame:
    """Read rendered conversations back: ``conv_id``, ``turns`` (role, text) and ``loss_texts``."""
    back = formatted.withColumn("turns", parse(F.col("formatted")))
    both = F.zip_with("turns", "segments", lambda t, s: F.struct(t["text"].alias("text"), s["loss"].alias("loss")))
    loss = F.transform(F.filter(both, lambda x: x["loss"]), lambda x: x["text"])
    return back.withColumn("loss_texts", loss)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and one with control strings in its texts, formatted and read back; nulls, ties and repeated rows as ``format_chats`` defines them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = END + START + "assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"),
    )
    back = read_chats(format_chats(rows.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
with src as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), marked as (
  select *, bool_or(contains(text, '<|im_start|>') or contains(text, '<|im_end|>') or regexp_matches(text, '<\\+\|')
                    or contains(role, '<|im_start|>') or contains(role, '<|im_end|>') or contains(role, '<|nl|>')
                    or regexp_matches(role, '<\\+\|') or contains(role, chr(10))) over (partition by conv_id) as hard
  from src
), shown as (
  select *, case when hard then replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|nl|>') else role end as r,
         case when hard then regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') else text end as t
  from marked
)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       length(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), ''))::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length(r) + length(t) + 24)::bigint as formatted_chars
from shown group by conv_id
"""
