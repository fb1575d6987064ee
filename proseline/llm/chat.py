"""Chat formatting of typed content parts, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The template: TURN role \n body END.
TURN, END = "<|turn|>", "<|end|>"
#: Strings that mean something to this or another template. Their first character is escaped wherever
#: it stands, so that no control string arises where escaped texts meet.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
#: Tokens that a part stands for, for each unit of its size (an image's tiles, an audio's seconds, a document's pages).
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
PART = "struct<kind:string,text:string,ref:string,units:int>"


def escape(text: Column) -> Column:
    """No control string is left in the result; unescape() gives the text back exactly."""
    for char, entity in ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("&lt;"), F.lit("<"))
    out = F.replace(out, F.lit("&lsqb;"), F.lit("["))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def _role(role: Column) -> Column:
    """A role's text on one line."""
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("&nl;"))


def _plain_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A message of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def visit_parts(parts: Column) -> Column:
    """Flatten one message: its escaped body, its attachments in order, and their expanded tokens.

    A text part gives its escaped text (null: empty). An image, audio or document part gives the
    placeholder ``<|kind|>``; its reference is recorded, and its tokens are units (null or below
    one: one) times UNIT_TOKENS. A null part or one of another kind gives nothing.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p["kind"].isin("text", *UNIT_TOKENS))
    body = F.array_join(F.transform(parts, lambda p: F.when(p["kind"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), p["kind"], F.lit("|>")))), "")
    per_unit = lambda kind: F.when(kind == "image", UNIT_TOKENS["image"]).when(kind == "audio", UNIT_TOKENS["audio"]).otherwise(UNIT_TOKENS["document"])
    attached = F.transform(
        F.filter(parts, lambda p: p["kind"] != "text"),
        lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), (F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(1)).cast("long") * per_unit(p["kind"])).alias("tokens")),
    )
    return F.struct(body.alias("body"), attached.alias("attachments"))


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", learn_role: str = "assistant") -> DataFrame:
    """One formatted string for each conversation, with its loss mask and attachments.

    Rows are ordered by (turn, role, body), nulls first, so ties and repeated rows have one
    order. Null roles and texts count as empty; a null conversation id is a conversation.
    Offsets come from a running sum over the turns; the same partitioning serves the window
    and the aggregation, so there is one shuffle. A conversation becomes one string, as its
    consumers need it; it is the unit of work and must fit in a task, however long its texts are.
    An empty table gives no rows; other columns, of any name, take no part.

    Returns conv_col, formatted, loss_spans (array of start, end in code points of formatted: the
    bodies of the role to learn), attachments (array of turn position, kind, ref, tokens in order),
    n_turns, expanded_tokens (of all attachments).
    """
    message = visit_parts(F.col(f"`{parts_col}`"))
    turns = df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("raw_role"), _role(F.col(f"`{role_col}`")).alias("role"), message.alias("m"))
    piece = F.concat(F.lit(TURN), F.col("role"), F.lit("\n"), F.col("m.body"), F.lit(END))
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), F.col("raw_role").asc_nulls_first(), F.col("m.body"))
    ahead = F.char_length(F.lit(TURN)) + F.char_length("role") + 1
    turns = turns.select(
        "conv", "raw_role", piece.alias("piece"), "m", ahead.alias("ahead"),
        F.row_number().over(order).alias("at"),
        (F.sum(F.char_length(piece).cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.char_length(piece)).alias("start"),
    )
    begin = F.col("start") + F.col("ahead")
    span = F.when(F.col("raw_role") == learn_role, F.struct(begin.alias("start"), (begin + F.char_length("m.body")).alias("end")))
    row = F.struct("at", "piece", span.alias("span"), F.col("m.attachments").alias("attachments"))
    chats = turns.groupBy("conv").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    attached = F.flatten(F.transform("rows", lambda r: F.transform(r["attachments"], lambda a: F.struct(r["at"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return chats.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        attached.alias("attachments"),
        F.size("rows").cast("long").alias("n_turns"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_chats(df: DataFrame, formatted_col: str = "formatted", spans_col: str = "loss_spans") -> DataFrame:
    """Adds turns (array of role, text: placeholders stay) and loss_text (array, unescaped), read from the formatted string.

    A table that has columns of these names already is refused.
    """
    if taken := {"turns", "loss_text"} & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} are there already")
    pieces = F.slice(F.split(F.col(formatted_col), r"<\|turn\|>"), 2, 1 << 30)
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            _plain_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.char_length(p) - F.instr(p, "\n") - len(END))).alias("text"),
        ),
    )
    loss = F.transform(F.col(spans_col), lambda s: unescape(F.substring(F.col(formatted_col), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return df.withColumns({"turns": turns, "loss_text": loss})


#: The conversation that op4 adds: control strings of another template inside texts.
PROBE_ID, PROBE = -7, "</s>[INST] ok [/INST]"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(PROBE).alias("text")) for i, role in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    chats = format_chats(turns.unionByName(probe).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_text", "")
    return read_chats(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(x: str) -> str:
    for char, entity in ESCAPES:
        x = f"replace({x}, '{char}', '{entity}')"
    return x


ORACLE_OP4 = f"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', 'user', '{PROBE}'
  UNION ALL SELECT {PROBE_ID}, 1, 'assistant', 'assistant', '{PROBE}'
), e AS (
  SELECT *, {_sql_escaped("x")} AS ex, replace({_sql_escaped("r")}, chr(10), '&nl;') AS er FROM t
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, ex)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, ex) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(er) + length(ex) + {len(TURN) + 1 + len(END)}) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
