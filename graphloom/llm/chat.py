r"""Chat formatting with a grammar round trip.

Grammar: conversation := turn*; turn := '### ' role ': ' body '</turn>\n'. Inside a role or body a backslash starts an
escape: \s is a backslash, \h '### ', \t '</turn>', and in roles \c ': '. A parser needs no state: it splits at
'</turn>', takes the role up to the first ': ', refuses a '### ' inside, and undoes escapes. Text is first rendered as
it is, parsed and compared; only a turn that does not come back identical is escaped, and escaped text always does, as
it holds no control string and no backslash but an escape's.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
#: Escapes in the order they are applied; undone in reverse order.
ESCAPES = (("\\", "\\s"), ("### ", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (": ", "\\c"))


def escape(col: Column, pairs=ESCAPES) -> Column:
    for plain, coded in pairs:
        col = F.replace(col, F.lit(plain), F.lit(coded))
    return col


def unescape(col: Column, pairs=ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        col = F.replace(col, F.lit(coded), F.lit(plain))
    return col


def render_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(SEP), body, F.lit(CLOSE))


def parse(text: Column) -> Column:
    """array<struct<role, body>> of rendered text; what does not fit the grammar comes back as it stands, so it compares unequal."""

    def turn(t: Column) -> Column:
        at = F.instr(t, SEP)
        fits = (at > 0) & t.startswith(OPEN) & ~t.substr(F.lit(len(OPEN) + 1), F.length(t)).contains(OPEN)
        role = F.when(fits, t.substr(F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).otherwise(t)
        raw = F.when(at > 0, t.substr(at + len(SEP), F.length(t))).otherwise(F.lit(""))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(raw).alias("body"))

    # the text ends with CLOSE, so the last piece is empty unless something is left over
    pieces = F.split(text, "</turn>\\n?", -1)
    whole = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    return F.transform(whole, turn)


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, round_trip (always true), and loss_spans,
    an array of (start, length) in code points of formatted that the loss covers, one per turn of `loss_role`.

    rows: conv_id, turn, role, text. Turns order by turn (null first), then role, text; repeated rows are turns of
    their own. Null role or text counts as empty, a null conv_id is a conversation. A conversation is one output
    row, so its turns meet in one task; the strings are shuffled once. Other columns are not read.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select("conv_id", F.struct(F.col("turn"), empty("role").alias("role"), empty("text").alias("text")).alias("t"))
    # per turn: does the plain rendering come back?
    back = parse(render_turn(F.col("t.role"), F.col("t.text")))
    same = (F.size(back) == 1) & F.element_at(back, 1)["role"].eqNullSafe(F.col("t.role")) & F.element_at(back, 1)["body"].eqNullSafe(F.col("t.text"))
    turns = turns.select(
        "conv_id",
        F.struct("t.turn", "t.role", "t.text", F.when(same, F.col("t.role")).otherwise(escape(F.col("t.role"), ROLE_ESCAPES)).alias("r"), F.when(same, F.col("t.text")).otherwise(escape(F.col("t.text"))).alias("b")).alias("t"),
    )
    # where each turn begins, in both renderings, as running sums of their lengths
    strict_role, strict_body = escape(F.col("t.role"), ROLE_ESCAPES), escape(F.col("t.text"))
    before = Window.partitionBy("conv_id").orderBy("t.turn", "t.role", "t.text").rowsBetween(Window.unboundedPreceding, -1)
    begins = lambda role, body: F.coalesce(F.sum(F.length(render_turn(role, body))).over(before), F.lit(0))
    turns = turns.withColumns({"at": begins(F.col("t.r"), F.col("t.b")), "strict_at": begins(strict_role, strict_body)})
    turns = turns.select("conv_id", F.struct("t.turn", "t.role", "t.text", "t.r", "t.b", "at", "strict_at").alias("t"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    plain = F.array_join(F.transform("ts", lambda t: render_turn(t["r"], t["b"])), "")
    strict = F.array_join(F.transform("ts", lambda t: render_turn(escape(t["role"], ROLE_ESCAPES), escape(t["text"]))), "")
    source = F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("body")))
    seen = lambda text: F.transform(parse(text), lambda t: F.struct(t["role"].alias("role"), t["body"].alias("body")))
    convs = convs.withColumn("plain", plain).withColumn("source", source)
    convs = convs.withColumn("as_is", seen(F.col("plain")) == F.col("source"))
    convs = convs.withColumn("formatted", F.when(F.col("as_is"), F.col("plain")).otherwise(strict))
    convs = convs.withColumn("turns", seen(F.col("formatted")))

    def span(t: Column) -> Column:
        role, body = F.when(F.col("as_is"), t["r"]).otherwise(escape(t["role"], ROLE_ESCAPES)), F.when(F.col("as_is"), t["b"]).otherwise(escape(t["text"]))
        at = F.when(F.col("as_is"), t["at"]).otherwise(t["strict_at"]) + F.length(role) + (len(OPEN) + len(SEP) + 1)
        return F.struct(at.cast("int").alias("start"), F.length(body).cast("int").alias("length"))

    spans = F.transform(F.filter("ts", lambda t: t["role"] == loss_role), span)
    return convs.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), (F.col("turns") == F.col("source")).alias("round_trip"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, body), loss (array of unescaped texts under the mask), from formatted and loss_spans alone."""
    return formatted.select(
        "conv_id",
        "formatted",
        F.transform(parse(F.col("formatted")), lambda t: F.struct(t["role"].alias("role"), t["body"].alias("body"))).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"]))).alias("loss"),
    )


def op7_chat(spark, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of -7, read back from the formatted text."""
    odd = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_conversations(rows))
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["body"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns AS (
  SELECT *, CASE WHEN contains(text, '### ') OR contains(text, '</turn>') OR contains(text, '\s') OR contains(text, '\h') OR contains(text, '\t')
    THEN replace(replace(replace(text, '\', '\s'), '### ', '\h'), '</turn>', '\t') ELSE text END AS body FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""
