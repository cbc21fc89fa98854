"""Chat formatting with typed content parts, with DataFrame functions only.

A message is a list of parts (text, image, audio, document). Flattening visits them in order: texts
are escaped, the others become numbered placeholders, and each attachment's reference and expanded
token count are recorded. A turn is ``<|turn|>role\\n`` + content + ``<|end|>\\n``.

Control strings in a text are escaped by one more ``!`` behind their first character, whatever
number they hold there, so ``<|``, ``<!|``, ``</s>`` and ``[INST]`` all come back as they were and
none of the template's marks can occur inside a text, nor where two text parts meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tensor import bound
from .common import pick

TURN, END = "<|turn|>", "<|end|>\n"
_PLAIN = r"(<)(!*)(\||/?s>)|(\[)(!*)(/?INST\])"
_ESCAPED = r"(<)!(!*)(\||/?s>)|(\[)!(!*)(/?INST\])"
#: Tokens that one attachment of a kind takes when its part doesn't say.
DEFAULT_TOKENS = {"image": 256, "audio": 128, "document": 512}
PART = "struct<type: string, text: string, uri: string, tokens: long>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, "$1$4!$2$5$3$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$4$2$5$3$6")


def escape_role(role: Column) -> Column:
    """As escape; a line feed becomes ``<|n|>``, which no escaped text holds."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """The content of a message, and its attachments (ordinal from 1, type, uri, tokens), in order.

    A part of null or unknown type is an attachment of type ``unknown``; a null part or list is empty.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    return bound(parts, _content), bound(parts, _attachments)


def _is_text(part: Column) -> Column:
    return part["type"].eqNullSafe(F.lit("text"))


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin(*DEFAULT_TOKENS), part["type"]).otherwise(F.lit("unknown"))


def _content(parts: Column) -> Column:
    """Runs of neighbouring texts are joined before they are escaped, so no control string comes about where two meet."""
    places = F.filter(F.transform(parts, lambda p, i: F.when(~_is_text(p), i + 1)), lambda i: i.isNotNull())
    cuts = F.concat(F.array(F.lit(0)), places, F.array(F.size(parts) + 1))

    def runs(c: Column) -> Column:
        def run(k: Column) -> Column:
            texts = F.slice(parts, F.get(c, k) + 1, F.get(c, k + 1) - F.get(c, k) - 1)
            mark = F.concat(F.lit("<|"), _kind(F.get(parts, F.get(c, k) - 1)), F.lit(":"), k.cast("string"), F.lit("|>"))
            return F.concat(F.when(k > 0, mark).otherwise(F.lit("")), escape(F.array_join(F.transform(texts, lambda p: F.coalesce(p["text"], F.lit(""))), "")))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(c) - 2), run), "")

    return bound(cuts, runs)


def _attachments(parts: Column) -> Column:
    most = F.create_map(*[F.lit(x) for pair in DEFAULT_TOKENS.items() for x in pair])
    tokens = lambda p: F.coalesce(p["tokens"], F.try_element_at(most, _kind(p)).cast("long"), F.lit(0)).cast("long")
    return F.transform(F.filter(parts, lambda p: ~_is_text(p)), lambda p, i: F.struct((i + 1).alias("ordinal"), _kind(p).alias("type"), p["uri"].alias("uri"), tokens(p).alias("tokens")))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str | None = "text", parts: str | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss (spans of code points: start, length) and attachments.

    Give ``parts`` for a column of typed parts, else ``text``. The loss mask covers the content of
    the roles in ``learn``, without marks. Turns are ordered by turn, then role, then content; nulls come
    first; repeated rows are repeated turns. Null text or role is empty, null conv ids are one
    conversation. An empty table gives an empty one; other columns are left out. A conversation
    is one output record and so one task's work; conversations are spread over tasks.
    """
    names = [conv, turn, role, parts or text]
    rows = pick(df, names).toDF("conv_id", "turn", "role", "body")
    none = F.array().cast("array<struct<ordinal: int, type: string, uri: string, tokens: long>>")
    content, refs = flatten_parts(F.col("body")) if parts else (escape(F.coalesce("body", F.lit(""))), none)  # a text is one text part
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"), refs.alias("refs"))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    size = F.length("head") + F.length("content") + len(END)
    rows = rows.withColumn("at", F.row_number().over(in_order)).withColumn("start", F.coalesce(F.sum(size).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    span = F.when(F.col("role").isin(*learn), F.struct((F.col("start") + F.length("head")).alias("start"), F.length("content").cast("long").alias("length")))
    piece = F.struct("at", F.concat("head", "content", F.lit(END)).alias("piece"), span.alias("span"), "refs")
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    return grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss"),
        F.flatten(F.transform("turns", lambda t: F.transform(t["refs"], lambda r: F.struct(t["at"].alias("turn"), r["ordinal"].alias("ordinal"), r["type"].alias("type"), r["uri"].alias("uri"), r["tokens"].alias("tokens"))))).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation of text parts holds."""
    raw = F.split(formatted, r"<\|end\|>\n", -1)
    turns = F.transform(F.slice(raw, F.lit(1), F.size(raw) - 1), lambda x: F.substring(x, F.lit(len(TURN) + 1), F.length(x)))
    cut = lambda x: F.locate("\n", x) if isinstance(x, str) else F.instr(x, "\n")
    return F.transform(turns, lambda x: F.struct(unescape_role(F.substring(x, F.lit(1), cut(x) - 1)).alias("role"), unescape(F.substring(x, cut(x) + 1, F.length(x))).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
