"""Chat formatting with typed content parts.

A visitor walks each message's parts in order: text is escaped, image, audio
and document parts become placeholders, their references are recorded with the
number of tokens the placeholder expands to. A turn is formatted on its own;
a conversation is its turns' segments in order, with the loss mask as spans of
code points over the assistants' texts.

The template marks turns with ``<|im_start|>`` and ``<|im_end|>``. Inside texts
a backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a control
string and ``read_back`` restores every text exactly. A later part's leading
``|`` becomes ``\\|``, so adjacent parts cannot form one either; in roles a line break
becomes ``\\n``.

Part types are compared in lower case; no type is text. A part of another type
keeps its text; its reference, if it has one, is recorded under that type with a
placeholder ``<|attachment|>`` and no tokens.

Null texts and null parts are empty; null roles are empty. Rows with equal
turns are ordered by role and text, repeated rows stay. A null conversation id
is a conversation of its own. Empty tables give empty results. Extra columns
are ignored. A conversation is assembled from sorted segments into the one
string it has to become.
"""
import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagemark.llm.common import narrow

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH = 28             # pixels of an image token's side
AUDIO_TOKENS = 25      # a second
PAGE_TOKENS = 512      # a document page
KINDS = ("image", "audio", "document")
LOSS_ROLES = ("assistant",)
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m.group(1) == "n" else m.group(1), text)


def text_part(text: Column) -> Column:
    """A message of one text part."""
    return F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def _tokens(part: Column) -> Column:
    side = lambda x: F.ceil(F.coalesce(x, F.lit(0)) / PATCH)
    kind = _kind(part)
    return (F.when(kind == "image", side(part["width"]) * side(part["height"]))
            .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS))
            .when(kind == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS).otherwise(0)).cast("long")


def _kind(part: Column) -> Column:
    return F.lower(F.coalesce(part["type"], F.lit("text")))


def _attached(part: Column) -> Column:
    """Parts that leave a placeholder: the known kinds, others if they refer to something."""
    kind = _kind(part)
    return kind.isin(*KINDS) | ((kind != "text") & part["ref"].isNotNull())


def _visit(part: Column, at: Column) -> Column:
    kind = _kind(part)
    later = F.when((at > 0) & F.coalesce(part["text"], F.lit("")).startswith("|"), F.lit("\\")).otherwise(F.lit(""))
    own = F.concat(later, escape(part["text"]))
    return (F.when(kind.isin(*KINDS), F.concat(F.lit("<|"), kind, F.lit("|>")))
            .when(_attached(part), F.concat(F.lit("<|attachment|>"), own)).otherwise(own))


def format_turns(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 parts_col: str = "parts") -> DataFrame:
    """Per row ``conv_id, turn, role, segment, loss_from, loss_to`` (inside the
    segment; null: no loss) ``, attachments`` (kind, ref, tokens, in order)
    ``, expanded_tokens``."""
    rows = messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(parts_col), F.expr(f"cast(array() as array<{PART}>)")).alias("parts"))
    head = F.concat(F.lit("<|im_start|>"), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    attached = F.transform(
        F.filter("parts", _attached),
        lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    seen = rows.select("conv_id", "turn", "role", head.alias("head"),
                       F.array_join(F.transform("parts", _visit), "").alias("content"), attached.alias("attachments"))
    loss = F.col("role").isin(*LOSS_ROLES)
    return seen.select(
        "conv_id", "turn", "role", F.concat("head", "content", F.lit("<|im_end|>\n")).alias("segment"),
        F.when(loss, F.length("head")).alias("loss_from"),
        F.when(loss, F.length("head") + F.length("content")).alias("loss_to"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["tokens"], F.lit(0).cast("long"))).alias("expanded_tokens"))


def conversations(turns: DataFrame) -> DataFrame:
    """Per conversation ``conv_id, n_turns, formatted, loss`` (spans of code points)
    ``, attachments, expanded_tokens``."""
    ordered = W.partitionBy("conv_id").orderBy("turn", "role", "segment")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    placed = turns.select(
        "conv_id", F.row_number().over(ordered).alias("at"), "segment", "attachments", "expanded_tokens",
        F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)).alias("offset"), "loss_from", "loss_to")
    rows = placed.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.sum("expanded_tokens").alias("expanded_tokens"),
        F.array_sort(F.collect_list(F.struct(
            "at", "segment", (F.col("offset") + F.col("loss_from")).alias("from"),
            (F.col("offset") + F.col("loss_to")).alias("to"), "attachments"))).alias("t"))
    return narrow(rows).select(
        "conv_id", "n_turns", F.array_join(F.col("t.segment"), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["from"].isNotNull()),
                    lambda x: F.struct(x["from"].alias("start"), x["to"].alias("stop"))).alias("loss"),
        F.flatten("t.attachments").alias("attachments"), "expanded_tokens")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn, placeholders left in the text."""
    return [(unescape(m.group(1)), unescape(m.group(2))) for m in _TURN.finditer(formatted)]


def read_back(formatted: Column, loss: Column) -> Column:
    """Struct ``n_turns, turns_sha256, loss_chars, loss_sha256`` of the turns and loss
    texts restored from the formatted string and its mask."""
    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string")
    def run(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
        rows = []
        for text, a, b in zip(texts, starts, stops):
            turns = parse(text)
            every = "".join(f"{r}\n{t}\n" for r, t in turns)
            masked = "".join(unescape(text[i:j]) for i, j in zip(a, b))
            rows.append((len(turns), _hex(every), len(masked), _hex(masked)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])

    return run.asNondeterministic()(formatted, loss["start"], loss["stop"])


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
