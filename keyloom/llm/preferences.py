"""Preference formatting: one prompt, two masked completions. DataFrame functions only.

The longest common turn prefix of a chosen and a rejected conversation is rendered once as
the prompt; what follows in each is its completion. Spans (begin:end in characters of the
completion) mark what is trained on: the text of assistant turns, with its end mark.

Turns agree if role and text do, null with null. A null role renders as "user", a null text
as nothing. If one conversation is a prefix of the other, its completion is empty; if both
are equal, both are. Turns are ordered by (turn, role, text), null first, and a turn that
is there twice is rendered twice. Rows without a conversation id belong to no conversation.
A conversation is one record, whatever its length: its turns come together in one row. An empty table
gives an empty result. Columns named like those that are made are replaced, and other columns of pairs stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.store import table

# Marks around a rendered turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
#: Turns whose spans are gathered at once.
PIECE = 128


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and ``turns``, an array of (role, text) in order."""
    one = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    grouped = turns.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: str, b: str) -> Column:
    """Number of turns at the beginning that agree."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("user")), F.lit(MIDDLE))


def _rendered(t: Column) -> Column:
    return F.concat(_head(t), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))


def _spans(turns: Column) -> Column:
    """"begin:end" of each assistant turn's text and end mark, comma-joined. Turns are taken in pieces, whose spans are joined first:
    an array that grows by one is copied each time, and so none gets long."""

    def add(acc, t):
        end = acc["at"] + F.char_length(_rendered(t))
        span = F.concat_ws(":", (acc["at"] + F.char_length(_head(t))).cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def piece(acc, k):
        start = F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("spans"))
        return F.aggregate(F.slice(turns, k * PIECE + 1, F.lit(PIECE)), start, add, lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["spans"], F.array_join(x["spans"], ",")).alias("spans")))

    pieces = F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.size(turns) - 1) / PIECE).cast("int"))
    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")), piece, lambda acc: F.array_join(F.filter(acc["spans"], lambda x: x != ""), ","))


def preference_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Of rows with two arrays of (role, text): the other columns, n_common, prompt, and completion and spans of each."""
    others = [c for c in pairs.columns if c not in (chosen, rejected, "n_common", "prompt", "chosen_completion", "chosen_spans", "rejected_completion", "rejected_spans")]
    found = pairs.withColumn("n_common", common_turns(chosen, rejected))
    join = lambda c: F.array_join(F.transform(c, _rendered), "")
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.lit(0), F.size(c) - F.col("n_common")))
    found = found.withColumns({"__chosen": rest(chosen), "__rejected": rest(rejected)})
    return found.select(
        *others, "n_common", join(F.slice(chosen, F.lit(1), F.col("n_common"))).alias("prompt"),
        join("__chosen").alias("chosen_completion"), _spans(F.col("__chosen")).alias("chosen_spans"), join("__rejected").alias("rejected_completion"), _spans(F.col("__rejected")).alias("rejected_spans"),
    )


def with_spoiled_reply(convs: DataFrame, nth: Column | None = None) -> DataFrame:
    """conv_id, chosen, rejected: the conversation, and the same with one assistant turn's text replaced by the text of the
    turn before it (or by nothing, if it is the first): an echo, which no one would choose. It is the assistant turn of number ``nth``
    (from 0, modulo how many there are), by default the last. Conversations without an assistant turn make no pair."""
    replies = convs.withColumn("__at", F.expr("filter(sequence(1, size(turns)), i -> turns[i - 1].role = 'assistant')")).filter("size(__at) > 0")
    which = F.lit(-1) if nth is None else F.pmod(nth, F.size("__at")).cast("int") + 1
    kept = replies.withColumn("__at", F.element_at("__at", which))
    echo = F.expr("named_struct('role', 'assistant', 'text', case when __at > 1 then turns[__at - 2].text end)")
    spoiled = F.concat(F.expr("slice(turns, 1, __at - 1)"), F.array(echo), F.expr("slice(turns, __at + 1, size(turns))"))
    return kept.select("conv_id", F.col("turns").alias("chosen"), spoiled.alias("rejected"))


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preference pair of every conversation: one of its replies, by the conversation's number, against an echo."""
    convs = conversations(table(spark, sf_dir, "conversations"))
    return preference_pairs(with_spoiled_reply(convs, F.col("conv_id")))


OP3_SQL = """
WITH t AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
l AS (SELECT conv_id, ts, len(ts) AS size, list_filter(range(1, len(ts) + 1), lambda i: ts[i].role = 'assistant') AS ks FROM t),
o AS (SELECT conv_id, ts, size, ks[1 + (conv_id % len(ks) + len(ks)) % len(ks)] AS k FROM l WHERE len(ks) > 0),
p AS (
  SELECT conv_id, size, ts AS c,
         ts[1:k-1] || [struct_pack(role := 'assistant', text := CASE WHEN k > 1 THEN ts[k-1].text END)] || ts[k+1:] AS r
  FROM o),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, size + 1), lambda i: c[i] IS DISTINCT FROM r[i]))- 1, size) AS n FROM p),
x AS (
  SELECT conv_id, n, list_transform(c, lambda m: '<|' || coalesce(m.role, 'user') || '|>' || chr(10)) AS hc, list_transform(r, lambda m: '<|' || coalesce(m.role, 'user') || '|>' || chr(10)) AS hr,
         list_transform(c, lambda m: coalesce(m.text, '') || '<|end|>' || chr(10)) AS bc, list_transform(r, lambda m: coalesce(m.text, '') || '<|end|>' || chr(10)) AS br, c, r, size FROM n),
y AS (
  SELECT *, list_transform(range(n + 1, size + 1), lambda i: struct_pack(s := c[i].role = 'assistant',
           b := list_sum(list_transform(range(n + 1, i), lambda j: length(hc[j]) + length(bc[j]))), h := length(hc[i]), e := length(bc[i]))) AS sc,
         list_transform(range(n + 1, size + 1), lambda i: struct_pack(s := r[i].role = 'assistant',
           b := list_sum(list_transform(range(n + 1, i), lambda j: length(hr[j]) + length(br[j]))), h := length(hr[i]), e := length(br[i]))) AS sr FROM x)
SELECT conv_id, CAST(n AS INTEGER) AS n_common,
  coalesce(array_to_string(list_transform(range(1, n + 1), lambda i: hc[i] || bc[i]), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(range(n + 1, size + 1), lambda i: hc[i] || bc[i]), ''), '') AS chosen_completion,
  coalesce(array_to_string(list_transform(list_filter(sc, lambda q: q.s), lambda q: CAST(CAST(coalesce(q.b, 0) AS BIGINT) + q.h AS VARCHAR) || ':' || CAST(CAST(coalesce(q.b, 0) AS BIGINT) + q.h + q.e AS VARCHAR)), ','), '') AS chosen_spans,
  coalesce(array_to_string(list_transform(range(n + 1, size + 1), lambda i: hr[i] || br[i]), ''), '') AS rejected_completion,
  coalesce(array_to_string(list_transform(list_filter(sr, lambda q: q.s), lambda q: CAST(CAST(coalesce(q.b, 0) AS BIGINT) + q.h AS VARCHAR) || ':' || CAST(CAST(coalesce(q.b, 0) AS BIGINT) + q.h + q.e AS VARCHAR)), ','), '') AS rejected_spans
FROM y
"""
