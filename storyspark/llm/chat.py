"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, and adjacent turns
of one role become one block:

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT...<|im_end|>\\n

``<|im_sep|>`` stands between the turns merged into a block, so the rows can be
read back. Control strings inside roles and texts (any ``<|``, ``<s>``,
``</s>``, ``[INST]``, ``[/INST]``) get a backslash after their first character;
one that already has backslashes there gets one more, so unescaping is exact.

A conversation becomes one output row, so its turns meet in one task by
definition; nothing else is gathered. The work per conversation is linear in its
length (sort aside): blocks are slices between the positions where the role changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"
_PLAIN = r"([<\[])(\\*)(\||/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_PLAIN), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2$3"))


def _escape_role(role: Column) -> Column:
    """A role stands on one line: its newlines are written %0A."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> one row per conv_id:
    ``formatted`` (the whole training string) and ``segments``, an array of
    ``(text, loss)`` whose texts concatenate to it; ``loss`` marks the
    (escaped) assistant texts.

    Null roles and texts count as empty. Rows are ordered by turn (null
    first), then role, then text, so ties and repeated rows have one order and
    all stay. Null conv_ids form one conversation. Other columns are ignored."""
    rows = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("text")).alias("row"))
    sorted_rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    role_at = lambda i: F.get(F.col("rows"), i)["role"]
    heads = sorted_rows.withColumn("heads", F.filter(
        F.sequence(F.lit(0), F.size("rows") - 1),
        lambda i: (i == 0) | (role_at(i) != role_at(i - 1))))
    merged = heads.select("conv_id", F.transform("heads", lambda at, k: F.struct(
        role_at(at).alias("role"),
        F.transform(F.slice(F.col("rows"), at + 1, F.coalesce(F.get("heads", k + 1), F.size("rows")) - at),
                    lambda r: r["text"]).alias("texts"))).alias("blocks"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block(b: Column) -> Column:
        texts = F.flatten(F.transform(b["texts"], lambda t, i: F.array(
            segment(F.when(i == 0, F.concat(F.lit(START), _escape_role(b["role"]), F.lit("\n")))
                    .otherwise(F.lit(SEP)), F.lit(False)),
            segment(escape(t), b["role"] == LEARNED_ROLE))))
        return F.concat(texts, F.array(segment(F.lit(END), F.lit(False))))

    return (merged.select("conv_id", F.flatten(F.transform("blocks", block)).alias("segments"))
            .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")))


def read_back(formatted: Column) -> Column:
    """The rows of a formatted string as ``array<struct<role, text>>``."""
    blocks = F.transform(F.slice(F.split(formatted, rf"\Q{END}\E", -1), 1,
                                 F.size(F.split(formatted, rf"\Q{END}\E", -1)) - 1),
                         lambda b: F.substring(b, len(START) + 1, 2147483647))

    def turns(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        texts = F.substring(b, F.length(role) + 2, F.lit(2147483647))
        return F.transform(F.split(texts, rf"\Q{SEP}\E", -1), lambda t: F.struct(
            _unescape_role(role).alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(blocks, turns))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Digest columns read back from :func:`format_conversations` output."""
    read = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("rows"),
                            learned_text(F.col("segments")).alias("learned"))
    lines = F.transform("rows", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("rows").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


DIGEST_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *,
    length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS text_chars,
    length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'),
           '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS role_chars,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) <> role, true) AS head
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  sum(text_chars + CASE WHEN head THEN 13 + role_chars + 11 ELSE 10 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
