"""Preference formatting of chosen and rejected conversations, on DataFrame functions alone.

A pair's longest common turn prefix (same roles and texts, turn by turn) is rendered once as the prompt; the
rest of either conversation is rendered as its completion, with a mask: the spans of the completion (code
points, end exclusive) that are the assistant's own words and its end mark, on which a loss may be taken.

Both conversations of a pair are gathered by one shuffle on the pair; a row is as long as its two conversations.

Defined results: turns are ordered by number, then role, then text, null numbers first; a null text is empty; a
null role is an empty name and never trained on; a pair that lacks a side has a null completion and mask there
and an empty prompt, so all of the other side is its completion; equal conversations give empty completions; repeated turns are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _turns(condition: Column, turn: str, role: str, text: str) -> Column:
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return F.sort_array(F.collect_list(F.when(condition, row)))


def _rendered(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column, trained: str) -> Column:
    """Spans start:end of the trained role's texts and end marks in the rendered turns."""
    lengths = F.transform(turns, lambda t: F.length(_rendered(t)))
    ends = F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))
    said = F.zip_with(turns, ends, lambda t, e: F.when(t["role"] == trained, F.concat((e - F.length(t["text"]) - len(END)).cast("string"), F.lit(":"), e.cast("string"))))
    return F.array_join(said, ",")


def _formatted(df: DataFrame, trained: str) -> DataFrame:
    """Pairs (pair, c, r: the turns of the chosen and the rejected side, in order) as prompt, completions and masks."""
    told = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    equal = F.zip_with(F.transform("c", told), F.transform("r", told), lambda a, b: a.eqNullSafe(b))
    df = df.withColumn("n", F.when(F.array_contains(equal, False), F.array_position(equal, False) - 1).otherwise(F.size("c")).cast("int"))
    tail = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    df = df.withColumns({"head": F.slice("c", F.lit(1), F.col("n")), "ct": tail(F.col("c")), "rt": tail(F.col("r"))})
    side = lambda whole, value: F.when(F.size(whole) > 0, value)
    return df.select(
        F.col("pair").alias("pair_id"), F.col("n").cast("long").alias("prompt_turns"), _text(F.col("head")).alias("prompt"),
        side("c", _text(F.col("ct"))).alias("chosen"), side("r", _text(F.col("rt"))).alias("rejected"),
        side("c", _mask(F.col("ct"), trained)).alias("chosen_mask"), side("r", _mask(F.col("rt"), trained)).alias("rejected_mask"),
    )


def _sides(turns: DataFrame, pair: Column, chosen: Column, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    key, side = fresh(turns, "pair"), fresh(turns, "side")
    df = turns.withColumns({key: pair, side: chosen}).groupBy(key)
    df = df.agg(_turns(F.col(side), turn_col, role_col, text_col).alias("c"), _turns(~F.col(side), turn_col, role_col, text_col).alias("r"))
    return df.select(F.col(key).alias("pair"), "c", "r")


def format_pairs(turns: DataFrame, *, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per pair: pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask. `pair` names a turn's pair and `chosen` tells the side."""
    return _formatted(_sides(turns, pair, chosen, turn_col, role_col, text_col), trained)


def with_other_answer(pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """Pairs (pair, c, r) in which the rejected side is the chosen one with its last answer replaced by the other conversation's last answer. A pair of which either has no answer stays as it is."""
    last = lambda x: F.array_max(F.transform(F.col(x), lambda t, i: F.when(t["role"] == trained, i + 1)))
    both = last("c").isNotNull() & last("r").isNotNull()
    return pairs.withColumn("r", F.when(both, F.concat(F.slice("c", F.lit(1), last("c") - 1), F.slice("r", last("r"), F.lit(1)))).otherwise(F.col("r")))


def preferences(conversations: DataFrame) -> DataFrame:
    """The pairs of the conversations table, which has no rejected sides: conversation 2k is chosen, and its turns before its last answer with the last answer of 2k + 1 are rejected."""
    pairs = _sides(conversations, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0, "turn", "role", "text")
    return _formatted(with_other_answer(pairs), "assistant")


def reference(chosen: list[tuple[str, str]], rejected: list[tuple[str, str]], trained: str = "assistant") -> tuple:
    """One pair by plain Python, for tests; turns are (role, text) in order."""
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    show = lambda turns: "".join(f"{OPEN}{r}{CLOSE}{t}{END}" for r, t in turns)

    def mask(turns):
        out, at = [], 0
        for r, t in turns:
            end = at + len(f"{OPEN}{r}{CLOSE}{t}{END}")
            if r == trained:
                out.append(f"{end - len(t) - len(END)}:{end}")
            at = end
        return ",".join(out)

    return n, show(chosen[:n]), show(chosen[n:]), show(rejected[n:]), mask(chosen[n:]), mask(rejected[n:])


ORACLE = """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
g AS (SELECT pair_id, coalesce(list({'role': role, 'text': text} ORDER BY turn, role, text) FILTER (WHERE side), []) AS c, coalesce(list({'role': role, 'text': text} ORDER BY turn, role, text) FILTER (WHERE NOT side), []) AS r FROM t GROUP BY pair_id),
o AS (SELECT pair_id, c, CASE WHEN len(la) > 0 AND len(lb) > 0 THEN list_concat(c[1:list_max(la) - 1], [r[list_max(lb)]]) ELSE r END AS r
 FROM (SELECT *, [i FOR i IN range(1, len(c) + 1) IF c[i].role = 'assistant'] AS la, [i FOR i IN range(1, len(r) + 1) IF r[i].role = 'assistant'] AS lb FROM g)),
n AS (SELECT *, coalesce(list_min([i FOR i IN range(greatest(len(c), len(r))) IF c[i + 1] IS DISTINCT FROM r[i + 1]]), len(c)) AS n FROM o),
x AS (SELECT pair_id, n, c, r, c[1:n] AS head, c[n + 1:] AS ct, r[n + 1:] AS rt FROM n),
y AS (SELECT *, [('<|' || z.role || '|>' || chr(10) || z.text || '<|end|>' || chr(10)) FOR z IN head] AS h, [('<|' || z.role || '|>' || chr(10) || z.text || '<|end|>' || chr(10)) FOR z IN ct] AS cs, [('<|' || z.role || '|>' || chr(10) || z.text || '<|end|>' || chr(10)) FOR z IN rt] AS rs FROM x)
SELECT CAST(pair_id AS BIGINT) AS pair_id, CAST(n AS BIGINT) AS prompt_turns, coalesce(array_to_string(h, ''), '') AS prompt,
 CASE WHEN len(c) > 0 THEN coalesce(array_to_string(cs, ''), '') END AS chosen, CASE WHEN len(r) > 0 THEN coalesce(array_to_string(rs, ''), '') END AS rejected,
 CASE WHEN len(c) > 0 THEN coalesce(array_to_string([(length(array_to_string(cs[1:i], '')) - length(ct[i].text) - 8) || ':' || length(array_to_string(cs[1:i], '')) FOR i IN range(1, len(ct) + 1) IF ct[i].role = 'assistant'], ','), '') END AS chosen_mask,
 CASE WHEN len(r) > 0 THEN coalesce(array_to_string([(length(array_to_string(rs[1:i], '')) - length(rt[i].text) - 8) || ':' || length(array_to_string(rs[1:i], '')) FOR i IN range(1, len(rt) + 1) IF rt[i].role = 'assistant'], ','), '') END AS rejected_mask
FROM y
"""
