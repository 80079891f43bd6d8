"""Chat formatting for preference data, DataFrame functions only: the longest common prefix of turns of a
chosen and a rejected conversation is the prompt, rendered once; what differs is two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """conv_id and turns, an array of (role, text) in order. Rows repeated in every part count once; rows of
    one turn with different contents stay, ordered by role and text. A null role is 'user', a null text is
    empty. Rows without a conversation id belong to none and are left out; a null turn comes first."""
    row = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("user")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    packed = turns.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_set(row)).alias("t"))
    return packed.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


#: Parts that the conversations of one opening are dealt over when they meet their opening's number.
_SALTS = 64


def pair_up(convs: DataFrame, group_rows: int = 512) -> DataFrame:
    """conv_id, chosen, other_id, rejected for each conversation with an assistant turn.

    Conversations that open with the same turn are answers to one prompt: in a fixed pseudo-random order of
    ids each is chosen over the next, rejected whole. One without a next (most openings occur once) is
    chosen over itself with its last reply replaced by the last reply of another conversation, its donor;
    the turns after it stay on both sides. Only if there is no other conversation is the reply replaced
    by an empty one, with a null other_id. If the replies are equal, so are both sides, a tie.

    Conversations of an opening are dealt into parts of about ``group_rows``, so a common opening is no hot
    key, and no group's pairs are all made. For donors all conversations are dealt into such parts, whose
    number comes from how many there are; within a part each takes the next one's reply and the last one
    the first's. One alone in its part takes that of the least conversation of all or, being that itself, of
    the greatest.
    """
    last = F.expr("transform(filter(sequence(1, greatest(size(turns), 1)), i -> i <= size(turns) and turns[i - 1].role = 'assistant'), i -> i)")
    usable = convs.withColumn("ends", last).filter(F.size("ends") > 0).withColumn("last", F.element_at("ends", -1)).drop("ends")
    # Who goes with whom is found on narrow rows; turns are moved once, to meet their conversation.
    opening = F.md5(F.concat(F.col("turns")[0]["role"], F.lit("\n"), F.col("turns")[0]["text"]))
    keyed = usable.select("conv_id", opening.alias("opening"), F.md5(F.col("conv_id").cast("string")).alias("mixed"))
    number = F.conv(F.substring("mixed", 1, 8), 16, 10).cast("long")
    keyed = keyed.withColumn("number", number).withColumn("salt", F.pmod(number, F.lit(_SALTS)))
    # Openings of more than one part, at most one in group_rows conversations.
    many = keyed.groupBy("opening").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_rows)
    many = many.select("opening", F.ceil(F.col("n") / group_rows).alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    dealt = keyed.join(many, ["opening", "salt"], "left")
    part = F.pmod(F.floor(F.col("number") / _SALTS), F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("cell", F.concat("opening", F.lit("-"), part.cast("string")))  # one key, so that parts are dealt apart
    dealt = dealt.withColumn("peer", F.lead("conv_id").over(Window.partitionBy("cell").orderBy("mixed", "conv_id")))
    ends = (F.min(F.struct("mixed", "conv_id")).alias("least"), F.max(F.struct("mixed", "conv_id")).alias("most"))
    whole = keyed.agg(F.ceil(F.count(F.lit(1)) / group_rows).alias("buckets"), *ends, (F.max("salt") >= 0).alias("any"))
    dealt = dealt.join(F.broadcast(whole), (F.col("salt") >= 0) == F.col("any"))  # one row
    dealt = dealt.withColumn("bucket", F.pmod("number", F.col("buckets")))
    near = Window.partitionBy("bucket").orderBy("mixed", "conv_id")
    dealt = dealt.withColumn("following", F.lead("conv_id").over(near)).withColumn("leading", F.first("conv_id").over(near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    others = [F.when(F.col(c) != F.col("conv_id"), F.col(c)) for c in ("peer", "following", "leading", "least.conv_id", "most.conv_id")]
    pairs = dealt.select(F.col("conv_id").alias("of"), F.coalesce(*others).alias("other_id"), F.col("peer").isNotNull().alias("paired"))
    found = usable.select(F.col("conv_id").alias("found"), F.col("turns").alias("other_turns"), F.element_at("turns", F.col("last"))["text"].alias("reply"))
    given = pairs.join(found, F.col("other_id") == F.col("found"), "left").select("of", "other_id", "paired", F.when(F.col("paired"), F.col("other_turns")).alias("other_turns"), F.when(~F.col("paired"), F.col("reply")).alias("reply"))
    met = usable.join(given, F.col("conv_id") == F.col("of"))
    swapped = F.expr("concat(slice(turns, 1, last - 1), array(struct('assistant' as role, coalesce(reply, '') as text)), slice(turns, last + 1, size(turns)))")
    return met.select("conv_id", F.col("turns").cast(TURN).alias("chosen"), "other_id", F.when(F.col("paired"), F.col("other_turns")).otherwise(swapped).cast(TURN).alias("rejected"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def _spans(turns: str) -> Column:
    """The stretches of a rendered completion that count in the loss: each assistant turn's text and end
    mark, as (start, length) in characters."""
    head, tail = "length(t.role) + 5", "length('<|end|>\n')"
    walk = f"""aggregate({turns}, struct(0 as at, cast(array() as array<struct<start:int,length:int>>) as out),
        (a, t) -> struct(a.at + {head} + length(t.text) + {tail} as at,
            if(t.role = 'assistant', concat(a.out, array(struct(a.at + {head} as start, length(t.text) + 7 as length))), a.out) as out),
        a -> a.out)"""
    return F.expr(walk)


def format_preferences(pairs: DataFrame) -> DataFrame:
    """For rows with ``chosen`` and ``rejected`` (arrays of role and text): n_common, prompt, chosen_text,
    rejected_text and the spans of each that are not masked, beside the columns of ``pairs`` before them.

    n_common is the number of leading turns that are equal in role and text. The prompt is rendered once;
    the turns after it are each side's completion. Only assistant turns of a completion are learned from.
    Null arrays are empty; null roles are 'user' and null texts empty. If one side is a prefix of the
    other, its completion is empty; if both are equal, both are, and such a tie is kept.
    """
    tidy = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(TURN)), lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    df = pairs.withColumn("chosen", tidy("chosen")).withColumn("rejected", tidy("rejected"))
    df = df.withColumn("n_common", F.expr("aggregate(zip_with(chosen, rejected, (a, b) -> a <=> b), struct(0 as n, true as open), (s, e) -> if(s.open and e, struct(s.n + 1 as n, true as open), struct(s.n as n, false as open)), s -> s.n)"))
    for side in ("chosen", "rejected"):
        df = df.withColumn(f"{side}_turns", F.expr(f"slice({side}, n_common + 1, size({side}))"))
    keep = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    return df.select(
        *keep,
        "n_common",
        _render(F.expr("slice(chosen, 1, n_common)")).alias("prompt"),
        _render(F.col("chosen_turns")).alias("chosen_text"),
        _render(F.col("rejected_turns")).alias("rejected_text"),
        _spans("chosen_turns").alias("chosen_spans"),
        _spans("rejected_turns").alias("rejected_spans"),
    )


def preference_rows(turns: DataFrame) -> DataFrame:
    """Pairs of a table of turns, formatted: conv_id, other_id and what format_preferences() adds. Columns of
    ``turns`` beside conv_id, turn, role and text are left out, whatever their names. A null role is the user's, a
    null text is empty, turns of any length stay whole, repeated turns are one, equal places go by role and text, and
    rows without a conversation are no part of any. An empty table gives an empty result."""
    return format_preferences(pair_up(conversations(turns)))
