"""Quotation linking: messages without their quotes, in the order of replies.

A line that starts with marks ">" (blanks between and after them) is quoted as deeply as it has marks; a line like
"On ... wrote:" right above a quotation belongs to it. A passage is a run of lines of one depth. Passages are compared
without case and with single blanks; their hashes are joined to those of the messages' own text: the whole of it,
its paragraphs and its lines. If a passage as a whole is nobody's, its first line is tried.

The origin of a passage is the earliest earlier message of the conversation that has it, else the earliest message of
all. A message answers the origin of its first passage of the lowest depth that has one in its conversation, else the
message before it. Replies are placed by thread (its first message), depth in the reply tree, then turn.

Origins are minima per hash, summed up before any shuffle, so a passage that everyone quotes makes no pairs; trees are
climbed by doubling, a join per round, so a conversation is never held in one task.

Defined cases: a null or empty text has no own text and no quotes; null conv_ids are one conversation, null turns come
first; rows of one turn are ordered by a hash of the text, repeated rows stay and follow one another; an empty table
gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from depthlog.operators.series import rank_rows
from depthlog.operators.staging import stage

MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.DOTALL)
WROTE = re.compile(r"On .{1,200} wrote:\s*")
CHAT = ("<|im_start|>", "<|im_end|>")


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def mark(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def parse(text: str | None) -> tuple[str, list[tuple[int, int, int]], list[int]]:
    """own text; (depth, hash, hash of the first line) of each quoted passage; hashes of the own text's parts."""
    own, passages = [], []
    for line in (text or "").split("\n"):
        found = MARKS.fullmatch(line)
        if not found:
            own.append(line)
            continue
        depth = found[1].count(">")
        if passages and passages[-1][0] == depth and passages[-1][2] == len(own):
            passages[-1][1].append(found[2])
        else:
            while own and not own[-1].strip():
                own.pop()
            if own and WROTE.fullmatch(own[-1].strip()):
                own.pop()
            passages.append((depth, [found[2]], len(own)))
    kept = "\n".join(own).strip("\n")
    quoted = []
    for depth, lines, _ in passages:
        parts = [x for x in map(normal, lines) if x]
        if parts:
            quoted.append((depth, mark(" ".join(parts)), mark(parts[0])))
    pieces = {normal(kept), *map(normal, kept.split("\n")), *map(normal, re.split(r"\n\s*\n", kept))} - {""}
    return kept, quoted, sorted(map(mark, pieces))


PARSED = StructType([
    StructField("own", StringType()),
    StructField("quoted", ArrayType(StructType([StructField("depth", IntegerType()), StructField("hash", LongType()),
                                                StructField("line", LongType())]))),
    StructField("parts", ArrayType(LongType()))])


@pandas_udf(PARSED)
def parsed(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(t) for t in texts], columns=["own", "quoted", "parts"])


def numbered(messages: DataFrame) -> DataFrame:
    """some, conv, turn, role, own, quoted, parts and `at`, the message's place in its conversation by turn."""
    kind = messages.schema["conv_id"].dataType
    rows = stage(messages.select(
        F.when(F.col("conv_id").isNull(), 0).otherwise(1).alias("some"), F.coalesce("conv_id", F.lit(0).cast(kind)).alias("conv"),
        "turn", "role", F.xxhash64("text", "role").alias("text_hash"), parsed(F.col("text")).alias("p"))
        .select("some", "conv", "turn", "role", "text_hash", "p.*"))
    return stage(rank_rows(rows, ["some", "conv"], ["turn", "text_hash"], "at"))


def origins(rows: DataFrame) -> DataFrame:
    """some, conv, at, i (number of the passage), depth, from_some, from_conv, from_at of every passage with an origin."""
    parts = rows.select("some", "conv", "at", F.explode("parts").alias("hash"))
    here = parts.groupBy("some", "conv", "hash").agg(F.min("at").alias("here"))
    anywhere = parts.groupBy("hash").agg(F.min(F.struct("some", "conv", "at")).alias("first"))
    quoted = rows.select("some", "conv", "at", F.posexplode("quoted").alias("i", "q"))
    tried = quoted.select("some", "conv", "at", "i", "q.depth", F.posexplode(F.array("q.hash", "q.line")).alias("way", "hash"))
    linked = tried.join(here, ["some", "conv", "hash"], "left").join(anywhere, "hash", "left")
    in_it = F.when(F.col("here") < F.col("at"), F.struct("some", "conv", F.col("here").alias("at")))
    out_of_it = F.when(~((F.col("first.some") == F.col("some")) & (F.col("first.conv") == F.col("conv"))), F.col("first"))
    place = F.coalesce(in_it, out_of_it)
    return (linked.filter(place.isNotNull()).groupBy("some", "conv", "at", "i", "depth")
            .agg(F.min(F.struct(in_it.isNull().alias("other"), "way", place.alias("place"))).alias("best"))
            .select("some", "conv", "at", "i", "depth", F.col("best.place.some").alias("from_some"),
                    F.col("best.place.conv").alias("from_conv"), F.col("best.place.at").alias("from_at")))


def replies(rows: DataFrame, found: DataFrame) -> DataFrame:
    """some, conv, at, up (place of the message answered, null for a first one), linked (by a quotation or not)."""
    inside = found.filter((F.col("from_some") == F.col("some")) & (F.col("from_conv") == F.col("conv")))
    first = inside.groupBy("some", "conv", "at").agg(F.min(F.struct("depth", "i", "from_at")).alias("best"))
    return (rows.select("some", "conv", "at").join(first, ["some", "conv", "at"], "left").select(
        "some", "conv", "at", F.coalesce("best.from_at", F.when(F.col("at") > 0, F.col("at") - 1)).alias("up"),
        F.col("best").isNotNull().alias("linked")))


def climbed(tree: DataFrame) -> DataFrame:
    """some, conv, at, root, depth: each round doubles the way up."""
    state = stage(tree.select("some", "conv", "at", F.coalesce("up", "at").alias("root"),
                              F.col("up").isNotNull().cast("int").alias("depth")))
    while True:
        above = state.select("some", "conv", F.col("at").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        higher = stage(state.join(above, ["some", "conv", "root"]).select(
            "some", "conv", "at", F.col("higher").alias("root"), (F.col("depth") + F.col("more")).alias("depth"),
            (F.col("higher") != F.col("root")).alias("moved")))
        if not higher.filter("moved").limit(1).count():
            return higher.drop("moved")
        state = higher.drop("moved")


def threads(messages: DataFrame) -> DataFrame:
    """Each message with conv_id, turn, role, own text, chat (the formatted turn), parent_turn, thread_turn (turn of the
    thread's first message), depth, place (in reply order, from 0), n_quotes, n_origins, linked."""
    rows = numbered(messages)
    found = stage(origins(rows))
    tree = stage(replies(rows, found))
    ordered = rank_rows(stage(climbed(tree)), ["some", "conv"], ["root", "depth", "at"], "place")
    counts = found.groupBy("some", "conv", "at").agg(F.count("*").alias("n_origins"))
    turns = rows.select("some", "conv", F.col("at").alias("other"), F.col("turn").alias("other_turn"))
    key = ["some", "conv", "at"]
    named = (rows.join(tree, key).join(ordered, key).join(counts, key, "left")
             .join(turns.select("some", "conv", F.col("other").alias("up"), F.col("other_turn").alias("parent_turn")), ["some", "conv", "up"], "left")
             .join(turns.select("some", "conv", F.col("other").alias("root"), F.col("other_turn").alias("thread_turn")), ["some", "conv", "root"]))
    return named.select(
        F.when(F.col("some") == 1, F.col("conv")).alias("conv_id"), "turn", "role", "own",
        F.concat(F.lit(CHAT[0]), F.coalesce("role", F.lit("")), F.lit("\n"), "own", F.lit(CHAT[1])).alias("chat"),
        "parent_turn", "thread_turn", "depth", F.col("place").cast("int").alias("place"),
        F.size("quoted").alias("n_quotes"), F.coalesce("n_origins", F.lit(0)).cast("int").alias("n_origins"), "linked")


def as_mail(messages: DataFrame) -> DataFrame:
    """The messages as an exchange of mails: each quotes the one before whole, and deeper the first line of the one
    before that. Neighbours are joined by turn, so turns without a direct predecessor quote nothing."""
    def earlier(by: int) -> DataFrame:
        text = F.col("text") if by == 1 else F.split("text", "\n")[0]
        quote = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("> " * by), x)), "\n")
        return (messages.groupBy("conv_id", (F.col("turn") + by).alias("turn")).agg(F.min("text").alias("text"))
                .select("conv_id", "turn", quote.alias(f"__quote{by}")))

    lines = F.concat_ws("\n", "__quote2", "__quote1", "text")
    return (messages.join(earlier(1), ["conv_id", "turn"], "left").join(earlier(2), ["conv_id", "turn"], "left")
            .select("conv_id", "turn", "role", lines.alias("text")))


def as_answers(messages: DataFrame) -> DataFrame:
    """The messages as mails in which turn t answers turn t div 2: it quotes that one, and deeper the one that it answers
    (t div 4). Every third mail quotes the first line only; in the others the first long line is wrapped, as mail programs
    do. Turns that are not there, and the first one, are not quoted."""
    turn = F.col("turn")
    texts = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    asked = messages.withColumns({"__up1": F.when(turn > 0, F.floor(turn / 2)), "__up2": F.when(turn > 1, F.floor(turn / 4))})
    for level in (1, 2):
        asked = asked.join(texts.select("conv_id", turn.cast("bigint").alias(f"__up{level}"), F.col("text").alias(f"__text{level}")),
                           ["conv_id", f"__up{level}"], "left")

    def quote(text, level):
        return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("> " * level), x)), "\n")

    wrapped = F.regexp_replace("__text1", r"^([^\n]{40}\S*) ", "$1\n")
    near = F.when(turn % 3 == 0, F.split("__text1", "\n")[0]).otherwise(wrapped)
    return asked.select("conv_id", "turn", "role", F.concat_ws("\n", quote(F.col("__text2"), 2), quote(near, 1), "text").alias("text"))
