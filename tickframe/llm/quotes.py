"""Chat formatting by quotation linking: conversations in reply order, without what messages quote.

A line's quote level is the number of > before it; lines that announce a quote ("On ... wrote:", of any length and
over one or two lines) go with it. Runs of lines of one level are passages, rejoined over line breaks and parted
at blank lines, and their sentences, in lower case and reduced to words, are hashed with their level. What a message quotes at a
level is joined to the earlier messages of its conversation that have it one level less deep: what stands at the
first level was said there, what stands deeper was quoted there. A message answers the one to which most of its
first level leads, by characters; of those alike, or where the first level leads nowhere, the one to which most of the
deeper levels lead; then the later one. A message that quotes nothing known answers the message before it. Reply
order is the tree in depth first order, answers to one message by their place.

Messages are in the order of turn (null last), role and text, so that equal rows are messages of their own.
Null texts are empty messages; messages that only quote stay with an empty text. A null conv_id is no
conversation: each different row of those stands alone, rows that are equal in all three columns, null by null,
together. An empty table has no conversations. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import column, cut, same

_LEVEL = re.compile(r"((?:[ \t]*>)*)[ \t]?(.*)", re.S)
_ANNOUNCES = re.compile(r"(?:on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb.*|el\b.*\bescribió|[^\n]+\b(?:wrote|writes?)(?=\s?:)|-{2,} ?original message ?-{2,})\s?:?\s*", re.I | re.S)
_STOP = re.compile(r"(?<=[.!?…])\s+")
_WORDS = re.compile(r"[^\W_]+")


def parsed(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its passages as (level, text); level 0 is its own."""
    lines = []
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        m = _LEVEL.match(line)
        lines.append((m.group(1).count(">"), m.group(2).rstrip()) if m else (0, line))
    gone = set()
    for i, (level, line) in enumerate(lines):
        ahead = next((k for k in range(i + 1, min(i + 3, len(lines))) if lines[k][1] or lines[k][0] > level), None)
        if line.strip() and ahead is not None and lines[ahead][0] > level and _ANNOUNCES.fullmatch(line.strip()):
            gone.add(i)
        elif i + 1 < len(lines) and lines[i + 1][0] == level and line.strip() and i + 2 < len(lines) and lines[i + 2][0] > level:
            if re.match(r"(?:on|le|am|el)\b", line.strip(), re.I) and _ANNOUNCES.fullmatch(f"{line.strip()} {lines[i + 1][1].strip()}"):
                gone |= {i, i + 1}
    passages: list[tuple[int, str]] = []
    run: list[str] = []
    at = None
    own = []
    for i, (level, line) in enumerate([*lines, (-1, "")]):
        if i in gone:
            continue
        if level == 0:
            own.append(line)
        if level != at or not line.strip():
            if run and at is not None:
                passages.append((at, " ".join(run)))
            run, at = [], level
        if line.strip():
            run.append(line.strip())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip(), passages


def units(passage: str) -> list[tuple[int, int]]:
    """(hash, characters) of the normalised sentences of a passage; sentences without a word have none."""
    out = []
    for sentence in _STOP.split(passage):
        norm = " ".join(_WORDS.findall(sentence.casefold()))
        if norm:
            out.append((int.from_bytes(hashlib.blake2b(norm.encode(), digest_size=8).digest(), "little", signed=True), len(norm)))
    return out


_UNIT = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("n", T.IntegerType())]))


@F.arrow_udf(T.StructType([T.StructField("own", T.StringType()), T.StructField("units", _UNIT), T.StructField("levels", T.IntegerType())]))
def message(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("own", pa.string()), ("units", pa.list_(pa.struct([("level", pa.int32()), ("h", pa.int64()), ("n", pa.int32())]))), ("levels", pa.int32())])
    for batch in batches:
        rows = []
        for text in batch:
            own, passages = parsed(text.as_py())
            found = [{"level": level, "h": h, "n": n} for level, p in passages for h, n in units(p)]
            rows.append({"own": own, "units": found, "levels": max((lv for lv, _ in passages), default=0)})
        yield pa.array(rows, kind)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def reply_order(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Places of messages in depth first order, from the place that each answers (from 1; 0 for none)."""
    for batch in batches:
        out = []
        for answers in batch:
            answers = answers.as_py()
            below: list[list[int]] = [[] for _ in range(len(answers) + 1)]
            for i, parent in enumerate(answers, 1):
                below[parent].append(i)
            order, todo = [], below[0][::-1]
            while todo:
                i = todo.pop()
                order.append(i)
                todo += below[i][::-1]
            out.append(order)
        yield pa.array(out, pa.list_(pa.int32()))


def linked(conversations: DataFrame) -> DataFrame:
    """(conv, alone, place, turn, role, own, answers, levels): each message with the place of the one that it answers."""
    c, turn, role, text = (column(conversations, n) for n in ("conv_id", "turn", "role", "text"))
    alone = F.when(c.isNull(), F.xxhash64(*(x for v in (turn, role, text) for x in (v.isNull(), v))))
    order = Window.partitionBy("conv", "alone").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = conversations.select(c.alias("conv"), alone.alias("alone"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("m", message.asNondeterministic()("text"))
    rows = cut(rows.select("conv", "alone", "place", "turn", "role", "m.*"))
    each = rows.where("conv is not null").select("conv", "place", F.inline("units"))
    there = each.select("conv", F.col("place").alias("by"), (F.col("level") + 1).alias("level"), "h").distinct()
    shared = each.where("level > 0").join(there, ["conv", "level", "h"]).where("by < place")
    first = F.sum(F.when(F.col("level") == 1, F.col("n")).otherwise(0))
    ranked = shared.groupBy("conv", "place", "by").agg(first.alias("first"), F.sum("n").alias("all"))
    parent = ranked.groupBy(F.col("conv").alias("c"), F.col("place").alias("p")).agg(F.max(F.struct("first", "all", "by"))["by"].alias("answers"))
    out = rows.join(parent, same(rows["conv"], F.col("c")) & (rows["place"] == F.col("p")), "left")
    return out.select("conv", "alone", "place", "turn", "role", "own", F.coalesce("answers", F.col("place") - 1).alias("answers"), F.col("answers").isNotNull().alias("linked"), "levels")


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, messages in reply order, how many of them a quotation links, and the chat as one text."""
    one = F.struct("place", "turn", "role", "own", "answers", "linked")
    grouped = linked(conversations).groupBy("conv", "alone").agg(F.sort_array(F.collect_list(one)).alias("all"))
    ordered = grouped.withColumn("order", reply_order.asNondeterministic()(F.transform("all", lambda m: m["answers"])))
    messages = F.transform("order", lambda i: F.element_at("all", i))
    out = ordered.select(F.col("conv").alias("conv_id"), messages.alias("all"))
    said = F.transform("all", lambda m: F.concat(F.lit("<|"), F.coalesce(m["role"], F.lit("")), F.lit("|>\n"), m["own"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("all").alias("messages"),
        F.size(F.filter("all", lambda m: m["linked"])).alias("linked"),
        F.transform("all", lambda m: m["turn"]).alias("turns"),
        F.transform("all", lambda m: m["answers"]).alias("answers"),
        F.array_join(said, "").alias("chat"),
    )
