"""Quality rules by repetition coverage: characters inside word n-grams and lines that a text repeats.

A word is a run of characters above U+0020, a line a run of words between newlines. For each n in `SIZES`
every occurrence after the first of an n-gram is marked, and `dup_n` counts the characters of marked words,
each once. `dup_lines` counts the characters of lines that occurred before in the text. A text is rejected if
any of these exceeds its share (`LIMITS`, `LINE_LIMIT`) of the text's word characters.

Null, empty and blank texts have no words, all counts 0, and stay: nothing in them repeats. Texts are
measured whole, whatever their length. Repeated rows are judged alike, each by itself. Other columns pass
through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import INK_BYTES, Rolling, column, fresh, mix, pieces, word_hashes, words

SIZES = (3, 5, 7, 10)
#: Hundredths of the word characters.
LIMITS = {3: 50, 5: 45, 7: 40, 10: 40}
LINE_LIMIT = 40
COUNTS = ("chars", "words", "dup_lines", *(f"dup_{n}" for n in SIZES))
_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key occurred before, and positions whose key occurs more than once."""
    order = np.argsort(key)
    ranked = key[order]
    equal = ranked[1:] == ranked[:-1]
    member = np.zeros(len(key), bool)
    member[1:] = equal
    member[:-1] |= equal
    many = order[member]
    if not len(many):
        return many, many
    first = ~np.r_[False, equal][member]  # of each group of equal keys, in ranked order
    least = np.minimum.reduceat(many, np.flatnonzero(first))
    return np.sort(many[many != least[np.cumsum(first) - 1]]), np.sort(many)


def measure(rolling: Rolling, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of each text, one column of `COUNTS` each."""
    texts = len(offsets) - 1
    out = np.zeros((texts, len(COUNTS)), np.int64)
    start, end, owner = words(data, offsets, INK_BYTES)
    if not len(start):
        return out
    length = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=length[1:])
    length = length[end] - length[start]
    codes = word_hashes(rolling, data, start, end)
    sums = rolling.sums(codes)
    salt = mix(np.arange(1, texts + 1, dtype=np.uint64))[owner]

    def count(weights: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.bincount(which, weights, texts).astype(np.int64)

    out[:, 0], out[:, 1] = count(length, owner), np.bincount(owner, minlength=texts)
    newline = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data == 10, out=newline[1:])
    newline = newline[start]
    head = np.flatnonzero(np.r_[True, (newline[1:] != newline[:-1]) | (owner[1:] != owner[:-1])])
    tail = np.r_[head[1:], len(start)]
    late, _ = again(mix(rolling.spans(sums, head, tail)) ^ salt[head])
    done = np.r_[0, np.cumsum(length)]
    out[:, 2] = count((done[tail] - done[head])[late], owner[head[late]])

    at = np.arange(len(start))
    last = np.searchsorted(owner, np.arange(texts), "right")[owner]  # end of the word's text
    shorter = SIZES[0]
    for k, n in enumerate(SIZES):
        if k:  # both ends of a repeated n-gram start a repeated shorter one
            there = np.zeros(len(start) + n, bool)
            there[at] = True
            at = at[there[at + n - shorter]]
        at = at[at + n <= last[at]]
        if not len(at):
            break
        late, many = again(mix(rolling.spans(sums, at, at + n)) ^ salt[at])
        change = np.zeros(len(start) + 1, np.int32)
        np.add.at(change, at[late], 1)
        np.add.at(change, at[late] + n, -1)
        covered = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        out[:, 3 + k] = count(length[covered], owner[covered])
        at, shorter = at[many], n
    return out


@F.arrow_udf(_TYPE)
def _measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    rolling = Rolling()
    for texts in batches:
        counts = [measure(rolling, data, offsets) for _, data, offsets in pieces(texts)]
        counts = np.concatenate(counts) if counts else np.zeros((0, len(COUNTS)), np.int64)
        yield pa.StructArray.from_arrays([pa.array(counts[:, i]) for i in range(len(COUNTS))], list(COUNTS))


_measured = _measured.asNondeterministic()  # else a filter on its result would run it twice


def keeps(counts) -> F.Column:
    """True for a text that no rule rejects; counts holds the `COUNTS`."""
    ok = counts["dup_lines"] * 100 <= counts["chars"] * LINE_LIMIT
    for n in SIZES:
        ok &= counts[f"dup_{n}"] * 100 <= counts["chars"] * LIMITS[n]
    return ok


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, and keep, for every row of docs."""
    (name,) = fresh(docs, "repetition")
    out = docs.select(column(docs, "doc_id").alias("doc_id"), _measured(column(docs, "text")).alias(name))
    return out.select("doc_id", *(F.col(name)[c].alias(c) for c in COUNTS), keeps(F.col(name)).alias("keep"))


def reject(docs: DataFrame) -> DataFrame:
    """docs without the rows that a rule rejects."""
    (name,) = fresh(docs, "repetition")
    return docs.withColumn(name, _measured(column(docs, "text"))).where(keeps(F.col(name))).drop(name)


def oracle() -> str:
    """DuckDB SQL for assess(documents)."""
    grams = ",\n".join(
        f"g{n} as (select doc_id, i, row_number() over (partition by doc_id, {', '.join(f'w{k}' for k in range(n))} order by i) as r from g where w{n - 1} is not null),\n"
        f"d{n} as (select doc_id, cast(sum(length(w0)) as bigint) as c from (select distinct doc_id, unnest(range(i, i + {n})) as i from g{n} where r > 1) join g using (doc_id, i) group by doc_id)"
        for n in SIZES
    )
    ahead = ", ".join(f"lead(w0, {k}) over (partition by doc_id order by i) as w{k}" for k in range(1, max(SIZES)))
    ok = " and ".join([f"dup_lines*100 <= chars*{LINE_LIMIT}", *(f"dup_{n}*100 <= chars*{LIMITS[n]}" for n in SIZES)])
    return f"""
with l as (select doc_id, row_number() over () as k, list_filter(regexp_split_to_array(line, '[\\x00-\\x20]+'), lambda x: x <> '') as lw
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents)),
ll as (select doc_id, k, list_aggregate(lw, 'string_agg', ' ') as line, list_sum(list_transform(lw, lambda x: length(x))) as c from l where len(lw) > 0),
dl as (select doc_id, cast(sum(c) as bigint) as c from (select doc_id, c, row_number() over (partition by doc_id, line order by k) as r from ll) where r > 1 group by doc_id),
w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x00-\\x20]+'), lambda x: x <> '') as ws from documents),
g as (select doc_id, i, w0, {ahead} from (select doc_id, unnest(ws) as w0, generate_subscripts(ws, 1) as i from w where len(ws) > 0)),
{grams},
m as (select doc_id, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as chars, cast(len(ws) as bigint) as words,
  coalesce(dl.c, 0) as dup_lines, {", ".join(f"coalesce(d{n}.c, 0) as dup_{n}" for n in SIZES)}
  from w left join dl using (doc_id) {" ".join(f"left join d{n} using (doc_id)" for n in SIZES)})
select doc_id, {", ".join(COUNTS)}, ({ok}) as keep from m"""
