"""Secret scans by one automaton that runs all rules in a single pass over the bytes.

A rule names the sign before the secret, the secret, and the sign after it. All rules whole are one minimal
automaton, made by subset construction, that says where matches end; in it, a part that is there several times may be there any
number of times, as counts of rules that run side by side would multiply its states. From each end, the minimal
automaton of the rule alone, counts and all, read backwards, says whether and where matches begin. Secrets of a rule don't overlap: the leftmost counts, as long as it can be. Rules
may be any number, and secrets of any length.

Long texts are cut into spans of `SPAN` bytes that run abreast, each read on until no match that began in it is
under way. Null and empty texts hold no secrets. Places are byte
offsets in UTF-8. Equal rows are scanned each by itself. Extra columns don't matter; an empty table has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Automaton
from .text import column, pieces

SPAN = 1024
ABREAST = 8 << 20
_WORD = r"[A-Za-z0-9_\-]"
_NOT = r"[^A-Za-z0-9_\-]"
_VALUE = r"[A-Za-z0-9_\-+/.]"
_PASS = r"[^ \t\r\n/@:\"'<>\0]"
#: name: (sign before, secret, sign after)
RULES = {
    "aws_access_key": (r"[^A-Za-z0-9]", r"(AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}", r"[^A-Za-z0-9]"),
    "assigned_secret": (
        r"[^A-Za-z0-9]",
        rf"(?i:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key)((?i:key)?[0-9]{{0,4}}|[_\-][A-Za-z0-9_\-]*)(\\?[\"'])?[ \t]*[=:][ \t]*(\\?[\"'])?{_VALUE}{{8,}}",
        r"[^A-Za-z0-9_\-+/.]",
    ),
    "github_token": (_NOT, r"gh[pousr]_[A-Za-z0-9]{36}", _NOT),
    "github_fine_token": (_NOT, r"github_pat_[A-Za-z0-9_]{22,}", _NOT),
    "npm_token": (_NOT, r"npm_[A-Za-z0-9]{36}", _NOT),
    "slack_token": (_NOT, r"xox[abprs]-[A-Za-z0-9\-]{10,}", _NOT),
    "google_api_key": (_NOT, r"AIza[A-Za-z0-9_\-]{35}", _NOT),
    "stripe_key": (_NOT, r"[sr]k_live_[A-Za-z0-9]{24,}", _NOT),
    "model_api_key": (_NOT, rf"sk-((ant|proj|svcacct)-{_WORD}{{20,}}|[A-Za-z0-9]{{32,}})", _NOT),
    "jwt": (_NOT, rf"eyJ{_WORD}{{8,}}\.eyJ{_WORD}{{8,}}\.{_WORD}{{8,}}", _NOT),
    "url_password": (_NOT, rf"(https?|ftp|postgres(ql)?|mysql|mongodb(\+srv)?|rediss?|amqps?)://[A-Za-z0-9._%+\-]*:{_PASS}{{3,}}@", r"[A-Za-z0-9\[_.\-]"),
    "private_key": (r"[^\-]", r"-----BEGIN ((RSA|EC|DSA|OPENSSH|PGP) )?PRIVATE KEY( BLOCK)?-----", r"[^\-]"),
}
_FOUND = T.ArrayType(T.StructType([T.StructField("rule", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


class Scanner:
    def __init__(self) -> None:
        rules = ["".join(rule) for rule in RULES.values()]
        self.automaton = Automaton(rules, loose=True)
        self.backwards = [Automaton([rule], anchored=True, backwards=True) for rule in rules]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each text (rule, start, stop), by rule and start."""
        texts = len(offsets) - 1
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(texts)]
        many = -(-np.diff(offsets) // SPAN)
        owner = np.repeat(np.arange(texts), many)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        first, last = offsets[:-1][owner], offsets[1:][owner]
        begin = first + place * SPAN
        span, stop, rules = self.automaton.ends(data, begin, np.minimum(begin + SPAN, last), first, last)
        found = np.unique(np.column_stack([owner[span], stop - first[span], rules]), axis=0)
        pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
        at, whole = -1, b""
        for text, end, which in found.tolist():
            if text != at:
                at, whole = text, b"\0" + data[offsets[text] : offsets[text + 1]].tobytes() + b"\0"
            for r in self.automaton.rule_sets[which]:
                pairs.setdefault((text, r), []).extend((start, -end) for start in self.backwards[r].starts(whole, end + 1))
        for (text, r), ends in sorted(pairs.items()):
            free = 0
            for start, end in sorted(ends):
                if start >= free:  # the sign before may be the one after the last
                    out[text].append((r, start, -end - 1))
                    free = -end - 1
        return out


def scanning(spark: SparkSession):
    """UDF: the secrets of a text. The automata are built once, here, and broadcast."""
    sent = spark.sparkContext.broadcast(Scanner())

    @F.arrow_udf(_FOUND)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [f for _, data, offsets in pieces(batch, ABREAST) for f in sent.value.scan(data, offsets)]
            flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 3)
            ends = pa.array(np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32))
            fields = pa.StructArray.from_arrays([pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1].copy()), pa.array(flat[:, 2].copy())], ["rule", "start", "stop"])
            yield pa.ListArray.from_arrays(ends, fields)

    return scanned.asNondeterministic()  # else a filter on its result would run it twice


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, rule, start and stop of every secret, with the sha2 of its bytes instead of them."""
    found = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").cast("binary").alias("b"), scanning(docs.sparkSession)(column(docs, "text")).alias("f"))
    each = found.where(F.size("f") > 0).select("doc_id", "b", F.explode("f").alias("f"))
    name = F.element_at(F.array(*map(F.lit, RULES)), F.col("f")["rule"] + 1)
    start, stop = F.col("f")["start"], F.col("f")["stop"]
    return each.select("doc_id", name.alias("rule"), start.alias("start"), stop.alias("stop"), F.sha2(F.substring("b", (start + 1).cast("int"), (stop - start).cast("int")), 256).alias("fingerprint"))
