"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are runs that look like e-mail addresses, IP addresses, bank accounts, phone, card and identity
numbers, street addresses, other numbers, and persons: runs of two or more capitalised words, with initials and particles, or of one
after a title or contact word; blanks and a line break may part them. Names in capitals or small letters only
are no candidates. The gazetteer of given names is loaded from a file; it votes on candidates and makes none. The context labeler says no to a run without given name, title or contact word. Regex, checksum, gazetteer and context labelers
each say yes, no or nothing to a candidate. `reliabilities` fits, by expectation-maximisation over the counts of
all vote patterns in the corpus, how often each labeler says what of personal data and of other spans, and how
common personal data is in each kind. A logistic classifier over the span's shape and its neighbour words is
then trained on these posteriors, on `SAMPLE` candidates at most (those of the lowest hash), and judges all.

Null and empty texts have no candidates. Whole texts are read; places are in characters. Equal rows are judged
alike, each by itself. Without any candidate the result is empty. Extra columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Collection, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import column, cut

SAMPLE = 50_000
FEATURES = 1024
ROUNDS = 60
THRESHOLD = 0.5
#: The gazetteer that comes with the package: given names of many languages, one a line.
NAMES = Path(__file__).with_name("given_names.txt")
ENDINGS = frozenset("com org net edu gov io info biz co uk de fr es eu us ca au jp ch at nl it".split())
KINDS = ("email", "ip", "iban", "phone", "card", "identity", "number", "person", "address")
_CANDIDATE = re.compile(
    r"(?P<email>[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+)"
    r"|(?<![\w.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)"
    r"|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?<!\w)(?P<phone>\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}[ \-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\w)"
    r"|(?<!\w)(?P<card>\d{4}(?:[ \-]\d{4}){3}|\d{13,19})(?!\w)"
    r"|(?<!\w)(?P<identity>\d{3}-\d{2}-\d{4})(?!\w)"
    r"|(?<!\w)(?P<address>\d{1,5}[A-Za-z]? (?:[A-ZÀ-ÖØ-Þ][\w'’.\-]* ){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace|Way|Close|Crescent)\b\.?)"
    r"|(?<!\w)(?P<number>\d+(?:[.,:/\-]\d+)*)"
)
_MAYBE = "[0-9@]"
_NAME = r"[A-ZÀ-ÖØ-ÞŁŚŻŽŠČ](?<!\w.)(?:['’][A-ZÀ-ÖØ-Þ])?[a-zß-öø-ſ]+(?:[A-Z][a-zß-öø-ſ]+)?(?:[\-'’][A-ZÀ-ÖØ-Þ][a-zß-öø-ſ]+)*(?!\w)"
_GAP = r"(?:[ \t\xa0]+(?:\r?\n[ \t]*)?|\r?\n[ \t]*)"
_RUN = re.compile(rf"{_NAME}(?:{_GAP}(?:(?:(?:van|von|der|den|de|la|del|di|da|dos|bin|al|el|y){_GAP}){{0,3}}{_NAME}|[A-Z]\.(?!\w)))*")
_CAPITAL = r"\p{Lu}['’]?\p{L}*\p{Ll}"
_PART = re.compile(r"[^\s]+")
_TITLES = frozenset("mr mrs ms miss mx dr prof sir dame herr frau señor señora sr sra monsieur madame mme name contact".split())
_LONGEST = max(map(len, _TITLES))
_LAST = re.compile(r"[^\W\d_]+$")
#: Words that begin sentences or name places, times, offices and works, not persons.
_COMMON = frozenset(
    "the a an in on at by for from to of and or but if as it its this that these those he she we they you i his her our their there here when where while what who how why after before since with without all some many most no not yes new "
    "der die das ein eine im am und oder aber wenn als es er sie wir ist nicht le les un une des du et mais si il elle nous vous ce cette dans pour los las una unos en con por para pero que se su "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "street road avenue university college school institute company inc corp ltd gmbh license public general united states kingdom north south east west city river lake mount chapter section figure table page version copyright rights reserved privacy policy terms".split()
)
_YES = frozenset("phone tel telephone call mobile fax email mail contact ssn card visa mastercard ip address iban account mr mrs ms dr name teléfono correo téléphone telefon".split())
_NO = frozenset("version v release chapter page pages section figure table line step licensed license lizenz licencia licence isbn part no".split())
_DATE = re.compile(r"(?:\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}|\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{1,2}:\d{2}(?::\d{2})?)$")
LABELERS = ("form", "checksum", "gazetteer", "before", "after", "size", "date")
_WORD = re.compile(r"[^\W\d_]+")
_SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("votes", T.IntegerType()), T.StructField("features", T.ArrayType(T.IntegerType()))])
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def loaded(path: str | Path = NAMES) -> frozenset[str]:
    """A gazetteer of given names, in small letters."""
    return frozenset(Path(path).read_text("utf-8").lower().split())


def gazetteer(span: str, names: Collection[str]) -> int:
    """Of a person: yes for a given name, no for a word that isn't a name's, else nothing."""
    found = _WORD.findall(span.lower())
    return 2 if any(w in names for w in found) else 1 if any(w in _COMMON or w in _NO for w in found) else 0


def persons(text: str) -> Iterator[tuple[int, int]]:
    """Places of the name-like runs; titles, contact words and common words before them don't belong to them."""
    for m in _RUN.finditer(text):
        begin, end = m.span()
        titled, parts = None, [(p.start() + begin, p.group()) for p in _PART.finditer(m.group())]
        while parts and ((word := parts[0][1].lower().rstrip(".")) in _TITLES or word in _YES or word in _COMMON):
            titled = word in _TITLES or word in _YES
            parts = parts[1:]
        if titled is None and parts:
            end_ = begin
            while end_ and text[end_ - 1] in " \t\xa0\r\n":
                end_ -= 1
            if end_ and text[end_ - 1] in ".:":
                end_ -= 1
            last = _LAST.search(text[max(0, end_ - 1 - _LONGEST) : end_])  # one sign more than the longest title
            titled = last is not None and last.group().lower() in _TITLES
        if len(parts) > 1 or parts and titled:
            yield parts[0][0], end


def votes(kind: str, span: str, before: list[str], after: list[str], names: Collection[str]) -> list[int]:
    """Of each labeler 0 for nothing, 1 for no, 2 for yes."""
    digits = re.sub(r"\D", "", span)
    out = [0] * len(LABELERS)
    if kind in ("email", "phone", "identity", "address"):
        out[0] = 2
    elif kind == "ip":
        out[0] = 2 if all(int(x) < 256 for x in span.split(".")) else 1
    elif kind == "number":
        out[0] = 1
    if kind == "card" or kind == "number" and len(digits) > 12:
        out[1] = 2 if luhn(digits) and digits[0] in "3456" else 1
    elif kind == "iban":
        moved = span.replace(" ", "")
        out[1] = 2 if int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1 else 1
    if kind == "email":
        out[2] = 2 if span.rsplit(".", 1)[1].lower() in ENDINGS else 1
    elif kind == "person":
        out[2] = gazetteer(span, names)
    elif kind == "phone" and span.startswith("+"):
        out[2] = 2 if digits[:1] in "12345679" else 1
    if any(w in _NO for w in before[-2:]):
        out[3] = 1
    elif any(w in _YES for w in before[-4:]) or kind == "person" and any(w in _TITLES for w in before[-2:]):
        out[3] = 2
    elif kind == "person" and out[2] < 2:
        out[3] = 1  # bare capitals; a labeler that never said no would weigh nothing
    if any(w in _YES for w in after[:1]):
        out[4] = 2
    if digits and kind not in ("email", "address"):
        out[5] = 1 if len(digits) < 7 else 0  # enough digits prove nothing
    if digits and kind not in ("email", "address") and _DATE.match(span):
        out[6] = 1
    return out


def shape(span: str) -> str:
    """Runs of letters as a, of digits as their number up to four; other signs stay."""
    return re.sub(r"\d+", lambda m: "9" * min(4, len(m.group())), re.sub(r"[^\W\d_]+", "a", span))


def before_words(text: str, at: int, n: int) -> list[str]:
    """The last n words before a place, however far away, in small letters."""
    reach = 64
    while True:
        found = _WORD.findall(text, max(0, at - reach), at)
        if len(found) > n or reach >= at:
            return [w.lower() for w in found[-n:]]
        reach *= 4


def hashed(*names: str) -> list[int]:
    return sorted({zlib.crc32(n.encode()) % FEATURES for n in names})


def candidates(text: str, names: Collection[str]) -> list[dict]:
    places, out = [], []
    for m in _CANDIDATE.finditer(text) if re.search(_MAYBE, text) else ():
        places.append((m.start(), m.start() + len(m.group().rstrip(".-")), m.lastgroup or ""))
    taken, at = places[:], 0
    for start, stop in persons(text):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at == len(taken) or taken[at][0] >= stop:
            places.append((start, stop, "person"))
    for start, stop, kind in sorted(places):
        span = text[start:stop]
        before = before_words(text, start, 4)
        m = _WORD.search(text, stop)
        after = [m.group().lower()] if m else []
        v = 0
        for x in votes(kind, span, before, after, names):
            v = v * 3 + x
        digits = sum(c.isdigit() for c in span)
        traits = ("bias", f"kind {kind}", f"shape {kind} {shape(span)}", f"digits {kind} {min(digits, 20)}", f"before {before[-1] if before else ''}", f"after {after[0] if after else ''}")
        checked = f"check {kind} {luhn(re.sub(r'[^0-9]', '', span)) if kind == 'card' else all(int(x) < 256 for x in span.split('.')) if kind == 'ip' else gazetteer(span, names) if kind == 'person' else ''}"
        out.append({"kind": KINDS.index(kind), "start": start, "stop": stop, "votes": v, "features": hashed(*traits, checked)})
    return out


def spanning(names: Collection[str]):
    """UDF: the candidates of a text, with the gazetteer sent along."""

    @F.arrow_udf(_SPANS)
    def spanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))]))
        for batch in batches:
            maybe = pc.fill_null(pc.match_substring_regex(batch, f"{_MAYBE}|{_CAPITAL}"), False).to_numpy(zero_copy_only=False)
            found: list[list[dict]] = [[] for _ in range(len(batch))]
            for i in np.flatnonzero(maybe).tolist():
                found[i] = candidates(batch[i].as_py(), names)
            yield pa.array(found, kind)

    return spanned.asNondeterministic()  # else a filter on its result would run it twice


def unpacked(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3 ** (len(LABELERS) - 1 - i) % 3 for i in range(len(LABELERS))], 1)


def reliabilities(kinds: np.ndarray, patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each pattern, share of personal data by kind, P(vote | truth, it votes) by labeler, truth and vote)
    from the counts of vote patterns by kind."""
    v = unpacked(patterns)
    score = (v == 2).sum(1) - (v == 1).sum(1)
    posterior = 1 / (1 + np.exp(-2.0 * score))
    share, says = np.full(len(KINDS), 0.5), np.full((len(LABELERS), 2, 3), 1 / 3)
    for _ in range(ROUNDS):
        for k in range(len(KINDS)):
            at = kinds == k
            share[k] = ((counts * posterior)[at].sum() + 1) / (counts[at].sum() + 2)
        for i in range(len(LABELERS)):
            for truth, p in enumerate((1 - posterior, posterior)):
                weight = np.bincount(v[:, i], counts * p, 3) + np.array([0.0, 2.0 if truth == 0 else 0.5, 2.0 if truth else 0.5])
                weight[0] = 0  # when a labeler is silent depends on the kind of span, not on the truth
                says[i, truth] = weight / weight.sum()
        odds = np.log(share[kinds] / (1 - share[kinds]))
        for i in range(len(LABELERS)):
            spoke = v[:, i] > 0
            odds += np.where(spoke, np.log((says[i, 1, v[:, i]] + 1e-12) / (says[i, 0, v[:, i]] + 1e-12)), 0.0)
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior, share, says


def fitted(features: list[list[int]], target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the logistic classifier, by full gradient steps scaled for each feature."""
    w, total = np.zeros(FEATURES), max(weight.sum(), 1.0)
    flat = np.array([f for fs in features for f in fs], np.int64)
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    scale = np.full(FEATURES, 1e-8)
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[flat], len(features)), -30, 30)))
        gradient = np.bincount(flat, ((p - target) * weight)[row], FEATURES) / total + 1e-5 * w
        scale += gradient**2
        w -= 0.5 * gradient / np.sqrt(scale)
    return w


def personal(docs: DataFrame, names: Collection[str] | None = None) -> DataFrame:
    """doc_id, kind, start, stop and probability of each span of personal data. names: a gazetteer of given names in
    small letters, else that of the package."""
    spanned = spanning(loaded() if names is None else frozenset(names))
    found = docs.select(column(docs, "doc_id").alias("doc_id"), F.explode(spanned(column(docs, "text"))).alias("s"))
    found = cut(found.select("doc_id", "s.*"))
    patterns = found.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).toPandas()
    kinds, codes, counts = (patterns[c].to_numpy(np.int64) for c in ("kind", "votes", "n"))
    posterior, _, _ = reliabilities(kinds, codes, counts.astype(float))
    truth = dict(zip(zip(kinds.tolist(), codes.tolist()), posterior.tolist()))
    sample = found.orderBy(F.xxhash64("doc_id", "start", "stop", "features"), "kind").limit(SAMPLE)
    rows = sample.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes", "features").collect()
    weights = fitted([r.features for r in rows], np.array([truth[r.kind, r.votes] for r in rows]), np.array([float(r.n) for r in rows]))

    @F.arrow_udf(T.DoubleType())
    def probability(features: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(features)), pc.list_value_length(features).to_numpy(zero_copy_only=False))
        z = np.bincount(row, weights[features.flatten().to_numpy()], len(features))
        return pa.array(np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6))

    judged = found.withColumn("probability", probability.asNondeterministic()("features")).where(F.col("probability") >= THRESHOLD)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return judged.select("doc_id", name.alias("kind"), "start", "stop", "probability")
