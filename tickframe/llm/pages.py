"""Main text of HTML pages by composite text density of DOM nodes.

A page is read into a tree: void elements and stray end tags are tolerated, and p, li, td, th, tr, dt, dd and
option end where another begins. script, style, noscript, template, textarea, svg and head hold no text. For each
node C counts its characters, T its tags, LC and LT those within links; with the body's LC/C the composite
density is C/T * log_b(C*T / (LC*LT)) with b = ln(C*LC/(C-LC) + LC_body*C/C_body + e), where counts of nothing
count as 1, and where b is 1, as in pages without links, the logarithm is the natural one. A node's density sum adds up the densities of its children. The node of the largest sum is taken;
the threshold is the smallest density on the path from it to the body, and of its subtree every node of at
least that density counts, with all that it holds, as do its own bits of text; nodes below the threshold are searched for such nodes.

Reading takes time in proportion to the page: open elements are counted, so that no end tag or implied end looks
further up than it closes, and where a quote in a tag is never closed, quotes count for nothing from that tag on.

A page whose nodes have no text at all gives an empty text. Null pages give null, empty pages an empty text;
without a body the root takes its place. Ties go to the node that comes first. Nesting may be of any depth, as
nothing recurses. Equal rows are read each by itself. Extra columns don't matter.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import column

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template textarea svg head title".split())
_RAW = frozenset("script style textarea title".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCK = frozenset("address article aside blockquote dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul br body".split())
#: What keeps an implied end from reaching outwards.
_FENCE = frozenset("table ul ol dl div article section aside nav main body html blockquote form select button".split())
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_BARE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_CUT_TAG = re.compile(r"</?[A-Za-z][^<>]*+\Z")
_BLANK = re.compile(r"\s+")


class Tree:
    """Nodes as parallel lists; node 0 is the root. parts holds of each node its texts and children in order.
    open_ counts the open elements by name, within those of the innermost open fence."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.parts = ["#root"], [-1], [[]]
        self.stack, self.open_, self.scopes = [0], defaultdict(int), [defaultdict(int)]
        at, begun, n, tag = 0, 0, len(source), _TAG
        last = source.rfind(">")
        while at < n:
            start = source.find("<", at)
            if start < 0:
                break
            m = None
            if source.startswith("<!--", start):
                stop = source.find("-->", start + 4)
                stop = n if stop < 0 else stop + 3
            elif source.startswith("<![CDATA[", start):
                stop = source.find("]]>", start + 9)
                stop = n if stop < 0 else stop + 3
            elif source.startswith(("<!", "<?"), start):
                stop = source.find(">", start)
                stop = n if stop < 0 else stop + 1
            else:
                m = tag.match(source, start) if start < last else None
                if m is None and start < last and tag is _TAG and _BARE_TAG.match(source, start):
                    tag = _BARE_TAG  # a quote here is never closed
                    m = tag.match(source, start)
                stop = m.end() if m else n if _CUT_TAG.match(source, start) else 0
            if not stop:
                at = start + 1  # a sign of the text
                continue
            if start > begun:
                self._text(self.stack[-1], source[begun:start])
            at = begun = stop
            if m is not None:
                name = m.group(2).lower()
                if m.group(1):
                    if self.open_[name]:
                        while self._close() != name:
                            pass
                else:
                    self._element(name, m.group(3).endswith("/"))
                    if name in _RAW and self.stack[-1] == len(self.tag) - 1:
                        end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                        at = begun = end.end() if end else n
                        self._close()
        if begun < n:
            self._text(self.stack[-1], source[begun:])

    def _close(self) -> str:
        """Ends the innermost element; its name."""
        name = self.tag[self.stack.pop()]
        self.open_[name] -= 1
        if name in _FENCE:
            self.scopes.pop()
        else:
            self.scopes[-1][name] -= 1
        return name

    def _element(self, name: str, closed: bool) -> None:
        within = self.scopes[-1]
        for end in _CLOSES.get(name, ("p",) if name in _BLOCK and name != "br" else ()):
            while within[end]:
                self._close()
        self.tag.append(name)
        self.parent.append(self.stack[-1])
        self.parts.append([])
        self.parts[self.stack[-1]].append(len(self.tag) - 1)
        if name in _VOID or closed:
            return
        self.stack.append(len(self.tag) - 1)
        self.open_[name] += 1
        if name in _FENCE:
            self.scopes.append(defaultdict(int))
        else:
            within[name] += 1

    def _text(self, node: int, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        if text.strip():
            self.parts[node].append(text)
        elif text:
            self.parts[node].append(" ")


def densities(tree: Tree) -> tuple[list[float], list[float], list[int], int]:
    """(density, density sum, characters) of each node, and the body."""
    n = len(tree.tag)
    silent, linked = [False] * n, [False] * n
    for i in range(1, n):
        silent[i] = silent[tree.parent[i]] or tree.tag[i] in _SILENT
        linked[i] = linked[tree.parent[i]] or tree.tag[i] == "a"
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):  # children come after their parents
        if tree.parts[i] and not silent[i]:
            own = 0
            for p in tree.parts[i]:
                if isinstance(p, str) and p != " ":
                    own += len(_BLANK.sub(" ", p).strip())
            chars[i] += own
            if linked[i]:
                link_chars[i] += own
        if i:
            up = tree.parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            if not silent[i]:
                tags[up] += tags[i] + 1
                link_tags[up] += link_tags[i] + (tree.tag[i] == "a")
    body = tree.tag.index("body") if "body" in tree.tag else 0
    ratio = link_chars[body] / max(chars[body], 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if chars[i]:
            c, t, lc, lt = chars[i], max(tags[i], 1), max(link_chars[i], 1), max(link_tags[i], 1)
            base = math.log(c * link_chars[i] / max(c - link_chars[i], 1) + ratio * c + math.e)
            density[i] = c / t * max(math.log(c * t / (lc * lt)) / math.log(max(base, 1.0001)), 0.0) if base > 1.0001 else c / t * math.log(max(c * t / (lc * lt), 1.0))
        if i:
            total[tree.parent[i]] += density[i]
    return density, total, chars, body


def main_text(source: str | None) -> tuple[str, int, float] | None:
    """(text, nodes, density sum of the chosen node)."""
    if source is None:
        return None
    tree = Tree(source)
    density, total, chars, body = densities(tree)
    inside = [False] * len(tree.tag)
    inside[body] = True
    for i in range(body + 1, len(tree.tag)):
        inside[i] = inside[tree.parent[i]]
    best = body
    for i in range(body, len(tree.tag)):
        if inside[i] and total[i] > total[best]:
            best = i
    if not chars[body]:
        return "", len(tree.tag), 0.0
    if not total[best]:
        best = body
    limit, up = math.inf, best
    while up >= 0:
        limit = min(limit, density[up])
        if up == body:
            break
        up = tree.parent[up]
    holds = [False] * len(tree.tag)  # is dense enough, or something in it is
    for i in range(len(tree.tag) - 1, best, -1):
        holds[i] = bool(chars[i]) and (holds[i] or density[i] >= limit)
        if holds[i]:
            holds[tree.parent[i]] = True
    out: list[str] = []
    todo: list = [(best, 0, False)]
    while todo:
        node, k, whole = todo.pop()
        parts = tree.parts[node]
        if k == 0 and tree.tag[node] in _BLOCK:
            out.append("\n")
        while k < len(parts):
            part = parts[k]
            k += 1
            if isinstance(part, str):
                out.append(_BLANK.sub(" ", part) if whole or node == best else " ")
            elif tree.tag[part] == "br":
                out.append("\n")
            elif chars[part] and tree.tag[part] not in _SILENT and (whole or holds[part]):
                todo += [(node, k, whole), (part, 0, whole or density[part] >= limit)]
                break
        else:
            if tree.tag[node] in _BLOCK:
                out.append("\n")
    lines = (_BLANK.sub(" ", line).strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line), len(tree.tag), round(total[best], 6)


_TYPE = T.StructType([T.StructField("text", T.StringType()), T.StructField("nodes", T.IntegerType()), T.StructField("density_sum", T.DoubleType())])


@F.arrow_udf(_TYPE)
def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("text", pa.string()), ("nodes", pa.int32()), ("density_sum", pa.float64())])
    for batch in batches:
        found = (main_text(p.as_py()) for p in batch)
        yield pa.array([None if f is None else {"text": f[0], "nodes": f[1], "density_sum": f[2]} for f in found], kind)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, nodes and density_sum of every page."""
    out = pages.select(column(pages, "page_id").alias("page_id"), column(pages, "url").alias("url"), read.asNondeterministic()(column(pages, "html")).alias("r"))
    return out.select("page_id", "url", "r.text", "r.nodes", "r.density_sum")
