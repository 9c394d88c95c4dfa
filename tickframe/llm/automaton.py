"""Regular expressions of bytes compiled into one minimal deterministic automaton, by subset construction.

Syntax: literals, escapes (\\d \\w \\s and escaped signs), classes with ranges and negation, groups, `|`, groups
(?i:...) in which the case of ASCII letters does not matter, and the repeats ? * + {n} {n,m} {n,}. Byte 0 stands for the ends of a text and matches only negated classes and \\0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .text import mix

_DIGIT = frozenset(range(48, 58))
_WORD = _DIGIT | frozenset(range(65, 91)) | frozenset(range(97, 123)) | {95}
_SPACE = frozenset(b" \t\n\r\f\v")
_ALL = frozenset(range(256))
_KINDS = {"d": _DIGIT, "w": _WORD, "s": _SPACE, "D": _ALL - _DIGIT, "W": _ALL - _WORD, "S": _ALL - _SPACE, "n": frozenset(b"\n"), "t": frozenset(b"\t"), "r": frozenset(b"\r"), "0": frozenset(b"\0")}


class _Parser:
    """Recursive descent into nested tuples."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.fold = text, 0, False

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def next(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def choice(self) -> tuple:
        options = [self.sequence()]
        while self.peek() == "|":
            self.next()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self) -> tuple:
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated())
        return ("then", items)

    def repeated(self) -> tuple:
        item = self.single()
        while self.peek() and self.peek() in "?*+{":
            sign = self.next()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(sign, (0, None))
            if sign == "{":
                inside = ""
                while self.peek() != "}":
                    inside += self.next()
                self.next()
                first, comma, last = inside.partition(",")
                low, high = int(first), (int(last) if last else None) if comma else int(first)
            item = ("repeat", item, low, high)
        return item

    def escape(self) -> frozenset:
        c = self.next()
        return _KINDS.get(c) or frozenset(c.encode())

    def single(self) -> tuple:
        c = self.next()
        if c == "(":
            outside = self.fold
            if self.text.startswith("?:", self.at):
                self.at += 2
            elif self.text.startswith("?i:", self.at):
                self.at, self.fold = self.at + 3, True
            inner = self.choice()
            self.fold = outside
            if not self.peek():
                raise ValueError(f"no ) in {self.text}")
            self.next()
            return inner
        if c == "[":
            return ("set", self.members())
        if c == ".":
            return ("set", _ALL - {0, 10})
        if c == "\\":
            return ("set", self.folded(self.escape()))
        return ("then", [("set", self.folded(frozenset([b]))) for b in c.encode()])

    def folded(self, members: frozenset) -> frozenset:
        if not self.fold:
            return members
        return members | frozenset(b ^ 32 for b in members if 65 <= b & ~32 <= 90 and b < 128)

    def members(self) -> frozenset:
        negated = self.peek() == "^"
        if negated:
            self.next()
        out: set[int] = set()
        first = True
        while self.peek() != "]" or first:
            first = False
            c = self.next()
            if c == "\\":
                out |= self.escape()
            elif self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.next()
                out |= set(range(ord(c), ord(self.next()) + 1))
            else:
                out |= set(c.encode())
        self.next()
        found = self.folded(frozenset(out))
        return _ALL - found if negated else found


def _reversed(tree: tuple) -> tuple:
    """The tree of the words read backwards."""
    kind = tree[0]
    if kind == "then":
        return (kind, [_reversed(x) for x in reversed(tree[1])])
    if kind == "or":
        return (kind, [_reversed(x) for x in tree[1]])
    return tree if kind == "set" else (kind, _reversed(tree[1]), *tree[2:])


def _loosened(tree: tuple) -> tuple:
    """The tree with every count above one as any number above none: its words are among those of the result."""
    kind = tree[0]
    if kind in ("then", "or"):
        return (kind, [_loosened(x) for x in tree[1]])
    if kind == "set":
        return tree
    _, item, low, high = tree
    return (kind, _loosened(item), min(low, 1), high if high == 1 else None)


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def build(self, tree: tuple, start: int) -> int:
        """Adds the tree from start on; where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "then":
            for item in tree[1]:
                start = self.build(item, start)
            return start
        if kind == "or":
            end = self.state()
            for option in tree[1]:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.build(option, begin)].append(end)
            return end
        _, item, low, high = tree
        for _ in range(low):
            start = self.build(item, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.build(item, loop)].append(loop)
            end = self.state()
            self.empty[loop].append(end)
            return end
        end = self.state()
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.build(item, start)
        self.empty[start].append(end)
        return end


class Automaton:
    """step[state * kinds + kind_of[byte]] is the next state; accepts[state] is an index into rule_sets, of the
    rules that have a match ending there, 0 for none. State 0 is the start, from which a match may begin at any byte;
    where it is anchored, at the first byte only, and `dead` is the state that leads nowhere. backwards: the
    patterns are read from their ends. loose: counts above one are any number, as states that count multiply where
    several rules may be under way."""

    def __init__(self, patterns: Sequence[str], most_states: int = 200_000, anchored: bool = False, backwards: bool = False, loose: bool = False) -> None:
        nfa, ends = _Nfa(), {}
        start = nfa.state()
        for i, p in enumerate(patterns):
            parser = _Parser(p)
            tree = parser.choice()
            if parser.at < len(p):
                raise ValueError(f"unbalanced ) in {p}")
            tree = _loosened(tree) if loose else tree
            begin = nfa.state()
            nfa.empty[start].append(begin)
            ends[nfa.build(_reversed(tree) if backwards else tree, begin)] = i
        sets = sorted({s for ms in nfa.moves for s, _ in ms}, key=sorted)
        profile: dict[tuple, int] = {}
        self.kind_of = np.zeros(256, np.uint8)
        for b in range(256):
            self.kind_of[b] = profile.setdefault(tuple(b in s for s in sets), len(profile))
        self.kinds = len(profile)
        first_byte = [int(np.flatnonzero(self.kind_of == k)[0]) for k in range(self.kinds)]

        def closed(state: int) -> int:
            todo, seen, out = [state], {state}, 0
            while todo:
                s = todo.pop()
                if nfa.moves[s] or s in ends:
                    out |= 1 << s
                for t in nfa.empty[s]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return out

        # Sets of states are numbers, a bit a state; reach[s][k]: where a byte of kind k leads from s.
        closure = [closed(s) for s in range(len(nfa.empty))]
        reach = []
        for ms in nfa.moves:
            to = [0] * self.kinds
            for members, t in ms:
                for k in range(self.kinds):
                    if first_byte[k] in members:
                        to[k] |= closure[t]
            reach.append(to)
        origin = closure[start]
        always = 0 if anchored else origin
        known, rows, todo = {origin: 0}, [], [origin]
        groups = []
        for current in todo:
            inside, rest = [], current
            while rest:
                low = rest & -rest
                inside.append(low.bit_length() - 1)
                rest ^= low
            groups.append(inside)
            row = []
            for targets in zip(*(reach[s] for s in inside)) if inside else [()] * self.kinds:
                target = always
                for t in targets:
                    target |= t
                at = known.get(target)
                if at is None:
                    at = known[target] = len(todo)
                    todo.append(target)
                    if at >= most_states:
                        raise ValueError("the rules need too many states together")
                row.append(at)
            rows.append(row)
        step = np.array(rows, np.int64)
        numbered: dict[tuple, int] = {(): 0}
        accepts = np.array([numbered.setdefault(tuple(sorted(ends[s] for s in group if s in ends)), len(numbered)) for group in groups], np.int64)
        self.rule_sets = list(numbered)
        # Minimise: split blocks until no two states of a block differ in the blocks that they lead to. Two states
        # with different rows of blocks have the same sum of random multiples with a probability of 2**-64.
        block = np.unique(accepts, return_inverse=True)[1]
        factor = np.random.default_rng(31).integers(1, 1 << 63, self.kinds + 1, dtype=np.uint64) | np.uint64(1)
        count = 0
        while block.max() + 1 != count:
            count = int(block.max()) + 1
            number = mix(block.astype(np.uint64) + np.uint64(1))
            total = number * factor[-1]
            for k in range(self.kinds):
                total += number[step[:, k]] * factor[k]
            block = np.unique(total, return_inverse=True)[1].reshape(-1)
        block = (block - block[0]) % count  # any numbering does, with the start at 0
        self.states = count
        of = np.zeros(count, np.int64)
        of[block] = np.arange(len(block))
        self.step = block[step[of]].astype(np.int32).reshape(-1)
        self.accepts = accepts[of]
        self.dead = int(block[known[0]]) if 0 in known else -1

    def ends(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(span, end of a match, its rule set) over spans of data, all abreast, each byte read once. first and last:
        where the texts of the spans begin and end, the spans themselves if not given; a text has an end-of-text
        byte before and after it. A span reads on beyond its end until no match that began in it is under way, so
        that matches of any length are found, those that two spans find by both."""
        first, last = begin if first is None else first, end if last is None else last
        order = np.argsort(begin - end, kind="stable")
        begin, length, first, last = begin[order], (end - begin)[order], first[order], last[order]
        table = self.step * np.int32(self.kinds)
        flag = np.zeros(self.states * self.kinds, bool)
        flag[:: self.kinds] = self.accepts != 0
        stop = int(self.kind_of[0])
        kinds = self.kind_of[data]
        state = np.full(len(begin), table[stop], np.int32)
        inner = np.flatnonzero(begin > first)
        state[inner] = table[kinds[begin[inner] - 1]]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def hits(which: np.ndarray, place: np.ndarray) -> None:
            if len(which):
                out.append((order[which], place, self.accepts[state[which] // self.kinds]))

        alive = len(begin)
        for i in range(int(length[0]) if len(length) else 0):
            alive = int(np.searchsorted(-length, -i, "left"))
            where = begin[:alive] + i
            state[:alive] = table[state[:alive] + kinds[where]]
            hit = np.flatnonzero(flag[state[:alive]])
            hits(hit, where[hit] + 1)
        stops = begin + length
        full = stops == last
        state[full] = table[state[full] + stop]
        done = np.flatnonzero(full & flag[state])
        hits(done, stops[done] + 1)
        back = np.empty(len(order), np.int64)  # spans by number
        back[order] = np.arange(len(order))
        on = np.flatnonzero(~full)
        on = on[state[on] != table[kinds[stops[on] - 1]]]
        if len(on):
            steps, of, accepting, more = table.tolist(), kinds.tolist() if len(on) > 64 else kinds, flag.tolist(), []
            reached, ends_at = state.tolist(), stops.tolist()
            for i in on.tolist():
                s, at, limit, after = reached[i], ends_at[i], int(last[i]), int(order[i]) + 1
                while at < limit:
                    k = int(of[at])
                    s, at = steps[s + k], at + 1
                    if accepting[s]:
                        more.append((i, at, s))
                    if s == steps[k]:
                        break
                    if at < limit and at == ends_at[back[after]]:
                        if s == reached[back[after]]:
                            break  # the next span goes on alike
                        after += 1
                else:
                    s = steps[s + stop]
                    if accepting[s]:
                        more.append((i, at + 1, s))
            if more:
                which, place, got = np.array(more, np.int64).T
                out.append((order[which], place, self.accepts[got // self.kinds]))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]

    def starts(self, text: bytes, end: int) -> list[int]:
        """Of an anchored automaton that reads backwards: where its matches begin that end there, the nearest first."""
        steps, kinds, k, state, out = self.step, self.kind_of, self.kinds, 0, []
        for at in range(end - 1, -1, -1):
            state = int(steps[state * k + int(kinds[text[at]])])
            if state == self.dead:
                break
            if self.accepts[state]:
                out.append(at)
        return out
