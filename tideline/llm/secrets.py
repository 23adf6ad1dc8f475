"""Secret scans: one minimal deterministic automaton for all rules, stepped once per byte.

Rule expressions become an NFA; subset construction over byte classes and minimisation give one
transition array for "some match of these rules ends here".  Documents are cut at bytes that send
every state back to the start, and all pieces of a slice advance in step on numpy arrays.  Where
a match ends, the reversed automaton of its rule walks back to the leftmost start.

Cases: a null text counts as empty and has no spans; repeated rows each give a row; a null key
stays null; other columns are ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged
from .shared import texts

_parser = re._parser  # the standard library's own expression trees


@dataclass(frozen=True)
class Rule:
    """``pattern`` must end its match greedily; spans where ``keep`` does not match are dropped."""

    kind: str
    pattern: str
    keep: str = ""


#: The base kinds, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""),
    Rule("access", r"AKIA[A-Z0-9]+", r".{20,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Published shapes of further credentials.  Each open-ended rule doubles the automaton's
#: states, so minimum lengths are left to ``keep`` except for hex, whose every letter would end a match.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosting", r"gh[opsu]_[A-Za-z0-9]+", r".{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)


class _Nfa:
    """States with silent moves and moves on byte sets."""

    def __init__(self) -> None:
        self.silent: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.silent.append([])
        self.moves.append([])
        return len(self.silent) - 1

    def add(self, tree, at: int, fold: bool) -> int:
        """Append the expression behind state ``at``; returns its last state."""
        for op, arg in tree:
            name = str(op)
            if name in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
                to = self.state()
                self.moves[at].append((_bytes_of(name, arg, fold), to))
                at = to
            elif name == "SUBPATTERN":
                _, on, off, inner = arg
                at = self.add(inner, at, (fold or bool(on & re.IGNORECASE)) and not off & re.IGNORECASE)
            elif name == "BRANCH":
                to = self.state()
                for inner in arg[1]:
                    begin = self.state()
                    self.silent[at].append(begin)
                    self.silent[self.add(inner, begin, fold)].append(to)
                at = to
            elif name == "MAX_REPEAT":
                least, most, inner = arg
                for _ in range(least):
                    at = self.add(inner, at, fold)
                if str(most) == "MAXREPEAT":
                    begin, to = self.state(), self.state()
                    self.silent[at] += [begin, to]
                    self.silent[self.add(inner, begin, fold)] += [begin, to]
                    at = to
                else:
                    to = self.state()
                    for _ in range(most - least):
                        self.silent[at].append(to)
                        at = self.add(inner, at, fold)
                    self.silent[at].append(to)
                    at = to
            else:
                raise ValueError(f"rules cannot use {name}")
        return at


def _bytes_of(name: str, arg, fold: bool) -> frozenset[int]:
    if name == "ANY":
        return frozenset(range(256)) - {10}
    if name == "NOT_LITERAL":
        return frozenset(range(256)) - _bytes_of("LITERAL", arg, fold)
    if name == "LITERAL":
        if arg > 127:
            raise ValueError("rules are ASCII")
        both = {ord(chr(arg).lower()), ord(chr(arg).upper())} if fold and chr(arg).isalpha() else {arg}
        return frozenset(both)
    found: set[int] = set()
    for op, x in arg:
        if str(op) == "RANGE":
            found |= {b for c in range(x[0], x[1] + 1) for b in _bytes_of("LITERAL", c, fold)}
        elif str(op) == "LITERAL":
            found |= _bytes_of("LITERAL", x, fold)
        elif str(op) != "NEGATE":
            raise ValueError(f"rules cannot use {op}")
    return frozenset(range(256)) - found if str(arg[0][0]) == "NEGATE" else frozenset(found)


@dataclass
class Automaton:
    """Minimal deterministic automaton; ``step[state * width + classes[byte]]`` is the next state times ``width``.

    ``accept`` (indexed by state times width) has bit r set where a match of rule r ends.
    """

    classes: np.ndarray
    width: int
    start: int
    step: np.ndarray
    accept: np.ndarray
    reset: np.ndarray  # bytes that lead from every state to the start


def determinise(nfa: _Nfa, first: set[int], finals: dict[int, int]) -> Automaton:
    """Subset construction over byte classes, then minimisation by refinement."""
    labels = {s for moves in nfa.moves for s, _ in moves}
    classes = np.zeros(256, np.int64)
    for s in labels:
        member = np.zeros(256, np.int64)
        member[list(s)] = 1
        classes = np.unique(classes * 2 + member, return_inverse=True)[1]
    width = int(classes.max()) + 1
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(width)]

    def closure(states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in nfa.silent[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    number = {closure(first): 0}
    order = list(number)
    rows: list[list[int]] = []
    for subset in order:
        moves = [m for s in subset for m in nfa.moves[s]]
        row = []
        for byte in sample:
            to = closure({t for s, t in moves if byte in s})
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    table = np.array(rows, np.int64)
    accept = np.array([sum({1 << finals[s] for s in subset if s in finals}) for subset in order], np.int64)
    block, n = np.unique(accept, return_inverse=True)[1], 0
    while n != (n := int(block.max()) + 1):
        block = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
    pick = np.zeros(n, np.int64)
    pick[block] = np.arange(len(block))
    table, accept, start = block[table[pick]], accept[pick], int(block[0])
    wide = np.zeros(n * width, np.int64)
    wide[::width] = accept
    return Automaton(classes.astype(np.uint8), width, start * width, (table * width).ravel().astype(np.int32), wide, (table == start).all(axis=0)[classes])


def compile_rules(rules: tuple[Rule, ...]) -> Automaton:
    """All rules, a match beginning anywhere."""
    nfa = _Nfa()
    root = nfa.state()
    nfa.moves[root].append((frozenset(range(256)), root))
    finals = {}
    for r, rule in enumerate(rules):
        begin = nfa.state()
        nfa.silent[root].append(begin)
        tree = _parser.parse(rule.pattern)
        finals[nfa.add(tree, begin, bool(tree.state.flags & re.IGNORECASE))] = r
    return determinise(nfa, {root}, finals)


def compile_reversed(rule: Rule) -> Automaton:
    """One rule read backwards from the end of a match."""
    nfa = _Nfa()
    begin = nfa.state()
    tree = _parser.parse(rule.pattern)
    last = nfa.add(tree, begin, bool(tree.state.flags & re.IGNORECASE))
    back = _Nfa()
    for _ in nfa.moves:
        back.state()
    for s, (silent, moves) in enumerate(zip(nfa.silent, nfa.moves)):
        for t in silent:
            back.silent[t].append(s)
        for label, t in moves:
            back.moves[t].append((label, s))
    return determinise(back, {last}, {begin: 0})


class Scanner:
    """Spans of all rules in flat texts."""

    def __init__(self, rules: tuple[Rule, ...], lane: int = 512):
        self.rules, self.lane = rules, lane
        self.forward = compile_rules(rules)
        self.backward = [self._lists(compile_reversed(r)) for r in rules]
        self.keep = [re.compile(r.keep.encode(), re.DOTALL) if r.keep else None for r in rules]

    @staticmethod
    def _lists(a: Automaton) -> tuple[list[list[int]], list[bool], int]:
        table = (a.step.reshape(-1, a.width) // a.width)[:, a.classes]
        return table.tolist(), (a.accept[:: a.width] > 0).tolist(), a.start // a.width

    def ends(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions behind a byte at which some match ends, ascending, and the rules (as bits) there."""
        a = self.forward
        resets = np.flatnonzero(a.reset[buf])
        targets = np.arange(self.lane, len(buf), self.lane)
        at = np.searchsorted(resets, targets)
        cuts = resets[at[at < len(resets)]] + 1
        edges = np.unique(np.concatenate([cuts, offs]))
        begin, size = edges[:-1], np.diff(edges)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        inputs = a.classes[buf]
        state = np.full(len(begin), a.start, np.int32)
        open_lanes = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
        found, masks = [], []
        for k, n in enumerate(open_lanes):
            s = a.step[state[:n] + inputs[begin[:n] + k]]
            state[:n] = s
            mask = a.accept[s]
            if mask.any():
                hit = np.flatnonzero(mask)
                found.append(begin[hit] + k + 1)
                masks.append(mask[hit])
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        where, mask = np.concatenate(found), np.concatenate(masks)
        order = np.argsort(where, kind="stable")
        return where[order], mask[order]

    def spans(self, buf: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Text number to its (start, rule, end) in bytes within the text, ascending: leftmost, greedy, non-overlapping per rule."""
        where, mask = self.ends(buf, offs)
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        raw = buf.tobytes() if len(where) else b""
        for r in range(len(self.rules)):
            mine = where[(mask >> r) & 1 == 1]
            if not len(mine):
                continue
            text = np.searchsorted(offs, mine, "left") - 1
            final = np.append((np.diff(mine) != 1) | (np.diff(text) != 0), True)  # the longest of a run of ends
            table, accept, start = self.backward[r]
            free, of = 0, -1
            for e, d in zip(mine[final].tolist(), text[final].tolist()):
                base = int(offs[d])
                free = base if d != of else free
                of, state, first = d, start, None
                for p in range(e - 1, free - 1, -1):
                    state = table[state][raw[p]]
                    if accept[state]:
                        first = p
                    elif not self._alive(r, state):
                        break
                if first is None:
                    continue
                free = e
                if self.keep[r] is None or self.keep[r].fullmatch(raw, first, e):
                    out[d].append((first - base, r, e - base))
        for found in out.values():
            found.sort()
        return out

    @lru_cache(maxsize=None)  # noqa: B019  one scanner lives as long as its worker
    def _alive(self, r: int, state: int) -> bool:
        """Whether an accepting state can still be reached."""
        table, accept, _ = self.backward[r]
        seen, todo = {state}, [state]
        while todo:
            s = todo.pop()
            if accept[s]:
                return True
            for t in set(table[s]) - seen:
                seen.add(t)
                todo.append(t)
        return False


@lru_cache(4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, spans array<struct<kind, start, end>>`` of every row, in code points, by start and then rule order."""
    rows = texts(docs, key, text=text)
    kind = rows.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    compiled = docs.sparkSession.sparkContext.broadcast(scanner(rules))  # its size depends on the rules alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = compiled.value
        for part, buf, offs in ragged.slices(batches, text):
            out: list[list[dict]] = [[]] * part.num_rows
            for d, found in scan.spans(buf, offs).items():
                chars = np.concatenate([[0], np.cumsum((buf[offs[d] : offs[d + 1]] & 0xC0) != 0x80)])
                out[d] = [{"kind": rules[r].kind, "start": int(chars[a]), "end": int(chars[b])} for a, r, b in found]
            yield pa.record_batch([part.column(key), pa.array(out, span)], [key, "spans"])

    return rows.mapInArrow(run, f"`{key}` {kind}, spans array<struct<kind:string,start:long,end:long>>")


def secret_digest(found: DataFrame, *, key: str = "doc_id", base: tuple[str, ...] = tuple(r.kind for r in BASE_RULES)) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    own = F.filter("spans", lambda s: s["kind"].isin(*base))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    return found.select(key, *counts, F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
