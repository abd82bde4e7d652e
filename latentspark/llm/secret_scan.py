"""Secret scan by one deterministic automaton for all rules.

Each rule's regex (bytes; classes, groups, alternation, ?, *, +, {n}, {n,}) becomes a Thompson automaton; their union behind a loop over
any byte is made deterministic by subset construction and minimised; the result is one transition array over byte classes. A text
is read once: state after each byte, rules that accept there. Pairs of bytes that lead from every state to one and the same state
cut the bytes in lanes that step through the array side by side. Where a rule accepts, the text between the next bytes that lead from
everywhere to the start, which no match crosses, is settled by transition arrays too: the rule's reversed automaton, run backwards, marks where
matches begin, and from there its own one finds their longest end. Leftmost, non-overlapping, and in linear time however often a
rule begins to match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, tidy, whole


@dataclass(frozen=True)
class Rule:
    """A match is the regex head and then all bytes of the class tail that follow, one at least (no tail: the head alone). Of the leftmost, non-overlapping matches those are reported that have least_tail bytes of tail and least bytes in all; fold: letters of either case. What `more` matches right behind a reported match belongs to it, over bytes that part all other matches: the lines of a key."""

    kind: str
    head: str
    tail: str = ""
    least_tail: int = 0
    least: int = 1
    fold: bool = False
    more: str = ""

    @property
    def full(self) -> str:
        return f"(?:{self.head}){self.tail}+" if self.tail else self.head

    @property
    def sure(self) -> str:
        """What every reported match begins with, and as little else as possible: the head and some of the tail, all of the least one if there is no head."""
        return f"(?:{self.head}){self.tail}{{{min(self.least_tail, QUIET) if self.head else self.least_tail}}}" if self.tail else self.head


#: Bytes of a tail that the common automaton waits for behind a head.
QUIET = 4
BASE = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]", least_tail=8, fold=True),
    Rule("access", "AKIA", "[A-Z0-9]", least_tail=12),
    Rule("hex", "", "[0-9a-f]", least_tail=32),
)
#: Behind the first line of a key: fields, then all up to its last line, or, where that is missing, lines that are no prose.
_PEM_FIELDS = "(?:[\\x09-\\x0D\\x20]*[A-Z][A-Za-z-]*:\\x20[A-Za-z0-9,-]*[\\x0A\\x0D])*"
_PEM_BODY = "(?:[\\x09-\\x0D\\x20]*[A-Za-z0-9+/=]+)*[\\x09-\\x0D\\x20]*-----END(?:\\x20[A-Z]+)*\\x20PRIVATE\\x20KEY-----"
_PEM_CUT = "(?:[\\x09-\\x0D\\x20]*[A-Za-z0-9+/=]{16,})+(?:[\\x09-\\x0D\\x20]+[A-Za-z0-9+/]+=)?"
#: What the method adds to the base rules.
ADDED = (
    Rule("forge", "gh[opusr]_", "[A-Za-z0-9]", least_tail=36),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.", "[A-Za-z0-9_-]", least_tail=1, least=30),
    Rule("pem", "-----BEGIN(?:\\x20[A-Z]+)*\\x20PRIVATE\\x20KEY-----", more=_PEM_FIELDS + "(?:" + _PEM_BODY + "|" + _PEM_CUT + ")"),
)
RULES = BASE + ADDED


# ---- regex to automaton ----------------------------------------------------------------------------------------------


class Nfa:
    """States with byte edges (mask of bytes, target) and empty edges."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, pattern: str, fold: bool, start: int, backwards: bool = False) -> int:
        """Adds the pattern, or what it matches read backwards, from start on; returns its accepting state."""
        tree, rest = _alternatives(pattern, 0)
        if rest != len(pattern):
            raise ValueError(f"unbalanced pattern: {pattern}")
        return self._build(_reversed(tree) if backwards else tree, fold, start)

    def _build(self, node: tuple, fold: bool, at: int) -> int:
        kind = node[0]
        if kind == "set":
            chars = node[1]
            if fold:
                chars = chars | {c ^ 32 for c in chars if 65 <= c & ~32 <= 90}
            to = self.state()
            self.edges[at].append((frozenset(chars), to))
            return to
        if kind == "cat":
            for x in node[1]:
                at = self._build(x, fold, at)
            return at
        if kind == "or":
            end = self.state()
            for x in node[1]:
                begin = self.state()
                self.empty[at].append(begin)
                self.empty[self._build(x, fold, begin)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            at = self._build(inner, fold, at)
        if high is None:
            loop, end = self.state(), self.state()
            self.empty[at].append(loop)
            self.empty[self._build(inner, fold, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        self.empty[at].append(end)
        for _ in range(high - low):
            at = self._build(inner, fold, at)
            self.empty[at].append(end)
        return end


def _reversed(node: tuple) -> tuple:
    kind = node[0]
    if kind == "cat":
        return ("cat", [_reversed(x) for x in reversed(node[1])])
    if kind == "or":
        return ("or", [_reversed(x) for x in node[1]])
    return ("repeat", _reversed(node[1]), *node[2:]) if kind == "repeat" else node


def _alternatives(p: str, i: int) -> tuple[tuple, int]:
    options, items = [], []
    while i < len(p) and p[i] != ")":
        if p[i] == "|":
            options.append(("cat", items))
            items, i = [], i + 1
            continue
        if p[i] == "(":
            i += 3 if p.startswith("(?:", i) else 1
            item, i = _alternatives(p, i)
            i += 1
        elif p[i] == "[":
            item, i = _char_class(p, i + 1)
        else:
            code, i = _char(p, i)
            item = ("set", {code})
        if i < len(p) and p[i] in "?*+{":
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[p[i]]
            if p[i] == "{":
                end = p.index("}", i)
                first, _, last = p[i + 1 : end].partition(",")
                low = int(first)
                high = (int(last) if last else None) if "," in p[i:end] else low
                i = end
            item, i = ("repeat", item, low, high), i + 1
        items.append(item)
    options.append(("cat", items))
    return (("or", options) if len(options) > 1 else options[0]), i


def _char(p: str, i: int) -> tuple[int, int]:
    if p[i] != "\\":
        return ord(p[i]), i + 1
    if p[i + 1] == "x":
        return int(p[i + 2 : i + 4], 16), i + 4
    return ord(p[i + 1]), i + 2


def _char_class(p: str, i: int) -> tuple[tuple, int]:
    chars: set[int] = set()
    while p[i] != "]":
        low, i = _char(p, i)
        if p[i] == "-" and p[i + 1] != "]":
            high, i = _char(p, i + 1)
            chars |= set(range(low, high + 1))
        else:
            chars.add(low)
    return ("set", chars), i + 1


@dataclass
class Automaton:
    """table[state * classes + byte_class[b]] is the next state; accepts[state] has a bit for each of the finals; state 0 is the start."""

    table: np.ndarray
    byte_class: np.ndarray
    accepts: np.ndarray
    classes: int

    @property
    def resets(self) -> np.ndarray:
        """Bytes that lead to the start from everywhere."""
        return (self.table.reshape(-1, self.classes) == 0).all(0)[self.byte_class]

    @property
    def merged(self) -> np.ndarray:
        """[class of one byte * classes + class of the next]: the state that the two lead to from everywhere, or -1."""
        small = self.table.reshape(-1, self.classes)
        after = small[small]  # state, first class, second class
        return np.where((after == after[:1]).all(0), after[0], -1).reshape(-1)


def deterministic(nfa: Nfa, start: int, final: dict[int, int], anywhere: bool) -> Automaton:
    """The minimal automaton of nfa; anywhere: matches may begin behind any byte. final: bits of accepting states."""
    # bytes that no edge tells apart form a class
    sets = {s for edges in nfa.edges for s, _ in edges}
    signature = [tuple(b in s for s in sets) for b in range(256)]
    names = {x: i for i, x in enumerate(dict.fromkeys(signature))}
    byte_class = np.array([names[x] for x in signature], np.uint8)
    sample = {int(c): b for b, c in reversed(list(enumerate(byte_class)))}
    width = len(names)

    def closed(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    first = closed({start})
    ids, rows, queue = {first: 0}, [], [first]
    for current in queue:
        row = []
        for c in range(width):
            to = closed({t for s in current for chars, t in nfa.edges[s] if sample[c] in chars} | ({start} if anywhere else set()))
            if to not in ids:
                ids[to] = len(ids)
                queue.append(to)
            row.append(ids[to])
        rows.append(row)
    table = np.array(rows)
    bits = np.array([sum({final[x] for x in st if x in final}) for st in queue])
    # minimise: split blocks by what they accept and where they go, until nothing splits
    block = np.unique(bits, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if new.max() == block.max():
            break
        block = new
    order = np.full(block.max() + 1, -1)
    order[block[0]] = 0
    rest = [b for b in range(block.max() + 1) if b != block[0]]
    order[rest] = np.arange(1, len(rest) + 1)
    block = order[block]
    small, accept = np.zeros((len(rest) + 1, width), np.int32), np.zeros(len(rest) + 1, np.int64)
    small[block], accept[block] = block[table], bits
    return Automaton(small.reshape(-1), byte_class, accept, width)


def compile_rules(rules: tuple[Rule, ...]) -> Automaton:
    """The common automaton: bit k is rule k's."""
    nfa = Nfa()
    start, final = nfa.state(), {}
    for k, rule in enumerate(rules):
        begin = nfa.state()
        nfa.empty[start].append(begin)
        final[nfa.add(rule.sure, rule.fold, begin)] = 1 << k
    return deterministic(nfa, start, final, anywhere=True)


class Settler:
    """One rule's own automata: forwards from where a match begins (bit 1: a match ends, bit 2: its head ends), and backwards to where matches begin."""

    def __init__(self, rule: Rule) -> None:
        self.rule = rule
        ahead, back = Nfa(), Nfa()
        start = ahead.state()
        head, whole = ahead.state(), ahead.state()
        ahead.empty[start] += [head, whole]
        self.ahead = self._lists(deterministic(ahead, start, {ahead.add(rule.full, rule.fold, whole): 1} | ({ahead.add(rule.head, rule.fold, head): 2} if rule.tail and rule.head else {}), anywhere=False))
        start = back.state()
        self.back = self._lists(deterministic(back, start, {back.add(rule.full, rule.fold, start, backwards=True): 1}, anywhere=True))
        on = Nfa()
        start = on.state()
        self.on = self._lists(deterministic(on, start, {on.add(rule.more, rule.fold, start): 1}, anywhere=False)) if rule.more else None

    @staticmethod
    def _lists(auto: Automaton) -> tuple[bytes, list[int], dict[int, int], set[int]]:
        """Byte classes, transitions between states times the number of classes, bits of accepting ones, dead ones."""
        w = auto.classes
        small = auto.table.reshape(-1, w)
        dead = {i * w for i in range(len(small)) if (small[i] == i).all() and not auto.accepts[i]}
        return bytes(auto.byte_class.tolist()), (auto.table * w).tolist(), {i * w: int(b) for i, b in enumerate(auto.accepts) if b}, dead

    def spans(self, text: bytes) -> list[tuple[int, int]]:
        """(start, end) of the reported matches in text."""
        classes, table, accepts, _ = self.back
        state, starts, x = 0, [], text.translate(classes)
        for i in range(len(x) - 1, -1, -1):
            state = table[state + x[i]]
            if state in accepts:
                starts.append(i)
        classes, table, accepts, dead = self.ahead
        x, to, out, rule = text.translate(classes), 0, [], self.rule
        for s in reversed(starts):
            if s < to:
                continue
            state, head = 0, s
            for i in range(s, len(x)):
                state = table[state + x[i]]
                if state in dead:
                    break
                bits = accepts.get(state, 0)
                if bits & 1:
                    to = i + 1
                if bits & 2:
                    head = i + 1
            if to - head >= rule.least_tail and to - s >= rule.least:
                out.append((s, to))
        return out


    def followed(self, data: np.ndarray, at: int, end: int) -> int:
        """Where the longest match of the rule's `more` from `at` on ends, `at` without one; data is read up to end at most."""
        classes, table, accepts, dead = self.on
        state, to = 0, at
        for a in range(at, end, 4096):
            for i, c in enumerate(data[a : min(a + 4096, end)].tobytes().translate(classes), a):
                state = table[state + c]
                if state in dead:
                    return to
                if state in accepts:
                    to = i + 1
        return to


#: Pieces that step through the automaton side by side, bytes that each has at least, and pieces that are stepped through one by one if so few are left.
LANES, LANE_BYTES, FEW = 4096, 64, 32


def accepting_places(auto: Automaton, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in data right behind which some rule accepts, and the bits of the rules."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    classes = auto.byte_class[data].astype(np.int32)
    known = auto.merged[classes[:-1] * auto.classes + classes[1:]]
    cuts = np.flatnonzero(known >= 0)
    step = max(LANE_BYTES, -(-n // LANES))
    at = np.searchsorted(cuts, np.arange(step, n, step))
    cuts = np.unique(cuts[at[at < len(cuts)]])
    cuts = cuts[cuts + 2 < n]
    begin, state = np.concatenate([[0], cuts + 2]), np.concatenate([[0], known[cuts]]).astype(np.int32)
    length = np.diff(np.append(begin, n))
    by = np.argsort(-length, kind="stable")
    begin, length, state = begin[by], length[by], state[by]
    loud = auto.accepts > 0
    together = int(length[FEW]) if len(length) > FEW else 0
    alive = np.searchsorted(-length, -np.arange(1, together + 1), "right")
    places, bits = [], []
    for i in range(together):
        k = int(alive[i])
        state[:k] = auto.table[state[:k] * auto.classes + classes[begin[:k] + i]]
        hit = loud[state[:k]]
        if hit.any():
            who = np.flatnonzero(hit)
            places.append(begin[who] + i)
            bits.append(auto.accepts[state[who]])
    # the few longest pieces, from there on
    table, accepts, w = (auto.table * auto.classes).tolist(), {i * auto.classes: int(b) for i, b in enumerate(auto.accepts) if b}, auto.classes
    for b, e, st in zip((begin[:FEW] + together).tolist(), (begin[:FEW] + length[:FEW]).tolist(), state[:FEW].tolist(), strict=True):
        st *= w
        found = []
        for i, c in enumerate(classes[b:e].tolist(), b):
            st = table[st + c]
            if st in accepts:
                found.append((i, accepts[st]))
        if found:
            places.append(np.array([f[0] for f in found]))
            bits.append(np.array([f[1] for f in found]))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, bits = np.concatenate(places), np.concatenate(bits)
    by = np.argsort(places, kind="stable")
    return places[by], bits[by]


def spans_of_texts(column: pa.Array, rules: tuple[Rule, ...], auto: Automaton) -> Iterator[list[tuple[int, int, int]]]:
    """For each text its (start, rule, end) in bytes, by start, then rule."""
    settlers = [Settler(r) for r in rules]
    can_reset = auto.resets
    for _, data, offsets in text_slices(column):
        found: list[set[tuple[int, int, int]]] = [set() for _ in range(len(offsets) - 1)]
        # a zero byte between texts: no rule has it, so it leads to the start
        apart = np.zeros(len(data) + len(offsets) - 1, np.uint8)
        lengths = np.diff(offsets)
        own = np.repeat(np.arange(len(lengths)), lengths)
        apart[np.arange(len(data)) + own] = data
        where = offsets[:-1] + np.arange(len(lengths))
        places, bits = accepting_places(auto, apart)
        if len(places):
            resets = np.flatnonzero(can_reset[apart])
            row = np.searchsorted(where, places, "right") - 1
            after = np.searchsorted(resets, places)
            left = np.where(after > 0, resets[np.maximum(after - 1, 0)] + 1, 0)
            right = np.where(after < len(resets), resets[np.minimum(after, max(0, len(resets) - 1))], len(apart))
            for k, settler in enumerate(settlers):
                mine = np.flatnonzero(bits >> k & 1)
                begins, first = np.unique(left[mine], return_index=True)
                upto: dict[int, int] = {}  # of each text: where the last match of a rule that goes on ends
                for a, b, i in zip(begins.tolist(), right[mine[first]].tolist(), row[mine[first]].tolist(), strict=True):
                    base = a - int(where[i])
                    for s, e in settler.spans(apart[a:b].tobytes()):
                        s, e = base + s, base + e
                        if settler.on:
                            if s < upto.get(i, 0):
                                continue
                            e = upto[i] = settler.followed(apart, int(where[i]) + e, int(where[i] + lengths[i])) - int(where[i])
                        found[i].add((s, k, e))
        yield from (sorted(x) for x in found)


@whole
def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans (array of kind, start, end in code points, by start, then rule order) of every row of docs.

    Null and empty texts have no spans; texts of any length are read whole. Rows keep their ids, null and repeated ones too; an empty
    table gives an empty one; other columns are not read.
    """
    auto = compile_rules(rules)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, spans in enumerate(spans_of_texts(batch.column(1), rules, auto)):
                if spans:
                    text = batch.column(1)[i].as_py().encode()
                    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]) if not text.isascii() else None
                    at = (lambda x: x) if before is None else (lambda x, b=before: int(b[x]))
                    spans = [{"kind": rules[k].kind, "start": at(s), "end": at(e)} for s, k, e in spans]
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, span_type)], ["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(rows), f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def scan_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text) of every row of docs, from scan_documents."""
    base = [r.kind for r in BASE]
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    found = scan_documents(docs)
    of_kind = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *(of_kind(k).alias(f"n_{k}") for k in base), F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), joined("spans").alias("spans"))


@whole
def redacted(docs: DataFrame) -> DataFrame:
    """docs, each secret in text replaced by `[kind]`; texts without secrets, null ones too, are as they were. n_chars follows the text if there is such a column.

    Every row and column stays, null and repeated ids and columns of any name too; spans that overlap are masked as one; an empty table stays empty.
    """
    auto = compile_rules(RULES)
    names = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            column, changed = batch.column(at), {}
            for i, spans in enumerate(spans_of_texts(column, RULES, auto)):
                if spans:
                    text, out, to = column[i].as_py().encode(), [], 0
                    for s, k, e in spans:
                        if s >= to:
                            out += [text[to:s], f"[{RULES[k].kind}]".encode()]
                        elif e <= to:
                            continue
                        to = e
                    changed[i] = b"".join([*out, text[to:]]).decode()
            if changed:
                texts = column.to_pylist()
                for i, x in changed.items():
                    texts[i] = x
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                n = batch.schema.get_field_index("n_chars")
                if n >= 0:
                    counts = batch.column(n).to_pylist()
                    for i, x in changed.items():
                        counts[i] = len(x)
                    batch = batch.set_column(n, batch.schema.field(n), pa.array(counts, batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(tidy(rows), docs.schema).select(*names)
