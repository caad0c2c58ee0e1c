"""Finding many fixed strings at once, and applying thousands of ordered rules where they can fire.

The strings become an Aho-Corasick automaton whose moves are completed to a dense table: a row per state, a column per class of
characters.  Texts are cut into lanes that overlap by the longest string, and all lanes take a step together, so a batch of texts
costs a few array operations per step and none per character.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

#: Bytes of moves that one automaton holds; more strings make more automata.
TABLE_BYTES = 32 << 20
#: Characters of a lane, and characters that are walked at a time.
LANE, PIECE = 512, 1 << 20


@dataclass
class Automaton:
    """States by number, 0 the start.  ``moves`` has a row per state; class 0 is of all characters that no string has."""

    classes: np.ndarray
    alphabet: np.ndarray
    moves: np.ndarray
    #: Which state hears a string end, the strings by state (their own, then those of the longest suffix that hears one).
    hears: np.ndarray
    ends: dict[int, tuple[int, ...]]
    longest: int
    column: dict[str, int] | None = None

    @classmethod
    def of(cls, strings: dict[int, str]) -> Automaton:
        """From strings by number; none is empty."""
        letters = sorted({c for s in strings.values() for c in s})
        number = {c: k for k, c in enumerate(letters, 1)}
        children: list[dict[int, int]] = [{}]
        own: dict[int, list[int]] = {}
        for key, s in strings.items():
            at = 0
            for c in s:
                at = children[at].setdefault(number[c], len(children))
                if at == len(children):
                    children.append({})
            own.setdefault(at, []).append(key)
        moves = np.zeros((len(children), len(letters) + 1), dtype=np.int32)
        ends: dict[int, tuple[int, ...]] = {}
        # By breadth: a state's own moves come over those of its longest proper suffix, which is nearer to the start and done.
        level = [(child, 0) for child in children[0].values()]
        for c, child in children[0].items():
            moves[0, c] = child
        while level:
            below = []
            for state, suffix in level:
                heard = tuple(own.get(state, ())) + ends.get(suffix, ())
                if heard:
                    ends[state] = heard
                moves[state] = moves[suffix]
                for c, child in children[state].items():
                    below.append((child, int(moves[suffix, c])))
                    moves[state, c] = child
            level = below
        hears = np.zeros(len(children), dtype=bool)
        hears[list(ends)] = True
        points = np.array([ord(c) for c in letters], dtype=np.uint32)
        return cls(np.arange(1, len(letters) + 1, dtype=np.int32), points, moves, hears, ends, max(map(len, strings.values()), default=0))

    def coded(self, points: np.ndarray) -> np.ndarray:
        """Classes of code points."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, self.classes[at], 0)

    def walked(self, text: str) -> set[int]:
        """The strings that a short text holds, character by character."""
        if self.column is None:
            self.column = {chr(p): k for p, k in zip(self.alphabet.tolist(), self.classes.tolist())}
        column, moves, ends, state, found = self.column, self.moves, self.ends, 0, set()
        for c in text:
            state = moves[state, column[c]] if c in column else 0
            if self.hears[state]:
                found.update(ends[int(state)])
        return found

    def heard(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, state) wherever a string ends, each at least once."""
        n, over = len(points), self.longest - 1
        lane = max(4 * over, 16, min(LANE, n // 512))
        starts = np.arange(0, n, lane)
        codes = np.concatenate((np.zeros(over, np.int32), self.coded(points), np.zeros(lane, np.int32)))
        state = np.zeros(len(starts), dtype=np.int32)
        where, which = [], []
        for step in range(over + lane):
            state = self.moves[state, codes[starts + step]]
            found = np.flatnonzero(self.hears[state])
            if len(found):
                where.append(starts[found] + (step - over))
                which.append(state[found])
        return (np.concatenate(where), np.concatenate(which)) if where else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@dataclass
class Finder:
    """Automata over all strings, none larger than ``TABLE_BYTES``."""

    automata: list[Automaton]
    longest: int
    #: Strings found in short stretches, which come again and again.
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, strings: list[str], table_bytes: int = TABLE_BYTES) -> Finder:
        automata, part, letters, states = [], {}, set(), 1
        for key, s in enumerate(strings):
            more = letters | set(s)
            if part and (states + len(s)) * (len(more) + 1) * 4 > table_bytes:
                automata.append(Automaton.of(part))
                part, more, states = {}, set(s), 1
            part[key] = s
            letters, states = more, states + len(s)
        if part:
            automata.append(Automaton.of(part))
        return cls(automata, max(map(len, strings), default=0))

    def size(self) -> int:
        return sum(a.moves.nbytes for a in self.automata)

    def found(self, texts: list[str]) -> list[set[int]]:
        """The strings that each text holds."""
        out: list[set[int]] = [set() for _ in texts]
        for first, last, points in self.pieces(texts):
            ends = np.cumsum([len(p) + 1 for p in points])
            joined = np.concatenate([x for p in points for x in (p, _BREAK)])
            for a in self.automata:
                where, which = a.heard(joined)
                pairs = np.unique(np.searchsorted(ends, where, side="right") * len(a.moves) + which)
                for owner, state in zip((pairs // len(a.moves)).tolist(), (pairs % len(a.moves)).tolist()):
                    out[first + owner].update(a.ends[state])
        return out

    def pieces(self, texts: list[str]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """Runs of texts of about ``PIECE`` characters; a longer text comes alone, in parts that overlap."""
        first, total, run = 0, 0, []
        for k, text in enumerate(texts):
            if run and total + len(text) > PIECE:
                yield first, k, run
                run = []
            if not run:
                first, total = k, 0
            if len(text) > PIECE:
                for at in range(0, len(text), PIECE):
                    yield k, k + 1, [code_points(text[max(0, at - self.longest + 1) : at + PIECE])]
                continue
            run.append(code_points(text))
            total += len(text)
        if run:
            yield first, len(texts), run

    def in_stretch(self, text: str) -> tuple[int, ...]:
        """The strings that a short stretch holds."""
        if text not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[text] = tuple({k for a in self.automata for k in a.walked(text)})
        return self.known[text]


_BREAK = np.array([0x110000], dtype=np.uint32)  # no character


def changed_places(text: str, source: str, target: str, terms: tuple[str, ...], reach: int) -> tuple[str, list[int]]:
    """The text with ``source`` replaced, and where in it the targets begin.

    Sources are taken from left to right without overlap.  With terms, one is replaced only where a term stands within ``reach``
    characters around it in the text as it was.
    """
    parts, places, at, length = [], [], 0, 0
    while (hit := text.find(source, at)) >= 0:
        parts.append(text[at:hit])
        length += hit - at
        at = hit + len(source)
        near = text[max(0, hit - reach) : at + reach]
        if terms and not any(t in near for t in terms):
            parts.append(source)
            length += len(source)
            continue
        places.append(length)
        parts.append(target)
        length += len(target)
    return "".join([*parts, text[at:]]), places


def applied(text: str, holds: Iterable[int], rules: list[tuple[str, str, tuple[str, ...], int]], finder: Finder) -> tuple[str, list[int]]:
    """A text after all rules (source, target, terms, reach) in order, and the numbers of those that changed it.

    ``holds`` are the rules whose source the text holds.  A rule can bring about the source of a later one only around what it
    changed, so only the surroundings of its targets are searched again.
    """
    waiting = list(holds)
    heapq.heapify(waiting)
    queued, fired = set(waiting), []
    around = finder.longest - 1
    while waiting:
        k = heapq.heappop(waiting)
        source, target, terms, reach = rules[k]
        made, places = changed_places(text, source, target, terms, reach)
        if not places:
            continue
        text = made
        fired.append(k)
        for stretch in {text[max(0, p - around) : p + len(target) + around] for p in places}:
            for later in finder.in_stretch(stretch):
                if later > k and later not in queued:
                    queued.add(later)
                    heapq.heappush(waiting, later)
    return text, fired
