"""Token counts by finite-state compilation of a byte-level BPE tokenizer.

Two deterministic transducers are compiled from the vocabulary file.

* The splitter reads characters and marks where a piece starts.  Texts of a batch are laid end to end and cut into equal
  chunks; every chunk becomes a map from entry state to exit state, the maps are composed by a parallel prefix scan, and
  with the entry states known all chunks write their marks at once.  Work does not depend on how long one text is.
* The counter reads the bytes of a piece.  A transition carries the change of the number of tokens of what was read, so
  the count of a piece is the sum along its path.  States are made when they are first met and forgotten when there are
  too many, as the automaton of a large vocabulary is too big to write out.
"""

from __future__ import annotations

import json
from itertools import pairwise

import numpy as np
import regex
from pyspark.sql import DataFrame

from tablescope.llm.common import by_text

CHUNK = 128
#: Entries of the lazily built tables above which a task forgets them and starts again.
MOST_STATES = 200_000
MOST_PIECES = 400_000

# splitter states
START, IN_L, IN_N, IN_O, IN_S, JOIN, ONE, TWO = range(8)
# splitter symbols; white space and apostrophes are told apart by what follows
LETTER, NUMBER, OTHER, APO1, APO2, SPACE_MID, BLANK_LAST, SPACE_LAST, END = range(9)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, 1 if the character starts a piece), each by symbol and state."""
    step, out = np.zeros((9, 8), np.uint8), np.zeros((9, 8), np.uint8)
    for state in range(8):
        for symbol, inside in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
            if state == TWO:
                step[symbol, state] = ONE
            elif state == ONE:
                step[symbol, state] = START
            else:
                step[symbol, state] = inside
                out[symbol, state] = state not in (inside, JOIN)
        for symbol, ahead in ((APO1, ONE), (APO2, TWO)):
            joined = state in (IN_O, JOIN)
            step[symbol, state] = IN_O if joined else ahead
            out[symbol, state] = not joined
        step[SPACE_MID, state], out[SPACE_MID, state] = IN_S, state != IN_S
        step[BLANK_LAST, state], out[BLANK_LAST, state] = JOIN, 1
        step[SPACE_LAST, state], out[SPACE_LAST, state] = START, 1
        step[END, state], out[END, state] = START, 1
    return step, out


STEP, STARTS = _splitter()


def char_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE_MID for every code point."""
    found = np.full(0x110000, OTHER, np.uint8)
    points = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE_MID)):
        for m in regex.finditer(pattern, points):
            found[m.start() : m.end()] = kind
    return found


def symbols(points: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Splitter symbols of texts laid end to end, each followed by one separator at ``ends``."""
    kind = classes[points]
    kind[ends] = END
    space = kind == SPACE_MID
    after = np.zeros(len(kind), bool)
    after[:-1] = ~space[1:] & (kind[1:] != END)
    last = space & after
    kind[last] = np.where(points[last] == 32, BLANK_LAST, SPACE_LAST)
    apo = np.flatnonzero((points == 39) & (kind != END))
    if len(apo):
        padded = np.concatenate([np.where(kind == END, 0, points), np.zeros(2, points.dtype)])
        one, two = padded[apo + 1], padded[apo + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kind[apo[short]] = APO1
        kind[apo[long & ~short]] = APO2
    return kind


def scan(kind: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pieces start (separators too): chunk maps, their prefix scan, then all chunks at once."""
    n = len(kind)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, END, np.uint8)
    grid[:n] = kind
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    flat = STEP.ravel()
    maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1)).T.copy()
    for i in range(chunk):
        maps = flat[(grid[i].astype(np.uint16) * 8) + maps]
    # inclusive prefix composition by doubling: after each round a map covers twice as many chunks
    maps = maps.T.copy()
    reach = 1
    while reach < rows:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    state = np.full(rows, START, np.uint8)
    state[1:] = maps[:-1, START]
    out = np.empty((chunk, rows), np.uint8)
    marks = STARTS.ravel()
    for i in range(chunk):
        at = grid[i].astype(np.uint16) * 8 + state
        out[i] = marks[at]
        state = flat[at]
    return np.flatnonzero(out.T.ravel()[:n])


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of the printable byte alphabet: printable Latin-1 stands for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """The counting transducer of one merge list."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[bytes, bytes]]):
        self.ids = {t: i for i, t in enumerate(tokens)}
        rank = {(self.ids[a], self.ids[b]): r for r, (a, b) in enumerate(merges)}
        made = {self.ids[a + b]: (r, self.ids[a], self.ids[b]) for r, (a, b) in reversed(list(enumerate(merges)))}
        self.rank, far = rank, len(merges)
        # the tokens that stand at the right and left edge while a token is built, each with the rank that ends it
        self.right: list[list[tuple[int, int]]] = []
        self.left: list[list[tuple[int, int]]] = []
        for i in range(len(tokens)):
            for spines, side in ((self.right, 2), (self.left, 1)):
                spine, at, until = [], i, far
                while True:
                    spine.append((at, until))
                    if at not in made:
                        break
                    until, at = made[at][0], made[at][side]
                spines.append(spine)
        # prefix tree of the tokens: child by (node, byte), token of a node, whether a node has children
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.inner = [False]
        for t, i in self.ids.items():
            if len(t) > 1 and i not in made:
                continue  # cannot be produced by merges
            node = 0
            for b in t:
                key = node << 8 | b
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.token)
                    self.inner[node] = True
                    self.token.append(-1)
                    self.inner.append(False)
                node = nxt
            self.token[node] = i
        self.forget()

    def forget(self) -> None:
        #: a state: where a token may still begin, as (tree node since then, token before it, tokens there minus now)
        self.states = [((0, -1, 0),)]
        self.names = {self.states[0]: 0}
        self.next: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, int] = {"": 0}

    def apart(self, a: int, b: int) -> bool:
        """Whether no merge ever crosses the border of the neighbours a and b."""
        if a < 0:
            return True
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            known = True
            for x, until_x in self.right[a]:
                for y, until_y in self.left[b]:
                    r = self.rank.get((x, y))
                    if r is not None and r < until_x and r <= until_y:
                        known = False
            self.pairs[key] = known
        return known

    def grow(self, state: int, byte: int) -> int:
        """The transition, as next state * 64 + (change of count + 32)."""
        alive, found, delta = [], -1, 0
        for node, before, ago in self.states[state]:
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            t = self.token[nxt]
            if t >= 0 and found < 0 and self.apart(before, t):
                found, delta = t, ago + 1
            if self.inner[nxt]:
                alive.append((nxt, before, ago))
        new = (*[(node, before, ago - delta) for node, before, ago in alive], (0, found, 0))
        name = self.names.get(new)
        if name is None:
            name = self.names[new] = len(self.states)
            self.states.append(new)
        edge = name << 6 | delta + 32
        self.next[state << 8 | byte] = edge
        return edge

    def count(self, piece: bytes) -> int:
        state, total, edges = 0, 0, self.next
        for b in piece:
            edge = edges.get(state << 8 | b)
            if edge is None:
                edge = self.grow(state, b)
            state = edge >> 6
            total += (edge & 63) - 32
        return total

    def piece(self, text: str) -> int:
        known = self.pieces.get(text)
        if known is None:
            if len(self.states) > MOST_STATES or len(self.pieces) > MOST_PIECES:
                self.forget()
            known = self.count(text.encode("utf-8", "surrogatepass"))
            if len(text) <= 64:
                self.pieces[text] = known
        return known


class TokenCounter:
    """Counts of whole texts for a byte-level BPE file with the usual splitting pattern and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        as_bytes = lambda t: bytes(letters[c] for c in t)
        special = {t["content"] for t in spec["added_tokens"]}
        tokens = [as_bytes(t) for t in spec["model"]["vocab"] if t not in special]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.counter = Counter(tokens, [(as_bytes(a), as_bytes(b)) for a, b in merges])
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.classes = char_classes()

    def __call__(self, texts: list[str]) -> list[int]:
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            cut = self.special.split(text) if self.special else [text]
            extra[i] = len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        joined = "\0".join(parts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) - 1
        starts = scan(symbols(points, ends, self.classes))
        known, piece = self.counter.pieces, self.counter.piece
        borders = starts.tolist()
        pieces = [joined[a:b] for a, b in pairwise(borders)]
        counts = [known.get(p) or 0 for p in pieces]
        numbers = np.array(counts, np.int64)
        is_end = np.isin(starts[:-1], ends)
        for at in np.flatnonzero((numbers == 0) & ~is_end).tolist():
            numbers[at] = piece(pieces[at])
            known = self.counter.pieces
        numbers[is_end] = 0
        upto = np.concatenate([[0], np.cumsum(numbers)])
        at_end = upto[np.searchsorted(starts, ends)]
        by_part = np.diff(np.concatenate([[0], at_end]))
        return (np.bincount(owner, weights=by_part, minlength=len(texts)).astype(np.int64) + extra).tolist()


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """Key, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every text, without begin and end tokens.

    ``path`` is a tokenizer file that every worker has.  Null and empty text have no bytes and no tokens; repeated rows
    and rows without a key keep their row; other columns are not read.  One pass, no shuffle.
    """

    def work():
        counter = TokenCounter(path)

        def act(texts: list[str]) -> dict[str, list]:
            n = counter(texts)
            return {
                "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n,
                "over_limit": [x > limit for x in n],
            }

        return act

    return by_text(docs, key, text, work, "n_bytes long, n_tokens long, over_limit boolean")
