"""Tokenizers compiled to deterministic finite-state transducers that count or cut tokens.

Two transducers run in cascade.

* Cutting: characters fall into a dozen classes; a machine over those classes marks where each
  word-like piece of the tokenizer's split pattern begins. A long stream is cut into chunks. Every chunk
  is first summarised by its state map (a function from entry state to end state); the maps are elements of the
  machine's finite transition monoid, so a map is one small integer and composing two is a table lookup.
  A parallel prefix scan composes them into each chunk's entry state, after which all chunks emit at once.
* Counting: within a piece, a second machine reads bytes; each transition carries the number of tokens that it
  adds (it may be negative when a longer token replaces shorter ones). Its states are made when first met, as in
  lazily determinised regular expressions, and forgotten when there are too many.

The counting machine rests on one property of byte-pair encoding: a token sequence is an encoding exactly if each pair
of neighbours is. The state after a prefix therefore needs only, for each place where a still growing
token could begin, the token that ends there and the count up to there.
"""

from __future__ import annotations

import json

import numpy as np

# Character classes of the cutting machines.
SPACE, WHITE, NUMBER, APOSTROPHE, OTHER, STMD, R, V, L, E, LETTER, END = range(12)
N_CLASSES = 12

# States: nothing pending; in letters, in a number, in other signs; white space of length 1 or more that ends in a
# space or another blank; an apostrophe that begins a piece, then followed by r, v or l.
START, IN_L, IN_N, IN_O, SP1, SPN, WS1, WSN, AP, AP_R, AP_V, AP_L = range(12)
N_STATES = 12
HERE, BEFORE = 1, 2  # marks: a piece begins at this character, at the one before


def char_classes(split=None) -> np.ndarray:
    """Class of every code point, by Unicode properties.

    split, a tokenizer's pre_tokenize_str, settles code points that its older Unicode tables don't know yet: no
    piece begins there after a hyphen.
    """
    import regex

    every = "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    for chars, kind in ((" ", SPACE), ("'", APOSTROPHE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        for c in chars:
            table[ord(c)] = kind
    if split:
        named = np.flatnonzero((table == LETTER) | (table == NUMBER))
        probe = "".join(f" -{chr(c)}-" for c in named.tolist())
        begins = np.zeros(len(probe), bool)
        begins[[a for _, (a, _) in split(probe)]] = True
        table[named[~begins[2::4]]] = OTHER
    return table


def cutting_tables(joins_space: bool, single_numbers: bool) -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks for (state, class).

    joins_space: a space goes with the word after it. single_numbers: each digit is a piece.
    Contractions ('s 't 'm 'd 're 've 'll) are pieces where an apostrophe begins a piece.
    """
    letters = (STMD, R, V, L, E, LETTER)
    step = np.zeros((N_STATES, N_CLASSES), np.uint8)
    mark = np.zeros((N_STATES, N_CLASSES), np.uint8)

    def enter(c: int) -> int:
        """State after a character that begins a piece."""
        if c in letters:
            return IN_L
        return {NUMBER: IN_N, OTHER: IN_O, APOSTROPHE: AP, SPACE: SP1, WHITE: WS1}[c]

    for s in range(N_STATES):
        for c in range(N_CLASSES):
            pending = s in (AP_R, AP_V, AP_L)
            if c == END:
                to, m = START, BEFORE * pending
            elif s == AP and c in (STMD, R, V, L):
                to, m = {STMD: START, R: AP_R, V: AP_V, L: AP_L}[c], 0
            elif (s, c) in ((AP_R, E), (AP_V, E), (AP_L, L)):
                to, m = START, 0
            elif pending:  # the apostrophe stands alone and its letter begins a word
                to, m = (IN_L, BEFORE) if c in letters else (enter(c), BEFORE | HERE)
            elif (s == IN_L and c in letters) or (s == IN_N and c == NUMBER and not single_numbers) or (s in (IN_O, AP) and c in (OTHER, APOSTROPHE)):
                to, m = (IN_O if s == AP else s), 0
            elif s in (SP1, SPN, WS1, WSN):
                if c in (SPACE, WHITE):
                    to, m = (SPN if c == SPACE else WSN), 0
                elif joins_space and s in (SP1, SPN):
                    to, m = (IN_O if c == APOSTROPHE else enter(c)), BEFORE * (s == SPN)
                else:
                    to, m = enter(c), HERE | BEFORE * (joins_space and s == WSN)
            else:
                to, m = enter(c), HERE
            step[s, c], mark[s, c] = to, m
    return step, mark


class Cutter:
    """The cutting machine with its transition monoid."""

    CHUNK = 256

    def __init__(self, joins_space: bool, single_numbers: bool):
        self.step, self.mark = cutting_tables(joins_space, single_numbers)
        identity = tuple(range(N_STATES))
        found, order = {identity: 0}, [identity]
        grow = []
        for f in order:  # order grows while it is read
            row = []
            for c in range(N_CLASSES):
                g = tuple(int(self.step[x, c]) for x in f)
                if g not in found:
                    found[g] = len(order)
                    order.append(g)
                row.append(found[g])
            grow.append(row)
        self.grow = np.array(grow, np.int32)
        self.maps = np.array(order, np.uint8)
        n = len(order)
        both = self.maps[:, self.maps]  # both[g, f] is "f, then g"
        self.then = np.array([[found[tuple(row)] for row in rows] for rows in both.tolist()], np.int32).T.copy()
        assert self.then.shape == (n, n)

    def marks(self, symbols: np.ndarray) -> np.ndarray:
        """For each symbol, whether a piece begins there (uint8 0 or 1)."""
        size = len(symbols)
        chunks = -(-size // self.CHUNK)
        grid = np.full(chunks * self.CHUNK, END, np.uint8)
        grid[:size] = symbols
        grid = np.ascontiguousarray(grid.reshape(chunks, self.CHUNK).T)
        grow, element = self.grow.ravel(), np.zeros(chunks, np.int32)
        for column in grid:
            element = grow[element * N_CLASSES + column]
        scanned, gap = element, 1
        while gap < chunks:
            scanned = np.concatenate([scanned[:gap], self.then[scanned[:-gap], scanned[gap:]]])
            gap *= 2
        state = np.concatenate([[START], self.maps[scanned[:-1], START]]).astype(np.int32)
        out = np.empty_like(grid)
        step, mark = self.step.ravel().astype(np.int32), self.mark.ravel()
        for row, column in zip(out, grid):
            at = state * N_CLASSES + column
            row[:] = mark[at]
            state = step[at]
        flags = out.T.reshape(-1)[:size]
        begins = flags & HERE
        begins[:-1] |= (flags[1:] & BEFORE) >> 1
        return begins


def pieces_of(cutter: Cutter, classes: np.ndarray, texts: list[str], blanks: bool) -> tuple[np.ndarray, ...]:
    """Code points of all texts, their classes, where pieces begin and stop, and where each text ends. blanks=False leaves pieces of white space out."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    of_char = classes[points]
    is_end = np.zeros(len(of_char) + len(texts), bool)
    is_end[ends + np.arange(len(texts))] = True
    symbols = np.full(len(is_end), END, np.uint8)
    symbols[~is_end] = of_char
    begins = np.flatnonzero(cutter.marks(symbols)[~is_end])
    stops = np.append(begins[1:], len(points))[: len(begins)]
    if not blanks:
        filled = (of_char[begins] != SPACE) & (of_char[begins] != WHITE)
        begins, stops = begins[filled], stops[filled]
    return points, of_char, begins, stops, ends


def cut(cutter: Cutter, classes: np.ndarray, texts: list[str], blanks: bool = True) -> tuple[list[str], np.ndarray]:
    """Pieces of all texts in order, and where each text's pieces begin (one more entry than texts). blanks=False leaves pieces of white space out."""
    _, _, begins, stops, ends = pieces_of(cutter, classes, texts, blanks)
    joined = "".join(texts)
    first = np.searchsorted(begins, np.concatenate([[0], ends]))
    return [joined[a:b] for a, b in zip(begins.tolist(), stops.tolist())], first


def marked(cutter: Cutter, classes: np.ndarray, texts: list[str], mark: str, blanks: bool = True) -> list[str]:
    """Each text with the character `mark` after every piece; with blanks=False not after white space, which becomes plain spaces."""
    points, of_char, _, stops, ends = pieces_of(cutter, classes, texts, blanks)
    if not blanks:
        points = np.where(of_char == WHITE, np.uint32(ord(" ")), points)
    joined = np.insert(points, stops, ord(mark)).tobytes().decode("utf-32-le")
    to = (ends + np.searchsorted(stops, ends, "right")).tolist()
    return [joined[a:b] for a, b in zip([0, *to], to)]


class PieceCounter:
    """Counting machine: bytes of a piece in, number of tokens out."""

    MAX_STATES = 300_000

    def __init__(self, tokens: list[bytes], merges: dict[tuple[int, int], int]):
        """tokens: bytes of each id; merges: (left id, right id) to the id that replaces them, lower ids first."""
        self.tokens, self.merges = tokens, merges
        self.single = {t[0]: i for i, t in enumerate(tokens) if len(t) == 1}
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.inner = bytearray(1)
        for i, t in enumerate(tokens):
            node = 0
            for b in t:
                self.inner[node] = 1
                key = node << 8 | b
                node = self.child.get(key)
                if node is None:
                    node = self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(0)
            if t:
                self.ends[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.states = {((0, -1, 0),): 0}
        self.of = [((0, -1, 0),)]
        self.arcs: dict[int, tuple[int, int]] = {}

    def encode(self, data: bytes) -> list[int]:
        """Byte-pair encoding by its definition."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            best = min((self.merges.get(p, 1 << 30) for p in zip(ids, ids[1:])), default=1 << 30)
            if best == 1 << 30:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.merges.get((ids[i], ids[i + 1])) == best:
                    out.append(best)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens may stand side by side in an encoding."""
        if left < 0:
            return True
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            known = self.fits[key] = self.encode(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def arc(self, state: int, byte: int) -> tuple[int, int]:
        """Compile the transition: (next state, tokens added)."""
        grown, last, count = [], -1, 0
        for node, before, so_far in self.of[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.ends[node]
            if last < 0 and token >= 0 and self.fit(before, token):
                last, count = token, so_far + 1
            if self.inner[node]:
                grown.append((node, before, so_far))
        key = (*((n, b, c - count) for n, b, c in grown), (0, last, 0))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.of)
            self.of.append(key)
        found = self.arcs[state << 8 | byte] = (to, count)
        return found

    def count(self, data: bytes) -> int:
        if len(self.of) > self.MAX_STATES:
            self.forget()
        state = total = 0
        arcs = self.arcs
        for b in data:
            found = arcs.get(state << 8 | b) or self.arc(state, b)
            state = found[0]
            total += found[1]
        return total


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_bpe(path: str) -> tuple[PieceCounter, list[str]]:
    """Counting machine and special strings of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
    special = [t["content"] for t in spec["added_tokens"]]
    tokens = [b""] * (max(vocab.values()) + 1)
    for text, i in vocab.items():
        if text not in special:
            tokens[i] = bytes(alphabet[c] for c in text)
    merges = {}
    for pair in spec["model"]["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[vocab[left], vocab[right]] = vocab[left + right]
    return PieceCounter(tokens, merges), special
