"""A byte-level BPE tokenizer compiled to finite-state transducers.

Two machines in cascade. The splitter is a small deterministic transducer over
character classes; its transitions say where a piece begins. A chunk of text is a
map from the splitter's states to its states; the maps of all chunks compose by a
parallel prefix scan, which gives the state in front of every chunk, whatever
text the chunk lies in. The piece machine reads the bytes of one piece; each
transition is annotated with the change of the number of tokens emitted so far.
Its states are compiled when first reached and are finite: the window of bytes
that can still be the start of a token, and the last token at each place in it.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import pyarrow as pa

from . import textvec as T

# ---- splitter: classes of bytes ----
CONT, SPC, WS, LET, NUM, OTH, APO, ONE, LR, LV, LL, LE = range(12)
CLASSES = 12
#: A class plus this is the same class at the start of a text.
FRESH = CLASSES
BEGIN, S_LET, S_NUM, S_OTH, SP1, SP2, WS1, WS2, QUO, QR, QV, QL, DONE = range(13)
STATES = 13
#: Emitted: a piece begins with this character; a piece begins one character earlier.
HERE, BACK = 1, 2
_LETTERS = (LET, ONE, LR, LV, LL, LE)
#: Fewer pieces than this are read one by one.
FEW = 12
#: Bytes of a chunk. Three at a time are one step of a map.
CHUNK = 48


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state and emission for one character class."""
    if c == CONT:
        return state, 0
    kind = S_LET if c in _LETTERS else {NUM: S_NUM, OTH: S_OTH, APO: S_OTH}.get(c)
    if state in (QR, QV, QL):
        if c == (LL if state == QL else LE):
            return DONE, 0
        after, emitted = _step(S_LET, c)
        return after, emitted | BACK
    if state == QUO:
        if c in (ONE, LR, LV, LL):
            return {ONE: DONE, LR: QR, LV: QV, LL: QL}[c], 0
        return _step(S_OTH, c)
    if kind is None:  # white space
        if state in (SP1, SP2, WS1, WS2):
            return (SP2 if c == SPC else WS2), 0
        return (SP1 if c == SPC else WS1), HERE
    if state == SP1:
        return kind, 0
    if state == SP2:
        return kind, BACK
    if state == kind:
        return kind, 0
    after = QUO if c == APO else kind
    return after, HERE | (BACK if state == WS2 else 0)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    go = np.zeros((2 * CLASSES, STATES), np.uint8)
    out = np.zeros((2 * CLASSES, STATES), np.uint8)
    for c in range(CLASSES):
        for s in range(STATES):
            go[c, s], out[c, s] = _step(s, c)
            go[c + FRESH, s], out[c + FRESH, s] = _step(BEGIN, c)
    three = go[None, None, :, :].repeat(2 * CLASSES, 0).repeat(2 * CLASSES, 1)
    first = go[:, None, None, :]
    second = np.take_along_axis(np.broadcast_to(go[None, :, None, :], three.shape), np.broadcast_to(first, three.shape), 3)
    three = np.take_along_axis(three, second, 3)
    return go, out, np.ascontiguousarray(three.reshape(-1, STATES))


GO, OUT, GO3 = _tables()


@cache
def code_point_classes() -> np.ndarray:
    """The splitter's class of every code point."""
    import regex

    out = np.full(0x110000, OTH, np.uint8)
    everything = "".join(map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)))
    for pattern, value in ((r"\p{L}", LET), (r"\p{N}", NUM), (r"\s", WS)):
        out[np.fromiter((ord(m) for m in regex.findall(pattern, everything)), np.int64)] = value
    for text, value in ((" ", SPC), ("'", APO), ("stmd", ONE), ("r", LR), ("v", LV), ("l", LL), ("e", LE)):
        for char in text:
            out[ord(char)] = value
    return out


@cache
def _ascii_classes() -> np.ndarray:
    out = np.full(256, CONT, np.uint8)
    out[:128] = code_point_classes()[:128]
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that begins at each byte, CONT inside a character."""
    out = _ascii_classes()[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = [np.where(lead + j < len(data), data[np.minimum(lead + j, len(data) - 1)], 0).astype(np.int64) & 0x3F for j in range(4)]
        first = data[lead].astype(np.int64)
        point = np.where(first < 0xE0, (first & 0x1F) << 6 | b[1], np.where(first < 0xF0, (first & 0x0F) << 12 | b[1] << 6 | b[2], (first & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3]))
        out[lead] = code_point_classes()[np.minimum(point, 0x10FFFF)]
    return out


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps under composition, in a logarithmic number of steps."""
    maps, reach = maps.copy(), 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], 1)
        reach *= 2
    return maps


def piece_starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every piece of all texts, and the number of pieces before each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    cls = byte_classes(data)
    cls[np.unique(off[:-1][off[:-1] < off[1:]])] += FRESH
    padded = np.zeros(-(-n // CHUNK) * CHUNK, np.uint8)
    padded[:n] = cls
    grid = padded.reshape(-1, CHUNK)
    triples = grid.reshape(len(grid), CHUNK // 3, 3).astype(np.int32)
    triples = (triples[:, :, 0] * (2 * CLASSES) + triples[:, :, 1]) * (2 * CLASSES) + triples[:, :, 2]
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (len(grid), STATES))
    for j in range(CHUNK // 3):
        maps = GO3[triples[:, j][:, None], maps]
    entry = np.empty(len(grid), np.uint8)
    entry[0], entry[1:] = BEGIN, compose_scan(maps)[:-1, BEGIN]
    before = np.empty(grid.shape, np.uint8)
    state = entry
    for j in range(CHUNK):
        before[:, j] = state
        state = GO[grid[:, j], state]
    before = before.reshape(-1)[:n]
    emitted = OUT[cls, before]
    begins = (emitted & HERE) > 0
    begins[off[:-1][off[:-1] < off[1:]]] = True
    late = np.flatnonzero(emitted & BACK)
    filled = off[1:][off[1:] > off[:-1]] - 1
    final = GO[cls[filled], before[filled]]
    late = np.concatenate([late, filled[(final >= QR) & (final <= QL)] + 1])
    previous = late - 1
    while len(inside := np.flatnonzero((data[previous] & 0xC0) == 0x80)):
        previous[inside] -= 1
    begins[previous] = True
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, off)


# ---- pieces ----
def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_ONE_BYTE = [bytes([i]) for i in range(256)]

#: What is compiled: the settings of a tokenizer file that change its counts, and the values that they must have. truncation and padding
#: are not used; of the pre-tokenizer trim_offsets, and the decoder, change no count.
COMPILED = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}


def refuse_others(whole: dict, path: str) -> None:
    """An error for a tokenizer file that sets anything else than what is compiled, so that none is counted wrongly."""
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False} | whole["model"]
    given = {"normalizer": whole.get("normalizer"), "pre_tokenizer": whole.get("pre_tokenizer"), "model": {k: model[k] or COMPILED["model"][k] for k in COMPILED["model"]}}
    if isinstance(given["pre_tokenizer"], dict):
        given["pre_tokenizer"] = {k: given["pre_tokenizer"].get(k) for k in COMPILED["pre_tokenizer"]} | ({"more": True} if "pretokenizers" in given["pre_tokenizer"] else {})
    odd = [k for k, v in COMPILED.items() if given[k] != v]
    odd += [f"added token {t['content']!r}" for t in whole.get("added_tokens") or () if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]
    if odd:
        raise ValueError(f"{path}: only byte-level BPE without a normalizer, a prefix space or word ends is compiled; other settings: {', '.join(odd)}")


class PieceMachine:
    """Counts the tokens of one piece; transitions are compiled when first taken."""

    #: States kept before the compiled table is dropped and built again.
    MOST = 100_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        refuse_others(whole, path)
        model, of = whole["model"], _byte_of_char()
        raw = {token: bytes(of[c] for c in token) for token in model["vocab"]}
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.rank = {(raw[a], raw[b]): i for i, (a, b) in enumerate(pairs)}
        #: The merge that makes each longer token: its rank and its two parts.
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for (a, b), i in self.rank.items():
            self.made.setdefault(a + b, (i, a, b))
        self.tokens = {t for t in raw.values() if len(self.merge(t)) == 1}
        self.prefixes = {t[:i] for t in self.tokens for i in range(len(t) + 1)}
        self.special = [t["content"] for t in whole["added_tokens"]]
        self._apart: dict[tuple[bytes, bytes], bool] = {}
        self._read: dict[bytes, tuple[int, list[bytes]]] = {}
        self._clear()

    def _clear(self) -> None:
        self.next = np.full((1024, 256), -1, np.int32)
        self.delta = np.zeros((1024, 256), np.int8)
        start = (b"", ((None, 0),))
        self.ids, self.states = {start: 0}, [start]

    def merge(self, piece: bytes) -> list[bytes]:
        """The tokens of a short byte string, by the merge rules themselves."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(((self.rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 30:
                break
            pair = (parts[best[1]], parts[best[1] + 1])
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def apart(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens side by side stay two."""
        key = (left, right)
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > 500_000:
                self._apart.clear()
            known = self._apart[key] = self._stay(left, right)
        return known

    def _stay(self, left: bytes, right: bytes) -> bool:
        """No merge across the border comes before the merges that made the two: these are undone, the latest first."""
        byte = (-1, b"", b"")
        before = 1 << 30
        while True:
            if self.rank.get((left, right), 1 << 30) < before:
                return False
            a, b = self.made.get(left, byte), self.made.get(right, byte)
            if a[0] < 0 and b[0] < 0:
                return True
            if a[0] > b[0]:
                before, left = a[0], a[2]
            else:
                before, right = b[0] + 1, b[1]  # of equal ranks the left one is merged first

    def _ends(self, read: bytes) -> tuple[int, list[bytes]]:
        """How many of the last bytes can still be the start of a token, and the tokens that end here, the longest first."""
        keep = next(s for s in range(len(read) + 1) if read[s:] in self.prefixes)
        # a token is a prefix of itself, so none is longer than what is kept
        return len(read) - keep, [read[s:] for s in range(keep, len(read)) if read[s:] in self.tokens]

    def compile(self, state: int, byte: int) -> None:
        window, chain = self.states[state]
        read = window + _ONE_BYTE[byte]
        known = self._read.get(read)
        if known is None:
            if len(self._read) > 500_000:
                self._read.clear()
            known = self._read[read] = self._ends(read)
        keep, ending = known
        for token in ending:
            last, below = chain[len(token) - 1]
            if last is None or self.apart(last, token):
                break
        change = 1 - below
        reached = (read[len(read) - keep :], ((token, 0), *[(t, n + change) for t, n in chain[:keep]]))
        at = self.ids.get(reached)
        if at is None:
            at = self.ids[reached] = len(self.states)
            self.states.append(reached)
            if at >= len(self.next):
                self.next = np.concatenate([self.next, np.full(self.next.shape, -1, np.int32)])
                self.delta = np.concatenate([self.delta, np.zeros(self.delta.shape, np.int8)])
        self.next[state, byte], self.delta[state, byte] = at, change

    def _rest(self, state: int, read: list[int]) -> int:
        """Change of the number of tokens from this state over these bytes."""
        total = 0
        for byte in read:
            after = self.next[state, byte]
            if after < 0:
                self.compile(state, byte)
                after = self.next[state, byte]
            total += int(self.delta[state, byte])
            state = after
        return total

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece; all pieces take their next byte together."""
        if len(self.states) > self.MOST:
            self._clear()
        order = np.argsort(starts - ends, kind="stable")
        first, length = starts[order], (ends - starts)[order]
        state, total = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        alive = len(order)
        for j in range(int(length[0]) if len(length) else 0):
            alive = int(np.searchsorted(-length[:alive], -j, side="left"))
            if alive < FEW:
                for i in range(alive):
                    total[i] += self._rest(int(state[i]), data[first[i] + j : first[i] + length[i]].tolist())
                break
            byte = data[first[:alive] + j]
            reached = self.next[state[:alive], byte]
            if (reached < 0).any():
                for key in np.unique(state[:alive][reached < 0].astype(np.int64) << 8 | byte[reached < 0]).tolist():
                    self.compile(key >> 8, key & 255)
                reached = self.next[state[:alive], byte]
            total[:alive] += self.delta[state[:alive], byte]
            state[:alive] = reached
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


class Pieces:
    """The distinct pieces of some texts. Piece i is distinct[back[i]]; pieces over T.LONG bytes are each distinct.

    Pieces of up to seven bytes are told apart by these themselves, longer ones by
    their hash and then byte by byte: a piece that has the hash of another but not
    its bytes is distinct too, with no key that a table could know it by.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts
        keys, long = T.short_keys(data, starts, ends), np.flatnonzero(size > 7)
        keys[long] = T.span_hashes(data, starts[long], ends[long], lower=False) | LONG_PIECE
        self.keys, where, self.back = np.unique(keys, return_index=True, return_inverse=True)
        first = where[self.back[long]]
        same = (size[long] <= T.LONG) & (size[first] == size[long])
        same[same] = T.equal_spans(data, starts[long[same]], data, starts[first[same]], size[long[same]])
        alone = long[~same]
        self.back[alone] = len(where) + np.arange(len(alone))
        where = np.concatenate([where, alone])
        self.data, self.starts, self.size = data, starts[where], size[where]
        self.keys = np.concatenate([self.keys, np.zeros(len(alone), np.uint64)])
        #: Those that a table may keep.
        self.keyed = (self.keys > 0) & (self.size <= T.LONG)


#: Marks the key of a piece of more than seven bytes.
LONG_PIECE = np.uint64(1 << 63)


class PieceCache:
    """What is known of pieces, in a sorted table of bounded size that keeps the bytes of longer pieces."""

    MOST = 400_000

    def __init__(self):
        self.keys, self.values, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bytes, self.used = np.zeros(1 << 16, np.uint8), 0

    def find(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """The value of each piece that is known, and which are."""
        if not len(self.keys):
            return np.zeros(len(pieces.keys), np.int64), np.zeros(len(pieces.keys), bool)
        at = np.minimum(np.searchsorted(self.keys, pieces.keys), len(self.keys) - 1)
        hit = (self.keys[at] == pieces.keys) & pieces.keyed
        long = np.flatnonzero(hit & (pieces.keys >= LONG_PIECE))
        same = self.size[at[long]] == pieces.size[long]
        some = long[same]
        same[same] = T.equal_spans(pieces.data, pieces.starts[some], self.bytes, self.at[at[some]], pieces.size[some])
        hit[long] = same
        return self.values[at], hit

    def add(self, pieces: Pieces, new: np.ndarray, values: np.ndarray) -> None:
        """Keeps the values of the pieces new, of those whose key is not taken."""
        fit = pieces.keyed[new]
        new, values = new[fit], values[fit]
        if len(self.keys) + len(new) > self.MOST:
            self.__init__()
        elif len(self.keys):
            free = self.keys[np.minimum(np.searchsorted(self.keys, pieces.keys[new]), len(self.keys) - 1)] != pieces.keys[new]
            new, values = new[free], values[free]
        size = np.where(pieces.keys[new] >= LONG_PIECE, pieces.size[new], 0)
        ends = self.used + np.cumsum(size)
        total = int(size.sum())
        while self.used + total > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.bytes[self.used : self.used + total] = pieces.data[np.repeat(pieces.starts[new] - (ends - size), size) + np.arange(self.used, self.used + total)]
        self.used += total
        order = np.argsort(keys := np.concatenate([self.keys, pieces.keys[new]]), kind="stable")
        self.keys = keys[order]
        self.values, self.at, self.size = (np.concatenate(x)[order] for x in ((self.values, values), (self.at, ends - size), (self.size, size)))


@cache
def machine(path: str) -> tuple[PieceMachine, PieceCache]:
    return PieceMachine(path), PieceCache()


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, first = piece_starts(data, off)
    return starts, np.append(starts[1:], len(data))[: len(starts)], first


def unspecial(texts: pa.Array, special: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut at special strings: the parts, the text of each part, and the number of special tokens of each text."""
    texts = texts.cast(pa.large_string())
    pattern = "|".join(re.escape(s) for s in special)
    hits = [i for i, hit in enumerate(pa.compute.match_substring_regex(texts, pattern).to_pylist()) if hit] if special else []
    owner, extra = np.arange(len(texts)), np.zeros(len(texts), np.int64)
    if not hits:
        return texts, owner, extra
    rest = np.ones(len(texts), bool)
    rest[hits] = False
    cut, who = [], []
    for i in hits:
        parts = re.split(pattern, texts[i].as_py())
        extra[i] = len(parts) - 1
        cut += parts
        who += [i] * len(parts)
    return pa.concat_arrays([texts.filter(pa.array(rest)), pa.array(cut, pa.large_string())]), np.concatenate([owner[rest], np.array(who, np.int64)]), extra


def count_tokens(column: pa.Array, path: str) -> np.ndarray:
    """The number of tokens of every text by a file with the settings of COMPILED, another is an error; special strings count one each.

    The machine of the splitter is scanned in chunks; that of the pieces reads each distinct piece byte by byte.
    """
    piece_machine, known = machine(path)
    texts, owner, total = unspecial(column.fill_null(""), piece_machine.special)
    data, off = T.flat(texts)
    for a, b in T.slices(off):
        part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
        starts, ends, first = pieces(part, at)
        found = Pieces(part, starts, ends)
        tokens, hit = known.find(found)
        new = np.flatnonzero(~hit)
        if len(new):
            tokens[new] = piece_machine.counts(part, found.starts[new], found.starts[new] + found.size[new])
            known.add(found, new, tokens[new])
        sums = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(tokens[found.back], out=sums[1:])
        np.add.at(total, owner[a:b], sums[first[1:]] - sums[first[:-1]])
    return total
