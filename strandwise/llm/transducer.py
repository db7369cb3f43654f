"""Byte-pair merges compiled into a transducer that is determinised as texts ask for it.

The encoding of a prefix ends in exactly one token, and that token depends only on which
tokens end the encodings of shorter prefixes: it is the longest one that may stand beside the last
token of the rest.  So a machine that reads byte by byte writes, at each position, the last token
there.  To go on it must remember the last tokens at those of the latest positions where
some token of the vocabulary could still begin; these are the subset that a state of the
determinised transducer stands for.  States and transitions are made when a text first leaves the
known ones, one for each visit, and forgotten when there are too many; the rest of that
piece is read with the subset spelled out, so that strings never seen again cost no states.
Read back from a position, the last tokens are an encoding; it is final as
soon as all remembered positions lead back to it, which bounds the lookahead by the longest tokens.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import regex

#: Fixed pattern that cuts a text before merges apply, and the same for ASCII texts.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces up to this many bytes are read side by side, longer ones by themselves.
SIDE_BY_SIDE = 64
LINES = re.compile(r"\n(?=[!-~])")
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return {chr(b if b in printable else next(spare)): b for b in range(256)}


def read_merges(path: str | Path) -> tuple[list[tuple[int, int]], list[int], list[bytes]]:
    """(merges, ids, texts) of a byte-level BPE file in JSON.

    Symbols are numbered 0 to 255 for the bytes, then by merge; merges name their two symbols, ids
    and texts are by symbol.
    """
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    letters = byte_letters()
    number = {letter: b for letter, b in letters.items()}
    ids = [0] * 256
    texts = [bytes([b]) for b in range(256)]
    for letter, b in letters.items():
        ids[b] = model["vocab"][letter]
    merges = []
    for pair in model["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((number[left], number[right]))
        texts.append(texts[number[left]] + texts[number[right]])
        ids.append(model["vocab"][left + right])
        number.setdefault(left + right, len(ids) - 1)
    return merges, ids, texts


class Transducer:
    """Encodes the pieces of texts; decodes ids."""

    def __init__(self, merges: list[tuple[int, int]], ids: list[int], texts: list[bytes], max_states: int = 200_000, max_pieces: int = 200_000, stretch: int = 4096) -> None:
        self.merges, self.ids, self.texts = merges, ids, texts
        self.merged = {}
        for i, pair in enumerate(merges):
            self.merged.setdefault(pair, 256 + i)
        self.symbol = {}
        for s, t in enumerate(texts):
            self.symbol.setdefault(t, s)
        self.starts = {t[:k] for t in texts for k in range(len(t) + 1)}
        self.sizes = [len(t) for t in texts]
        self.max_states, self.max_pieces, self.stretch = max_states, max_pieces, stretch
        self.by_id = dict(zip(ids, texts, strict=True))
        self.known: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.apart: dict[int, bool] = {}
        #: The ends of what was read that start a token: their text, and the tokens that end with them, longest first.
        self.nodes, self.ends, self.tokens = {b"": 0}, [b""], [()]
        self.reads: dict[int, int] = {}
        start = (0, (-1,))
        self.states, self.numbers = [start], {start: 0}
        self.steps: dict[int, tuple[int, int]] = {}

    def stays_apart(self, a: int, b: int) -> bool:
        """Does no merge ever join the end of symbol ``a`` to the start of symbol ``b``?

        Undo both derivations from the latest merge back.  At each moment the symbols that touch
        the border are a right end of ``a`` and a left end of ``b``; they would have merged if their
        pair's merge comes before the later of the two was made into something larger.
        """
        key = a << 24 | b
        if (known := self.apart.get(key)) is not None:
            return known
        due = len(self.texts) + 1  # the touching pair exists until the merge of this number
        while True:
            joint = self.merged.get((a, b))
            if joint is not None and joint < due:
                result = False
                break
            if a < 256 and b < 256:
                result = True
                break
            # The later of the two is undone; equal ones on the left first: of overlapping equal pairs the left merges first.
            if a > b:
                due, a = a, self.merges[a - 256][1]
            else:
                due, b = b + 1, self.merges[b - 256][0]
        self.apart[key] = result
        return result

    def _read(self, node: int, byte: int) -> int:
        """The node after one more byte: the longest end of what was read that starts a token."""
        read = self.ends[node] + bytes([byte])
        k = next(k for k in range(len(read)) if read[k:] in self.starts)
        ends = read[k:]
        number = self.nodes.get(ends)
        if number is None:
            number = self.nodes[ends] = len(self.ends)
            self.ends.append(ends)
            self.tokens.append(tuple((len(ends) - i, t) for i in range(len(ends)) if (t := self.symbol.get(ends[i:])) is not None))
        self.reads[node << 8 | byte] = number
        return number

    def _remembered(self, node: int) -> list[int]:
        """How far back the positions lie that a state at this node keeps."""
        ends = self.ends[node]
        return [k for k in range(len(ends) + 1) if ends[len(ends) - k :] in self.starts]

    def _back(self, lasts: list[int], end: int) -> list[int]:
        out, sizes = [], self.sizes
        while end:
            token = lasts[end - 1]
            out.append(token)
            end -= sizes[token]
        out.reverse()
        return out

    def symbols(self, piece: bytes) -> list[int]:
        """The symbols of one piece.  A long piece is written a stretch at a time, as soon as that is final."""
        if len(self.states) > self.max_states or len(self.apart) > 4 * self.max_states:
            self._forget()
        steps, state, lasts, at = self.steps, 0, [], 0
        for byte in piece[: self.stretch]:
            step = steps.get(state << 8 | byte)
            if step is None:
                break
            state, token = step
            lasts.append(token)
            at += 1
        if at == len(piece):
            return self._back(lasts, at)
        return self._spelled_out(piece, at, state, lasts)

    def _spelled_out(self, piece: bytes, at: int, state: int, lasts: list[int]) -> list[int]:
        out: list[int] = []
        before, node, reads, tokens, apart = -1, self.states[state][0], self.reads, self.tokens, self.apart
        new = at
        for i in range(at, len(piece)):
            byte = piece[i]
            then = reads.get(node << 8 | byte)
            node = self._read(node, byte) if then is None else then
            n = len(lasts) + 1
            for size, token in tokens[node]:
                last = lasts[n - size - 1] if n > size else before
                if last < 0:
                    break
                fits = apart.get(last << 24 | token)
                if fits is None:
                    fits = self.stays_apart(last, token)
                if fits:
                    break
            lasts.append(token)
            if i == new and not out:
                kept = (node, tuple(lasts[n - k - 1] if n > k else before for k in self._remembered(node)))
                number = self.numbers.get(kept)
                if number is None:
                    number = self.numbers[kept] = len(self.states)
                    self.states.append(kept)
                self.steps[state << 8 | byte] = (number, token)
            if n >= self.stretch:
                lasts = self._flush(node, lasts, out)
                before = out[-1] if out else -1
        return out + self._back(lasts, len(lasts))

    def _flush(self, node: int, lasts: list[int], out: list[int]) -> list[int]:
        """Write what all remembered positions share; the last tokens of what follows."""
        shared: list[int] | None = None
        for k in self._remembered(node):
            way = self._back(lasts, len(lasts) - k)
            if shared is None:
                shared = way
                continue
            n = 0
            while n < min(len(shared), len(way)) and shared[n] == way[n]:
                n += 1
            shared = shared[:n]
        out += shared
        return lasts[sum(self.sizes[t] for t in shared) :]

    def _compile(self) -> None:
        """The same machine as arrays: nodes by depth, their steps by byte, and their tokens longest first."""
        ends = sorted(self.starts, key=lambda t: (len(t), t))
        number = {t: i for i, t in enumerate(ends)}
        n = len(ends)
        self.goto = np.zeros((n, 256), np.int32)
        fail, own = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        for t, s in self.symbol.items():
            own[number[t]] = s
        depths = np.fromiter(map(len, ends), np.int32, n)
        parents = np.fromiter((number[t[:-1]] if t else 0 for t in ends), np.int32, n)
        lasts = np.fromiter((t[-1] if t else 0 for t in ends), np.int32, n)
        self.goto[0, lasts[depths == 1]] = np.flatnonzero(depths == 1)
        for d in range(1, int(depths.max()) + 1):
            at = np.flatnonzero(depths == d)
            if d > 1:
                fail[at] = self.goto[fail[parents[at]], lasts[at]]
            self.goto[at] = self.goto[fail[at]]
            below = np.flatnonzero(depths == d + 1)
            self.goto[parents[below], lasts[below]] = below
        #: The token that ends at each node, and the node of the next shorter one.
        nearest = np.arange(n, dtype=np.int32)
        for d in range(int(depths.max()) + 1):
            at = np.flatnonzero((depths == d) & (own < 0))
            nearest[at] = nearest[fail[at]]
        self.token_of, self.shorter, self.nearest = own, nearest[fail], nearest
        self.size_of = np.array(self.sizes, np.int32)
        self.id_of = np.array(self.ids, np.int32)
        keys = np.array([a << 20 | b for a, b in self.merged], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_merge = keys[order], np.fromiter(self.merged.values(), np.int64, len(keys))[order]
        both = np.array([(0, 0)] * 256 + self.merges, np.int64)
        self.left, self.right = both[:, 0], both[:, 1]
        self.slot_keys, self.slot_fits = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _all_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stays_apart`` of many pairs."""
        a, b, out = a.astype(np.int64), b.astype(np.int64), np.zeros(len(a), bool)
        due, at = np.full(len(a), len(self.texts) + 1), np.arange(len(a))
        while len(at):
            key = a << 20 | b
            i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            joined = (self.pair_keys[i] == key) & (self.pair_merge[i] < due)
            done = (a < 256) & (b < 256) & ~joined
            out[at[done]] = True
            go = ~(joined | done)
            at, a, b = at[go], a[go], b[go]
            undo_left = a > b
            due = np.where(undo_left, a, b + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return out

    def _fits(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        key = last.astype(np.int64) << 20 | token
        slot = ((key * 0x9E3779B97F4A7C1) >> 24) & ((1 << 20) - 1)
        new = np.flatnonzero(self.slot_keys[slot] != key)
        fits = self.slot_fits[slot]
        if len(new):
            fits[new] = self._all_apart(last[new], token[new])
            self.slot_keys[slot[new]], self.slot_fits[slot[new]] = key[new], fits[new]
            # Two new pairs may share a slot; a key must stand beside its own answer.
            mixed = new[self.slot_keys[slot[new]] != key[new]]
            self.slot_keys[slot[mixed]] = -1
        return fits

    def learn(self, pieces: list[str]) -> None:
        """Read pieces side by side, one byte of each at a time, with their subsets spelled out in arrays."""
        if not hasattr(self, "goto"):
            self._compile()
        if len(self.known) + len(pieces) > self.max_pieces:
            self.known.clear()
        # A lone surrogate has no bytes; it is read as a question mark.
        raw = [p.encode("utf-8", "replace") for p in pieces]
        short = [i for i, r in enumerate(raw) if len(r) <= SIDE_BY_SIDE]
        for i, r in enumerate(raw):
            if len(r) > SIDE_BY_SIDE:
                self.known[pieces[i]] = self.id_of[self.symbols(r)].tobytes()
        if not short:
            return
        short.sort(key=lambda i: -len(raw[i]))
        sizes = np.fromiter((len(raw[i]) for i in short), np.int64, len(short))
        width = int(sizes[0])
        read = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in short), np.uint8).reshape(len(short), width)
        lasts = np.full((len(short), width + 1), -1, np.int32)
        node = np.zeros(len(short), np.int32)
        for i in range(width):
            m = int(np.searchsorted(-sizes, -i, "left"))
            node = self.goto[node[:m], read[:m, i]]
            todo, at = np.arange(m), self.nearest[node]
            while len(todo):
                token = self.token_of[at]
                last = lasts[todo, i + 1 - self.size_of[token]]
                fits = last < 0
                ask = np.flatnonzero(~fits)
                fits[ask] = self._fits(last[ask], token[ask])
                lasts[todo[fits], i + 1] = token[fits]
                todo, at = todo[~fits], self.shorter[at[~fits]]
        end, columns, rows = sizes.copy(), [], np.arange(len(short))
        while len(rows):
            token = lasts[rows, end[rows]]
            column = np.full(len(short), -1, np.int32)
            column[rows] = token
            columns.append(column)
            end[rows] -= self.size_of[token]
            rows = rows[end[rows] > 0]
        back = np.stack(columns[::-1], axis=1)
        used = back >= 0
        flat, until = self.id_of[back[used]].tobytes(), np.cumsum(used.sum(axis=1)) * 4
        start = 0
        for i, stop in zip(short, until.tolist(), strict=True):
            self.known[pieces[i]] = flat[start:stop]
            start = stop

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit integers; an empty text has none.

        No piece crosses a line break before a printable ASCII character, and that break is cut off
        as a piece of its own; so texts are cut there, and ASCII lines get the quicker pattern.
        """
        cut = []
        for text in texts:
            if text.isascii():
                cut.append(ASCII_PIECES.findall(text))
            else:
                own: list[str] = []
                for k, line in enumerate(LINES.split(text)):
                    own += (ASCII_PIECES if line.isascii() else PIECES).findall("\n" + line if k else line)
                cut.append(own)
        new = set().union(*cut).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.max_pieces:
                self.known.clear()
                new = set().union(*cut)
            self.learn(list(new))
        known = self.known.__getitem__
        return [b"".join(map(known, pieces)) for pieces in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of ids, piece by piece as they come; a character cut by a token border waits for its other bytes."""
        reader = Utf8Reader()
        for i in ids:
            if text := reader.feed(self.by_id[i]):
                yield text
        if text := reader.end():
            yield text


class Utf8Reader:
    """An incremental UTF-8 state machine: bytes in, whole characters out, U+FFFD for what cannot be one."""

    def __init__(self) -> None:
        self.missing, self.code, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.missing:
                if self.low <= b <= self.high:
                    self.code, self.missing, self.low, self.high = self.code << 6 | b & 0x3F, self.missing - 1, 0x80, 0xBF
                    if not self.missing:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.missing, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.missing, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.missing, self.code = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.missing, self.code = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        waiting, self.missing = self.missing, 0
        return "�" if waiting else ""
