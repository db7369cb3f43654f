"""Text that was decoded with a wrong character encoding: found by a trained classifier, restored where possible."""

from __future__ import annotations

import codecs
import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.llm.blocks import text_slices
from strandwise.session import ship_package

BUCKETS = 1 << 15
#: Lines with a character beyond ASCII that the models are trained on, at most, and those of them that are garbled in every way.
SAMPLE, GARBLED_SAMPLE = 20_000, 1_500
#: Likeliest chains by which a line is left out of the counts of clean text.
COUNTED = 8
#: Surprise (nats) of a character from which its line is looked at; gain that an inversion must bring.  Little
#: text happens to be valid UTF-8 after all, so that to it a smaller gain will do.
SURPRISE, GAIN, GAIN_UTF8 = 5.5, 7.0, 3.0
BLOCK = 4_000_000

#: Encodings of one script, any of which a text of it may have been written in.
SCRIPTS = {
    "western": ("cp1252", "mac_roman", "cp437", "cp850"),
    "central": ("cp1250", "iso8859-2", "cp852"),
    "cyrillic": ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic"),
    "japanese": ("cp932", "euc_jp"),
}
#: Encodings that readers assume by mistake.
ASSUMED = {
    "utf-8": ("latin-1", "cp1252", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac_roman", "iso8859-2", "gbk", "cp932", "big5"),
    "western": ("latin-1", "cp1250", "cp1251", "koi8-r", "cp866", "iso8859-2", "gbk", "cp932"),
    "central": ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437"),
    "cyrillic": ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "gbk"),
    "japanese": ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "gbk"),
}
#: Readings that replace what they cannot read; these are found but not restored.
LOSSY = (("cp1252", "utf-8"), ("cp1250", "utf-8"), ("cp1251", "utf-8"), ("koi8-r", "utf-8"), ("cp932", "utf-8"), ("euc_jp", "utf-8"), ("utf-8", "ascii"), ("utf-8", "gbk"), ("utf-8", "cp932"), ("euc_jp", "cp932"), ("cp932", "euc_jp"))
MULTIBYTE = {"gbk", "cp932", "big5", "euc_kr", "euc_jp", "utf-8", "ascii"}


def _table(name: str) -> tuple[str, dict[int, int]]:
    """A one-byte encoding as readers implement it: bytes without a character stand for the control of their number."""
    chars = [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]
    return "".join(chars), {ord(c): b for b, c in reversed(list(enumerate(chars)))}


_tables: dict[str, tuple[str, dict[int, int]]] = {}


@functools.lru_cache(64)
def to_bytes(text: str, name: str) -> bytes | None:
    """The bytes that ``name`` reads as ``text``, or None if there are none."""
    try:
        if name in MULTIBYTE:
            return text.encode(name)
        if name not in _tables:
            _tables[name] = _table(name)
        return codecs.charmap_encode(text, "strict", _tables[name][1])[0]
    except UnicodeError:
        return None


def to_text(data: bytes, name: str, errors: str = "strict") -> str | None:
    try:
        if name in MULTIBYTE:
            return data.decode(name, errors)
        if name not in _tables:
            _tables[name] = _table(name)
        return codecs.charmap_decode(data, errors, _tables[name][0])[0]
    except UnicodeError:
        return None


def chains() -> list[tuple[str, str, bool]]:
    """(written in, read as, loses characters) of every single wrong reading that is told apart."""
    out = [("utf-8", w, False) for w in ASSUMED["utf-8"]]
    for script, own in SCRIPTS.items():
        out += [(r, w, False) for r in own for w in dict.fromkeys((*own, *ASSUMED[script])) if r != w]
    return out + [(r, w, True) for r, w in LOSSY]


def garble(text: str, right: str, wrong: str, lossy: bool) -> str | None:
    data = to_bytes(text, right)
    return None if data is None else to_text(data, wrong, "replace" if lossy else "strict")


def restore(text: str, right: str, wrong: str) -> str | None:
    """``text`` read as ``right`` instead of ``wrong``; None unless every character allows it.

    Characters that ``wrong`` does not have cannot come from it; they stay, as they do where only what
    ``right`` could write went through the wrong reading.  All stretches between them must allow it.
    """
    data = to_bytes(text, wrong)
    if data is not None:
        return to_text(data, right)
    if wrong in MULTIBYTE or right in MULTIBYTE:
        return None
    table, own = _tables[wrong][1], _own(wrong)
    stretches = own.findall(text)
    was = [to_text(codecs.charmap_encode(x, "strict", table)[0], right) for x in stretches]
    if None in was or was == stretches:
        return None
    left = iter(was)
    return own.sub(lambda _: next(left), text)


@functools.cache
def _own(name: str) -> re.Pattern[str]:
    """Stretches of characters that a one-byte encoding has."""
    return re.compile("[" + re.escape(_tables[name][0]) + "]+")


@functools.cache
def _runs(wrong: str) -> re.Pattern[str]:
    """What a one-byte encoding makes of a character of several bytes in UTF-8."""
    if wrong not in _tables:
        _tables[wrong] = _table(wrong)
    chars = lambda a, b: "[" + "".join(map(re.escape, _tables[wrong][0][a : b + 1])) + "]"
    more = chars(0x80, 0xBF)
    return re.compile(f"{chars(0xC2, 0xDF)}{more}|{chars(0xE0, 0xEF)}{more}{{2}}|{chars(0xF0, 0xF4)}{more}{{3}}")


def restore_runs(text: str, wrong: str) -> str | None:
    """``text`` with its runs of UTF-8 that were read as ``wrong`` put right, where correct characters stand beside them; None if there is no run."""
    was = _runs(wrong).sub(lambda m: restore(m.group(), "utf-8", wrong) or m.group(), text)
    return None if was == text else was


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, ends): the hashed byte bigrams of each text in which a byte beyond ASCII takes part.

    ASCII letters count as their case only and digits as one, as it is their kind that tells.
    """
    raw = [b"\n" + x.encode("utf-8", "replace") + b"\n" for x in texts]
    data = KINDS[np.frombuffer(b"".join(raw), np.uint8)]
    both = np.flatnonzero((data[:-1] >= 0x80) | (data[1:] >= 0x80))
    buckets = _buckets(data, both)
    owner = np.searchsorted(np.cumsum([len(r) for r in raw]), np.concatenate([both, both]), "right")
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))


def _buckets(data: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Of the byte bigrams that begin there: first the buckets of them, then those with the byte before."""
    pairs = data[both].astype(np.uint32) << 8 | data[both + 1]
    # Two steps back as well, for characters of three bytes.
    third = np.where((data[both] >= 0x80) & (data[both + 1] >= 0x80), data[np.maximum(both - 1, 0)], 0).astype(np.uint32)
    return np.concatenate([pairs * np.uint32(2654435761) >> np.uint32(17), (pairs << 8 ^ third * np.uint32(40503)) * np.uint32(2246822519) >> np.uint32(17)]).astype(np.int64)


def sums(rows: np.ndarray, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The sum of ``rows[at]`` over each run of ``at``; runs that hold nothing have zeros.

    ``np.add.reduceat`` along the first axis goes down each column on its own; here whole rows are added.
    """
    sizes = np.diff(np.append(begin, len(at)))
    pieces = -(-sizes // PIECE)
    first = np.cumsum(pieces) - pieces
    owner = np.repeat(np.arange(len(sizes)), pieces)
    offset = (np.arange(len(owner)) - first[owner]) * PIECE
    length = np.minimum(sizes[owner] - offset, PIECE)
    order = np.argsort(-length, kind="stable")
    start = (begin[owner] + offset)[order]
    added = np.zeros((len(owner), rows.shape[1]), rows.dtype)
    for i, n in enumerate(np.searchsorted(-length[order], -np.arange(PIECE), "left")):
        if not n:
            break
        added[:n] += rows[at[start[:n] + i]]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    if pieces.max(initial=0) > 1:
        return sums(added, place, first)
    out = np.zeros((len(sizes), rows.shape[1]), rows.dtype)
    out[owner] = added[place]
    return out


def either(flags: np.ndarray, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Per run of ``at``, none of which is empty, and column: is a flag set in any of ``flags[at]``?"""
    bits = np.packbits(flags, axis=1)
    words = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    words[:, : bits.shape[1]] = bits
    words = words.view(np.uint64)
    any_of = np.stack([np.bitwise_or.reduceat(words[:, i][at], begin) for i in range(words.shape[1])], axis=1)
    return np.unpackbits(any_of.view(np.uint8), axis=1, count=flags.shape[1]).view(bool)


#: Rows of a run added up one by one; numbers of a table of rows and chains held at a time.
PIECE, HELD = 32, 8_000_000


KINDS = np.arange(256, dtype=np.uint8)
KINDS[65:91], KINDS[97:123], KINDS[48:58] = 65, 97, 48


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, first of each text): two line ends stand before each text, so that what it is worth does not depend on the one before."""
    joined = "\n\n" + "".join(x.replace("\n", " ") + "\n\n" for x in texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32), np.cumsum(sizes + 2) - sizes - 2


@dataclass
class Plain:
    """How likely a text is as clean text: each character given the two before, backing off to one and none.

    Texts of any length and script compare, as every character counts once: a wrong reading is as likely
    as what it would be undone to.
    """

    triples: np.ndarray
    pairs: np.ndarray
    singles: np.ndarray

    @staticmethod
    def train(lines: list[str]) -> Plain:
        chars, _, pair, _, triple = Plain._read(codes_of(lines)[0])
        count = lambda x, bits: np.bincount(x, minlength=1 << bits).astype(np.float32)
        return Plain(count(triple, 21), count(pair, 20), count(chars, 16))

    @staticmethod
    def add(lines: dict[str, int], totals: np.ndarray) -> None:
        """Add the characters of lines that come so many times to the three tables one after another."""
        if not lines:
            return
        texts, counts = list(lines), np.fromiter(lines.values(), np.int64, len(lines))
        for begin, stop in _spans(texts, 100_000):
            codes, first = codes_of(texts[begin:stop])
            chars, _, pair, _, triple = Plain._read(codes)
            times = np.repeat(counts[begin:stop], np.diff(np.append(first, len(codes) - 2)))
            start = 0
            for at, bits in ((triple, 21), (pair, 20), (chars, 16)):
                np.add.at(totals[start : start + (1 << bits)], at, times)
                start += 1 << bits

    @staticmethod
    def _read(codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(character, the one before, pair, pair before, triple) from the third code point on, as places in the tables."""
        return Plain._places(codes[:-2], codes[1:-1], codes[2:])

    @staticmethod
    def _places(*three: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same of any code points, each given after the one two before and the one before."""
        a, b, c = ((y ^ y >> 16 << 7) & 0xFFFF for y in (np.where((x >= 49) & (x <= 57), np.uint32(48), x) for x in three))
        second = b * np.uint32(40503)
        pair_before = (a * np.uint32(40503) ^ b * np.uint32(2654435761)) * np.uint32(2246822519) >> np.uint32(12)
        mixed = (second ^ c * np.uint32(2654435761)) * np.uint32(2246822519)
        triple = (mixed ^ a * np.uint32(3266489917)) * np.uint32(668265263) >> np.uint32(11)
        return c, b, mixed >> np.uint32(12), pair_before, triple

    @functools.cached_property
    def alone(self) -> np.ndarray:
        return ((self.singles + 0.05) / (self.singles.sum() + 0.05 * 65536)).astype(np.float32)

    def surprise(self, codes: np.ndarray) -> np.ndarray:
        """Surprise of each character from the third code point on."""
        return self.surprise_after(codes[:-2], codes[1:-1], codes[2:])

    def surprise_after(self, two_before: np.ndarray, one_before: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Surprise of each code point after those before it."""
        chars, before, pair, pair_before, triple = self._places(two_before, one_before, codes)
        # Where counts share a bucket, what comes after must not outnumber what came before.
        one, two = self.singles[before], self.pairs[pair_before]
        after_one = (np.minimum(self.pairs[pair], one) + np.float32(3.0) * self.alone[chars]) / (one + np.float32(3.0))
        chance = (np.minimum(self.triples[triple], two) + np.float32(1.5) * after_one) / (two + np.float32(1.5))
        return -np.log(chance)

    def score(self, texts: list[str]) -> np.ndarray:
        codes, first = codes_of(texts)
        return -np.add.reduceat(self.surprise(codes).astype(np.float64), first) if texts else np.zeros(0)

    def odd(self, texts: list[str]) -> np.ndarray:
        """Does a text hold a pair beyond ASCII that clean text would hardly have?"""
        if not texts:
            return np.zeros(0, bool)
        codes, first = codes_of(texts)
        beyond = (codes[1:-1] > 127) | (codes[2:] > 127)
        return np.logical_or.reduceat(beyond & (self.surprise(codes) > SURPRISE), first)


class Segments:
    """What is known of the parts of lines around characters beyond ASCII, each worked out once while it is remembered.

    ASCII stays ASCII in every chain, so all that an inversion changes of a line lies in its segments, and odds and gains
    of a line are the sums over them.
    """

    def __init__(self, model: Classifier) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.texts: list[str] = []
        self.chars = 0
        k = len(self.model.classes)
        self.odd, self.seen = np.zeros(0, bool), np.zeros(0, bool)
        self.odds, self.weighed = np.zeros((0, k), np.float32), np.zeros(0, bool)
        self.gains, self.fits, self.measured = np.zeros((0, k), np.float32), np.zeros((0, k), np.int8), np.zeros((0, k), bool)

    def of(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(segment ids of all lines one after another, first of each line); every line has one at least."""
        if len(self.texts) > REMEMBERED or self.chars > 40 * REMEMBERED:
            self.clear()
        segments, first = segments_in(lines)
        ids = [self.ids.setdefault(s, len(self.ids)) for s in segments]
        new = list(itertools.islice(self.ids, len(self.texts), None))
        for start, stop in _spans(new, 200_000):
            part = new[start:stop]
            self.odd = np.concatenate([self.odd, self.model.plain.odd(part)])
            self.seen = np.concatenate([self.seen, np.fromiter((SEEN.search(x) is not None for x in part), bool, len(part))])
        self.texts += new
        self.chars += sum(map(len, new))
        more = lambda x: np.concatenate([x, np.zeros((len(self.texts) - len(x), *x.shape[1:]), x.dtype)])
        self.odds, self.weighed, self.gains, self.fits, self.measured = map(more, (self.odds, self.weighed, self.gains, self.fits, self.measured))
        return np.array(ids, np.int64), first

    def weigh(self, ids: np.ndarray) -> np.ndarray:
        """What the classifier holds of these segments."""
        todo = np.unique(ids[~self.weighed[ids]])
        texts = [self.texts[i] for i in todo]
        for start, stop in _spans(texts, 100_000):
            self.odds[todo[start:stop]] = self.model.scores(texts[start:stop])
        self.weighed[todo] = True
        return self.odds[ids]

    def measure(self, ids: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how they fit, what they gain) of the wanted chains' inversions of these segments; others that are not known yet do not fit."""
        todo, at = np.unique(ids, return_inverse=True)
        need = np.zeros((len(todo), want.shape[1]), bool)
        np.logical_or.at(need, at, want)
        need &= ~self.measured[todo]
        some = need.any(axis=1)
        todo, need = todo[some], need[some]
        texts = [self.texts[i] for i in todo]
        for start, stop in _spans(texts, 100_000):
            self._measure(todo[start:stop], texts[start:stop], need[start:stop])
        self.measured[todo] |= need
        return self.fits[ids], self.gains[ids]

    def _measure(self, at: np.ndarray, texts: list[str], need: np.ndarray) -> None:
        model = self.model
        codes, first = codes_of(texts)
        base = np.add.reduceat(model.plain.surprise(codes).astype(np.float64), first)
        own_control = np.fromiter((CONTROLS.search(x) is not None for x in texts), bool, len(texts))
        single = [k for k, (right, wrong, lossy) in enumerate(model.classes) if not lossy and right not in MULTIBYTE and wrong not in MULTIBYTE]
        if need[:, single].any():
            gains, moved, control = self._one_byte(codes, first, single)
            fits = np.where(moved, np.where(own_control[:, None] | control, REFUSED, WHOLE), SAME)
            for i, k in enumerate(single):
                rows = np.flatnonzero(need[:, k])
                self.fits[at[rows], k], self.gains[at[rows], k] = fits[rows, i], gains[rows, i]
        encoded: dict[str, list[bytes | None]] = {}
        for k, (right, wrong, _) in enumerate(model.classes):
            if k in single or not need[:, k].any():
                continue
            if right == "utf-8" and wrong not in MULTIBYTE:
                rows = np.flatnonzero(need[:, k] & _may_hold_runs(codes, first, wrong))
                results = [model.invert(texts[i], k) for i in rows]
            else:
                if wrong not in encoded:
                    # Each of these encodings writes a character the same wherever it stands.
                    able = np.logical_and.reduceat(encodable(codes, wrong), first)
                    encoded[wrong] = [to_bytes(x, wrong) if a else None for x, a in zip(texts, able.tolist(), strict=True)]
                data = encoded[wrong]
                rows = np.fromiter((i for i in np.flatnonzero(need[:, k]).tolist() if data[i] is not None), np.int64)
                results = [_fitted(texts[i], to_text(data[i], right)) for i in rows.tolist()]
            self.fits[at[need[:, k]], k] = REFUSED
            fits = np.fromiter((f for _, f in results), np.int8, len(results))
            self.fits[at[rows], k] = fits
            good = np.flatnonzero(fits > 0)
            if len(good):
                self.gains[at[rows[good]], k] = base[rows[good]] + model.plain.score([results[i][0] for i in good])

    def _one_byte(self, codes: np.ndarray, first: np.ndarray, single: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gain, is a character changed, is one changed or left a control) of each text in each of these one-byte chains.

        Such a chain changes nothing but characters beyond ASCII, and so the worth of these and of the two after each. Texts
        share most runs of three characters: each is worked out once.
        """
        beyond = codes > 127
        at_risk = np.flatnonzero(beyond[2:] | beyond[1:-1] | beyond[:-2])
        begin = np.searchsorted(at_risk, first)
        key = codes[at_risk].astype(np.uint64) << np.uint64(42) | codes[at_risk + 1].astype(np.uint64) << np.uint64(21) | codes[at_risk + 2]
        key, which = np.unique(key, return_inverse=True)
        three = np.stack([key >> np.uint64(42), key >> np.uint64(21) & np.uint64(0x1FFFFF), key & np.uint64(0x1FFFFF)]).astype(np.uint32)
        basic, plain = three < 65536, self.model.plain
        place = np.where(basic, three, 0)
        held = plain.surprise_after(*three).astype(np.float64)
        full = np.diff(np.append(begin, len(which))) > 0
        out = np.zeros((len(first), len(single))), np.zeros((len(first), len(single)), bool), np.zeros((len(first), len(single)), bool)
        step = max(1, HELD // max(1, len(key), len(which) // PIECE))
        for start in range(0, len(single) if full.any() else 0, step):
            part = single[start : start + step]
            gains = np.zeros((len(key), len(part)))
            moved, control = np.zeros(gains.shape, bool), np.zeros(gains.shape, bool)
            for i, k in enumerate(part):
                was = np.where(basic, _map(*self.model.classes[k][:2])[place], three)
                some = np.flatnonzero((was != three).any(axis=0))
                gains[some, i] = held[some] - plain.surprise_after(*was[:, some])
                moved[:, i] = was[2] != three[2]
                control[:, i] = CONTROL[np.minimum(was[2], 128)]
            out[0][:, start : start + step] = sums(gains, which, begin)
            for flags, found in zip((moved, control), out[1:], strict=True):
                found[full, start : start + step] = either(flags, which, begin[full])
        return out


@functools.cache
def _known(name: str) -> np.ndarray:
    """Per code point: does the encoding have it?  -1 as long as nobody asked."""
    return np.full(65536, -1, np.int8)


def encodable(codes: np.ndarray, name: str) -> np.ndarray:
    """Has the encoding each of the code points?  None of those that are told apart here has one beyond 65535."""
    known = _known(name)
    inside = np.where(codes < 65536, codes, 0)
    for c in np.unique(inside[known[inside] < 0]).tolist():
        known[c] = to_bytes(chr(c), name) is not None
    return (known[inside] > 0) & (codes < 65536)


@functools.cache
def _parts(wrong: str) -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it what a one-byte encoding makes of the first byte of a character of several in UTF-8, or of a further one?"""
    _runs(wrong)
    lead, more = np.zeros(65537, bool), np.zeros(65537, bool)
    for flags, a, b in ((lead, 0xC2, 0xF4), (more, 0x80, 0xBF)):
        flags[[ord(c) for c in _tables[wrong][0][a : b + 1]]] = True
    return lead, more


def _may_hold_runs(codes: np.ndarray, first: np.ndarray, wrong: str) -> np.ndarray:
    """Which texts hold a character that may begin one of ``_runs`` before one that may go on; no other text holds a run."""
    (lead, more), place = _parts(wrong), np.minimum(codes, 65536)
    return np.logical_or.reduceat(np.append(lead[place[:-1]] & more[place[1:]], False), first)


def _fitted(segment: str, was: str | None) -> tuple[str, int]:
    if was == segment:
        return segment, SAME
    return (segment, REFUSED) if was is None or CONTROLS.search(was) else (was, WHOLE)


#: How an inversion fits a segment: not at all; it changes nothing; all of it; runs of it only.
REFUSED, SAME, WHOLE, RUNS = -1, 0, 1, 2
#: Segments remembered in a worker at a time.
REMEMBERED = 50_000
CONTROL = np.zeros(129, bool)
CONTROL[[*range(9), 11, 12, *range(14, 32), 127]] = True


def _spans(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, x in enumerate(texts, 1):
        total += len(x)
        if total >= size or i == len(texts):
            yield start, i
            start, total = i, 0


@functools.cache
def _map(right: str, wrong: str) -> np.ndarray:
    """Per code point, what it was if ``right`` was read as ``wrong``, both of one byte; characters that ``wrong`` lacks stay."""
    for name in (right, wrong):
        if name not in _tables:
            _tables[name] = _table(name)
    out = np.arange(65536, dtype=np.uint32)
    for c, b in _tables[wrong][1].items():
        out[c] = ord(_tables[right][0][b])
    return out


@dataclass
class Classifier:
    """Multinomial over hashed byte bigrams: one class for each of ``chains()`` and one for clean text; and a model of clean text to hold results against.

    ``weights`` holds, per bucket and chain, how much likelier the chain is than clean text.
    """

    classes: list[tuple[str, str, bool]]
    weights: np.ndarray
    plain: Plain

    @staticmethod
    def train(lines: list[str], rounds: int = 3) -> Classifier:
        """Fit on lines garbled in every way.

        Some of the lines are garbled already.  Those that are UTF-8 read as something else are left out
        from the start; after each round, those found otherwise are left out of the next.
        """
        classes = chains()
        utf8 = [w for r, w, lossy in classes if r == "utf-8" and not lossy]
        verdict: dict[str, bool] = {}
        for x in lines:
            if x not in verdict:
                verdict[x] = "\ufffd" not in x and all((was := restore(x, "utf-8", w)) is None or was == x for w in utf8)
        clean = [x for x in lines if verdict[x]]
        for r in range(rounds):
            distinct = list(dict.fromkeys(clean))
            counts = np.zeros((len(classes) + 1, BUCKETS))
            for k, (right, wrong, lossy) in enumerate(classes):
                made = [g for x in distinct[:GARBLED_SAMPLE] if (g := garble(x, right, wrong, lossy)) is not None and g != x and (("\ufffd" in g) == lossy)]
                if made:
                    counts[k] = np.bincount(features(made)[0], minlength=BUCKETS)
            counts[-1] = np.bincount(features(distinct)[0], minlength=BUCKETS)
            total = counts.sum(axis=1, keepdims=True)
            # What any class has seen is more likely in another than what none has.
            prior = counts.sum(axis=0) + 1.0
            prior /= prior.sum()
            weights = np.log((counts + 200.0 * prior) / (total + 200.0)).T.astype(np.float32)
            weights = weights[:, :-1] - weights[:, -1:]
            weights[:, total[:-1, 0] < 20] = -50.0
            model = Classifier(classes, np.ascontiguousarray(weights), Plain.train(clean))
            if r < rounds - 1:
                found = dict(zip(distinct, model.judge(distinct), strict=True))
                clean = [x for x in clean if found[x] is None]
        return model

    def scores(self, texts: list[str]) -> np.ndarray:
        """How much likelier than clean text each chain makes each text: the weights of its ``features``.

        A character's bytes and the one or two before them lie in it and in the character before it. Texts share most
        pairs of characters: the weights of each are added up once.
        """
        codes = np.frombuffer("".join(f"\n{x}\n" for x in texts).encode("utf-32-le", "replace"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
        beyond = codes > 127
        at = np.flatnonzero(beyond[:-1] | beyond[1:])
        key, which = np.unique(codes[at].astype(np.int64) << 21 | codes[at + 1], return_inverse=True)
        pair = np.stack([key >> 21, key & 0x1FFFFF], axis=1).astype(np.uint32)
        data = KINDS[np.frombuffer(pair.tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)]
        lengths = 1 + (pair > 0x7F) + (pair > 0x7FF) + (pair > 0xFFFF).astype(np.int64)
        own = lengths[:, 1]
        last = np.cumsum(lengths.sum(axis=1)) - own - 1
        begin = np.cumsum(own) - own
        both = np.repeat(last - begin, own) + np.arange(own.sum())
        buckets = _buckets(data, both).reshape(2, -1).T.ravel()
        first = np.searchsorted(at, np.cumsum(sizes) - sizes)
        out = np.empty((len(texts), self.weights.shape[1]), np.float32)
        step = max(1, HELD // max(1, len(key), len(at) // PIECE))
        for i in range(0, out.shape[1], step):
            out[:, i : i + step] = sums(sums(self.weights[:, i : i + step], buckets, 2 * begin), which, first)
        return out

    def invert(self, segment: str, k: int) -> tuple[str, int]:
        """A segment as chain ``k`` had it, and how the inversion fits."""
        right, wrong, _ = self.classes[k]
        runs = right == "utf-8" and wrong not in MULTIBYTE
        if runs and not _runs(wrong).search(segment):
            return segment, REFUSED
        was, fit = restore(segment, right, wrong), WHOLE
        if was is None and runs:
            was, fit = restore_runs(segment, wrong), RUNS
        if was == segment or was is None and right not in MULTIBYTE and wrong not in MULTIBYTE:
            return segment, SAME
        return (segment, REFUSED) if was is None or CONTROLS.search(was) else (was, fit)

    @functools.cached_property
    def segments(self) -> Segments:
        return Segments(self)

    def judge(self, lines: list[str], likeliest: int | None = None) -> list[tuple[str, str] | None]:
        """For each line its chain ("right<wrong") and what it was, or None if clean.

        A line is asked if the classifier holds any chain for likelier than clean text, and if it has an odd pair of
        characters.  Every chain is inverted, or, if given, only the ``likeliest`` ones and all of UTF-8.  One counts if the characters allow the inversion and the
        result is a likelier clean text than the line was by ``GAIN``.  Of those that count, the one of the largest gain is
        taken; a chain that the classifier holds for less likely than clean text counts only if its result has nothing odd.  Of lossy chains the result stays the line itself.
        """
        out: list[tuple[str, str] | None] = [None] * len(lines)
        if not lines:
            return out
        known = self.segments
        ids, first = known.of(lines)
        last = np.append(first[1:], len(ids))
        lossy = np.array([c[2] for c in self.classes])
        utf8 = np.array([c[0] == "utf-8" for c in self.classes])

        def segments_of(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            begin = np.cumsum(np.append(0, last[some] - first[some]))
            return np.repeat(first[some] - begin[:-1], np.diff(begin)) + np.arange(begin[-1]), begin[:-1]

        lost = np.fromiter(("\ufffd" in x for x in lines), bool, len(lines))
        asked = np.flatnonzero(lost | np.logical_or.reduceat(known.odd[ids], first) & np.logical_or.reduceat(known.seen[ids], first))
        if not len(asked):
            return out
        at, begin = segments_of(asked)
        odds = np.add.reduceat(known.weigh(ids[at]), begin, axis=0)
        for j in np.flatnonzero(lost[asked]):
            k = int(np.argmax(np.where(lossy, odds[j], -np.inf)))
            out[asked[j]] = (f"{self.classes[k][0]}<{self.classes[k][1]}", lines[asked[j]])
        likely = ~lost[asked] & (np.where(lossy, -np.inf, odds).max(axis=1) > 0)
        asked, odds = asked[likely], odds[likely]
        if not len(asked):
            return out
        at, begin = segments_of(asked)
        want = np.tile(~lossy, (len(asked), 1))
        if likeliest is not None:
            top = np.argpartition(-np.where(lossy, -np.inf, odds), likeliest, axis=1)[:, :likeliest]
            want &= utf8
            np.put_along_axis(want, top, True, axis=1)
            want &= ~lossy
        fits, gains = known.measure(ids[at], np.repeat(want, np.diff(np.append(begin, len(at))), axis=0))
        # What UTF-8 does not fit stays as it is; a one-byte inversion goes through the whole line.
        usable = np.where(utf8, np.where(fits > 0, np.maximum(gains, 0), 0), np.where(fits > 0, gains, 0))
        gain = np.add.reduceat(usable, begin, axis=0)
        refused = np.logical_or.reduceat(fits == REFUSED, begin, axis=0)
        partly = refused | np.logical_or.reduceat(fits == RUNS, begin, axis=0) | np.logical_or.reduceat((fits > 0) & (gains < 0), begin, axis=0)
        counts = np.logical_or.reduceat(fits > 0, begin, axis=0) & (gain > np.where(utf8 & ~partly, GAIN_UTF8, GAIN)) & (utf8 | ~refused) & ~lossy
        likelier = counts & (odds > 0)
        for j in np.flatnonzero(counts.any(axis=1)):
            line = lines[asked[j]]
            k = int(np.argmax(np.where(counts[j], gain[j], -np.inf)))
            result = self._result(line, k)
            if not likelier[j, k] and self.plain.odd([result[1]])[0]:
                if not likelier[j].any():
                    continue
                result = self._result(line, int(np.argmax(np.where(likelier[j], gain[j], -np.inf))))
            out[asked[j]] = result
        return out

    def _result(self, line: str, k: int) -> tuple[str, str]:
        right, wrong, _ = self.classes[k]
        if right == "utf-8":
            gains = {x: self.segments.gains[self.segments.ids[x], k] for x in SEGMENT.findall(line)}
            was = SEGMENT.sub(lambda m: self.invert(m.group(), k)[0] if gains[m.group()] > 0 else m.group(), line)
        else:
            was = restore(line, right, wrong)
        return f"{right}<{wrong}", was

    def undo(self, lines: list[str]) -> list[tuple[str, str] | None]:
        """``judge`` again and again, until the result is clean: the chain's last reading comes first.

        Each inversion makes a line likelier as clean text by ``GAIN_UTF8`` at least, so that this ends.
        """
        found = self.judge(lines)
        again = [i for i, f in enumerate(found) if f]
        while again := [i for i in again if not found[i][1].isascii() and "\ufffd" not in found[i][1]]:
            more = self.judge([found[i][1] for i in again])
            for i, m in zip(again, more, strict=True):
                if m:
                    found[i] = (f"{found[i][0]} {m[0]}", m[1])
            again = [i for i, m in zip(again, more, strict=True) if m]
        return found


#: Something beyond ASCII other than white space, joiners and marks of order.
SEEN = re.compile(r"[^\x00-\x7f\u00a0\u00ad\u2000-\u200f\u2028-\u202f\u2060\u3000\ufeff]")
#: What is beyond plain ASCII, and up to four characters of it at either end: a chain takes at most one of them into a character, and one counts with the two before.
SEGMENT = re.compile(r"[\t\r\x20-\x7e]{0,4}[^\t\r\x20-\x7e](?:[\t\r\x20-\x7e]{0,8}[^\t\r\x20-\x7e])*[\t\r\x20-\x7e]{0,4}")
CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def segments_in(lines: list[str]) -> tuple[list[str], np.ndarray]:
    """(what ``SEGMENT.findall`` gives of all lines one after another, first of each line); a line without any has an empty one."""
    text = "".join(lines)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    at = np.flatnonzero((codes > 0x7E) | (codes < 0x20) & (codes != 9) & (codes != 13))
    line = np.searchsorted(ends, at, "right")
    # Over eight plain characters, or the end of a line, lie between one segment and the next.
    opens = np.ones(len(at) + 1, bool)
    opens[1:-1] = (np.diff(at) > 9) | (np.diff(line) > 0)
    owner, begin, last = line[opens[:-1]], at[opens[:-1]], at[opens[1:]]
    begin = np.maximum(begin - 4, np.append(0, ends)[owner])
    stop = np.minimum(last + 5, ends[owner])
    held = np.bincount(owner, minlength=len(lines))
    none = np.flatnonzero(held == 0)
    if len(none):
        before = np.cumsum(held)[none]
        begin, stop = np.insert(begin, before, 0), np.insert(stop, before, 0)
        held[none] = 1
    return [text[i:j] for i, j in zip(begin.tolist(), stop.tolist(), strict=True)], np.cumsum(held) - held


def training_lines(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> list[str]:
    """Up to ``sample`` lines with a character beyond ASCII, from documents drawn by a hash of their text.

    Only documents with such characters count, copies of one text once.  The share of documents drawn
    shrinks as their number grows, so that what reaches the driver does not.
    """
    beyond = docs.select(text, F.xxhash64(text).alias("h")).where(F.octet_length(text) > F.length(text))
    count = beyond.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    if not count:
        return []
    drawn = beyond.where(F.col("h") <= F.lit(highest_hash(sample / 4 / count))).dropDuplicates(["h"])
    lines = drawn.select("h", F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").rlike(r"[^\x00-\x7F]") & (F.length("line") <= 2000))
    found = [r.line for r in lines.select("line", F.xxhash64("line", "h").alias("h")).orderBy("h", "line").limit(sample).select("line").collect()]
    if not found and count > sample:
        raise ValueError(f"no line to train on was drawn from {count} documents beyond ASCII")
    return found


def highest_hash(share: float) -> int:
    """The largest 64-bit hash of the lowest ``share`` of all, which is never none as it is not cut to whole parts of anything."""
    return min((1 << 63) - 1, int(share * 2**64) - (1 << 63))


#: Counters of a ``Plain`` that travel as one row.
PART = 1 << 14


def count_plain(docs: DataFrame, classifier: Classifier, text: str = "text") -> Plain:
    """The character counts of all lines beyond ASCII of all documents that ``classifier`` holds for clean, by the chains it finds likeliest.

    Each task counts its documents; the counts of a part of the tables are added in a task of their own, so that the
    driver gets tables of the same size whatever the size of the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(replace(classifier, plain=replace(classifier.plain)))
    sizes = [1 << 21, 1 << 20, 1 << 16]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, totals, waiting, size = shared.value, np.zeros(sum(sizes), np.int64), {}, 0

        def add() -> None:
            for at, was in zip(waiting, model.judge(list(waiting), COUNTED), strict=True):
                waiting[at] = 0 if was else waiting[at]
            model.plain.add({x: n for x, n in waiting.items() if n}, totals)
            waiting.clear()

        for batch in batches:
            for _, texts in text_slices(batch, 0, BLOCK):
                for line in pc.value_counts(lines_beyond(texts)[0]).to_pylist():
                    size += 0 if line["values"] in waiting else len(line["values"])
                    waiting[line["values"]] = waiting.get(line["values"], 0) + line["counts"]
                if size >= BLOCK:
                    add()
                    size = 0
        add()
        for part in range(len(totals) // PART):
            own = totals[part * PART : (part + 1) * PART]
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([own[at].astype("<i8").tobytes()], pa.binary())], names=["part", "at", "n"])

    def total(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(PART, np.int64)
        for batch in parts:
            for at, n in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist(), strict=True):
                own[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([own.astype("<f4").tobytes()], pa.binary())], names=["part", "counts"])

    beyond = docs.select(text).where(F.octet_length(text) > F.length(text))
    added = beyond.mapInArrow(count, "part int, at binary, n binary").groupBy("part").applyInArrow(total, "part int, counts binary")
    flat = np.zeros(sum(sizes), np.float32)
    for r in added.toLocalIterator():
        flat[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.counts, "<f4")
    return Plain(*np.split(flat, np.cumsum(sizes)[:-1]))


def find_garbled(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, chains, n_lines, restored) of the documents with at least one wrongly decoded line.

    ``chains`` lists the encodings in which lines were written and the ones they were read as, the outermost
    reading first; ``restored`` is the whole text with these lines put right, where it is possible.  Lines
    with U+FFFD are wrongly decoded too, but what they lost stays lost.  Null, empty and ASCII texts are clean.
    Documents given twice come out twice.  Without a document beyond ASCII nothing is found; where there are some but no line
    of them can be trained on (all longer than 2000 characters), an error says so.

    The classifier is trained on a bounded sample of lines and has a fixed size; what clean text looks like is counted
    on all lines of all documents; every line of every document is judged.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sampled = Classifier.train(training_lines(docs, text, sample))
    shared = spark.sparkContext.broadcast(replace(sampled, plain=count_plain(docs, sampled, text)))
    schema = T.StructType([docs.schema[key], T.StructField("chains", T.ArrayType(T.StringType())), T.StructField("n_lines", T.LongType()), T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, texts in text_slices(batch, 1, BLOCK):
                yield _judged(model, batch.column(0).slice(at, len(texts)), texts, key)

    return docs.select(key, text).mapInArrow(run, schema)


def lines_beyond(texts: pa.StringArray) -> tuple[pa.StringArray, pa.Int64Array]:
    """(lines beyond ASCII, the row of each); the others, most of a text, do not become Python strings."""
    cut = pc.split_pattern(texts, "\n")
    lines, rows = pc.list_flatten(cut), pc.list_parent_indices(cut)
    beyond = pc.invert(pc.string_is_ascii(lines))
    return lines.filter(beyond), rows.filter(beyond)


def _judged(model: Classifier, keys: pa.Array, texts: pa.StringArray, key: str) -> pa.RecordBatch:
    lines, at = lines_beyond(texts)
    asked = pc.unique(lines).to_pylist()
    found = {line: f for line, f in zip(asked, model.undo(asked), strict=True) if f}
    hit = pc.is_in(lines, value_set=pa.array(list(found), lines.type))
    rows = pc.unique(at.filter(hit))
    chains_of, counts, restored = [], [], []
    for text in texts.take(rows).to_pylist():
        cut = text.split("\n")
        hits = [found[x] for x in cut if x in found]
        chains_of.append(sorted({h[0] for h in hits}))
        counts.append(len(hits))
        restored.append("\n".join(found[x][1] if x in found else x for x in cut))
    arrays = [keys.take(rows), pa.array(chains_of, pa.list_(pa.string())), pa.array(counts, pa.int64()), pa.array(restored, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=[key, "chains", "n_lines", "restored"])
