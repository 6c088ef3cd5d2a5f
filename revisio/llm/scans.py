"""Noise in text from scanned pages: page furniture, broken words, misread characters.

The lines of a report are labelled by a hidden Markov model with the states
body, running (headers, footers, page numbers, stamps) and break (blank lines
and page feeds).  Its observations are layout features of a line; its
parameters are fitted by expectation-maximisation on all reports: features are
written once, a byte a line, and each round sums expectations over them.  Body
lines are then rejoined into paragraphs: a mark at a line's end is dropped if
the joined word is the usual one, and characters are restored where a word
differs from a usual one only by shapes that scanners confuse.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from revisio.operators.texts import HEADINGS
from revisio.plans.lineage import written

#: Lines whose expectations are computed at a time, to bound memory; a longer report goes by itself.
CELLS = 200_000
#: A word is a usual one if at least this share of the reports has it.  Reports of D different words give at most D / USUAL such words, however many reports there are.
USUAL = 0.004
#: A word counts as a misreading of one that is this many times as frequent.
OUTDONE = 15
BODY, RUNNING, BREAK = 0, 1, 2
MARKS = "-¬‐­"
#: Shapes that scanners confuse, in the order in which they are made equal: single strokes first, then pairs of them, then the rest.
CONFUSED = (("1", "l"), ("|", "l"), ("!", "l"), ("i", "l"), ("b", "h"), ("6", "h"), ("8", "h"), ("h", "ll"), ("€", "c"), ("e", "c"), ("rn", "m"), ("ln", "m"), ("nl", "m"), ("ll", "u"), ("cl", "d"), ("vv", "w"), ("@", "a"), ("0", "o"), ("5", "s"), ("$", "s"), ("q", "g"), ("9", "g"), ("f", "t"), ("v", "y"))
_TOKEN = regex.compile(r"[\p{L}\p{M}\d@€|$!]+(?:[.,'’]\d+[A-Za-z|]?|['’]\p{L}+)*")
_HEADING = regex.compile(r"(?i)^(?:\d+\.?\s+)?(?:" + "|".join((*HEADINGS, "funding")) + r")$")
_NUMBER = regex.compile(r"\d+")
_MIXED = regex.compile(r"^(?=.*\d)[\dOoIlZzSB|]+(?:[.,][\dOoIlZzSB|]+)*$")
_INNER = regex.compile(r"\p{L}[@€|$]\p{L}|\p{Ll}{2}[01]\p{Ll}{2}")


@lru_cache(maxsize=200_000)
def shape(word: str) -> str:
    """A key that is equal for words that differ only by confused shapes."""
    for a, b in CONFUSED:
        word = word.replace(a, b)
    return word


def _undoing() -> tuple[dict[str, list[str]], regex.Pattern]:
    """What a piece of a word may stand for, for confusions of one letter with two, in both directions; the pieces as a pattern."""
    same: dict[str, list[str]] = {}
    for a, b in CONFUSED:
        if len(a) == len(b) == 1:
            same.setdefault(b, [b]).append(a)
    out: dict[str, list[str]] = {}
    for a, b in CONFUSED:
        if len(a) != len(b):
            two, one = (a, b) if len(a) > 1 else (b, a)
            for form in (c + d for c in same.get(two[0], [two[0]]) for d in same.get(two[1], [two[1]])):
                out.setdefault(form, []).append(one)
            out.setdefault(one, []).append(two)
    return out, regex.compile("|".join(map(regex.escape, out)))


_UNDONE, _PIECE = _undoing()


@lru_cache(maxsize=100_000)
def undone(word: str) -> frozenset[str]:
    """Shapes of the spellings in which one confusion of one letter with two is undone at one place.

    The chain of :func:`shape` is not closed: a rule may take a letter that a
    later one needs ("ll" before "cl").  Undone by itself, that one isn't lost.
    """
    return frozenset(shape.__wrapped__(word[: m.start()] + new + word[m.end() :]) for m in _PIECE.finditer(word, overlapped=True) for new in _UNDONE[m[0]])


def masked(line: str) -> str:
    """A line without digits, blanks and case, with confused letters made equal: furniture repeats so."""
    return shape(regex.sub(r"[\d\s\W_]+", "", line.lower()))


def page_chain(lines: list[str], pages: int | None) -> set[int]:
    """Lines that bear the page numbers: the longest run of numbers, each one more than the one before, that ends near the text's end."""
    seen: dict[int, list[tuple[float, int]]] = {}
    width = max((len(x) for x in lines), default=0)
    best: list[tuple[int, int]] = []
    top = -1.0
    size = len(lines)
    for i, line in enumerate(lines):
        bare = line.strip("\f ")
        if not bare or (len(bare) > 0.95 * max(40, width) and not regex.search(r"\s{2,}", bare)):
            continue
        alone = not regex.search(r"[\p{L}]", bare)
        for m in _NUMBER.finditer(bare):
            if len(m[0]) > 5 or (m[0][0] == "0" and len(m[0]) > 1):
                continue
            edge = m.start() == 0 or m.end() == len(bare)
            cited = bool(regex.search(r"\d{4};\d+:\d+$", bare)) and m.end() == len(bare)
            sided = cited or bool(regex.search(r"\s{2,}", bare)) or alone or bool(regex.match(r"(?i)^\W*(page|p\.|seite|s\.)?\W*\d+(\W*(of|/|von|de)\W*\d+)?\W*$", bare))
            if not sided or not edge and not alone and not bare.lower().startswith(("page", "- ", "[")):
                continue
            if regex.match(r"^\d+\.\s", bare) or (not cited and regex.search(r"[±(;:]", bare) and (alone or not regex.search(r"\s{2,}", bare))):
                continue
            v = int(m[0])
            prior = [(n - (1 if d == 1 else 1.3), n, j, d) for d in (1, 2) for n, j in seen.get(v - d, []) if i - j >= 4 * d]
            _, n, j, d = max(prior, default=(0, 0, -1, 0))
            reach_ = n + (1 if d < 2 else 0.7)
            seen.setdefault(v, []).append((reach_, i))
            parent[(v, i)] = (v - d, j) if n else None
            score = reach_ + (1.5 if i >= size - 4 else 0) + (0.3 if not alone else 0) - (abs(reach_ - pages) * 0.4 if pages else 0)
            if reach_ > 1.5 and score > top:
                top, best = score, [(v, i)]
    if not best or (pages and len(best) == 0):
        parent.clear()
        return set()
    out = set()
    at: tuple[int, int] | None = best[0]
    while at:
        out.add(at[1])
        at = parent.get(at)
    parent.clear()
    ends = max(out) >= size - 4
    return out if ends or len(out) >= 3 or (pages and len(out) >= pages) or any("\f" in lines[i] for i in out) else set()


parent: dict[tuple[int, int], tuple[int, int] | None] = {}


_NAME = regex.compile(r"^(?:\d+\s{2,})?(?:\p{Lu}[\p{L}-]+|of|and|in|the|for)(?: (?:\p{Lu}[\p{L}-]+|of|and|in|the|for)){2,}(?: \d{4};\d+:\d+)?$")


def _stamp(line: str, others: list[str], authors: set[str], near: bool) -> bool:
    """Whether a line reads like a stamp, the journal's name, or the title or an author again."""
    bare = line.strip()
    if regex.search(r"(?i)\bdownloaded\b|\baccessed\b|©|\bpage \d+ of\b", bare) and (near or "\f" in line or "©" in bare):
        return True
    parts = [masked(p) for p in regex.split(r"\s{2,}", bare)]
    if any(len(k) >= 10 and o.startswith(k[: max(10, len(k) - 3)]) for k in parts for o in others):
        return True
    first = regex.match(r"(\p{L}+)\W+(et al|and others|and colleagues)\b", bare)
    if first and (first[1].lower() in authors or near) and not bare.endswith("."):
        return True
    if regex.match(r"^\p{Lu}[\p{L}\s-]+ [\dOlIZSB]{4};[\dOlIZSB]+:[\dOlIZSB]+$", bare):
        return True
    letters = regex.sub(r"[^\p{L}]", "", bare)
    if len(letters) > 14 and letters.isupper() and not regex.match(r"^\d+\.", bare) and (near or "\f" in line) and bare.count(" ") > 1:
        return True
    close = regex.sub(r"(?<=\b\p{L}) (?=\p{L}\b)", "", bare)  # letters set apart
    return (near or "\f" in line) and bool(_NAME.match(regex.sub(r" +", " ", close)))


def observations(text: str, pages: int | None) -> tuple[list[str], np.ndarray]:
    """Lines and their features (0 or 1): see the comments."""
    lines = text.split("\n")
    size = len(lines)
    keys = [masked(x) for x in lines]
    chain = page_chain(lines, pages)
    where: dict[str, list[int]] = {}
    for i, k in enumerate(keys):
        if len(k) >= 4:
            where.setdefault(k, []).append(i)
    width = float(np.percentile([len(x) for x in lines if x.strip()] or [1], 85))
    blank = [not x.strip() for x in lines]
    opening = [masked("".join(lines[i : i + 2])) for i in range(min(4, size - 1))]
    authors = {w.lower() for x in lines[1:6] for w in regex.findall(r"\p{Lu}\p{Ll}{3,}", x)}
    near = np.zeros(size, bool)
    for c in chain:
        near[c] = True
        for step in (-1, 1):
            i, left = c + step, 3
            while 0 <= i < size and left:
                near[i] = True
                i += step
                left -= 1
    x = np.zeros((size, 8), np.int8)
    for i, line in enumerate(lines):
        k = keys[i]
        again = [j for j in where.get(k, ()) if abs(j - i) >= 8]
        beside = sum(bool(near[j]) for j in again)
        p, n = i - 1, i + 1
        while p >= 0 and (blank[p] or p in chain):
            p -= 1
        while n < size and (blank[n] or n in chain):
            n += 1
        broken = p >= 0 and n < size and not regex.search(r"[.!?:][\"'”)]*$", lines[p].rstrip()) and lines[n][:1].islower()
        stamp = _stamp(line, [o for j, o in enumerate(opening) if j != i and j + 1 != i], authors, bool(near[i])) if not blank[i] and i != 1 or i > 5 else False
        x[i] = (
            i in chain,  # bears a page number
            bool(again) and (beside >= len(again) / 2 and near[i] if chain else stamp),  # comes again at page breaks
            near[i] and broken and len(line) < 0.8 * width,  # stands beside a page number inside a sentence
            "\f" in line,  # begins a page
            len(line.strip()) > 0.8 * width,  # fills its line
            i in (0, size - 1) and not blank[i],  # the text's first or last line
            stamp,
            blank[i],
        )
    return lines, x


#: The features of each value of a byte.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int8)


def packed(x: np.ndarray) -> bytes:
    """The features of a text's lines, a byte a line."""
    return np.packbits(x, axis=1).tobytes()


def unpacked(seen: bytes) -> np.ndarray:
    return _BITS[np.frombuffer(seen, np.uint8)]


class LineModel:
    """A hidden Markov model of independent two-valued features."""

    def __init__(self) -> None:
        self.start = np.log(np.array([0.9, 0.08, 0.02]))
        self.move = np.log(np.array([[0.93, 0.03, 0.04], [0.7, 0.25, 0.05], [0.9, 0.08, 0.02]]))
        # what the states look like before any text was seen
        self.emit = np.array([[0.002, 0.003, 0.01, 0.01, 0.65, 0.02, 0.004, 0.001], [0.6, 0.6, 0.4, 0.2, 0.2, 0.05, 0.6, 0.001], [0.001, 0.001, 0.01, 0.01, 0.001, 0.01, 0.001, 0.999]])

    def seen(self, x: np.ndarray) -> np.ndarray:
        return x @ np.log(self.emit).T + (1 - x) @ np.log(1 - self.emit).T

    def fit(self, texts: list[np.ndarray], rounds: int = 8) -> "LineModel":
        """:meth:`fit_by` on texts at hand."""
        seen = [packed(x) for x in texts]
        return self.fit_by(lambda model: model.expected(seen), rounds)

    def fit_by(self, expected: Callable[["LineModel"], np.ndarray], rounds: int = 8) -> "LineModel":
        """Baum-Welch from the first guess, which counts as three times the data: states keep their meaning.

        ``expected`` returns the sum of :meth:`expected` over all texts.
        Parameters are rounded, so that the order of its terms doesn't matter.
        """
        guess, turn = self.emit.copy(), np.exp(self.move)
        for _ in range(rounds):
            on, n, moves, first = np.split(expected(self), [24, 27, 36])
            on, n, moves, first = on.reshape(3, 8) + 0.05, n + 0.1, moves.reshape(3, 3) + 0.1, first + 0.1
            on, moves = on + 3 * n[:, None] * guess, moves + 3 * moves.sum(1, keepdims=True) * turn
            self.emit = np.clip(on / (4 * n[:, None]), 1e-3, 1 - 1e-3).round(9)
            self.move, self.start = np.log(moves / moves.sum(1, keepdims=True)).round(9), np.log(first / first.sum()).round(9)
        return self

    def expected(self, texts: list[bytes]) -> np.ndarray:
        """Expected counts over texts of packed features, in one row: features by state (24), lines by state (3), moves (9), first states (3)."""
        total = np.zeros(39)
        texts = sorted(texts, key=len, reverse=True)
        at = 0
        while at < len(texts):
            some = texts[at : at + max(1, CELLS // len(texts[at]))]
            total += self._expected(some)
            at += len(some)
        return total

    def _expected(self, texts: list[bytes]) -> np.ndarray:
        """:meth:`expected` of texts by falling length, line by line of all of them; of probabilities scaled to a sum of 1 at each line."""
        size = np.array([len(t) for t in texts])
        byte = np.zeros((size[0], len(texts)), np.uint8)
        for k, t in enumerate(texts):
            byte[: len(t), k] = np.frombuffer(t, np.uint8)
        live = len(texts) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")  # texts that have the line
        move, start = np.exp(self.move), np.exp(self.start)
        b = np.exp(self.seen(_BITS))[byte]
        a, z = np.zeros_like(b), np.ones_like(b)
        for t, k in enumerate(live):
            v = (a[t - 1, :k] @ move if t else start) * b[t, :k]
            scale = v.sum(1, keepdims=True)
            a[t, :k] = v / scale
            b[t, :k] /= scale
            b[t, k:] = 0
        for t in range(len(live) - 2, -1, -1):
            k = live[t + 1]
            z[t, :k] = (b[t + 1, :k] * z[t + 1, :k]) @ move.T
        g = a * z
        by_byte = np.stack([np.bincount(byte.ravel(), g[..., state].ravel(), 256) for state in range(3)])
        moves = move * (a[:-1].reshape(-1, 3).T @ (b[1:] * z[1:]).reshape(-1, 3))
        return np.concatenate([(by_byte @ _BITS).ravel(), by_byte.sum(1), moves.ravel(), g[0].sum(0)])

    def label(self, x: np.ndarray) -> np.ndarray:
        """The most likely states, by Viterbi."""
        b = self.seen(x)
        back = np.zeros(b.shape, int)
        v = self.start + b[0]
        for t in range(1, len(b)):
            way = v[:, None] + self.move
            back[t] = way.argmax(0)
            v = way.max(0) + b[t]
        out = [int(v.argmax())]
        for t in range(len(b) - 1, 0, -1):
            out.append(int(back[t][out[-1]]))
        return np.array(out[::-1])


class Words:
    """The usual words of all reports, by shape."""

    def __init__(self, n: dict[str, int]) -> None:
        self.n = n
        self.by_shape: dict[str, str] = {}
        for w, c in n.items():
            if any(ch.isdigit() or ch in "@€|$!" for ch in w):
                continue
            k = shape(w)
            if k not in self.by_shape or n[self.by_shape[k]] < c:
                self.by_shape[k] = w

    def near(self, word: str) -> str | None:
        """The most frequent usual word that is one undone confusion away."""
        return max((w for k in undone(word) if (w := self.by_shape.get(k)) and w != word), key=lambda w: (self.n[w], w), default=None)

    def right(self, word: str, own: Counter[str], own_shapes: dict[str, str]) -> str | None:
        """The word of which ``word``, in lower case, is a misreading; null if it is none."""
        k = shape(word)
        for best, count in ((self.by_shape.get(k), self.n), (own_shapes.get(k), own)):
            if best and best != word and (count.get(best, 0) >= OUTDONE * count.get(word, 0) if count is self.n else count.get(best, 0) > max(1, count.get(word, 0)) and word not in self.n):
                return best
        best = self.near(word)
        return best if best and self.n[best] >= OUTDONE * self.n.get(word, 0) else None


def tokens_of(line: str) -> list[str]:
    return _TOKEN.findall(line)


def _joined(lines: list[str], kinds: np.ndarray, words: Words, own: Counter[str]) -> dict[int, tuple[int, bool]]:
    """For each body line that ends with a mark after a letter: the line its word goes on in, and whether the mark is no part of the word."""
    out = {}
    size = len(lines)
    for i in range(size):
        x = lines[i].rstrip()
        if kinds[i] != BODY or len(x) < 2 or x[-1] not in MARKS or not x[-2].isalnum() and x[-2] not in "@€|":
            continue
        j = i + 1
        while j < size and kinds[j] != BODY:
            j += 1
        if j >= size:
            continue
        a = tokens_of(x[:-1])[-1:] or [""]
        b = regex.match(r"[\p{L}\p{M}\d@€|$!]+", lines[j].lstrip("\f "))
        if not b or not a[0]:
            continue
        if x[-1] != "-" and x[-1] != "‐":
            out[i] = (j, True)
            continue
        one = (a[0] + b[0]).lower()
        # compounds stand in the counts with their mark
        lead = regex.search(r"[\p{L}\p{M}\d@€|$!]+(?:-[\p{L}\p{M}\d@€|$!]+)*$", x[:-1])
        two = ((lead[0] if lead else a[0]) + "-" + b[0]).lower()
        c1, c2 = max(words.n.get(one, 0), words.n.get(words.by_shape.get(shape(one), ""), 0)), max(words.n.get(two, 0), words.n.get(words.by_shape.get(shape(two), ""), 0))
        if c1 == c2 == 0:
            c1, c2 = own.get(one, 0), own.get(two, 0)
        whole = c1 >= c2 if c1 or c2 else b[0][:1].islower() and not (words.n.get(a[0].lower(), 0) and words.n.get(b[0].lower(), 0))
        out[i] = (j, whole)
    return out


def own_words(lines: list[str], kinds: np.ndarray) -> tuple[Counter[str], dict[str, str]]:
    own: Counter[str] = Counter()
    for line, k in zip(lines, kinds):
        if k == BODY:
            own.update(w.lower() for w in regex.findall(r"[\p{L}\p{M}\d@€|$!]+(?:-[\p{L}\p{M}\d@€|$!]+)*", line))
            own.update(w.lower() for w in tokens_of(line) if "-" in line)
    shapes: dict[str, str] = {}
    for w, c in own.items():
        k = shape(w)
        if k not in shapes or own[shapes[k]] < c:
            shapes[k] = w
    return own, shapes


def restored(token: str, words: Words, own: Counter[str], shapes: dict[str, str]) -> str | None:
    """``token`` with its misread characters put right; null if it has none."""
    if _MIXED.match(token) and not token.isdigit():
        digits = token.translate(str.maketrans("OoIlZzSB|", "001122581"[:9]))
        return digits if any(c.isalpha() or c == "|" for c in token) and digits != token and len(token) > 1 else None
    if token.isdigit() or len(token) < 3:
        return None
    low = token.lower()
    if not any(c.isalpha() for c in low) or regex.match(r"^\d+(st|nd|rd|th)?$", low) or regex.search(r"[.,]\d", low):
        return None
    best = words.right(low, own, shapes)
    if best is None:
        return low.replace("@", "a").replace("€", "e").replace("|", "l").replace("$", "s").replace("0", "o").replace("1", "i") if _INNER.search(token) else None
    return best


def _cased(new: str, old: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() or (old[:1] in "1|5" and old[1:2].isupper()) else new


def noisy_lines(text: str, pages: int | None, model: LineModel, words: Words, seen: bytes | None = None) -> list[tuple[int, str]]:
    """``(line, kind)`` of all noisy lines, counted from 1; ``seen``: the packed features, if they are known."""
    lines, x = (text.split("\n"), unpacked(seen)) if seen else observations(text, pages)
    kinds = model.label(x)
    out = [(i + 1, "running") for i in np.flatnonzero(kinds == RUNNING)]
    own, shapes = own_words(lines, kinds)
    joins = _joined(lines, kinds, words, own)
    begun = {j: i for i, (j, _) in joins.items()}
    wrong: set[int] = set()
    for i, line in enumerate(lines):
        if kinds[i] != BODY:
            continue
        toks = [(m.start(), m[0]) for m in _TOKEN.finditer(line)]
        for n, (_, t) in enumerate(toks):
            if n == len(toks) - 1 and i in joins:
                j, _ = joins[i]
                b = regex.match(r"\f?\s*([\p{L}\p{M}\d@€|$!]+)", lines[j])
                full = t + b[1] if b else t
                new = restored(full, words, own, shapes)
                if new is not None:
                    if new[: len(t)] != t.lower():
                        wrong.add(i)
                    if b and new[-len(b[1]) :] != b[1].lower():
                        wrong.add(j)
                continue
            if n == 0 and i in begun:
                continue
            if restored(t, words, own, shapes) is not None:
                wrong.add(i)
    out += [(i + 1, "hyphen") for i, (_, whole) in joins.items() if whole]
    out += [(i + 1, "ocr") for i in wrong]
    return out


def repaired(text: str, pages: int | None, model: LineModel, words: Words, sections: dict[str, str | None] | None = None, seen: bytes | None = None) -> list[tuple[str, str | None]]:
    """``(part, paragraphs)`` of the whole text ("full_text") and of each section, by its heading.

    Paragraphs are parted by an empty line; furniture is gone, words are
    rejoined and characters restored.  A section is found in the whole text and
    takes its labels from there; one that isn't in it is treated by itself.
    ``seen``: the packed features of the whole text, if they are known.
    """
    lines, x = (text.split("\n"), unpacked(seen)) if seen else observations(text, pages)
    kinds = model.label(x)
    own, shapes = own_words(lines, kinds)
    joins = _joined(lines, kinds, words, own)
    out: list[tuple[str, str | None]] = [("full_text", _paragraphs(lines, kinds, joins, words, own, shapes, 0, len(lines)))]
    for heading, part in (sections or {}).items():
        at = text.find(part) if part else -1
        if not part or not part.strip():
            out.append((heading, part))
        elif at < 0:
            out.append((heading, repaired(part, None, model, words)[0][1]))
        else:
            first = text.count("\n", 0, at)
            out.append((heading, _paragraphs(lines, kinds, joins, words, own, shapes, first, first + part.count("\n") + 1)))
    return out


def _paragraphs(lines: list[str], kinds: np.ndarray, joins: dict[int, tuple[int, bool]], words: Words, own: Counter[str], shapes: dict[str, str], first: int, end: int) -> str:
    """The body lines from ``first`` to before ``end`` as paragraphs."""
    width = max((len(x) for x in lines), default=0)
    parts: list[str] = []
    now = ""

    def fixed(s: str) -> str:
        return _TOKEN.sub(lambda m: _cased(new, m[0]) if (new := restored(m[0], words, own, shapes)) is not None else m[0], s)

    for i in range(first, end):
        line = lines[i]
        if kinds[i] == RUNNING:
            continue
        bare = line.strip("\f ")
        if not bare:
            # a blank beside furniture belongs to the page, not to the text
            beside = (i and kinds[i - 1] == RUNNING) or (i + 1 < len(lines) and kinds[i + 1] == RUNNING)
            if now and not (beside and not regex.search(r"[.!?:][\"'”)]*$", now)):
                parts.append(now)
                now = ""
            continue
        if _HEADING.match(bare):
            parts += [p for p in (now, bare) if p]
            now = ""
            continue
        if now and regex.search(r"[.!?:][\"'”)]*$", now) and i and len(lines[i - 1].strip()) + 1 + len(bare.split()[0]) < 0.9 * width and kinds[i - 1] == BODY:
            parts.append(now)
            now = ""
        if i in joins:
            now += bare[:-1] if joins[i][1] else bare
            glue = ""
        else:
            now += bare
            glue = " "
        now += glue
    if now.strip():
        parts.append(now)
    return "\n\n".join(fixed(p.strip()) for p in parts)


def usual_words(docs: DataFrame, text_col: str = "full_text") -> dict[str, int]:
    """Words, and compounds with their mark, in how many reports each stands, if in at least the share ``USUAL`` of them.

    The shares bound how many words come to the driver.
    """
    total = docs.count()
    word = r"[\p{L}\p{M}\d@€|$!]+(?:-[\p{L}\p{M}\d@€|$!]+)*"
    # a word at a line's end that ends with a mark is a piece
    mid = F.regexp_replace(F.lower(text_col), r"[\p{L}\p{M}\d@€|$!-]+[-¬‐­]\s*\n[\s\f]*\S+", " ")
    each = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(mid, F.lit(word), F.lit(0)))).alias("w"))
    n = each.groupBy("w").count().where(F.col("count") >= max(2, USUAL * total))
    out = {r["w"]: r["count"] for r in n.collect()}
    # the parts of a compound are words too
    for w, c in list(out.items()):
        for p in w.split("-") if "-" in w else ():
            out[p] = max(out.get(p, 0), c)
    return out


def _observed(docs: DataFrame, columns: list[str], text_col: str, pages_col: str) -> DataFrame:
    """``columns`` and ``_seen``, the packed features of the text's lines, of all rows; null without text.  Written: each round of the fit reads them, then the labels."""
    some = docs.select(*columns)
    schema = T.StructType([*some.schema.fields, T.StructField("_seen", T.BinaryType())])
    text_at, pages_at = columns.index(text_col), columns.index(pages_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                seen = [packed(observations(t, p)[1]) if t else None for t, p in zip(part.column(text_at).to_pylist(), part.column(pages_at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(seen, pa.binary())], names=schema.names)

    return written(some.mapInArrow(run, schema), "scans")


def _line_model(seen: DataFrame) -> LineModel:
    """The model fitted on all rows of ``_seen``; 39 sums a task and round reach the driver."""
    texts = seen.where(F.col("_seen").isNotNull()).select("_seen")

    def expected(model: LineModel) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum((model.expected(batch.column(0).to_pylist()) for batch in batches), np.zeros(39))
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

        return sum((np.array(r["total"]) for r in texts.mapInArrow(run, "total array<double>").collect()), np.zeros(39))

    return LineModel().fit_by(expected)


def _each(docs: DataFrame, columns: list[str], text_col: str, pages_col: str, work, schema: T.StructType) -> DataFrame:  # noqa: ANN001
    seen = _observed(docs, columns, text_col, pages_col)
    fitted = docs.sparkSession.sparkContext.broadcast((_line_model(seen), Words(usual_words(seen, text_col))))
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = fitted.value
        arrow = pa.schema([pa.field(f.name, kind) for f, kind in zip(schema.fields, kinds)])
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                rows = [r for row in zip(*(c.slice(s, 64).to_pylist() for c in batch.columns)) for r in work(*row, model, words)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return seen.mapInArrow(run, schema)


def noise(docs: DataFrame, *, id_col: str = "pdf_id", text_col: str = "full_text", pages_col: str = "n_pages") -> DataFrame:
    """``(pdf_id, line_no, kind)``: running lines, lines that end inside a broken word, body lines with misread characters.

    Null and empty texts have no line of note; repeated rows have theirs each.
    """
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("line_no", T.LongType()), T.StructField("kind", T.StringType())])

    def work(i, t, p, seen, model, words):  # noqa: ANN001, ANN202
        return [(i, n, k) for n, k in noisy_lines(t, p, model, words, seen)] if t and t.strip() else []

    return _each(docs, [id_col, text_col, pages_col], text_col, pages_col, work, out)


def paragraphs(docs: DataFrame, *, id_col: str = "pdf_id", text_col: str = "full_text", pages_col: str = "n_pages", sections_col: str | None = "sections") -> DataFrame:
    """``(pdf_id, part, repaired)``: the whole text and each section of every report as continuous paragraphs; null and blank texts stay as they are."""
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("part", T.StringType()), T.StructField("repaired", T.StringType())])

    def work(i, t, p, *rest):  # noqa: ANN001, ANN202
        *sections, seen, model, words = rest
        of = dict(sections[0]) if sections and sections[0] else {}
        if not t or not t.strip():
            return [(i, "full_text", t), *((i, h, x and x.strip() and repaired(x, None, model, words)[0][1] or x) for h, x in of.items())]
        return [(i, part, x) for part, x in repaired(t, p, model, words, of, seen)]

    return _each(docs, [id_col, text_col, pages_col, *([sections_col] if sections_col else [])], text_col, pages_col, work, out)
