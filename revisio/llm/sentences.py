"""Sentence units of texts in any language or script.

Characters are tagged as boundary or inside by a linear-chain model with
learned emission and transition weights, decoded with Viterbi.  Only
characters that can end a unit are free: terminal marks with their closing
marks, line ends, and blanks in scripts that are written without marks.

The labels come from layout alone.  A stop at a paragraph's end is a boundary, a
stop before lower case is none; all other stops are unlabelled, and how likely
they are boundaries follows from how often their word, and places of their
kind, end paragraphs (learning from positive and unlabelled examples).  The
model is trained on texts from which that evidence has been stripped: line ends
are blanks there and case is not seen, so the weights have to rest on what is
left.  For scripts without marks the marks are stripped as well, and the line
ends and marks that were there are the boundaries to learn from.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisio.plans.lineage import written

#: Documents the model is fitted on at most, chosen by a hash of their id and text, ...
SAMPLE = 3000
#: ... with so many characters in all (documents are left out whole, not shortened).
SAMPLE_CHARS = 30_000_000
#: So many words with statistics are broadcast at most; if there are more they are joined to the documents.
BROADCAST_WORDS = 1_000_000
#: A word with a stop is an abbreviation if it ends a paragraph less often than this share of the usual.
RARELY = 0.35
CLOSE = "\"'”’»)）]」』“"
MARK = regex.compile(r"[.!?。！？।॥؟．｡]+")
NO_SPACE = r"\p{Han}\p{Hiragana}\p{Katakana}"
UNMARKED = r"\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_CJK = regex.compile(f"[{NO_SPACE}]")
_UNMARKED = regex.compile(f"[{UNMARKED}]")
_GAP = regex.compile(f"(?<=[{UNMARKED}])[^\\S\\n]+(?=\\S)|(?<=\\S)[^\\S\\n]+(?=[{UNMARKED}])")
_LINE = regex.compile(r"\s*\n\s*")
_QUOTED = regex.compile(
    r"«[^«»]*»|“[^“”„]*”|„[^„“”]*[“”]|「[^「」]*」|『[^『』]*』|(?<![\w\"])\"[^\s\"][^\"\n]*(?:\n[^\"\n]+)*\"(?!\w)|(?<![\w'])'[^\s'][^'\n]*[^\s'][.?!]'(?!\w)|\([^()]*(?:\([^()]*\)[^()]*)*\)|（[^（）]*）"
)
_OPEN = regex.compile(r"«[^«»\n]*$|“[^“”\n]*$|„[^„“\n]*$|「[^「」]*$|(?<![\w\"])\"[^\s\"][^\"\n]*$|(?<![\w'])'[^\s'][^'\n]*$")
_BEFORE = regex.compile(r"(?:([^\s(«“„\"]+)[\s]+)?([\p{L}\p{M}\p{N}.'’_-]+)$")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def _kind(ch: str) -> str:
    """The class of a character."""
    if not ch:
        return "E"
    if ch.isdigit():
        return "9"
    if ch.islower():
        return "a"
    if ch.isupper():
        return "A"
    if _CJK.match(ch):
        return "C"
    if _UNMARKED.match(ch):
        return "T"
    if ch.isalpha():
        return "X"
    if ch in "\"“«„'「『¿¡([（‘":
        return "Q"
    return ","


_LETTER = regex.compile(r"[\p{L}\p{N}]")
_BLANKS = regex.compile(r"\s+")
_REST = regex.compile(r"\s*")
_SOLID = regex.compile(r"\S+")
_DIGIT = regex.compile(r"\p{Nd}")
_RUN_ON = regex.compile(r"^.*\p{L}{4,}\.(?=.)")


class Place:
    """A character that may end a unit, with what the model sees of it.

    ``fixed`` is 1 or 0 where the text's form leaves no choice, else -1; ``label``
    is the layout's word on it, or -1; ``seen`` are features of what surrounds
    it once layout and case are stripped, ``cues`` the stripped evidence itself;
    ``group`` is the kind of place for which ends of paragraphs are counted and
    ``parted`` whether this one ends a paragraph.
    """

    __slots__ = ("end", "key", "seen", "cues", "fixed", "label", "group", "parted", "short")

    def __init__(self, end: int, key: str, seen: tuple[str, ...], cues: tuple[str, ...], fixed: int, label: int, group: str, parted: bool, short: str) -> None:
        self.end, self.key, self.seen, self.cues, self.fixed, self.label, self.group, self.parted, self.short = end, key, seen, cues, fixed, label, group, parted, short


def _key(text: str, end: int) -> str:
    """The word before a stop, digits masked; a number takes the word before it along unless that ends with a stop."""
    size = 40
    while len(_BLANKS.findall(text, max(0, end - size), end)) < 3 and size < end:
        size *= 2
    m = _BEFORE.search(text[max(0, end - size) : end])
    if not m:
        return ""
    # a blank that is missing after a sentence: the word is what comes after its stop
    word = _RUN_ON.sub("", _DIGIT.sub("9", m[2]).lstrip("."))
    if word.replace("9", "").strip(".") == "":
        lead = m[1] or ""
        return f"{'' if lead[-1:] in '.．｡' else lead}|{word[-4:]}"
    return word


def _shape(key: str) -> str:
    """1: a letter, i: with stops inside, d: a number, s: short, l: long, -: none."""
    word = key.rpartition("|")[2]
    return "-" if not key else "d" if word.replace("9", "") == "" or "|" in key else "1" if len(word) == 1 else "i" if "." in word.strip(".") else "s" if len(word) < 5 else "l"


def places(text: str) -> list[Place]:
    """All places of a text in order."""
    quotes = [m.span() for m in _QUOTED.finditer(text)]
    opened = [a for a, _ in quotes]
    last = _OPEN.search(text)
    if last and not any(a <= last.start() < b for a, b in quotes):
        quotes.append((last.start(), len(text) + 1))
        opened.append(last.start())
        quotes.sort()
        opened.sort()
    closing = {b: a for a, b in quotes}
    reach, most = [], 0
    for _, b in quotes:
        most = max(most, b)
        reach.append(most)

    def within(i: int) -> bool:
        """Whether the character before ``i`` lies in a quotation that goes on after it."""
        k = bisect.bisect_left(opened, i) - 1
        while k >= 0 and reach[k] > i:
            if quotes[k][0] < i < quotes[k][1]:
                return True
            k -= 1
        return False

    starts = set(opened)
    size = len(text)
    width = max((len(x) for x in text.split("\n")), default=0)
    lines = text.count("\n")
    hard = lines >= 2 and width <= 110
    out: list[Place] = []
    taken = -1
    for m in MARK.finditer(text):
        i = m.end()
        if m.start() < taken:
            continue
        while i < size:
            if text[i] in CLOSE and i not in starts:
                i += 1
            elif text[i] in "   " and i + 1 < size and text[i + 1] == "»":
                i += 2
            else:
                break
        taken = i
        rest = _REST.match(text, i).end()
        gap = text[i:rest]
        nxt = text[rest : rest + 1]
        kind = _kind(nxt)
        if kind == "a":
            w = _WORD.match(text, rest)
            tail = text[w.end() : w.end() + 1] if w else ""
            if w and (any(c.isupper() for c in w[0]) or (not gap and tail and _CJK.match(tail)) or (not gap and _CJK.search(w[0]))):
                kind = "A"  # a name such as mRNA, or a foreign word that opens a sentence
        elif kind == "Q":
            kind = "Q" + _kind(text[rest + 1 : rest + 2])
        mark = m[0][-1]
        mark = "…" if len(m[0]) > 1 and set(m[0]) == {"."} else "." if mark in "．｡" else mark
        key = _key(text, m.start()) if mark == "." else ""
        closers = text[m.end() : i].strip()
        q = "-"
        if closers:
            q = ")" if set(closers) <= set(")）]") else '"'
            if q == '"' and i in closing:
                lead = text[: closing[i]].rstrip()[-1:] if closing[i] < 64 else text[closing[i] - 64 : closing[i]].rstrip()[-1:] or text[: closing[i]].rstrip()[-1:]
                q = ":" if lead in ":：" and lead else "s" if not lead or lead in ".!?。！？।؟\"”»」" else "m"
        ws = "e" if rest >= size else "p" if gap.count("\n") > 1 else "n" if "\n" in gap else "_" if gap else "-"
        prev = _kind(text[m.start() - 1 : m.start()]) if m.start() else "E"
        shape = _shape(key)
        # the text's form leaves no choice within quotations and numbers, at its end and between paragraphs
        fixed = -1
        if within(i):
            fixed = 0
        elif ws in "ep":
            fixed = 1
        elif mark == "." and ws == "-" and (kind in "9a" or nxt in ",;:/-–"):
            fixed = 0
        elif kind in ("C", "X", "T") and q in "sm" and ws in "-_":
            fixed = 0  # without capitals, only a quotation that was led in by a colon ends the sentence
        follows_on = kind == "a" or nxt in ",;:)]）、，；：" or (nxt in "—–-" and q in 's"m:')
        label = fixed if fixed >= 0 else 0 if follows_on else 1 if ws == "n" and not hard and width > 110 else -1
        # without case and layout
        k = "L" if kind in ("a", "A") else "QL" if kind in ("Qa", "QA") else kind
        script = next((x for x in "CX" if x in (prev, kind[-1])), "L")
        blank = "-" if ws == "-" or (ws in "pn" and script == "C") else "_"
        open_ = "L" if prev in "aA" else prev
        seen = (f"m{mark}", f"s{shape}", f"s{shape}{open_}", f"q{q}", f"k{k}{blank}", f"mk{mark}{k}{blank}", f"sk{shape}{k}{blank}", f"qk{open_}{q}{k}")
        cues = (f"c{kind}", f"c{kind}{ws if ws in '-_' else 'n'}{shape}") + ((f"c{nxt}{q}",) if follows_on and kind != "a" else ()) + ((f"l{hard}",) if ws in "np" else ())
        out.append(Place(i, key, seen, cues, fixed, label, f"{script}{mark}{shape}{k}{q}{blank if key else ''}" if nxt else "", ws == "p" or (ws == "n" and not hard), shape))
    done = {p.end for p in out}
    for m in _LINE.finditer(text):
        end = m.start()
        if end in done or end == 0 or m.end() >= size:
            continue
        begin = text.rfind("\n", 0, end) + 1
        w = _SOLID.match(text, m.end())
        need = 1 if w and _CJK.match(w[0]) else 1 + len(w[0]) if w else 0
        room = end - begin + need <= width  # the next word had room: nobody had to break here
        brk = m[0].count("\n") > 1
        a, b = _kind(text[end - 1]), _kind(text[m.end()])
        title = _kind(text[begin : begin + 1]) in "AXCT9Q" and b in "AXCT9Q"
        fixed = 0 if within(end) and not brk else 1 if brk else 1 if (not hard or (room and title)) and text[end - 1] not in ",;" and b != "a" else -1
        if fixed < 0 and not (a == "T" and b == "T"):
            fixed = 0
        bare = a == "T" or b == "T"
        near = (f"g{a}{b}", f"t{text[max(0, end - 3) : end]}", f"n{text[m.end() : m.end() + 3]}") if bare else ()
        out.append(Place(end, "", near, (), fixed, fixed, f"g{a}{b}" if bare else "", bare and fixed == 1, "-"))
    if _UNMARKED.search(text):
        for m in _GAP.finditer(text):
            if m.start() in done:
                continue
            a, b = _kind(text[m.start() - 1]), _kind(text[m.end() : m.end() + 1])
            out.append(Place(m.start(), "", (f"g{a}{b}", f"t{text[max(0, m.start() - 3) : m.start()]}", f"n{text[m.end() : m.end() + 3]}"), (), 0 if within(m.start()) else -1, -1, f"g{a}{b}", False, "-"))
    out.sort(key=lambda p: p.end)
    return out


# ---- statistics of words before stops ---------------------------------------


def _hits(text: Column) -> Column:
    """Each word before a stop with the blanks and the character after it, parted by a control character."""
    number = r"(?:[^\s(«“„\"]*[^\s(«“„\".．｡]\s+)?\p{Nd}[\p{Nd}.]*"
    word = r"[\p{L}\p{M}\p{N}.'’_-]*[\p{L}\p{M}\p{N}'’_-]"
    closers = "(?:[\"'”’»)）\\]』」“]|[\u0020\u00a0\u202f]»)*"
    stop = rf"(?<![\p{{L}}\p{{M}}\p{{N}}.'’_-])({number}|{word})(?<![.．｡])[.．｡](?![.．｡])(?={closers}(\s*)(\S?))"
    marked = F.regexp_replace(F.translate(text, "\u0001\u0002\u0003", ""), stop, "\u0001$1\u0002$2\u0002$3\u0003")
    return F.transform(F.slice(F.split(marked, "\u0001"), 2, 2**31 - 2), lambda x: F.substring_index(x, "\u0003", 1))


def _part(hit: Column, i: int) -> Column:
    return F.element_at(F.split(hit, "\u0002"), i)


def _key_of(hit: Column) -> Column:
    """:func:`_key` of a hit."""
    raw = F.regexp_replace(_part(hit, 1), r"\p{Nd}", "9")
    last = F.regexp_replace(F.regexp_extract(raw, r"(\S*)$", 1), r"^\.+|^.*\p{L}{4,}\.(?=.)", "")
    lead = F.regexp_extract(raw, r"^(\S+)\s+\S+$", 1)
    return F.when(F.length(F.translate(last, "9.", "")) == 0, F.concat(lead, F.lit("|"), F.right(last, F.lit(4)))).otherwise(last)


def word_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(key, n, low, end)`` of every word before a stop: how often it stands there, before lower case or a digit, and at a paragraph's end.

    One pass of one expression over the texts; equal hits are counted before
    words are told apart, so few strings are shuffled.
    """
    n = docs.select(F.explode(_hits(F.col(text_col))).alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    gap, nxt = _part(F.col("h"), 2), _part(F.col("h"), 3)
    ends = (nxt == "") | gap.contains("\n")
    # of scripts without case, a letter that follows at once
    uncased = (gap == "") & nxt.rlike(r"[\p{Lo}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]")
    low = (nxt != "") & (nxt.rlike(r"[\p{Ll}\p{Nd},;:)]") | uncased)
    each = n.where((gap != "") | (nxt == "") | uncased).select(_key_of(F.col("h")).alias("key"), "c", ends.alias("ends"), low.alias("low"))
    return each.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("low"), F.col("c")).otherwise(0)).alias("low"), F.sum(F.when(F.col("ends"), F.col("c")).otherwise(0)).alias("end"))


def telling(words: DataFrame) -> DataFrame:
    """``(key, cls, q)`` of the words whose class differs from what their form alone says.

    ``cls`` is 1 for an abbreviation, else 0; ``q`` is the chance that a stop
    after the word, not followed by lower case, is a boundary.  Two sums come
    to the driver.
    """
    w = words.where("n > 0")
    s = w.agg(F.sum("n"), F.sum("low"), F.sum("end")).first()
    total, low, end = (float(x or 0) for x in s)
    base = end / max(1.0, total)
    free = F.col("n") - F.least("low", "n")
    ends = w.select((F.col("end") * F.try_divide("end", free)).alias("x"), "end").agg(F.sum("x"), F.sum("end")).first()
    share = F.coalesce(F.try_divide("end", free), F.lit(0.0))
    rate = F.when(free > 0, (share + 0.5 / free + F.sqrt(share * (1 - share) / free + 0.25 / (free * free))) / (1 + 1 / free)).otherwise(0.0)
    usual = min(0.999, float(ends[0] or 0) / max(1.0, float(ends[1] or 0)) or 0.5)
    # Elkan and Noto: of unlabelled examples, how many are positive
    odds = F.try_divide(rate, 1 - rate) * (1 - usual) / usual
    often = F.col("n") >= 12
    avoided = often & (F.col("end") < RARELY * base * F.col("n"))
    before = (F.col("low") * 2 > F.col("n") - F.col("end")) & (F.col("n") > 1) & (F.col("end") < 0.5 * base * F.col("n") + 1)
    cls = F.when(avoided | before, 1).otherwise(F.when(often, 0).otherwise(2))
    short = F.length(F.substring_index("key", "|", -1)) < 5
    out = w.select("key", cls.cast("int").alias("cls"), F.least(F.lit(1.0), F.coalesce(odds, F.lit(1.0))).alias("q"), short.alias("short"))
    # a long word that is no abbreviation need not be known
    return out.where("cls = 1 or (short and cls = 0)").select("key", "cls", "q")


Known = dict[str, tuple[int, float]]


def _class(p: Place, known: Known) -> str:
    if not p.key:
        return "-"
    got = known.get(p.key)
    return str(got[0]) if got else "0" if p.short == "l" else "2"


def features(p: Place, known: Known, cued: bool, close: bool = False) -> list[str]:
    """What the model sees of a place: with case and layout (``cued``) or without; ``close`` takes the blank before a letter away."""
    if not p.seen or p.seen[0][0] != "m":
        return list(p.seen)
    a = _class(p, known)
    seen = [s[:-1] + "-" if s[-2:] == "L_" else s for s in p.seen] if close and p.seen[4] == "kL_" else p.seen
    k = seen[4]
    more = [f"a{a}", f"a{a}{p.short}", f"a{a}{k}", f"a{a}{p.short}{k}"]
    return [*seen, *more, *(p.cues if cued else ())]


# ---- the model ------------------------------------------------------------------

#: States: a boundary; inside and nothing but marks since the last boundary; inside a unit that has a letter or digit.
B, EMPTY, OPEN = 0, 1, 2
BINS = 5


def _bin(distance: int) -> int:
    return min(BINS - 1, max(0, int(distance).bit_length() - 2))


class Chain:
    """Weights of a linear chain of boundary and inside tags: emissions by feature, transitions by the tags and the distance."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.w = np.zeros(1)
        self.move = np.zeros((2, 2, BINS))

    def emission(self, names: list[str]) -> float:
        return float(self.w[0] + sum(self.w[self.ids[f]] for f in names if f in self.ids))

    def steps(self, letters: bool, distance: int) -> np.ndarray:
        """Scores of the moves between the three states; impossible ones are minus infinity."""
        return _steps(self.move, np.array([letters]), np.array([_bin(distance)]))[0]

    def decode(self, emissions: list[float], letters: list[bool], distances: list[int]) -> list[bool]:
        """The best sequence of tags, by Viterbi: True at boundaries."""
        best = [0.0, -np.inf, -np.inf]  # a text begins as after a boundary
        back: list[tuple[int, int, int]] = []
        m = self.move
        for e, l, d in zip(emissions, letters, distances):
            b = _bin(d)
            # towards a boundary: there must be a letter since the last one
            to_b = [(best[B] + m[1, 1, b] if l else -np.inf), (best[EMPTY] + m[0, 1, b] if l else -np.inf), best[OPEN] + m[0, 1, b]]
            in_b, in_e, in_o = best[B] + m[1, 0, b], best[EMPTY] + m[0, 0, b], best[OPEN] + m[0, 0, b]
            x = max(range(3), key=to_b.__getitem__)
            if l:
                opens = [in_b, in_e, in_o]
                o = max(range(3), key=opens.__getitem__)
                new, way = [to_b[x] + e, -np.inf, opens[o]], (x, 0, o)
            else:
                y = 0 if in_b > in_e else 1
                new, way = [to_b[x] + e, in_b if y == 0 else in_e, in_o], (x, y, 2)
            back.append(way)
            best = new
        state = max(range(3), key=best.__getitem__)
        tags = []
        for way in reversed(back):
            tags.append(state == B)
            state = way[state]
        return tags[::-1]


def _steps(move: np.ndarray, letters: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Moves between the states for many chains at once: chain, from, to."""
    n = len(letters)
    s = np.full((n, 3, 3), -np.inf)
    for a, tag in ((B, 1), (EMPTY, 0), (OPEN, 0)):
        s[:, a, B] = np.where(letters | (a == OPEN), move[tag, 1, bins], -np.inf)
        if a == OPEN:
            s[:, a, OPEN] = move[tag, 0, bins]
        else:
            s[:, a, OPEN] = np.where(letters, move[tag, 0, bins], -np.inf)
            s[:, a, EMPTY] = np.where(letters, -np.inf, move[tag, 0, bins])
    return s


def _segments(text: str, ps: list[Place], soft: list[float]) -> Iterator[tuple[list[Place], list[float], list[bool], list[int]]]:
    """A text's chain, parted where a boundary is certain: what follows does not depend on what was before."""
    now: tuple[list[Place], list[float], list[bool], list[int]] = ([], [], [], [])
    at = 0
    for p, q in zip(ps, soft):
        for x, y in zip(now, (p, q, bool(_LETTER.search(text, at, p.end)), p.end - at)):
            x.append(y)
        at = p.end
        if p.fixed == 1:
            yield now
            now = ([], [], [], [])
    if now[0]:
        yield now


def _upper(hits: float, of: float, z: float) -> float:
    """The upper end of Wilson's interval of a share: few examples prove little."""
    s = hits / of
    return (s + z * z / 2 / of + z * (s * (1 - s) / of + z * z / 4 / of**2) ** 0.5) / (1 + z * z / of)


def soft_labels(samples: list[list[Place]], known: Known) -> list[list[float]]:
    """How likely each place is a boundary, by layout alone.

    Places at ends of paragraphs are positive examples, places before lower
    case negative ones.  For the others, the share of their word's free places
    that end paragraphs, or of their kind's if the word is too rare, against the
    share among ends of paragraphs, says how many of them are positive.
    """
    ends: dict[str, float] = {}
    free: dict[str, float] = {}
    for ps in samples:
        for p in ps:
            if p.group and (p.parted or (p.label < 0 and p.fixed < 0)):
                free[p.group] = free.get(p.group, 0) + 1
                ends[p.group] = ends.get(p.group, 0) + p.parted
    out_of: dict[str, float] = {}
    for script in "gCXL":  # how long paragraphs are differs between scripts
        some = [g for g in free if g[0] == script]
        c = sum(ends[g] * ends[g] / free[g] for g in some) / (sum(ends[g] for g in some) or 1.0)
        for g in some:
            r = (ends[g] + 0.5 * c) / (free[g] + 0.5) if script == "g" else _upper(ends[g], free[g], 1.0 if g[1] == "." else 2.0)  # marks that end no abbreviation need stronger evidence
            out_of[g] = min(1.0, r / (1 - r) * (1 - c) / c) if 0 < c < 1 and r < 1 else 1.0
    soft = []
    for ps in samples:
        row = []
        for p in ps:
            if p.label >= 0:
                row.append(float(p.label))
            elif p.key and _class(p, known) != "2":
                row.append(known.get(p.key, (0, 1.0))[1])
            else:
                row.append(out_of.get(p.group, 1.0))
        soft.append(row)
    return soft


def fit(texts: list[str], known: Known, rounds: int = 40) -> Chain:
    """The chain's weights: conditional likelihood of the soft labels, by gradient steps scaled by feature.

    Every text is seen twice: with case and layout, and stripped of them; every
    fifth place of the stripped text has lost its blank too, as happens in texts.
    """
    samples = [places(t) for t in texts]
    soft = soft_labels(samples, known)
    model = Chain()
    # equal chains are weighed by their number
    seen: dict[tuple, int] = {}
    for text, ps, qs in zip(texts, samples, soft):
        free = [(p, q) for p, q in zip(ps, qs) if p.end <= len(text)]
        for part, q, letters, gaps in _segments(text, [p for p, _ in free], [q for _, q in free]):
            for cued in (False, True):
                at = tuple(tuple(model.ids.setdefault(f, len(model.ids) + 1) for f in features(p, known, cued, not cued and i % 5 == 0)) for i, p in enumerate(part))
                row = (at, tuple(q), tuple(letters), tuple(_bin(d) for d in gaps), tuple(p.fixed for p in part))
                seen[row] = seen.get(row, 0) + 1
    if not seen:
        return model
    rows = sorted(seen.items(), key=lambda r: len(r[0][0]))
    wide = max(len(f) for (at, *_), _ in rows for f in at) + 1
    off = len(model.ids) + 1  # what pads a row of features
    model.w = np.zeros(off + 1)
    blocks = []
    for s in range(0, len(rows), 2048):
        part = rows[s : s + 2048]
        n, size = len(part), max(len(r[0]) for r, _ in part)
        x = np.full((n, size, wide), off, np.int32)
        y, on, letters, bins, fixed = np.zeros((n, size)), np.zeros((n, size), bool), np.zeros((n, size), bool), np.zeros((n, size), np.int8), np.full((n, size), -1, np.int8)
        for i, ((at, q, let, bs, fx), _) in enumerate(part):
            k = len(at)
            x[i, :k, 0] = 0
            for j, f in enumerate(at):
                x[i, j, 1 : len(f) + 1] = f
            y[i, :k], on[i, :k], letters[i, :k], bins[i, :k], fixed[i, :k] = q, True, let, bs, fx
        blocks.append((x[on], y, on, letters, bins, fixed, np.array([c for _, c in part], float)))
    grow_w, grow_m = np.zeros_like(model.w), np.zeros_like(model.move)
    for _ in range(rounds):
        g, gm = np.zeros_like(model.w), np.zeros_like(model.move)
        for x, y, on, letters, bins, fixed, many in blocks:
            p, pairs = _expected(model, x, on, letters, bins, fixed, many)
            d = np.where(on & (fixed < 0), y - p, 0.0) * many[:, None]
            g += np.bincount(x.ravel(), np.repeat(d[on], wide), len(g))
            gm += _told(np.where(fixed >= 0, fixed, y), on, bins, many) - pairs
        g[off] = 0
        g -= 1e-3 * model.w
        gm -= 1e-2 * model.move
        grow_w += g * g
        grow_m += gm * gm
        model.w += 0.5 * g / np.sqrt(grow_w + 1e-6)
        model.move += 0.1 * gm / np.sqrt(grow_m + 1e-6)
    model.w = model.w[:off]
    return model


def _told(y: np.ndarray, on: np.ndarray, bins: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Pairs of tags as labelled; before a chain's first place there is a boundary."""
    before = np.concatenate([np.ones((len(y), 1)), y[:, :-1]], 1)
    out = np.zeros((2, 2, BINS))
    for a in (0, 1):
        for b in (0, 1):
            out[a, b] = np.bincount(bins[on], ((before if a else 1 - before) * (y if b else 1 - y) * many[:, None])[on], BINS)
    return out


def _expected(model: Chain, x: np.ndarray, on: np.ndarray, letters: np.ndarray, bins: np.ndarray, fixed: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of a boundary at each place and of pairs of tags, by forward and backward sums."""
    n, size = on.shape
    e = np.zeros((n, size))
    e[on] = model.w[x].sum(1)
    emit = np.exp(np.clip(np.where(fixed == 1, 30.0, np.where(fixed == 0, -30.0, e)), -30, 30))
    steps = [np.exp(_steps(model.move, letters[:, t], bins[:, t])) for t in range(size)]
    ahead = np.zeros((n, size + 1, 3))
    ahead[:, 0, B] = 1.0
    scale = np.ones((n, size))
    for t in range(size):
        now = (ahead[:, t, :, None] * steps[t]).sum(1)
        now[:, B] *= emit[:, t]
        scale[:, t] = np.where(on[:, t], now.sum(1), 1.0)
        ahead[:, t + 1] = np.where(on[:, t, None], now / scale[:, t, None], ahead[:, t])
    z = np.ones((n, 3))
    p = np.zeros((n, size))
    pairs = np.zeros((2, 2, BINS))
    for t in range(size - 1, -1, -1):
        p[:, t] = ahead[:, t + 1, B] * z[:, B]
        after = z / scale[:, t, None]
        after[:, B] *= emit[:, t]
        w = ahead[:, t, :, None] * steps[t] * after[:, None, :] * (many * on[:, t])[:, None, None]
        for i, tag in ((B, 1), (EMPTY, 0), (OPEN, 0)):
            pairs[tag, 1] += np.bincount(bins[:, t], w[:, i, B], BINS)
            pairs[tag, 0] += np.bincount(bins[:, t], w[:, i, EMPTY] + w[:, i, OPEN], BINS)
        z = np.where(on[:, t, None], (steps[t] * after[:, None, :]).sum(2), z)
    return p, pairs


def decode(text: str, known: Known, model: Chain) -> list[int]:
    """Ends of the units: the most likely sequence of tags, in which no unit is without a letter or digit."""
    final = len(text.rstrip())
    if not final:
        return []
    ps = [p for p in places(text) if p.end < final]
    emissions, letters, distances, at = [], [], [], 0
    for p in ps:
        emissions.append(-1e6 if p.fixed == 0 else 1e6 if p.fixed == 1 else model.emission(features(p, known, True)))
        letters.append(bool(_LETTER.search(text, at, p.end)))
        distances.append(p.end - at)
        at = p.end
    out = [p.end for p, tag in zip(ps, model.decode(emissions, letters, distances)) if tag]
    if out and not _LETTER.search(text, out[-1], final):
        # what is left has no letter: blanks go, marks join the last unit
        return out if not text[out[-1] : final].strip() else [*out[:-1], final]
    return [*out, final]


def sentence_ends(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``(doc_id, end_pos)``, one row a unit: the code points of the text up to its last character.

    Null and blank texts have no unit; repeated rows have theirs each.  Words
    with statistics are broadcast if they are at most ``broadcast_words``, else
    each document gets those of its own words by a join.
    """
    spark = docs.sparkSession
    words = telling(written(word_statistics(docs, text_col), "stops"))
    words = written(words, "words")
    few = words.count() <= broadcast_words
    some = docs.where(F.length(F.trim(text_col)) > 0)
    order = F.xxhash64(id_col, text_col)
    first = some.select(order.alias("h"), F.length(text_col).alias("n")).orderBy("h").limit(SAMPLE).collect()
    cut, chars = None, 0
    for r in first:
        chars += r["n"]
        if chars > SAMPLE_CHARS and cut is not None:
            break
        cut = r["h"]
    sample = [r["t"] for r in some.where(order <= cut).select(F.col(text_col).alias("t")).collect()] if cut is not None else []
    if few:
        known: Known = {r["key"]: (r["cls"], r["q"]) for r in words.collect()}
    else:
        mine = spark.createDataFrame([(t,) for t in sample], "t string") if sample else docs.select(F.col(text_col).alias("t")).limit(0)
        keys = word_statistics(mine, "t").select("key")
        known = {r["key"]: (r["cls"], r["q"]) for r in words.join(keys, "key", "left_semi").collect()}
    model = fit(sample, known)
    shared = spark.sparkContext.broadcast((known if few else None, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_, chain = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                own = part.column(2).to_pylist() if all_ is None else None
                ends = [decode(t, all_ if own is None else {w["key"]: (w["cls"], w["q"]) for w in own[k] or ()}, chain) if t else [] for k, t in enumerate(part.column(1).to_pylist())]
                n = np.array([len(e) for e in ends], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(ends)), n))), pa.array([x for e in ends for x in e], pa.int64())], names=["id", "end_pos"])

    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("end_pos", T.LongType())])
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not few:
        each = base.where("text is not null").select(F.xxhash64("text").alias("h"), "text").dropDuplicates(["h"])
        per = each.select("h", F.explode(F.array_distinct(F.transform(_hits(F.col("text")), _key_of))).alias("key")).join(words, "key").groupBy("h").agg(F.collect_list(F.struct("key", "cls", "q")).alias("own"))
        base = base.withColumn("h", F.xxhash64("text")).join(per, "h", "left").select("id", "text", "own")
    return base.mapInArrow(run, out).withColumnRenamed("id", id_col)
