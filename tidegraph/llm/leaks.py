"""Evaluation texts leaking into training texts, through scanning errors: winnowing over folded letters.

Both sides are folded to streams of letters in which case, punctuation, white space, hyphens and commonly misread shapes
make no difference. Both are winnowed alike, so any stretch of GRAM + WINDOW - 1 folded letters that they share yields a
common fingerprint. Places that meet in a fingerprint are extended from there in both directions, over lines of adverts
and other columns that stand in between, until the number of consecutive words is known.

The tests are broadcast in shards of TEST_CHARS code points, whatever their number, and the join of the fingerprints is a
lookup on the side of the pages: one pass per shard reads the pages, and neither texts nor fingerprints are shuffled.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.blocks import blocks
from tidegraph.llm.winnow import fingerprints, rolling

GRAM, WINDOW = 12, 7
#: Words in a row that make a leak.
WORDS = 13
#: Inserted lines up to which a continuing line is preferred to a slip; later lines are looked for where no slip fits.
NEAR_LINES = 14
#: Code points of tests in one broadcast. More tests go in several, each with a pass of its own over the pages.
TEST_CHARS = 4_000_000
#: Pairs of places that are looked at together in one step of a kernel.
STEP = 100_000
#: Shapes that scanning takes for each other, each written as one of them (letter by letter).
SHAPES = {
    "e": "c", "r": "v", "y": "v", "a": "o", "0": "o", "f": "t", "n": "u", "l": "i", "1": "i", "j": "i", "g": "q", "b": "h", "8": "h", "5": "s",
    "m": "vu", "d": "ci", "k": "ic", "w": "vv",
}
_ENDS = np.array([ord(c) for c in "\r\n\v\f\x85\u2028\u2029"], np.uint32)
#: Scripts written without spaces between words (first and last code point).
UNSPACED = (
    ("Thai and Lao", 0x0E00, 0x0EFF), ("Myanmar", 0x1000, 0x109F), ("Khmer", 0x1780, 0x17FF),
    ("kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Han beyond the first plane", 0x20000, 0x3FFFF),
)
#: A run without spaces of more letters of such scripts than this is no single word: UNSPACED_WORD letters make one.
UNSPACED_RUN, UNSPACED_WORD = 6, 2


def folded_letters(ch: str) -> str:
    """The folded letters of one character. Accents fall away, ligatures and old letter forms become their letters; what
    is no letter, digit or vowel sign of running text (signs, spaces, ornamental forms of letters) vanishes."""
    kind = unicodedata.category(ch)
    plain = unicodedata.normalize("NFKD", ch)
    if kind in ("Lu", "Ll", "Lt", "Nd") and ord(ch) <= 0xFFFF:
        pass
    elif kind in ("Lu", "Ll", "Lt", "Lo", "Lm", "Nd"):
        if plain != ch and plain.isascii():
            return ""
    elif not (kind in ("Mc", "Mn") and not unicodedata.combining(ch) and "VOWEL SIGN" in unicodedata.name(ch, "")):
        return ""
    plain = plain.lower().replace("ß", "ss").replace("æ", "ae").replace("œ", "oe")
    return "".join(SHAPES.get(c, c) for c in plain if not unicodedata.combining(c))


class Folding:
    """Folded letters by code point, filled as code points are met: their number, and where they stand in ``flat``."""

    def __init__(self) -> None:
        self.size = np.full(0x110000, -1, np.int8)
        self.start = np.zeros(0x110000, np.int32)
        self.flat = np.empty(0, np.uint32)

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(folded letters, where each code point's letters end in them)."""
        sizes = self.size[codes]
        if len(sizes) and sizes.min() < 0:
            for code in np.unique(codes[sizes < 0]).tolist():
                letters = folded_letters(chr(code))
                self.start[code], self.size[code] = len(self.flat), len(letters)
                self.flat = np.concatenate([self.flat, np.array([ord(c) for c in letters], np.uint32)])
            sizes = self.size[codes]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[codes] - (ends - sizes), sizes) + np.arange(total)
        return self.flat[at], ends


FOLDING = Folding()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def as_text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def mended(text: str) -> str:
    """Two dots of an i and its neighbour are a misread u with two dots."""
    return text.replace("ii", "u")


def fold(text: str) -> str:
    """The folded letters of a text."""
    return as_text(FOLDING(code_points(mended(text)))[0])


class Pages:
    """A block of folded pages: their letters end to end, and the bounds of pages and of lines that hold letters."""

    def __init__(self, texts: list[str | None]):
        raw = [mended(t) if t else "" for t in texts]
        codes = code_points("".join(raw))
        self.letters, ends = FOLDING(codes)
        ends = np.concatenate([[0], ends])
        cuts = np.cumsum([0, *map(len, raw)])
        self.begins, self.ends = ends[cuts[:-1]], ends[cuts[1:]]
        marks = ends[np.flatnonzero(np.isin(codes, _ENDS))]
        bounds = np.unique(np.concatenate([marks, self.begins, self.ends]))
        self.lines, self.line_ends = bounds[:-1], bounds[1:]
        self.page_of_line = np.searchsorted(self.ends, self.lines, side="right")
        self.grams = Grams(self.letters)

    def page(self, k: int) -> Page:
        a, b = int(self.begins[k]), int(self.ends[k])
        first, last = np.searchsorted(self.lines, [a, b])
        return Page(as_text(self.letters[a:b]), (self.lines[first:last] - a).tolist())


#: Ways to step over a slip that folding didn't mend: letters of the page, letters of the test.
SLIPS = ((1, 1), (0, 1), (1, 0), (2, 1), (1, 2), (2, 2), (0, 2), (2, 0), (3, 2), (2, 3), (3, 3), (3, 1), (1, 3))
AGREE, LINE_AGREE, LEAST_LINE = 5, 8, 4


class Page:
    """A folded page with the begins of its lines, read in either direction."""

    def __init__(self, text: str, starts: list[int]):
        self.text, self.starts = text, starts
        self.heads = line_heads(text, starts)
        n = len(text)
        self._back: tuple[str, list[int], dict[str, list[int]]] | None = None
        self._ends = [n - e for e in reversed([*starts[1:], n])] if starts else []

    def backward(self) -> tuple[str, list[int], dict[str, list[int]]]:
        if self._back is None:
            text = self.text[::-1]
            self._back = text, self._ends, line_heads(text, self._ends)
        return self._back


def line_heads(text: str, starts: list[int]) -> dict[str, list[int]]:
    """The begins of lines by their first four letters."""
    out: dict[str, list[int]] = {}
    for s in starts:
        out.setdefault(text[s : s + LEAST_LINE], []).append(s)
    return out


def agreeing(page: str, i: int, item: str, o: int) -> int:
    """How many letters in a row agree from the two places on."""
    n = most = min(len(page) - i, len(item) - o)
    while n and page[i : i + n] != item[o : o + n]:
        n //= 2
    while n < most and page[i + n] == item[o + n]:
        n += 1
    return n


def extend(
    page: str, starts: list[int], heads: dict[str, list[int]], i: int, item: str, o: int, near: int = NEAR_LINES
) -> tuple[int, list[int]]:
    """How far ``item`` from ``o`` on follows ``page`` from ``i`` on: the end in the item and the places of slips in it.
    Where neither one of the ``near`` next lines nor a slip goes on, the later line that agrees longest does."""
    slips: list[int] = []
    n, m = len(page), len(item)
    while i < n and o < m:
        step = min(n - i, m - o, 64)
        if page[i : i + step] == item[o : o + step]:
            i, o = i + step, o + step
            continue
        while page[i] == item[o]:
            i, o = i + 1, o + 1
        line = bisect_right(starts, i) - 1
        back = o - (i - starts[line])
        if back >= 0:
            need = item[back : back + LINE_AGREE]
            on = next((s for s in starts[line + 1 : line + 1 + near] if len(need) >= LEAST_LINE and page.startswith(need, s)), None)
            if on is not None:
                slips = [s for s in slips if s < back]
                i, o = on, back
                continue
        for di, do in SLIPS:
            then = item[o + do : o + do + AGREE]
            if len(then) == AGREE and page.startswith(then, i + di):
                slips += range(o, o + max(di, do)) if do else [o] * di
                i, o = i + di, o + do
                break
        else:
            need = item[back : back + LINE_AGREE] if back >= 0 else ""
            later = heads.get(need[:LEAST_LINE], ()) if len(need) >= LEAST_LINE else ()
            reach, on = max(((agreeing(page, s, item, back), -s) for s in later if s > starts[line]), default=(0, 0))
            if reach < len(need) or reach <= o - back:
                break
            slips = [s for s in slips if s < back]
            i, o = -on, back
    return o, slips


def is_unspaced(ch: str) -> bool:
    return any(a <= ord(ch) <= b for _, a, b in UNSPACED)


class Item:
    """A folded test with the bounds of its words (between white space); words without letters have none. Long runs in
    scripts without spaces are cut into words of UNSPACED_WORD letters."""

    def __init__(self, text: str):
        self.words: list[tuple[int, int]] = []
        parts, at = [], 0
        for word in text.split():
            f = fold(word)
            run = sum(map(is_unspaced, f)) > UNSPACED_RUN
            for a in range(0, len(f), UNSPACED_WORD) if run else [0] * bool(f):
                b = min(len(f), a + UNSPACED_WORD) if run else len(f)
                self.words.append((at + a, at + b))
            parts.append(f)
            at += len(f)
        self.text = "".join(parts)
        self.back = self.text[::-1]


def longest_run(page: Page, item: Item, places: list[tuple[int, int]]) -> int:
    """The most consecutive words of the item that the page holds, grown from places (page, item) whose letters agree."""
    best = 0
    n, m = len(page.text), len(item.text)
    back, starts, heads = page.backward()
    for i, o in places:
        end, slips = extend(page.text, page.starts, page.heads, i, item.text, o)
        begin, others = extend(back, starts, heads, n - i, item.back, m - o)
        begin = m - begin
        slips += [m - 1 - s for s in others]
        run = 0
        for a, b in item.words:
            bad = sum(a <= s < b for s in slips) if slips else 0
            run = run + 1 if begin <= a and b <= end and bad <= max(1, (b - a) // 3) else 0
            best = max(best, run)
    return best


class Tests:
    """The tests of one broadcast, each different text once, with their winnowed fingerprints ready for lookups."""

    def __init__(self, rows: list[tuple[int, str]], least: int):
        ids: dict[tuple, list[int]] = {}
        self.items: list[Item] = []
        for i, text in rows:
            item = Item(text)
            if len(item.words) >= least:
                key = (item.text, tuple(item.words))
                if key not in ids:
                    self.items.append(item)
                ids.setdefault(key, []).append(i)
        self.ids = [sorted(set(x)) for x in ids.values()]
        parts = [code_points(x.text) for x in self.items]
        sizes = np.array([len(p) for p in parts], np.int64)
        self.letters = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        self.grams = Grams(self.letters)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        words = [np.array(x.words, np.int64) + b for x, b in zip(self.items, self.begins, strict=True)]
        self.words = np.concatenate(words) if words else np.empty((0, 2), np.int64)
        number, at, h = fingerprints(self.letters, sizes, GRAM, WINDOW)
        order = np.argsort(h, kind="stable")
        self.prints, first, self.many = np.unique(h[order], return_index=True, return_counts=True)
        self.first, self.item_of = first, number[order]
        self.at = (at + self.begins[number])[order] if len(at) else np.empty(0, np.int64)
        self.may = np.zeros(1 << 20, bool)
        self.may[self.prints & np.uint64(0xFFFFF)] = True

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the given fingerprints, place in ``at``) of every meeting of equal fingerprints."""
        where = np.flatnonzero(self.may[prints & np.uint64(0xFFFFF)])
        k = np.minimum(np.searchsorted(self.prints, prints[where]), max(0, len(self.prints) - 1))
        hit = self.prints[k] == prints[where] if len(self.prints) else np.zeros(len(where), bool)
        where, k = where[hit], k[hit]
        n = self.many[k]
        return np.repeat(where, n), np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Grams:
    """Hashes of the ``k`` letters from every place of a stream on; the caller sees to it that they are there."""

    def __init__(self, letters: np.ndarray):
        self.letters = letters
        self.held: dict[int, np.ndarray] = {}

    def at(self, places: np.ndarray, k: int) -> np.ndarray:
        if k not in self.held:
            h = rolling(self.letters, k)
            self.held[k] = h if len(h) else np.zeros(1, np.uint64)
        h = self.held[k]
        return h[np.clip(places, 0, len(h) - 1)]


def agreement(p: np.ndarray, i: np.ndarray, q: np.ndarray, o: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many letters agree in a row from the places on (``way`` 1) or before them (-1), no more than ``most``."""
    n = np.zeros(len(i), np.int64)
    open_, width = np.flatnonzero(most > 0), 16
    while len(open_):
        left = []
        for a in np.array_split(open_, len(open_) * width // 4_000_000 + 1):
            reach = np.minimum(width, most[a] - n[a])
            step = np.minimum(np.arange(width), reach[:, None] - 1)
            step = step + n[a][:, None] if way > 0 else -1 - step - n[a][:, None]
            same = p[i[a][:, None] + step] == q[o[a][:, None] + step]
            k = np.minimum(np.where(same.all(1), reach, same.argmin(1)), reach)
            n[a] += k
            left.append(a[(k == width) & (n[a] < most[a])])
        open_, width = np.concatenate(left), min(width * 4, 4096)
    return n


class Lines:
    """The lines of a block by page and by the ``k`` letters that they begin (``way`` 1) or end with (-1)."""

    def __init__(self, pages: Pages, k: int, way: int):
        self.k, self.way = k, way
        at = pages.lines if way > 0 else pages.line_ends
        first = at if way > 0 else at - k
        page = pages.page_of_line
        ok = np.flatnonzero((first >= pages.begins[page]) & (first + k <= pages.ends[page]))
        self.all, self.at = np.zeros(len(at), np.uint64), at
        self.all[ok] = self.key(pages.grams, first[ok], page[ok])
        order = ok[np.argsort(self.all[ok], kind="stable")]
        self.keys, self.first, self.many = np.unique(self.all[order], return_index=True, return_counts=True)
        self.of_key = at[order]

    def key(self, grams: Grams, at: np.ndarray, page: np.ndarray) -> np.ndarray:
        return grams.at(at, self.k) + (page.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)

    def beyond(self, grams: Grams, at: np.ndarray, page: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the given places, line) of every line of the page beyond ``line`` with the letters from ``at`` on."""
        k = np.minimum(np.searchsorted(self.keys, want := self.key(grams, at, page)), max(0, len(self.keys) - 1))
        some = np.flatnonzero(self.keys[k] == want) if len(self.keys) else np.empty(0, np.int64)
        n = self.many[k[some]] if len(some) else some
        which = np.repeat(some, n)
        found = self.of_key[np.repeat(self.first[k[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(some) else some
        on = (found - line[which]) * self.way > 0
        return which[on], found[on]

    def near(self, grams: Grams, at: np.ndarray, page: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The first of the NEAR_LINES next lines with the letters from ``at`` on, or -1."""
        want = self.key(grams, at, page)
        here = np.searchsorted(self.at, line)
        out = np.full(len(at), -1, np.int64)
        for j in range(1, NEAR_LINES + 1):
            k = here + j * self.way
            fits = (out < 0) & (k >= 0) & (k < len(self.at))
            k = np.clip(k, 0, len(self.at) - 1)
            fits &= self.all[k] == want
            out[fits] = self.at[k[fits]]
        return out


def runs(pages: Pages, tests: Tests, text: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """(page, item, place in the page, place in the item, length), each once, of the stretches of agreeing letters around
    pairs of places (``at`` in ``pages.letters``, ``tests.at[number]``) whose fingerprints are equal."""
    item, o = tests.item_of[number], tests.at[number]
    p, q = pages.letters, tests.letters
    pb, pe, qb, qe = pages.begins[text], pages.ends[text], tests.begins[item], tests.ends[item]
    left = agreement(p, at, q, o, np.minimum(at - pb, o - qb), -1)
    right = agreement(p, at, q, o, np.minimum(pe - at, qe - o), 1)
    enough = np.flatnonzero(left + right >= GRAM)
    _, one = np.unique(((at - left)[enough] << 32) | (o - left)[enough], return_index=True)
    k = enough[one]
    return np.stack([text[k], item[k], (at - left)[k], (o - left)[k], (left + right)[k]], axis=1)


def promising(pages: Pages, tests: Tests, found: np.ndarray, least: int) -> np.ndarray:
    """Which stretches (page, item, place, place, length) may grow to ``least`` words: all are followed in step over lines
    and slips, as ``extend`` does, until one ends or needs a line further off (which counts as enough)."""
    ok = np.zeros(len(found), bool)
    reach = []
    for way in (1, -1):
        text, item, i, o, n = found.T
        x, y = (i + n, o + n) if way > 0 else (i.copy(), o.copy())
        full, short = Lines(pages, LINE_AGREE, way), Lines(pages, LEAST_LINE, way)
        going = np.arange(len(found))
        while len(going):
            new_x, new_y = _step(pages, tests, (full, short), text[going], item[going], x[going], y[going], way)
            on = np.flatnonzero(new_x >= 0)
            going = going[on]
            x[going], y[going] = new_x[on], new_y[on]
            p, q = text[going], item[going]
            room = (pages.ends[p] - x[going], tests.ends[q] - y[going]) if way > 0 else (x[going] - pages.begins[p], y[going] - tests.begins[q])
            n = agreement(pages.letters, x[going], tests.letters, y[going], np.minimum(*room), way)
            x[going] += way * n
            y[going] += way * n
        reach.append(y)
    held = np.searchsorted(tests.words[:, 1], reach[0], side="right") - np.searchsorted(tests.words[:, 0], reach[1])
    return held >= least


def _step(pages: Pages, tests: Tests, lines: tuple[Lines, Lines], text, item, x, y, way: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the page and the item go on; -1: nowhere."""
    pb, pe, qb, qe = pages.begins[text], pages.ends[text], tests.begins[item], tests.ends[item]
    on = (x < pe) & (y < qe) if way > 0 else (x > pb) & (y > qb)
    if way > 0:
        line = pages.lines[np.searchsorted(pages.lines, x, side="right") - 1]
    else:
        line = pages.line_ends[np.minimum(np.searchsorted(pages.line_ends, x), len(pages.line_ends) - 1)]
    back = y + (line - x)
    left = (qe - back) if way > 0 else (back - qb)
    inside = on & ((back >= qb) & (back <= qe))
    new_x, new_y = np.full(len(x), -1, np.int64), np.full(len(x), -1, np.int64)
    full, short = lines
    first = lambda k, some: back[k] if way > 0 else back[k] - some.k
    k = np.flatnonzero(inside & (left >= LINE_AGREE))
    which, other = full.beyond(tests.grams, first(k, full), text[k], line[k])
    k_of, which = np.unique(which), k[which]
    k = k[k_of]
    next_ = full.near(tests.grams, first(k, full), text[k], line[k])
    k, next_ = k[next_ >= 0], next_[next_ >= 0]
    new_x[k], new_y[k] = next_, back[k]
    theirs = [tests.grams.at(y + d if way > 0 else y - d - AGREE, AGREE) for d in range(4)]
    ours = [pages.grams.at(x + d if way > 0 else x - d - AGREE, AGREE) for d in range(4)]
    for a, b in SLIPS:
        room = (x + a + AGREE <= pe) & (y + b + AGREE <= qe) if way > 0 else (x - a - AGREE >= pb) & (y - b - AGREE >= qb)
        fits = np.flatnonzero(on & room & (new_x < 0) & (ours[a] == theirs[b]))
        new_x[fits], new_y[fits] = x[fits] + way * a, y[fits] + way * b
    # Of lines further off, the one that agrees longest (then the nearest), if it leads beyond the present place.
    open_ = new_x[which] < 0
    which, other = which[open_], other[open_]
    if len(which):
        most = np.minimum(pe[which] - other, qe[which] - back[which]) if way > 0 else np.minimum(other - pb[which], back[which] - qb[which])
        n = agreement(pages.letters, other, tests.letters, back[which], most, way)
        order = np.lexsort((other * way, -n, which))
        which, other, n = which[order], other[order], n[order]
        best = np.concatenate([[True], which[1:] != which[:-1]]) & (n >= LINE_AGREE) & (n > np.abs(line[which] - x[which]))
        new_x[which[best]], new_y[which[best]] = other[best], back[which[best]]
    # Where the item is nearly over, it goes on to its end at most.
    k = np.flatnonzero(inside & (left >= LEAST_LINE) & (left < LINE_AGREE))
    k = k[np.unique(short.beyond(tests.grams, first(k, short), text[k], line[k])[0])]
    new_x[k], new_y[k] = (pe[k], qe[k]) if way > 0 else (pb[k], qb[k])
    return new_x, new_y


_TESTS: dict = {}


def _search(least: int, held):
    """Pages against the tests of one broadcast, which a worker prepares once."""
    name = uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = _TESTS.get(name)
        if tests is None:
            _TESTS.clear()
            tests = _TESTS[name] = Tests(held.value, least)
        for ids, texts in blocks(batches, 1_000_000):
            pages = Pages(texts)
            text, at, prints = fingerprints(pages.letters, pages.ends - pages.begins, GRAM, WINDOW)
            met, number = tests.lookup(prints)
            out: list[tuple] = []
            grown: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for a in range(0, len(met), STEP):
                some, of = met[a : a + STEP], number[a : a + STEP]
                found = runs(pages, tests, text[some], at[some] + pages.begins[text[some]], of)
                found = found[promising(pages, tests, found, least)] if len(found) else found
                for k, item, i, o in found[:, :4].tolist():
                    place = (i - int(pages.begins[k]), o - int(tests.begins[item]))
                    if place not in grown.setdefault((k, item), []):
                        grown[k, item].append(place)
            page, held_page = -1, None
            for (k, item), places in sorted(grown.items()):
                if k != page:
                    page, held_page = k, pages.page(k)
                words = longest_run(held_page, tests.items[item], places)
                if words >= least:
                    out += [(i, ids[k], words, len(tests.items[item].words)) for i in tests.ids[item]]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["item_id", "doc_id", "n_words", "item_words"]
            )

    return run


def leaks(
    documents: DataFrame, tests: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item: str = "text",
    words: int = WORDS, test_chars: int = TEST_CHARS,
) -> DataFrame:
    """(item_id, doc_id, n_words, item_words): each pair where the page holds ``words`` or more consecutive words of the item.

    Null ids and null, empty or blank texts match nothing; tests of fewer words neither. Tests with equal words all
    count. Repeated rows with one id give one row per pair. Other columns are left out. A pair is sure to be found if
    somewhere GRAM + WINDOW - 1 folded letters of the passage stand in a row; else only by chance.

    The size of the tests is summed up first; each broadcast holds ``test_chars`` code points of them, and the pages are
    read once for each. A page never leaves the task that reads it, and only rows found are shuffled.
    """
    spark = documents.sparkSession
    items = tests.select(F.col(item_id).cast("long").alias("item_id"), F.col(item).alias("item")).filter("item_id IS NOT NULL AND item IS NOT NULL")
    chars = items.agg(F.sum(F.char_length("item"))).first()[0] or 0
    shards = -(-chars // test_chars) or 1
    items = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    pages = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    found: DataFrame | None = None
    for k in range(shards):
        rows = [(r["item_id"], r["item"]) for r in items.filter(F.col("shard") == k).collect()]  # about test_chars
        held = spark.sparkContext.broadcast(rows)
        part = pages.mapInArrow(_search(words, held), "item_id long, doc_id long, n_words int, item_words int")
        found = part if found is None else found.union(part)
    assert found is not None
    return found.groupBy("item_id", "doc_id").agg(F.max("n_words").alias("n_words"), F.max("item_words").alias("item_words"))
