"""Held-out test items inside training documents.

Items and documents are reduced to streams of letters and digits (look-alikes folded, case, spacing, line breaks, hyphens and
punctuation dropped), so words broken over lines join by themselves. A stream is made canonical by a template, in which a whole number
and a unit after it are typed placeholders (`counted`); for re-parameterised copies (`changed`) also by one in which names are
placeholders too (`Slotted`). Windows of the items' templates are rows, and so are the windows of documents; they meet in a hash join
that keeps the places of both. Then the slots and words around each meeting are compared in the texts themselves.

* Windows begin at every word and are as wide as every run of words that a sufficient passage must hold without a replaced word (see
  `clean_run`), as far as its template doesn't depend on what stands around it. Whatever passage counts, one of these windows lies in
  it: the join loses nothing. An item with a run of nothing but numbers has windows of its stream instead.
* A document is compared with an item only if as many of its windows meet the item's as every such passage shares (`least_met`).
* With `changed` there are also windows at every place of the template with names, no wider than the shortest half of an item; a quarter
  of the windows of an unbroken half must meet.

A meeting is extended word by word in both directions, and the words (and slots) that differ are counted.

Documents are not expanded to a row per character: a table of bits, of at most `MOST_BITS`, tells which windows can't be an item's. A
suite too large for it lets more windows pass to the join, and the result is the same. Items and windows are never collected.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.lookalike import rewriter

WIDTHS = (24, 16, 12, 8, 5, 3, 2, 1)
#: Kinds of windows: of the template without names, of the stream, of the template with names.
PLAIN, LITERAL, NAMED = 0, 1, 2
#: Size of the table of bits, in powers of two: from the first to the second.
LEAST_BITS, MOST_BITS = 16, 24
#: Characters hashed at once.
CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

# Units that may follow a number, in the texts' languages.
UNITS = "minutes hours days pieces parts stone acres furlongs feet inch pages sheets lines stresses faults copies Minuten Stunden Tage Stück Teile Gründe Größen minutes heures jours pièces parts 分 日 亩 步 座 处 页"
_CJK = re.compile("[⺀-⿟㐀-鿿豈-﫿]")
_UPPER = "".join(c for c in map(chr, [*range(0x530), *range(0x1E00, 0x2000)]) if c.isupper())
#: Characters that end a Chinese place name to the left, and those that close it. Names without such an ending can't be told from words.
_BEFORE = "与向在若而后的从于为是至到之和及自把由被得问用对给离往经过某该此各每以其"
_PLACES = "村镇县乡市省州府城"
_SLOT = re.compile(
    rf"(?P<name>(?<=[^\W\d_{_UPPER}] )[{_UPPER}][^\W\d_]+(?:[ -][{_UPPER}][^\W\d_]+)*|(?:(?![{_BEFORE}{_PLACES}])[㐀-鿿豈-﫿]){{1,3}}[{_PLACES}])"
    r"|(?P<number>\d+(?:[.,]\d+)*)(?:\s*(?P<unit>(?:" + "|".join(sorted((u for u in set(UNITS.split()) if not _CJK.search(u)), key=len, reverse=True)) + r")\b|[" + "".join(u for u in UNITS.split() if _CJK.search(u)) + "]))?"
)


class _Kept(dict):
    """Translation table: letters, marks and digits in their folded case, the placeholders, nothing else."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        self[code] = kept = c.casefold() if c.isalnum() or unicodedata.category(c)[0] in "LMN" or code in (1, 2, 3) else None
        return kept


@lru_cache(maxsize=1)
def _kept() -> dict:
    table = _Kept()
    return _Kept({i: table[i] for i in range(128)})


def stream(text: str) -> str:
    """Letters and digits only."""
    return rewriter()(text).translate(_kept())


_LIKE_UNITS = sorted({u.casefold() for u in UNITS.split()}, key=len, reverse=True)
_COUNTED = re.compile(r"(\d+)(" + "|".join(_LIKE_UNITS) + ")?")


def counted(text: str) -> str:
    """The template of a stream: 2 for a whole number, 3 for a unit after it. It depends on nothing but the stream."""
    return _COUNTED.sub(lambda m: "\x02\x03" if m.group(2) else "\x02", text) if any(map(str.isdigit, text)) else text


def places(text: str) -> np.ndarray:
    """Of each character of a stream's template, and of its end, the place in the stream."""
    out: list[int] = []
    at = 0
    for m in _COUNTED.finditer(text):
        out += range(at, m.start())
        out.append(m.start())
        if m.group(2):
            out.append(m.start(2))
        at = m.end()
    return np.array([*out, *range(at, len(text) + 1)])


class Slotted:
    """The stream with one typed placeholder for a whole name (1), number (2) or unit (3): `stream`; what stands in each by its place:
    `slots`; the words: (place, end, count) of literal words and slots; and the places in the plain stream of all parts: `parts`. Of
    Chinese every character is a word."""

    def __init__(self, text: str, cjk: bool = False):
        text = " ".join(rewriter()(text).split())
        parts: list[str] = []
        self.slots: dict[int, str] = {}
        self.words: list[tuple[int, int, int]] = []
        self.parts: list[tuple[int, int]] = []
        self.size = self.plain = at = 0

        def literal(piece: str) -> None:
            glued = bool(parts) and not piece[:1].isspace()
            for n, w in enumerate(piece.split()):
                w = w.translate(_kept())
                if cjk:
                    self.words += [(self.size + k, self.size + k + 1, 1) for k in range(len(w))]
                elif w:
                    self.words.append((self.size, self.size + len(w), 0 if glued and n == 0 else 1))
                parts.append(w)
                self.parts.append((self.size, self.plain))
                self.size += len(w)
                self.plain += len(w)

        for m in _SLOT.finditer(text):
            literal(text[at : m.start()])
            for mark, kind in (("\x01", "name"), ("\x02", "number"), ("\x03", "unit")):
                if said := m.group(kind):
                    self.slots[self.size] = stream(said)
                    self.words.append((self.size, self.size + 1, len(stream(said)) if cjk else len(said.split())))
                    parts.append(mark)
                    self.parts.append((self.size, self.plain))
                    self.size += 1
                    self.plain += len(self.slots[self.size - 1])
            at = m.end()
        literal(text[at:])
        self.stream = "".join(parts)

    def place(self, at: int) -> int:
        """The place in the plain stream of a place in the template."""
        there, plain = self.parts[bisect_right(self.parts, (at, 1 << 60)) - 1]
        return plain + at - there


def template(text: str) -> str:
    """The stream with typed placeholders for names (1), numbers (2) and units (3)."""
    return Slotted(text).stream


def same_template(doc: Slotted, item: Slotted, place: int, at: int) -> tuple[int, int]:
    """The longest stretch of an item's template around `at` that a document's template holds around `place`: from and to, in the item."""
    a, b = doc.stream, item.stream
    lo = 0
    while lo < min(place, at) and a[place - lo - 1] == b[at - lo - 1]:
        lo += 1
    hi = 0
    while hi < min(len(a) - place, len(b) - at) and a[place + hi] == b[at + hi]:
        hi += 1
    return at - lo, at + hi


def changed_slots(doc: Slotted, item: Slotted, shift: int, lo: int, hi: int, n: int) -> tuple[bool, bool]:
    """Of the stretch from `lo` to `hi` of an item of n words, which stands `shift` further in the document: whether it is a passage
    that counts as it is, and whether half of the item in it has slots changed, equal ones equally."""
    inside = [x for x in item.words if lo <= x[0] and x[1] <= hi]
    flags = [item.slots.get(x, "") == doc.slots.get(x + shift, "") for x, _, k in inside for _ in range(k)]
    if enough(flags, n):
        return True, False
    for i in range(len(inside)):
        seen: dict[str, str] = {}
        count, other = 0, False
        for x, _, k in inside[i:]:
            if x in item.slots:
                old, new = item.slots[x], doc.slots[x + shift]
                if seen.setdefault(old, new) != new:
                    break
                other = other or old != new
            count += k
            if other and count >= max(1, sufficient(n)):
                return False, True
    return False, False


def words_of(text: str) -> list[str]:
    """Words of an item: between spaces, reduced to letters and digits; for Chinese its characters."""
    if len(_CJK.findall(text)) * 2 > len(stream(text)):
        return list(stream(text))
    return [w for w in map(stream, text.split()) if w]


def sufficient(n: int) -> int:
    """Words of the shortest passage that counts."""
    return (n + 1) // 2


def clean_run(n: int) -> int:
    """Every passage of at least half of n words with at most one word in ten replaced holds a run of so many words that are not."""
    return min(-(-(k - k // 10) // (k // 10 + 1)) for k in range(max(1, sufficient(n)), n + 1))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b)])) for b in (_BASE, _INVERSE))


def hashes(codes: np.ndarray, kind: int, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hashes of every window of so many values): differences of prefix sums of a polynomial modulo 2^64, brought to one power."""
    powers, back = _powers(1 << max(12, (len(codes) + 1).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * powers[: len(codes)], out=sums[1:])
        for width in widths:
            n = len(codes) - width + 1
            if n > 0:
                h = (sums[width:] - sums[:n]) * back[:n]
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9 + 2 * (97 * kind + width))
                yield width, h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def _runs(words: list[str]) -> tuple[str, list[int]]:
    """An item's stream and the places where its words begin, with its end."""
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w))
    return "".join(words), starts


def plain_windows(words: list[str]) -> tuple[int, int, str, list[tuple[int, int, int]]] | None:
    """(kind, width, template, [(place, word, offset)]): the windows of an item, each with the word that leads to its place in the
    document and that word's offset in the window."""
    text, starts = _runs(words)
    run = clean_run(len(words))
    form = counted(text)
    there = {int(p): t for t, p in enumerate(places(text))}  # place in the stream -> place in the template
    first = [there.get(p) for p in starts[:-1]]
    width = 1 << 30
    for i in range(len(words) - run + 1):
        begin = next((first[k] for k in range(i, i + run) if first[k] is not None and not (k == i and form[first[k]] == "\x03")), None)
        end = _settled(text, starts[i + run])
        width = min(width, 0 if begin is None else end - begin)
        if width <= 0:
            break
    if width > 0:
        width = next(w for w in WIDTHS if w <= width)
        out = []
        for i, at in enumerate(first):
            if at is None or at + width > len(form):
                continue
            # a number in the document may be a longer one, so the word after it leads to the place
            word = next((k for k in range(i, len(words)) if first[k] is not None and first[k] < at + width and form[first[k]] != "\x02"), i)
            out.append((at, word, first[word] - at))
        return PLAIN, width, form, out
    width = next(w for w in WIDTHS if w <= min(starts[i + run] - starts[i] for i in range(len(words) - run + 1)))
    return LITERAL, width, text, [(at, i, 0) for i, at in enumerate(starts[:-1]) if at + width <= len(text)]


def _settled(text: str, end: int) -> int:
    """How many characters of a stream's template up to `end` are the same whatever follows: a unit may begin or go on there."""
    numbers = list(re.finditer(r"\d+", text[max(0, end - 40) : end]))
    after = text[max(0, end - 40) + numbers[-1].end() : end] if numbers else ""
    open_ = after and any(len(u) > len(after) and u.startswith(after) for u in _LIKE_UNITS)
    return len(counted(text[: end - len(after) if open_ else end]))


def named_windows(item: Slotted, words: list[str]) -> tuple[int, int, str, list[tuple[int, int, int]], int] | None:
    """As `plain_windows`, at every place of the template with names, and the length of the shortest half of it; a word of -1 leads nowhere."""
    least, shortest = max(1, sufficient(len(words))), len(item.stream)
    for i in range(len(item.words)):
        count = 0
        for _, end, k in item.words[i:]:
            count += k
            if count >= least:
                shortest = min(shortest, end - item.words[i][0])
                break
    if not shortest:
        return None
    width = next(w for w in WIDTHS if w <= shortest)
    begins = {p: i for i, p in enumerate(_runs(words)[1][:-1])}
    leads = [(at, begins[p]) for at, _, _ in item.words if (p := item.place(at)) in begins]
    out = []
    for at in range(len(item.stream) - width + 1):
        k = bisect_right(leads, (at - 1, 1 << 60))
        near = k < len(leads) and leads[k][0] < at + width
        out.append((at, leads[k][1] if near else -1, leads[k][0] - at if near else 0))
    return NAMED, width, item.stream, out, shortest


def least_met(words: list[str], kind: int, width: int, form: str, rows: list[tuple[int, int, int]]) -> int:
    """How many windows of an item every sufficient passage shares with it, whichever words are replaced: those that lie in the passage
    less those that a replaced word can break."""
    text, starts = _runs(words)
    there = places(text) if kind == PLAIN else np.arange(len(text) + 1)
    at = np.array([r[0] for r in rows])
    lo, hi = there[at], there[at + width - 1]  # first and last character of the stream
    begin = np.searchsorted(starts, lo, "right") - 1
    last = np.searchsorted(starts, hi, "right") - 1
    unit = np.array([form[a] == "\x03" for a in at])
    over = max(int(((begin <= k) & (last >= k)).sum()) for k in range(len(words)))  # windows that one word can break
    ends = [_settled(text, e) if kind == PLAIN else e for e in starts]
    # windows are in order: those of a passage are the ones from its first word on that end before its end, but for a unit at its begin
    first = np.searchsorted(begin, np.arange(len(words)))
    first = first + [n < len(at) and begin[n] == k and unit[n] for k, n in enumerate(first)]
    upto = np.searchsorted(at + width, ends, "right")
    least = 1 << 30
    for size in range(max(1, sufficient(len(words))), len(words) + 1):
        inside = np.maximum(upto[size:] - first[: len(words) - size + 1], 0)
        least = min(least, int(inside.min()) - (size // 10) * over)
    return max(1, least)


def windows(items: DataFrame, changed: bool) -> DataFrame:
    """(key, item_id, kind, width, at, word, lead, need) of the windows of every item (item_id, item). A document in which fewer than `need`
    windows of the kind meet the item holds no passage that counts; with `changed`, a quarter of the windows that an unbroken half of the
    template has (and any of the others) makes a candidate."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for ident, text in zip(batch.column("item_id").to_pylist(), batch.column("item").to_pylist(), strict=True):
                words = words_of(text)
                if not words:
                    continue
                for made in (plain_windows(words), named_windows(Slotted(text, all(len(w) == 1 for w in words)), words) if changed else None):
                    if made is None or not made[3]:
                        continue
                    kind, width, form, rows = made[:4]
                    at, word, lead = (np.array(x) for x in zip(*rows, strict=True))
                    _, h = next(hashes(_codes(form), kind, [width]))
                    if changed:
                        need = max(1, (made[4] - width + 1) // 4) if kind == NAMED else 1 << 30
                    else:
                        need = least_met(words, kind, width, form, rows)
                    same = [np.full(len(at), x) for x in (ident, kind, width, need)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[at].view(np.int64)), pa.array(same[0], pa.int64()), pa.array(same[1], pa.int32()), pa.array(same[2], pa.int32()), *(pa.array(x, pa.int32()) for x in (at, word, lead, same[3]))],
                        names=["key", "item_id", "kind", "width", "at", "word", "lead", "need"],
                    )

    return items.mapInArrow(run, "key long, item_id long, kind int, width int, at int, word int, lead int, need int")


class Sieve:
    """Tells which hashes can't be an item's: two places in a table of bits, which must both be set."""

    def __init__(self, bits: int, slots: np.ndarray, masks: np.ndarray):
        self.bits = bits
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[slots] = masks.view(np.uint64)
        self.table = np.packbits(np.unpackbits(table.view(np.uint8), bitorder="little"))
        self._open: np.ndarray | None = None

    def __getstate__(self) -> tuple:
        return self.bits, self.table

    def __setstate__(self, state: tuple) -> None:
        self.bits, self.table = state
        self._open = None

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Places in `h` of the hashes that pass."""
        if self._open is None:
            self._open = np.unpackbits(self.table).astype(bool)
        at = np.flatnonzero(self._open[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        return at[self._open[(h[at] & np.uint64((1 << self.bits) - 1)).astype(np.int64)]]


def sieve(known: DataFrame, total: int) -> Sieve:
    """The table of bits of all item windows; its words, at most 2 ^ (MOST_BITS - 6) of them, reach the driver."""
    bits = min(max((64 * total).bit_length(), LEAST_BITS), MOST_BITS)
    place = F.explode(F.array(F.shiftrightunsigned("key", 64 - bits), F.col("key").bitwiseAND(F.lit((1 << bits) - 1)))).alias("p")
    rows = known.select(place).select(F.shiftright("p", 6).alias("slot"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("mask")).groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    return Sieve(bits, rows.column("slot").to_numpy(), rows.column("mask").to_numpy())


def _chunks(forms: list[str], overlap: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Forms put together for hashing, with (begin, text, place of the begin in its form); long ones in parts that overlap."""
    held: list[str] = []
    where: list[tuple[int, int, int]] = []
    size = 0
    for n, form in enumerate(forms):
        for lo in range(0, max(1, len(form) - overlap), CHUNK):
            part = form[lo : lo + CHUNK + overlap]
            where.append((size, n, lo))
            held.append(part)
            size += len(part) + 1
            if size >= CHUNK:
                yield "\x00".join(held), where
                held, where, size = [], [], 0
    if held:
        yield "\x00".join(held), where


def met_windows(documents: DataFrame, passes: Sieve, kinds: dict[int, list[int]]) -> DataFrame:
    """(ident, sign, key, place) of the windows of documents (ident, text, sign) that pass the sieve."""
    shared = documents.sparkSession.sparkContext.broadcast(passes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        passes = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                texts = batch.column("text").to_pylist()
                streams = [stream(x) for x in texts] if kinds.keys() & {PLAIN, LITERAL} else []
                for kind, widths in kinds.items():
                    forms = [counted(x) for x in streams] if kind == PLAIN else streams if kind == LITERAL else [Slotted(x).stream for x in texts]
                    for text, where in _chunks(forms, max(widths) - 1):
                        starts, number, lo = (np.array(x) for x in zip(*where, strict=True))
                        for _, h in hashes(_codes(text), kind, widths):
                            at = passes(h)
                            if len(at):
                                part = np.searchsorted(starts, at, "right") - 1
                                take = pa.array(number[part])
                                yield pa.RecordBatch.from_arrays(
                                    [batch.column("ident").take(take), batch.column("sign").take(take), pa.array(h[at].view(np.int64)), pa.array(at - starts[part] + lo[part], pa.int32())], names=["ident", "sign", "key", "place"]
                                )

    return documents.mapInArrow(run, f"ident {documents.schema['ident'].dataType.simpleString()}, sign long, key long, place int")


class Document:
    """A document's stream and the places in it where words begin."""

    def __init__(self, text: str):
        pieces = [w.translate(_kept()) for w in rewriter()(text).split()]
        self.stream = "".join(pieces)
        cjk = bool(_CJK.search(self.stream))
        starts, at = [], 0
        for p in pieces:
            if cjk and _CJK.search(p):
                starts += range(at, at + len(p))
            elif p:
                starts.append(at)
            at += len(p)
        self.starts = np.array([*starts, at])

    def after(self, o: int, n: int) -> list[int]:
        k = int(np.searchsorted(self.starts, o, "right"))
        return self.starts[k : k + n].tolist()

    def before(self, o: int, n: int) -> list[int]:
        k = int(np.searchsorted(self.starts, o, "left"))
        return self.starts[max(0, k - n) : k].tolist()[::-1]


def follow(doc: Document, words: list[str], i: int, o: int, step: int, most: int | None = None) -> tuple[list[bool], list[str]]:
    """Whether each word from word i on (step 1: to the right, from place o; -1: to the left, up to place o) stands in its
    place, and what stands there. A word that doesn't is taken to be replaced by the next word of the document, or the next two if
    it was broken. More than `most` other words in a row (one more than may be replaced) end it."""
    out: list[bool] = []
    said: list[str] = []
    s, n = doc.stream, len(words)
    bad, most = 0, n // 10 + 1 if most is None else most
    while 0 <= i < n and 0 <= o <= len(s):
        w = words[i]
        if (s.startswith(w, o) if step > 0 else s.endswith(w, 0, o)) and w:
            out.append(True)
            said.append(w)
            o += step * len(w)
            bad = 0
        else:
            bad += 1
            if bad > most:
                break
            ends = doc.after(o, 2) if step > 0 else doc.before(o, 2)
            if not ends:
                break
            nxt = words[i + step] if 0 <= i + step < n else ""
            before = o
            o = next((e for e in ends if nxt and (s.startswith(nxt, e) if step > 0 else s.endswith(nxt, 0, e))), ends[0])
            out.append(False)
            said.append(s[min(o, before) : max(o, before)])
        i += step
    while out and not out[-1]:
        out.pop()
    return out, said[: len(out)]


def enough(flags: list[bool], n: int) -> bool:
    """Whether a stretch of the flags is at least half of n words long with at most one in ten false."""
    least = max(1, sufficient(n))
    score = [0]
    for f in flags:
        score.append(score[-1] + (-1 if f else 9))
    best = -1 << 60
    for y in range(least, len(score)):
        best = max(best, score[y - least])
        if score[y] <= best:
            return True
    return False


def slots_of(text: str) -> set[int]:
    """Places (as in `words_of`) of an item's numbers, names and units: what a re-parameterised copy may change."""
    out: set[int] = set()
    words = words_of(text)
    if all(len(w) == 1 for w in words):
        return {i for i, w in enumerate(words) if w.isdigit()}
    i, start, number = 0, True, False
    for token in text.split():
        word = stream(token)
        if not word:
            continue
        has = any(c.isdigit() for c in word)
        if has or (number and token.strip(".,;:?!") in _UNIT_WORDS) or (token.lstrip("(\"'«„“")[:1].isupper() and not start):
            out.add(i)
        start, number, i = token[-1] in ".?!", has, i + 1
    return out


_UNIT_WORDS = set(UNITS.split())


def slots_agree(words: list[str], flags: list[bool], said: list[str]) -> bool:
    """Slot consistency: equal words of the item were replaced by equal words of the document."""
    seen: dict[str, str] = {}
    return all(f or seen.setdefault(w, x) == x for w, f, x in zip(words, flags, said, strict=False))


def reparameterised(words: list[str], slots: set[int], first: int, flags: list[bool], said: list[str]) -> bool:
    """Whether at least half of the item stands in the document with nothing but slots changed, consistently and more of them than a
    leak may have. `flags` and `said` begin at word `first`."""
    at = 0
    for end in [*(k for k, f in enumerate(flags) if not f and first + k not in slots), len(flags)]:
        part = flags[at:end]
        if len(part) >= max(1, sufficient(len(words))) and not all(part) and slots_agree(words[first + at : first + end], part, said[at:end]):
            return True
        at = end + 1
    return False


def leaked(documents: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", changed: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """(doc_id, item_id) of documents with a sufficient passage of an item (`items`: item_id, text); each pair once. With `changed`,
    instead of those, documents in which half of an item stands with its numbers, names and units consistently changed.

    Null and empty texts, items without an id and items without a letter or digit give no rows; repeated rows of either table count
    once, and rows of one id with different texts are searched apart. Whole documents are searched. `keep` cuts the lineage of the items'
    windows, which are read three times.
    """
    narrow = documents.selectExpr(f"`{ident}` as ident", f"`{text}` as text", f"xxhash64(`{text}`) as sign").where("text <> ''")
    asked = items.selectExpr("cast(item_id as bigint) as item_id", "text as item").where("item_id is not null and item <> ''").distinct()
    known = keep(windows(asked.repartition(documents.sparkSession.sparkContext.defaultParallelism), changed))
    groups = known.groupBy("kind", "width").agg(F.count("*").alias("n")).collect()  # a row for each kind and width
    kinds: dict[int, list[int]] = {}
    for r in sorted(groups):
        kinds.setdefault(r.kind, []).append(r.width)
    if not kinds:
        return narrow.where("false").select(F.col("ident").alias(ident), F.lit(0).cast("long").alias("item_id"))
    met = met_windows(narrow, sieve(known, sum(r.n for r in groups)), kinds).join(known, "key")
    # no more seeds than a document has places
    seeds = met.groupBy("ident", "sign", "item_id").agg(F.collect_list(F.struct("kind", "at", "word", "lead", "place")).alias("seeds"), F.min("need").alias("need"))
    mine = F.filter("seeds", lambda x: x["kind"] == NAMED) if changed else F.col("seeds")
    seeds = seeds.where(F.size(F.array_distinct(F.transform(mine, lambda x: x["at"]))) >= F.col("need")).drop("need")
    found = seeds.join(asked, "item_id").groupBy("ident", "sign").agg(F.collect_list(F.struct("item_id", "item", "seeds")).alias("found")).select(F.col("ident").alias("i"), F.col("sign").alias("s"), "found")
    whole = narrow.join(found, narrow["ident"].eqNullSafe(found["i"]) & (narrow["sign"] == found["s"])).select("ident", "text", "found")
    return _compared(whole, changed).distinct().withColumnRenamed("ident", ident)


def _compared(whole: DataFrame, changed: bool) -> DataFrame:
    """(ident, item_id) of the pairs of documents (ident, text) and items that met (found) in which a sufficient passage stands."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows, who = [], []
            for n, (text, found) in enumerate(zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True)):
                doc = Compared(text, changed)
                for x in found:
                    if doc.holds(x["item"], x["seeds"]):
                        rows.append(n)
                        who.append(x["item_id"])
            yield pa.RecordBatch.from_arrays([batch.column("ident").take(pa.array(rows, pa.int64())), pa.array(who, pa.int64())], names=["ident", "item_id"])

    return whole.mapInArrow(run, f"ident {whole.schema['ident'].dataType.simpleString()}, item_id long")


@lru_cache(maxsize=10_000)
def _item(text: str) -> tuple[list[str], set[int], Slotted]:
    words = words_of(text)
    return words, slots_of(text), Slotted(text, all(len(w) == 1 for w in words))


class Compared:
    """A document that windows of items led to."""

    def __init__(self, text: str, changed: bool):
        self.doc, self.changed = Document(text), changed
        self.named = Slotted(text) if changed else None
        self.places = places(self.doc.stream)

    def holds(self, item: str, seeds: list[dict]) -> bool:
        """Whether a sufficient passage of an item stands around one of the meetings of windows; with `changed`, whether none does but
        one with changed slots."""
        words, slots, plain = _item(item)
        other = False
        upto: dict[int, int] = {}  # of each alignment of the templates, up to where it has been followed
        leads: set[tuple[int, int]] = set()
        for x in sorted(seeds, key=lambda x: (x["place"], x["at"])):
            place, at = x["place"], x["at"]
            if x["kind"] == NAMED:
                if at >= upto.get(place - at, 0):
                    a, b = same_template(self.named, plain, place, at)
                    upto[place - at] = b
                    leak, new = changed_slots(self.named, plain, place - at, a, b, len(words))
                    if leak:
                        return False
                    other = other or new
                if x["word"] >= 0:
                    leads.add((x["word"], self.named.place(place + x["lead"])))
            else:
                leads.add((x["word"], int(self.places[place + x["lead"]]) if x["kind"] == PLAIN else place))
        done: set[tuple[int, int]] = set()  # words whose place a tried alignment already holds
        for word, place in sorted(leads, key=lambda x: (x[1], x[0])):
            if (word, place) in done:
                continue
            most = len(words) if self.changed else None
            right, after = follow(self.doc, words, word, place, 1, most)
            left, before = follow(self.doc, words, word - 1, place, -1, most)
            o = place
            for n, f in enumerate(right):
                if not f:
                    break
                done.add((word + n, o))
                o += len(words[word + n])
            done.add((word, place))
            flags = [*left[::-1], *right]
            if enough(flags, len(words)):
                return not self.changed
            other = other or (self.changed and reparameterised(words, slots, word - len(left), flags, [*before[::-1], *after]))
        return other
