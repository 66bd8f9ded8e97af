"""Traces of scanned paper in page texts: page frames, words broken at line ends, words read wrongly.

1. Words (for Chinese: each character with its neighbours) are counted over all pages.
2. Correction candidates: rare words meet frequent ones through an inverted index of character q-grams. A word's q-grams are its
   two halves (and the second half without its first character), so a single misreading leaves one of them whole. Words of one or
   two characters have no such halves: they meet by every form with one or two characters left out.
3. Gradient-boosted trees rank the candidates by how often the same misreading recurs over the vocabulary, how the counts compare
   and what the words look like. They are fitted on pages that were read twice: a word of one reading that stands corrected in the
   other is a misreading, a word on which both agree is none. At most `SAMPLE` pages are used for this.
4. Line pairs: boosted trees decide whether a line's last word goes on in the next line (fitted on words of the vocabulary,
   broken artificially) and whether a line belongs to the frame (fitted on lines the margin segments name).
5. The frame reaches from a page's edge to the first line that isn't furniture.

Tasks hold the most frequent words, at most `KNOWN` of them, and no result depends on that bound: words outside are joined with the
table of corrections, and a line's end is decided in the task only if its decision is the same for every count that the words outside
may have; all others are joined with the whole vocabulary (`decided`). Nothing of the size of the corpus is collected.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.boost import Boost
from pagewright.llm.lookalike import Kept, rewriter
from pagewright.llm.repeated import SALT, letters

FIELDS = ("text", "extraction_text")
SAMPLE = 3000  #: pages from which classifiers are fitted
CORRECTED = 0.2  #: share of its places at which a misreading of the sample is corrected, at least
FRAME_SAMPLE = 1000  #: of them, pages from which the frame's trees are fitted
KNOWN = 400_000  #: words a task holds, at most
RATIO = 4  #: a word is at least so many times as frequent as a misreading of it
TRAIN_WORDS = 20_000  #: words from which the trees for line ends are fitted, most frequent ones, and as many of all
FOLDED = 0.002  #: share of all misreadings from which on a kind of them is folded in titles, so that there are at most 1 / FOLDED kinds
FLUSH = 200_000  #: distinct words counted in a task before they are handed on

_CJK = re.compile("[㐀-鿿豈-﫿]")
_HAN_RUN = re.compile("[㐀-鿿豈-﫿]+")
_EDGE = ".,;:!?()[]{}\"'«»„“”‘’*—–-‐¬·…。，、；：！？（）"
_ORDINAL = re.compile(r"^\D?\d{2,}|^\d+(?:st|nd|rd|th|e|er|re|ère|te|ten|m|[½²³])$|\d.*\d.*\d")
_MARKS = tuple("-‐‑¬\u00ad")
_MARK = re.compile("([-‐‑¬­])\\s*$")
_NUMBER_LINE = re.compile(
    r"^[\s\-—–·•*\[\](){}|~.]*(?:(?:page|seite|pag|p|s|f|n[o°]?|第)\s*\.?\s*)?([0-9lIiOoSBZ]{1,5}|[0-9lIO](?:\s[0-9lIO]){1,4}|[ivxlcdm]{1,7})\s*页?[\s\-—–·•*\[\](){}|~.]*$", re.I
)
_TITLE_NUMBER = re.compile(r"^\s*[\[(]?[0-9lIOoSBivxIVX]{1,5}[\])]?\s{1,}(?=\D{3})|[\s·•|—-]+[\[(]?(?:p\.\s*)?[0-9lIOoSB]{1,5}[\])]?\s*$")


def _roman(numeral: str) -> int:
    """Value of a roman numeral; 0 if it isn't written as one."""
    value = [dict(i=1, v=5, x=10, l=50, c=100, d=500, m=1000)[c] for c in numeral]
    total = sum(-a if a < b else a for a, b in zip(value, [*value[1:], 0], strict=True))
    units, rest, text = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")], total, ""
    for n, t in units:
        text += t * (rest // n)
        rest %= n
    return total if text == numeral else 0


def page_number(line: str, number: int | None) -> bool:
    """Whether a line is a page number only. A year, and a number with a full stop, is one only on the page of that number."""
    m = _NUMBER_LINE.match(line)
    if not m:
        return False
    digits = re.sub(r"\s", "", m.group(1)).translate(str.maketrans("lIiOoSBZ", "11100582"))
    if not any(c.isdigit() for c in m.group(1)) and re.fullmatch("[ivxlcdm]+", m.group(1), re.I):
        return _roman(m.group(1).lower()) > 0
    sentence = line[-1] == "." and line[-2:-1].isalnum()  # a number that ends a sentence of the text
    return digits.isdigit() and (int(digits) == number or not (sentence or 1500 <= int(digits) <= 2100))


def words_of(line: str) -> list[str]:
    """Words of a line between spaces, in lower case, without punctuation at their ends; formulas and numbers are left out."""
    out = []
    for t in line.split():
        if "$" in t or "\\" in t or "_" in t:
            out.append("")
            continue
        t = t.strip(_EDGE).lower()
        out.append("" if not any(c.isalpha() for c in t) or _ORDINAL.match(t) or _CJK.search(t) else t)
    return out


class _Context(dict):
    """Translation table: ideographs are kept, digits become 0, everything else a full stop."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kept = c if _CJK.match(c) else "0" if c.isdigit() else "."
        return kept


_CONTEXT = _Context()


def contexts(text: str) -> list[str]:
    """Every character that isn't white space with its neighbours; line feeds are passed over. Those that aren't about an
    ideograph have `.` or `0` in the middle."""
    n = "." + "".join(text.split()).translate(_CONTEXT) + "."
    return [n[i : i + 3] for i in range(len(n) - 2)]


class _Memo(dict):
    """Raw token -> its word, kept for tokens met before."""

    def __missing__(self, token: str) -> str:
        if len(self) > FLUSH:
            self.clear()
        self[token] = word = words_of(token)[0]
        return word


def vocabulary(pages: DataFrame) -> DataFrame:
    """(word, n) over all rows. Words at line ends, which may be broken, aren't counted."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fold = rewriter()
        raw: Counter = Counter()
        han: Counter = Counter()

        def hand_on() -> Any:
            seen: Counter = Counter({w: n for w, n in han.items() if w[1] not in ".0"})
            for token, n in raw.items():
                if word := words_of(token)[0]:
                    seen[word] += n
            raw.clear()
            han.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            tokens: list[str] = []
            for f in FIELDS:
                for text in batch.column(f).to_pylist():
                    if not text:
                        continue
                    text = fold(text)
                    if not text.isascii() and _CJK.search(text):
                        han.update(contexts(text))
                        continue
                    for line in text.split("\n"):
                        ws = line.split()
                        tokens += ws[1:-1]
                        if ws and line[:1].isupper():
                            tokens.append(ws[0])
                        if len(ws) > 1 and line[-1:] in ".,;:!?":
                            tokens.append(ws[-1])
            raw.update(tokens)
            if len(raw) + len(han) > FLUSH:
                yield hand_on()
        yield hand_on()

    return pages.select(*FIELDS).mapInArrow(count, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _edit(w: str, c: str) -> tuple[str, str] | None:
    """The one place where two words differ: (in w, in c), at most two characters each; None if they differ in more."""
    i = 0
    while i < min(len(w), len(c)) and w[i] == c[i]:
        i += 1
    j = 0
    while j < min(len(w), len(c)) - i and w[-1 - j] == c[-1 - j]:
        j += 1
    a, b = w[i : len(w) - j], c[i : len(c) - j]
    return (a, b) if 1 <= len(a) <= 2 and 1 <= len(b) <= 2 else None


def candidates(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(w, c, nw, nc, a, b): words and the words at least `ratio` times as frequent that they may be misreadings of; a was read for b.

    Inverted index of character q-grams. Words of six characters and more are indexed by their halves (three characters at least) with
    their length. A shorter word is indexed by what is left around a gap of one or two characters, so only words that differ in the gap
    meet. An ideograph is indexed by its neighbours; without two ideographs for neighbours these say so little that the index is split
    in `SALT` parts, each probed on its own."""
    han = F.col("word").rlike("^.[㐀-鿿豈-﫿].$")
    plain = F.when(han, F.concat(F.substring("word", 1, 1), F.substring("word", 3, 1))).rlike("[.0]")
    right = vocab.where(F.col("n") >= ratio).where(han | F.col("word").rlike("^[\\p{L}'’-]+$"))
    words = lambda df, w, n: df.select(F.col("word").alias(w), F.col("n").alias(n), "word")

    signs = "concat(substring(word, 1, 1), substring(word, 3, 1))"
    part = F.when(plain, F.pmod(F.hash("word"), F.lit(SALT))).otherwise(0)
    parts = F.when(plain, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    met = (
        words(vocab.where(han), "w", "nw").select("w", "nw", F.expr(signs).alias("g"), F.explode(parts).alias("part"))
        .join(words(right.where(han), "c", "nc").select("c", "nc", F.expr(signs).alias("g"), part.alias("part")), ["g", "part"])
        .select("w", "c", "nw", "nc")
    )

    cut = lambda m: f"cast({m} / 2 as int)"
    gram = lambda k, g, m: f"named_struct('k', '{k}', 'g', {g}, 'm', {m})"
    n = "length(word)"
    index = f"array({gram('p', f'substring(word, 1, {cut(n)})', n)}, {gram('s', f'substring(word, {cut(n)} + 1)', n)}, {gram('t', f'substring(word, {cut(n)} + 2)', n)})"
    probes = f"flatten(transform(array({n} - 1, {n}, {n} + 1), m -> array({gram('p', f'substring(word, 1, {cut("m")})', 'm')}, {gram('s', f'right(word, m - {cut("m")})', 'm')}, {gram('t', f'right(word, m - {cut("m")} - 1)', 'm')})))"
    long = words(vocab.where(~han & (F.length("word") >= 5)), "w", "nw").select("w", "nw", F.expr(f"inline({probes})")).where("m >= 6")
    met = met.union(long.join(words(right.where(~han & (F.length("word") >= 6)), "c", "nc").select("c", "nc", F.expr(f"inline({index})")), ["k", "g", "m"]).select("w", "c", "nw", "nc"))

    # the gap of a pair has one character at least on each side, and on one side one only where a word has one or two characters: two
    # for two would leave nothing of it
    gaps = f"inline(flatten(transform(sequence(1, {n}), i -> transform(sequence(1, least(2, {n} - i + 1)), l -> named_struct('head', substring(word, 1, i - 1), 'tail', substring(word, i + l), 'l', l)))))"
    short = words(vocab.where(~han & (F.length("word") <= 6)), "w", "nw").select("w", "nw", F.expr(gaps))
    short_right = words(right.where(~han & (F.length("word") <= 5)), "c", "nc").select("c", "nc", F.expr(gaps)).withColumnRenamed("l", "k")
    met = met.union(short.join(short_right, ["head", "tail"]).where("least(length(w), length(c)) >= 3 or least(k, l) = 1").select("w", "c", "nw", "nc"))
    met = met.where(f"w <> c and nc >= {ratio} * nw")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ws, cs = batch.column("w").to_pylist(), batch.column("c").to_pylist()
            edits = [_edit(w, c) for w, c in zip(ws, cs, strict=True)]
            keep = pa.array([i for i, e in enumerate(edits) if e], pa.int64())
            kept = [e for e in edits if e]
            yield pa.RecordBatch.from_arrays([*batch.take(keep).columns, pa.array([e[0] for e in kept], pa.string()), pa.array([e[1] for e in kept], pa.string())], names=["w", "c", "nw", "nc", "a", "b"])

    return met.mapInArrow(compare, "w string, c string, nw long, nc long, a string, b string").dropDuplicates(["w", "c"])


def scored_pairs(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Candidates with the recurrence of their misreading: `kinds` different words and `mass` places it explains, and for
    ideographs the `share` of all places of the read character."""
    strong = pairs.where("nc >= 10 * nw")
    edits = strong.groupBy("a", "b").agg(F.count("*").alias("kinds"), F.sum("nw").alias("mass"))
    han = vocab.where(F.col("word").rlike("^.[㐀-鿿豈-﫿].$")).groupBy(F.substring("word", 2, 1).alias("a")).agg(F.sum("n").alias("all"))
    edits = edits.join(han, "a", "left").selectExpr("a", "b", "kinds", "mass", "coalesce(mass / `all`, 1.0D) as share")
    return pairs.join(edits, ["a", "b"], "left").fillna(0, ["kinds", "mass", "share"])


def features(rows: dict[str, list]) -> np.ndarray:
    nw, nc = np.array(rows["nw"], float), np.array(rows["nc"], float)
    w = rows["w"]
    han = np.array([bool(_CJK.search(x)) for x in w], float)
    odd = np.array([any(not (c.isalpha() or c in "'’-") for c in x) for x in w], float) * (1 - han)
    return np.stack(
        [
            np.log1p(np.array(rows["kinds"], float)), np.log1p(np.array(rows["mass"], float)), np.log(nc / nw), np.log(nw), np.log(nc),
            np.array([len(x) for x in w], float), odd, han, np.array([len(x) for x in rows["a"]], float), np.array([len(x) for x in rows["b"]], float),
            np.array(rows["share"], float),
        ],
        1,
    )


def twice_read(pages: DataFrame, sample: int = SAMPLE) -> list:
    """A sample of about `sample` pages that were read twice, never more than twice as many, by the hash of their id."""
    part = max(1, round(pages.count() / sample))
    both = pages.where("length(text) > 40 and length(extraction_text) > 40").select("page_id", *FIELDS)
    return both.where(F.pmod(F.xxhash64("page_id"), F.lit(part)) == 0).limit(2 * sample).collect()


def _tokens(text: str) -> set[str]:
    text = rewriter()(text)
    if _CJK.search(text):
        return {w for w in contexts(text) if w[1] not in ".0"}
    return {w for line in text.split("\n") for w in words_of(line)[1:-1]} - {""}


def labelled(pairs: DataFrame, sample: list) -> Any:
    """Candidates of words of the sample, with a `label`: 1 if the word stands corrected so in the other reading on at least a `CORRECTED`
    of the pages where it does, or both readings agree on it, or the other has neither, else 0; and a `weight`, the root of the number of
    those pages. Only pages with a corrected word tell that a word is right: two readings without one may be the same reading. A word
    that is agreed on is counted once less, as one reading has it once more."""
    read = [(_tokens(r.text), _tokens(r.extraction_text)) for r in sample]
    asked = sorted(set().union(*(a | b for a, b in read)) if read else [])
    rows = pairs.join(F.broadcast(pairs.sparkSession.createDataFrame([(w,) for w in asked] or [("",)], "w string")), "w").toPandas()  # candidates of the sample's words only
    by_word: dict[str, list[int]] = {}
    for i, w in enumerate(rows["w"]):
        by_word.setdefault(w, []).append(i)
    yes, no = np.zeros(len(rows)), np.zeros(len(rows))
    right = rows["c"].tolist()
    agreed: set[str] = set()
    for a, b in read:
        moved = [(i, right[i] in other) for x, other in ((a - b, b - a), (b - a, a - b)) for w in x for i in by_word.get(w, ())]
        if any(hit for _, hit in moved):
            for i, hit in moved:
                (yes if hit else no)[i] += 1
            for w in a & b:
                agreed.add(w)
                for i in by_word.get(w, ()):
                    no[i] += 1
    rows = rows.assign(label=(yes > CORRECTED * (yes + no)).astype(int), weight=np.sqrt(yes + no))
    rows["nw"] -= rows["w"].isin(agreed) & (rows["label"] == 0) & (rows["nw"] > 1)
    return rows[rows["weight"] > 0].reset_index(drop=True)


def ranker(pairs: DataFrame, sample: list) -> Boost:
    """Boosted trees over candidates, fitted on pages read twice."""
    known = labelled(pairs, sample)
    x = features({k: list(known[k]) for k in known.columns}) if len(known) else np.zeros((0, 11))
    return Boost().fit(x, known["label"].to_numpy(float), known["weight"].to_numpy())


def corrections(pairs: DataFrame, model: Boost) -> DataFrame:
    """(word, right, score): the words taken for misreadings, each with its best replacement. The ranker alone decides."""

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            p = model.predict(features(batch.to_pydict())) if batch.num_rows else np.zeros(0)
            keep = pa.array(np.flatnonzero(p > 0.5))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keep) for c in ("w", "c")), pa.array(p[p > 0.5])], names=["word", "right", "score"])

    ranked = pairs.mapInArrow(score, "word string, right string, score double")
    return ranked.groupBy("word").agg(F.max_by("right", F.struct("score", "right")).alias("right"), F.max("score").alias("score"))


def training_words(right: DataFrame, most: int = TRAIN_WORDS) -> dict[str, int]:
    """Words with their counts for `join_model`: the most frequent, and a sample of all by their hash, about `most` of each."""
    words = frequent(right, most)[0]
    part = max(1, -(-right.count() // most))
    return words | {r.word: r.n for r in right.where(F.pmod(F.xxhash64("word"), F.lit(part)) == 0).collect()}


def join_model(words: dict[str, int], right: DataFrame | None = None, seed: int = 5, many: int = 6000) -> Boost:
    """Trees that tell words broken at a line's end from words that end there; fitted on `words`, broken at random, on compounds
    broken at their own hyphen, and on neighbouring words. The parts' counts are those of `right` (without it, of `words`).

    Any word may end a line or begin one, so neighbours are words of every length: half of them as frequent as they are, half any words,
    not counted themselves, as rare neighbours of a line's end often stand nowhere else."""
    rng = random.Random(seed)
    plain = sorted(w for w in words if w.isalpha() and len(w) >= 4 and not _CJK.search(w))
    compound = sorted(w for w in words if w.count("-") == 1 and all(len(x) > 1 for x in w.split("-")))
    firsts = sorted(w for w in words if w[-1:].isalpha() and not _CJK.search(w))
    seconds = sorted(w for w in words if w[:1].isalpha() and not _CJK.search(w))
    made: list[tuple[str, str, str, int, int]] = []
    y: list[int] = []
    if plain:
        weights = [min(words[w], 200) for w in plain]
        for i, w in enumerate(rng.choices(plain, weights, k=many) + rng.choices(plain, k=many)):
            k = rng.randint(2, len(w) - 2)
            made.append((w[:k], w[k:], rng.choice(["", "-", "-", "‐", "¬", "­"]), 1 if i >= many else 0, 0))
            y.append(1)
        often = [rng.choices(side, [words[w] for w in side], k=many) for side in (firsts, seconds)]
        seldom = [rng.choices(side, k=many) for side in (firsts, seconds)]
        made += [(a, b, "", 0, 0) for a, b in zip(*often, strict=True)] + [(a, b, "", 0, 1) for a, b in zip(*seldom, strict=True)]
        y += [0] * (2 * many)
    if compound:
        for w in rng.choices(compound, [min(words[w], 200) for w in compound], k=many // 2):
            a, b = w.split("-")
            made.append((a, b, rng.choice("-‐"), 0, 0))
            y.append(0)
    known = words
    if right is not None:
        asked = sorted({w for a, b, *_ in made for w in (a + b, a, b, f"{a}-{b}")})
        known = {r.word: r.n for r in right.join(F.broadcast(right.sparkSession.createDataFrame([(w,) for w in asked] or [("",)], "word string")), "word").collect()}
    return Boost().fit(np.array([pair_features(a, b, m, known, *less) for a, b, m, *less in made], float).reshape(-1, 8), np.array(y, float))


def pair_features(a: str, b: str, mark: str, known: dict[str, int], less: int, parts_less: int = 0) -> list[float]:
    """`less` and `parts_less`: places of the whole word and of each part that don't count."""
    lg = lambda w, k=0: float(np.log1p(max(0, known.get(w, 0) - k)))
    return [lg(a + b, less), lg(a, parts_less), lg(b, parts_less), lg(f"{a}-{b}"), *_marked(a, b, mark)]


def _marked(a: str, b: str, mark: str) -> list[float]:
    return [float(mark in ("-", "‐", "‑")), float(mark in ("¬", "­")), len(a), len(b)]


ENDS = "page_id string, field int, line_no int, bit int, a string, b string, mark string, counts array<long>"


class Ends:
    """Decides whether words at line ends go on: at once, if the decision is the same for every count that words which the task doesn't
    hold may have (fewer than `least`), else None."""

    def __init__(self, known: dict[str, int], least: int, joins: Boost):
        self.known, self.least, self.joins = known, least, joins
        self.made: dict[tuple[str, str, str], bool | None] = {}

    def counts(self, pair: tuple[str, str, str]) -> list[int]:
        """Places of the whole word, of both parts and of the compound; -1 if it isn't known here."""
        a, b, _ = pair
        get = self.known.get
        return [get(a + b, -1), get(a, -1), get(b, -1), get(f"{a}-{b}", -1)]

    def decide(self, pairs: list[tuple[str, str, str]]) -> dict[tuple[str, str, str], bool | None]:
        if len(self.made) > FLUSH:
            self.made.clear()
        new = [p for p in dict.fromkeys(pairs) if p not in self.made]
        if new:
            n = np.array([self.counts(p) for p in new], float)
            rest = np.array([_marked(*p) for p in new], float)
            low = np.column_stack([np.log1p(np.maximum(n, 0)), rest])
            high = np.column_stack([np.log1p(np.where(n < 0, self.least - 1, n)), rest])
            least, most = self.joins.bounds(low, high) if self.least > 1 else (self.joins.predict(low),) * 2
            self.made.update({p: y > 0.5 if (x > 0.5) == (y > 0.5) else None for p, x, y in zip(new, least.tolist(), most.tolist(), strict=True)})
        return self.made


def decided(ends: DataFrame, right: DataFrame, joins: Boost) -> DataFrame:
    """(page_id, field, line_no, more): bits of the line ends that tasks couldn't decide (`ends`) and whose word goes on. Their rare words
    are looked up in the whole vocabulary `right`; each distinct pair of parts once."""

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            b = batch.to_pydict()
            if batch.num_rows:
                x = [[*np.log1p(n), *_marked(a, c, m)] for a, c, m, n in zip(b["a"], b["b"], b["mark"], b["counts"], strict=True)]
                yield batch.select(["a", "b", "mark"]).filter(pa.array(joins.predict(np.array(x, float)) > 0.5))

    pairs = ends.groupBy("a", "b", "mark").agg(F.first("counts").alias("counts"))
    words = F.expr("array(concat(a, b), a, b, concat(a, '-', b))")
    asked = pairs.select("a", "b", "mark", F.posexplode(F.arrays_zip(words.alias("word"), F.col("counts").alias("n"))).alias("i", "x")).select("a", "b", "mark", "i", F.col("x.word").alias("word"), F.col("x.n").alias("have"))
    found = asked.where("have < 0").join(right, "word", "left").select("a", "b", "mark", "i", F.coalesce("n", F.lit(0)).alias("n"))
    whole = asked.where("have >= 0").select("a", "b", "mark", "i", F.col("have").alias("n")).union(found)
    one = lambda i: F.max(F.when(F.col("i") == i, F.col("n")))
    goes = whole.groupBy("a", "b", "mark").agg(F.array(*map(one, range(4))).alias("counts")).mapInArrow(judge, "a string, b string, mark string")
    salted = goes.select("a", "b", "mark", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    places = ends.select("page_id", "field", "line_no", "bit", "a", "b", "mark", F.pmod(F.hash("page_id"), F.lit(SALT)).alias("salt"))
    return places.join(salted, ["a", "b", "mark", "salt"]).select("page_id", "field", "line_no", F.col("bit").alias("more"))


def _broken(line: str, after: str) -> tuple[str, str, str] | None:
    """(last part, first part of the next line, mark) if a word might go on; None otherwise."""
    m = _MARK.search(line)
    mark = m.group(1) if m else ""
    head = line[: m.start()] if m else line.rstrip()
    last, first = head.split()[-1:] or [""], after.split()[:1] or [""]
    a, b = last[0].lower().lstrip(_EDGE), first[0]
    if not a or not b or not a[-1:].isalpha() or not b[0].isalpha() or (not mark and b[0].isupper()) or _CJK.search(a[-1]) or _CJK.search(b[0]):
        return None
    return a, b.lower().rstrip(_EDGE), mark


class Collapse:
    """Folds strings that are often read for each other, so that a misread title equals the title."""

    def __init__(self, edits: list[tuple[str, str]]):
        up: dict[str, str] = {}

        def find(x: str) -> str:
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edits:
            if len(a) == len(b) == 1 and a.isalpha() and b.isalpha():
                up[find(a)] = find(b)
        self.single = Kept({ord(x): find(x) for x in list(up)})
        self.several = [(a, b) for a, b in edits if len(a) == 2 and a.isalpha()]
        inside = {a: b for a, b in edits if len(a) == 1 and not a.isalpha()}
        self.inside = inside
        self.odd = re.compile("(?<=[^\\W\\d_])[" + "".join(map(re.escape, inside)) + "]|[" + "".join(map(re.escape, inside)) + "](?=[^\\W\\d_])") if inside else None

    def __call__(self, text: str) -> str:
        """Letters of a folded text, line by line."""
        if self.odd:
            text = self.odd.sub(lambda m: self.inside[m.group()], text)
        key = text.translate(letters())
        for a, b in self.several:
            key = key.replace(a, b)
        return key.translate(self.single)


LINES = "page_id string, book_id string, field int, line_no int, key long, sign long, bits int, short float, words int, first string, last string, joined string, odd array<string>, ends array<struct<bit: int, a: string, b: string, mark: string, counts: array<bigint>>>"
#: What a line looks like, as bits.
NUMBER, NAMED, STOP, LOWER, CAPS, STAR, DIGITS, HEAD, GOES1, GOES2 = (1 << i for i in range(10))
_ROMAN_EDGE = re.compile(r"^[ivxlcIl\[(]{1,7}[\])]?\s|\s[ivxlcIlO\[(]{1,7}[\])]?$")


def lines_of(pages: DataFrame, known: dict[str, int], least: int, joins: Boost, edits: list[tuple[str, str]]) -> DataFrame:
    """One row per line with a character of both fields: what it looks like, whether its last word may go on (in the next line, and
    in the one after that; undecided ones are in `ends`), and its suspicious words. `known` holds the words of `least` places and more."""
    shared = pages.sparkSession.sparkContext.broadcast((known, least, joins, edits))  # bounded by KNOWN and FOLDED

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest as digest

        known, least, joins, edits = shared.value
        fold, collapse, memo, judge = rewriter(), Collapse(edits), _Memo(), Ends(known, least, joins)
        end = pa.struct([("bit", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("mark", pa.string()), ("counts", pa.list_(pa.int64()))])
        half = 1 << 63
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(end)]
        names = ["field", "line_no", "key", "sign", "bits", "short", "words", "first", "last", "joined", "odd", "ends"]

        def page_lines(raw: str, f: int, number: int | None, named: set[str], rows: list, asked: list, where: list) -> int:
            text = fold(raw)
            lines = text.split("\n")
            full = [n for n, x in enumerate(lines) if x and not x.isspace()]
            if not full:
                return 0
            soft = raw.split("\n") if "\u00ad" in raw else lines
            keys = collapse(text).split("\n")
            chinese = not text.isascii() and bool(_CJK.search(text))
            odd: dict[int, list[str]] = {}
            if chinese:
                ends = None
                for i, w in enumerate(contexts(text)):
                    if w not in known and w[1] not in ".0":
                        if ends is None:
                            ends = np.cumsum([len("".join(x.split())) for x in lines])
                        odd.setdefault(int(np.searchsorted(ends, i, "right")), []).append(w)
            sign = digest(max(keys, key=len)) - half
            widest = max(len(lines[n]) for n in full)
            for at, n in enumerate(full):
                s = lines[n].strip()
                key = keys[n]
                short = len(s) <= 60
                if short and (s[0].isdigit() or s[-1].isdigit() or _ROMAN_EDGE.search(s)):
                    key = collapse(_TITLE_NUMBER.sub(" ", s))
                is_number = len(s) <= 16 and page_number(s, number)
                bad, first, last, joined = odd.get(n, []), None, None, None
                raw_words = s.split()
                count = len(raw_words)
                ends_mark = soft[n]
                marked = ends_mark.rstrip()[-1:] in _MARKS
                if chinese:
                    count += len(s) // 2
                else:
                    for w in raw_words[1:-1]:
                        w = memo[w]
                        if w and w not in known:
                            bad.append(w)
                    w = memo[raw_words[0]]
                    if w and w not in known:
                        first = w
                    if count > 1 and not marked:
                        w = memo[raw_words[-1]]
                        if w and w not in known:
                            last = w
                    for slot in (1, 2):
                        if at + slot < len(full):
                            nxt = lines[full[at + slot]]
                            if pair := _broken(ends_mark, nxt):
                                asked.append(pair)
                                where.append((len(rows), GOES1 if slot == 1 else GOES2))
                                if slot == 1 and pair[0] + pair[1] not in known:
                                    joined = pair[0] + pair[1]
                            if nxt.lstrip()[:1].islower():
                                break  # text goes on: the line after it isn't asked
                bits = (
                    NUMBER * is_number + NAMED * (key in named) + STOP * (s[-1] in ".!?。！？,，;；:") + LOWER * s[0].islower() + CAPS * s.isupper()
                    + STAR * (s[0] in "*[" or s[-1] in "*]") + DIGITS * any(map(str.isdigit, s)) + HEAD * (s[0] == "\\")
                )
                rows.append([f, n, digest(key) - half if key else None, sign, bits, len(s) / widest, count, first, last, joined, bad, None])
            return len(full)

        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                part = whole.slice(lo, 1000)
                b = part.to_pydict()
                rows: list[list] = []
                take: list[int] = []
                asked: list[tuple[str, str, str]] = []
                where: list[tuple[int, int]] = []
                for i, number in enumerate(b["number"]):
                    named: set[str] = set()
                    for column in ("header_segments_json", "footer_segments_json"):
                        t = b[column][i]
                        if t and len(t) > 2:
                            try:
                                named |= {collapse(fold(x["text"])) for x in json.loads(t) if x.get("kind") == "text" and isinstance(x.get("text"), str)}
                            except (ValueError, AttributeError, TypeError, KeyError):
                                pass
                    named.discard("")
                    for f, column in enumerate(FIELDS):
                        if b[column][i]:
                            take += [i] * page_lines(b[column][i], f, number, named, rows, asked, where)
                if asked:
                    goes = judge.decide(asked)
                    for (r, bit), pair in zip(where, asked, strict=True):
                        if goes[pair]:
                            rows[r][4] |= bit
                        elif goes[pair] is None:
                            rows[r][11] = [*(rows[r][11] or []), (bit, *pair, judge.counts(pair))]
                if rows:
                    at = pa.array(take)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("page_id").take(at), part.column("book_id").take(at), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], names=["page_id", "book_id", *names]
                    )

    return pages.select("page_id", "book_id", "number", *FIELDS, "header_segments_json", "footer_segments_json").mapInArrow(run, LINES)


def repeats(lines: DataFrame, pages: DataFrame, keep: Any, elsewhere: float = 0.03, doubt: int = 100) -> DataFrame:
    """(book, key, like): on how many different pages of a book the like of a line stands, from two on. Pages with the same longest
    line are scans of one page and count once; the counts are pre-aggregated where the lines are made.

    A frame belongs to its book. A line whose share of the pages of all other books (with `doubt` more books that lack it, for what
    few books can tell) is at least `elsewhere` of its share in its own (`Continued overleaf.`) is text that books have: it gets no count."""
    each = lines.where("key is not null").groupBy(F.xxhash64("book_id").alias("book"), "key", "field", "sign").agg(F.lit(1).alias("one"))
    counted = keep(each.groupBy("book", "key", "field").agg(F.count("*").alias("like")).groupBy("book", "key").agg(F.max("like").alias("like")))
    sizes = pages.groupBy(F.xxhash64("book_id").alias("book")).agg(F.count("*").alias("pages"))
    books = sizes.count()
    # a book may hold a large part of all lines
    salted = sizes.select("book", "pages", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    shares = counted.withColumn("salt", F.pmod("key", F.lit(SALT)).cast("int")).join(salted, ["book", "salt"]).select("book", "key", "like", (F.col("like") / F.col("pages")).alias("share"))
    total = shares.groupBy("key").agg(F.sum("share").alias("all"), F.count("*").alias("n")).where("n > 1").select("key", "all")
    met = shares.where("like > 1").join(total, "key", "left").where(f"coalesce(`all` - share, 0) < {elsewhere} * share * {books + doubt}")
    return met.select("book", "key", "like")


def with_repeats(lines: DataFrame, counted: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Lines with `like` (1 for lines that stand alone) and with the bits of `more`. Only the hashes of lines go through the salted join,
    as one line of one book may be a large part of all lines; what it finds is then laid beside the lines of each page."""
    # the merge hint: sixteen copies of the counts are more than their size lets the planner expect, so it mustn't broadcast them
    salted = counted.select("book", "key", "like", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    narrow = lines.where("key is not null").select(F.xxhash64("book_id").alias("book"), "key", "page_id", "field", "line_no", F.pmod(F.hash("page_id"), F.lit(SALT)).alias("salt"))
    alike = narrow.join(salted.hint("merge"), ["book", "key", "salt"]).select("page_id", "field", "line_no", "like")
    slim = lines.drop("book_id", "key", "sign", "ends")
    laid = slim.withColumn("like", F.lit(None).cast("long")).withColumn("more", F.lit(None).cast("int")).unionByName(alike, allowMissingColumns=True)
    return laid if more is None else laid.unionByName(more, allowMissingColumns=True)


def paired(table: Any) -> Any:
    """Sorted rows of `with_repeats`, where the rows of a line follow each other, as one row a line; a line that arrived twice counts once."""
    import pyarrow as pa

    page, field, line = (table.column(c).to_numpy(zero_copy_only=False) for c in ("page_id", "field", "line_no"))
    new = np.ones(len(page), bool)
    new[1:] = (page[1:] != page[:-1]) | (field[1:] != field[:-1]) | (line[1:] != line[:-1])
    group = np.cumsum(new) - 1
    like = np.ones(int(new.sum()), np.int64)
    found = table.column("like").fill_null(0).to_numpy()
    np.maximum.at(like, group, found)
    more = np.zeros(len(like), np.int32)
    np.bitwise_or.at(more, group, table.column("more").fill_null(0).to_numpy())
    bits = table.column("bits")
    own = np.flatnonzero(bits.is_valid().to_numpy(zero_copy_only=False))
    first = np.full(len(like), -1)
    first[group[own][::-1]] = own[::-1]
    keep = first >= 0
    out = table.take(pa.array(first[keep]))
    out = out.set_column(out.schema.get_field_index("bits"), "bits", pa.array(out.column("bits").to_numpy() | more[keep]))
    return out.set_column(out.schema.get_field_index("like"), "like", pa.array(like[keep]))


class Columns:
    """Columns of sorted lines as arrays, with each line's place in its page."""

    def __init__(self, table: Any):
        col = lambda n: table.column(n).to_numpy(zero_copy_only=False)
        self.line_no, self.like, self.bits, self.short, self.words = col("line_no"), col("like").astype(float), col("bits"), col("short").astype(float), col("words")
        page, field = col("page_id"), col("field")
        n = len(page)
        new = np.ones(n, bool)
        new[1:] = (page[1:] != page[:-1]) | (field[1:] != field[:-1])
        self.start = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.ends = np.ones(n, bool)  # the last line of its page
        self.ends[:-1] = new[1:]

    def has(self, bit: int) -> np.ndarray:
        return (self.bits & bit) > 0

    def features(self) -> np.ndarray:
        """Features of lines in the context of the next line of the page (the last line's next is itself)."""
        nxt = np.arange(len(self.bits)) + ~self.ends
        lower, stop = self.has(LOWER), self.has(STOP)
        return np.stack([np.log(self.like), self.short, stop, lower, self.has(CAPS), self.has(STAR), self.has(DIGITS), self.words, lower[nxt], stop[nxt], self.short[nxt]], 1).astype(float)


def frame_model(table: Any) -> Boost:
    """Trees that tell furniture from text, fitted on the sorted lines of a bounded sample of pages: lines that the page's margin
    segments name against lines inside the page whose like stands nowhere else."""
    if table.num_rows == 0:
        return Boost().fit(np.zeros((0, 11)), np.zeros(0))
    c = Columns(table)
    x = c.features()
    place = np.arange(len(x)) - c.start[c.group]
    last = np.append(c.start[1:], len(x))[c.group] - 1 - (np.arange(len(x)))
    yes = c.has(NAMED)
    no = ~yes & (c.like <= 2) & (((place > 2) & (last > 2)) | c.has(LOWER))
    return Boost().fit(x[yes | no], yes[yes | no].astype(float))


def framed(lines: DataFrame, model: Boost, least: int = 3) -> DataFrame:
    """(page_id, field, line_no, kind, word): frame lines and broken words, and the suspicious words of the page's own lines (kind
    `word`). Lines are read in order; a task holds a batch and the page that the batch cuts."""

    def settle(table: Any) -> Any:
        import pyarrow as pa

        table = paired(table)
        c = Columns(table)
        n = len(c.bits)
        if not n:
            return []
        at = np.arange(n)
        lower, number = c.has(LOWER), c.has(NUMBER)
        furniture = c.has(NAMED) | (model.predict(c.features()) > 0.5) | ((c.like >= least) & ~lower)
        sentence = c.has(STOP) & ((c.words <= 2) | (lower & ~c.has(NAMED)))  # ends a sentence of the text
        frame = number | (~c.has(HEAD) & ~sentence & furniture)
        top = np.minimum.reduceat(np.where(frame, n, at), c.start)[c.group]
        end = np.maximum.reduceat(np.where(frame, -1, at), c.start)[c.group]
        outside = (at < top) | (at > end)
        notice = ~outside & (c.like >= least) & ~lower & (c.has(CAPS) | c.has(STAR) | c.has(STOP) | (c.short < 0.95))
        nxt = np.minimum(at + 1, n - 1)
        skip = notice[nxt] & ~c.ends
        goes = ~outside & ~notice & ~c.ends & np.where(skip, c.has(GOES2) & (at + 2 <= end), c.has(GOES1) & (at + 1 <= end))
        into = np.zeros(n, bool)
        into[np.minimum(np.flatnonzero(goes & ~skip) + 1, n - 1)] = True
        into[np.minimum(np.flatnonzero(goes & skip) + 2, n - 1)] = True
        own = np.flatnonzero(~outside & ~notice)
        take = [*np.flatnonzero(outside), *np.flatnonzero(goes)]
        kind = ["page_number" if number[i] else "running" for i in np.flatnonzero(outside)] + ["hyphen"] * int(goes.sum())
        word: list[str | None] = [None] * len(kind)
        mine = table.take(pa.array(own))
        for i, odd, first, last, joined in zip(own, *(mine.column(x).to_pylist() for x in ("odd", "first", "last", "joined")), strict=True):
            if odd or first or last or joined:
                for w in (*odd, None if into[i] else first, joined if goes[i] else last):
                    if w:
                        take.append(i)
                        kind.append("word")
                        word.append(w)
        where = pa.array(np.array(take, np.int64))
        fields = np.array(FIELDS, object)[table.column("field").to_numpy()[np.array(take, np.int64)]] if take else []
        made = pa.Table.from_arrays(
            [table.column("page_id").take(where), pa.array(fields, pa.string()), table.column("line_no").take(where), pa.array(kind, pa.string()), pa.array(word, pa.string())], names=["page_id", "field", "line_no", "kind", "word"]
        )
        return made.combine_chunks().to_batches()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            whole = pa.Table.from_batches(held)
            ids, fields = whole.column("page_id"), whole.column("field")
            # up to where the last page begins
            k = whole.num_rows - 1
            tail = (ids[k].as_py(), fields[k].as_py())
            while k > 0 and (ids[k - 1].as_py(), fields[k - 1].as_py()) == tail:
                k -= 1
            if k:
                yield from settle(whole.slice(0, k))
                held = whole.slice(k).to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held))

    return lines.repartition("page_id", "field").sortWithinPartitions("page_id", "field", "line_no").mapInArrow(run, "page_id string, field string, line_no int, kind string, word string")


def noise(pages: DataFrame, keep: Any = None, most: int = KNOWN) -> DataFrame:
    """(page_id, field, line_no, kind): running, page_number, hyphen and misread lines of every page.

    Null and empty texts have no rows; a page that arrived twice counts once; a page without a book has no repeated lines.
    `keep` cuts the lineage of a table that is used several times (a written table or a checkpoint). `most` words are held by a task.
    """
    frames, words = findings(pages, keep, most)
    misread = words.select("page_id", "field", "line_no", F.lit("misread").alias("kind")).distinct()
    return frames.union(misread)


def repaired(pages: DataFrame, keep: Any = None) -> DataFrame:
    """(page_id, field, text): every text as continuous paragraphs, without its frame, with broken words joined and misread words
    replaced. Paragraphs begin at blank or indented lines and after short lines that end a sentence, and are parted by line feeds;
    ideographs are joined without a space.
    Null and empty texts stay as they are; `pages` is unique by page_id."""
    frames, words = findings(pages, keep)
    every = frames.select("page_id", "field", F.struct("line_no", "kind", F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("right")).alias("x")).union(
        words.select("page_id", "field", F.struct("line_no", F.lit("word").alias("kind"), "word", "right").alias("x"))
    )
    # what was found on one page: no more than the page has words
    notes = every.groupBy("page_id").agg(F.collect_list(F.struct("field", "x.line_no", "x.kind", "x.word", "x.right")).alias("notes"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            b = batch.to_pydict()
            out: list[tuple] = []
            for i, page in enumerate(b["page_id"]):
                for f in FIELDS:
                    out.append((page, f, repair(b[f][i], [n for n in b["notes"][i] or [] if n["field"] == f])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], names=["page_id", "field", "text"])

    return pages.select("page_id", *FIELDS).join(notes, "page_id", "left").mapInArrow(run, "page_id string, field string, text string")


def repair(text: str | None, notes: list[dict]) -> str | None:
    """One text, repaired by what was found in it."""
    if not text:
        return text
    cut = {n["line_no"] for n in notes if n["kind"] in ("running", "page_number")}
    goes = {n["line_no"] for n in notes if n["kind"] == "hyphen"}
    swaps: dict[int, list[tuple[str, str]]] = {}
    for n in notes:
        if n["kind"] == "word":
            swaps.setdefault(n["line_no"], []).append((n["word"], n["right"]))
    paragraphs: list[str] = []
    pending: list[tuple[str, str]] = []  # corrections of words that go on in the next line
    new, joined = True, False
    lines = text.split("\n")
    widest = max((len(x) for n, x in enumerate(lines) if n not in cut), default=0)
    for n, line in enumerate(lines):
        if n in cut:
            continue
        body = line.strip()
        if not body:
            new = True
            continue
        if n in goes:
            body = _MARK.sub("", body)
        new = new or line[:2].isspace() and bool(paragraphs)
        if new and not joined or not paragraphs:
            paragraphs.append(body)
        elif joined:
            paragraphs[-1] += body
        else:
            paragraphs[-1] += ("" if _CJK.match(body[0]) or _CJK.match(paragraphs[-1][-1]) or paragraphs[-1][-1] in "，。；：、？！" else " ") + body
        for word, right in [*pending, *swaps.get(n, [])]:
            whole = paragraphs[-1]
            done = _swap(whole, word, right)
            paragraphs[-1] = done if done != whole else _swap(rewriter()(whole), word, right)  # written with look-alikes
        pending = swaps.get(n, []) if n in goes else []
        # a line that ends a sentence ends its paragraph if it is short, or if lines are whole paragraphs
        new, joined = body[-1] in ".!?。！？" and (len(line) < 0.8 * widest or widest > 120), n in goes
    return "\n".join(paragraphs)


def _swap(text: str, word: str, right: str) -> str:
    """The last place of a word replaced, in its case; for an ideograph with its neighbours only the middle changes."""
    if len(word) == 3 and _CJK.match(word[1]):
        outer = [re.escape(c) if _CJK.match(c) else r"\d" if c == "0" else "[^\u3400-\u9fff\\d]|^|$" for c in (word[0], word[2])]
        found = list(re.finditer(f"(?<![^\\s\\S])({outer[0]})\\s*({re.escape(word[1])})(?=\\s*(?:{outer[1]}))", text))
        return text[: found[-1].start(2)] + right[1] + text[found[-1].end(2) :] if found else text
    found = list(re.finditer(r"(?<!\w)" + re.escape(word) + r"(?!\w)", text, re.I))
    if not found:
        return text
    m = found[-1]
    old = m.group()
    return text[: m.start()] + (right.upper() if old.isupper() and len(old) > 1 else right.capitalize() if old[0].isupper() else right) + text[m.end() :]


def frequent(right: DataFrame, most: int) -> tuple[dict[str, int], int]:
    """The words of at least T places, and T: the least count that no more than `most` words have (or exceed). Counts are binned, so that
    a few hundred rows reach the driver to choose T; a T of 1 means all words."""
    bins = right.groupBy(F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n") * 8) + 16).cast("int").alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    least, total = 1 << 62, 0
    for r in sorted(bins.collect(), key=lambda r: -r.bin):
        total += r.words
        if total > most:
            break
        least = r.least
    else:
        least = 1
    return {r.word: r.n for r in right.where(F.col("n") >= least).collect()}, least


def findings(pages: DataFrame, keep: Any = None, most: int = KNOWN) -> tuple[DataFrame, DataFrame]:
    """(page_id, field, line_no, kind) of frame lines and broken words, and (page_id, field, line_no, word, right) of misread words.
    `most`: words that a task holds; the result doesn't depend on it."""
    keep = keep or (lambda df: df)
    vocab = keep(vocabulary(pages))
    pairs = keep(scored_pairs(keep(candidates(vocab)), vocab))
    sample = twice_read(pages)
    fixes = keep(corrections(pairs, ranker(pairs, sample)))
    right = keep(vocab.join(fixes, "word", "left_anti"))
    known, least = frequent(right, most)
    joins = join_model(training_words(right), right)
    kinds = pairs.join(fixes.select(F.col("word").alias("w"), F.col("right").alias("c")), ["w", "c"]).groupBy("a", "b").agg(F.count("*").alias("k"))
    enough = FOLDED * (fixes.count() or 1)
    edits = sorted((r.a, r.b) for r in kinds.where(F.col("k") >= max(3.0, enough)).collect())  # 1 / FOLDED rows at most
    lines = keep(lines_of(pages, known, least, joins, edits))
    ends = lines.where("ends is not null").select("page_id", "field", "line_no", F.expr("inline(ends)"))
    counted = keep(repeats(lines, pages, keep))
    some = with_repeats(lines.where(F.col("page_id").isin([r.page_id for r in sample[:FRAME_SAMPLE]])), counted)
    some = paired(some.drop("odd", "first", "last", "joined").orderBy("page_id", "field", "line_no").toArrow())
    found = keep(framed(with_repeats(lines, counted, decided(ends, right, joins)), frame_model(some)))
    words = found.where("kind = 'word'").join(fixes.select("word", "right"), "word").select("page_id", "field", "line_no", "word", "right")
    return found.where("kind <> 'word'").select("page_id", "field", "line_no", "kind"), words
