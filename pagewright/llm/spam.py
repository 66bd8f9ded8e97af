"""Pages made of keywords, links or product tags instead of sentences.

A text is cut into lines, and lines into sentences. A hidden Markov model labels the pieces as prose, link list, tag list, menu or
apparatus (contents, indexes, bibliographies, tables: lists that real books have). Every piece is observed through a few yes/no
features, among them how few different words stand around it. A page is flagged if pieces of the link, tag and menu states
hold more than half of its words (of ideographs two count as a word, of an address each part).

The model is trained here: emission and transition probabilities are counted on generated pages of each kind, with smoothing
(`train()`, seeded), so nothing in it depends on the corpus or its size.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

STATES = ("prose", "links", "tags", "menu", "apparatus")
SPAM = (1, 2, 3)
#: Words around a piece among which different ones are counted, near and far.
AROUND, FAR = 40, 120

_URL = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,12}/\S*|\b[\w-]+(?:\.[\w-]+)+\.[a-z]{2,12}\b|\b[a-z][\w-]*\d[\w-]*\.[a-z]{2,12}\b", re.I)
#: What every URL holds, every price, page list and citation, and every table row: cheap tests before the patterns.
_DOTTED, _DIGIT = re.compile(r"\.\S|//"), re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]+", re.U)
_CJK = re.compile("[⺀-⿟㐀-鿿豈-﫿]+")
_PRICE = re.compile(r"(?:[$€£¥]\s?\d)|\b\d{1,4}[.,]\d\d\b(?!\s*\\\\)")
_TAG = re.compile(r"(?:^|\s)[#@][^\s#]+")
_END = re.compile(r"[.!?。！？…][\"'”’»）)]*\s*$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_a-zß-ÿ])|(?<=[。！？])")
_NUMBERED = re.compile(r"^\s*(?:\[\d+\]|\(?\d+[.)]|[-*•])\s")
_PAGES = re.compile(r"(?:,\s*\d+)+\s*$|(?:(?:[.·…]\s*){2,}|\s{2,})\d+\s*$|\s\d+\s*$")
_MENU = re.compile(r"[|»›>•·/]")
#: Arrows, dingbats and other pictures, as badges are made of.
_SIGNS = re.compile("[\u2190-\u21ff\u2300-\u23ff\u2500-\u2bff\U0001f300-\U0001faff]")
_CITED = re.compile(r"^\s*(?:\[\d+\]|\d+\.)\s.*\b(?:1[5-9]|20)\d\d\b")


def pieces(text: str) -> list[str]:
    """Lines, and sentences within lines; blank ones are left out."""
    return [s for line in text.split("\n") if line.strip() for s in _SENTENCE.split(line) if s.strip()]


def units(piece: str) -> list[str]:
    """Words of a piece for counting different ones: words in lower case; runs of ideographs as overlapping pairs."""
    out = []
    for w in _WORD.findall((_URL.sub(" ", piece) if _DOTTED.search(piece) else piece).lower()):
        if _CJK.match(w) and len(w) > 1:
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        else:
            out.append(w)
    return out


_RUN = re.compile(r"[^\W_]+")


def weight(piece: str) -> float:
    """Words of a piece: runs of letters and digits; of ideographs two are a word."""
    if piece.isascii():
        return len(_RUN.findall(piece))
    han = sum(map(len, _CJK.findall(piece)))
    return han / 2 + len(_RUN.findall(_CJK.sub(" ", piece) if han else piece))


def _different(flat: list[str], mid: int, width: int, least: int) -> float:
    """Share of different words among the `width` around a place; 1 where there are fewer than `least`."""
    window = flat[max(0, mid - width // 2) : mid + width // 2]
    return len(set(window)) / len(window) if len(window) >= least else 1.0


def observe(parts: list[str]) -> np.ndarray:
    """Yes/no features of each piece of one text."""
    tokens = [units(p) for p in parts]
    flat = [t for ts in tokens for t in ts]
    out = np.zeros((len(parts), FEATURES), np.uint8)
    at = 0
    for i, (p, ts) in enumerate(zip(parts, tokens, strict=True)):
        mid = at + len(ts) // 2
        ratio = _different(flat, mid, max(AROUND, len(ts)), 12)
        far = _different(flat, mid, max(FAR, len(ts)), 60)
        own = len(set(ts)) / len(ts) if len(ts) >= 8 else 1.0
        at += len(ts)
        url = bool(_DOTTED.search(p) and _URL.search(p))
        digit = bool(_DIGIT.search(p))
        row = (
            url, url and len(ts) <= 6, bool(_END.search(p)), len(ts) <= 4, len(ts) >= 8, digit and bool(_PRICE.search(p)), ("#" in p or "@" in p) and len(_TAG.findall(p)) >= 2,
            ratio < 0.3, 0.3 <= ratio < 0.42, 0.42 <= ratio < 0.55, far < 0.2, 0.2 <= far < 0.3, 0.3 <= far < 0.4, own < 0.4, bool(_NUMBERED.match(p)), digit and bool(_PAGES.search(p)), "&" in p or "\t" in p or "\\\\" in p,
            len(_MENU.findall(p)) >= (1 if len(ts) < 8 else 3), bool(_SIGNS.search(p)), digit and bool(_CITED.search(p)),
        )
        out[i] = row
    return out


FEATURES = 20


def generated(rng: random.Random) -> tuple[list[str], list[int]]:
    """A page of pieces with their states, made up of random words."""
    letters = "abcdefghilmnoprstuvw"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 10)))
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x5E00)) for _ in range(n))
    chinese = rng.random() < 0.25
    site = lambda: f"{rng.choice(['https://', 'http://', 'www.', 'https://www.'])}{word()}{rng.randint(1, 99)}.{word()[:3]}/{word()}/{rng.randint(1, 9999)}"
    keys = [han(rng.randint(2, 4)) if chinese else " ".join(word() for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(3, 8))]
    small = [word() for _ in range(12)]
    common = [han(2) for _ in range(40)] if chinese else [word() for _ in range(60)]

    def sentence() -> str:
        if chinese:
            return "，".join("".join(rng.choice(common) for _ in range(rng.randint(3, 7))) for _ in range(rng.randint(1, 3))) + "。"
        ws = [rng.choice(small) if rng.random() < 0.4 else rng.choice(common) if rng.random() < 0.7 else word() for _ in range(rng.randint(6, 22))]
        return " ".join(ws).capitalize() + rng.choice(["."] * 9 + ["?", "!"])

    def prose(n: int) -> list[str]:
        text = [sentence() for _ in range(n)]
        if rng.random() < 0.4:  # wrapped lines
            joined = ("" if chinese else " ").join(text)
            width = rng.randint(26, 34) if chinese else rng.randint(45, 70)
            return [s for line in (joined[i : i + width] for i in range(0, len(joined), width)) for s in pieces(line)]
        if rng.random() < 0.1:
            text[rng.randrange(n)] += " " + site()
        return [s for t in text for s in pieces(t)]

    def links(n: int) -> list[str]:
        form = rng.randrange(5)
        return [(site(), f"[{k}]({site()})", f'<a href="{site()}">{k}</a>', f"{k} » {site()[8:]}", f"{k} {site()}")[form] for k in (rng.choice(keys) for _ in range(n))]

    def tags(n: int) -> list[str]:
        form = rng.randrange(6)
        picked = [rng.choice(keys) for _ in range(n * 4)]
        if form == 0:
            return picked[:n]
        if form == 1:
            return [" ".join(picked)]
        if form == 2:
            return [" ".join("#" + k.replace(" ", "") for k in picked)]
        if form == 3:
            return [rng.choice([", ", " | ", "、", " / "]).join(picked)]
        if form == 4:
            by, names = rng.choice([" - ", " @ ", ": ", " in "]), [word().capitalize() for _ in range(6)]
            return [rng.choice([", ", "; ", " | "]).join(f"{k}{by}{rng.choice(names)}" for k in picked)]
        join = ["的", "和", "最好的", "在"] if chinese else small[:5]
        return [("" if chinese else " ").join(x for _ in range(4) for x in (rng.choice(join), rng.choice(keys), rng.choice(keys))) + rng.choice("。！" if chinese else ".!") for _ in range(n)]

    def price() -> str:
        n, mark, sign = rng.randint(1, 999), rng.choice(".,"), rng.choice(["$", "€", "£", "¥", "EUR", "", ""])
        amount = rng.choice([f"{n}{mark}{rng.randint(0, 99):02d}", f"{n}{mark}{rng.randint(0, 99):02d}", str(n)])
        return rng.choice([f"{sign}{amount}", f"{amount} {sign}".strip()])

    def badge() -> str:
        return rng.choice([lambda: chr(rng.choice([0x2605, 0x2606, 0x2714, 0x25CF, 0x2665, 0x27A4])) * rng.randint(1, 5), lambda: word()[:4], lambda: word()[:5].upper(), lambda: f"-{rng.randint(5, 70)}%", lambda: f"({rng.randint(1, 900)})"])()

    def menu(n: int) -> list[str]:
        if rng.random() < 0.35:
            return [rng.choice([" | ", " » ", " > ", " · ", " / "]).join(rng.choice(keys) for _ in range(rng.randint(3, 9))) for _ in range(max(1, n // 3))]
        # goods: a few fields in an order of their own, on every line
        code = lambda: rng.choice([word()[:2].upper(), f"{word()[:1].upper()}{rng.randint(1, 99)}", f"{rng.randint(1, 99)}{word()[:2]}"])
        makes = {"key": lambda: rng.choice(keys), "name": lambda: han(2) if chinese else word().capitalize(), "code": code, "price": price, "badge": badge}
        order = ["key", *rng.sample(["name", "code", "price", "badge"], rng.randint(2, 4))]
        if rng.random() < 0.3:
            rng.shuffle(order)
        by = rng.choice([" ", " ", " ", " - ", ", ", " | ", "; "])
        return [by.join(makes[f]() for f in order) for _ in range(n)]

    def apparatus(n: int) -> list[str]:
        form = rng.randrange(6)
        name = lambda: han(2) if chinese else word().capitalize()
        heads = [name() for _ in range(n)]
        if form == 0:
            return [f"{h}, " + ", ".join(str(rng.randint(1, 400)) for _ in range(rng.randint(1, 5))) for h in heads]
        if form == 1:
            head, leader = rng.choice(["", "", "", word().capitalize() + " "]), rng.choice(["." * rng.randint(4, 24), "." * rng.randint(4, 24), ". " * rng.randint(3, 9), "…", "  "])
            title = lambda h: rng.choice([h, f"The {h} {name()}", f"{h} {rng.choice(small)} {rng.choice(small)} {rng.choice(common)}"])
            return [s for i, h in enumerate(heads, 1) for s in pieces(f"{head}{i}. {title(h)} {leader} {i * 13}")]
        if form == 2:
            link, form_of = rng.random() < 0.5, rng.random() < 0.6
            return [s for i, h in enumerate(heads, 1) for s in pieces((f"[{i}] {h} {name()}. The {name()} {name()}. {name()}, {rng.randint(1700, 1999)}." if form_of else f"{i}. {h}, {rng.choice('ABCDEFGH')}. {rng.choice(small).capitalize()} {rng.choice(small)} {rng.choice(common)} {rng.choice(small)} {name()}. {name()}, {rng.randint(1550, 2020)}.") + (f" {site()}" if link and rng.random() < 0.5 else ""))]
        if form == 3:
            few = heads[: rng.randint(3, 12)]
            return [f"{rng.choice(few)} & {rng.randint(1, 900)} & {rng.random() * 40:.1f} \\\\" for _ in heads]
        if form == 4:
            return [f"{h} — {sentence()}" for h in heads]
        return [(han(rng.randint(5, 7)) if chinese else " ".join(rng.choice(common) for _ in range(rng.randint(4, 8))).capitalize()) + rng.choice([",", "", ".", ";"]) for _ in heads]

    makers = (prose, links, tags, menu, apparatus)
    main = rng.choice([0, 0, 1, 2, 3, 4])
    blocks = [(main, rng.randint(8, 40))] if main else [(0, rng.randint(2, 40))]
    if main and rng.random() < 0.5:
        blocks.insert(0, (0, rng.randint(1, 4)))
    if main and rng.random() < 0.3:
        blocks.append((0, rng.randint(1, 3)))
    text, states = [], []
    for s, n in blocks:
        made = makers[s](n)
        text += made
        states += [s] * len(made)
    return text, states


Model = tuple[np.ndarray, np.ndarray, np.ndarray]


@lru_cache(maxsize=2)
def train(pages: int = 2000, seed: int = 7) -> Model:
    """(log start, log transitions, feature weights): counted on generated pages, with one added to every count."""
    rng = random.Random(seed)
    k = len(STATES)
    start, move = np.ones(k), np.ones((k, k))
    yes, total = np.ones((k, FEATURES)), np.full(k, 2.0)
    for _ in range(pages):
        parts, states = generated(rng)
        seen = observe(parts)
        start[states[0]] += 1
        for a, b in zip(states, states[1:], strict=False):
            move[a, b] += 1
        for s, row in zip(states, seen, strict=True):
            yes[s] += row
            total[s] += 1
    p = yes / total[:, None]
    return np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), np.stack([np.log(p), np.log1p(-p)])


def label(seen: np.ndarray, model: Model) -> np.ndarray:
    """The most probable states of a text's pieces (Viterbi)."""
    return label_all([seen], model)[0]


def label_all(texts: list[np.ndarray], model: Model) -> list[np.ndarray]:
    """As `label`, of many texts at once: texts of like length go through each step together."""
    start, move, (on, off) = model
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
    order = sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: len(texts[i]))
    for lo in range(0, len(order), 128):
        group = order[lo : lo + 128]
        size = np.array([len(texts[i]) for i in group])
        flat = np.concatenate([texts[i] for i in group])
        emit = np.zeros((len(group), size.max(), len(start)))
        emit[np.arange(size.max()) < size[:, None]] = flat @ on.T + (1 - flat) @ off.T
        score = start + emit[:, 0]
        back = np.zeros(emit.shape, np.int8)
        for t in range(1, size.max()):
            through = score[:, :, None] + move
            best = through.argmax(1)
            back[:, t] = best
            score = np.where((t < size)[:, None], through.max(1) + emit[:, t], score)
        last = score.argmax(1)
        states = np.zeros(emit.shape[:2], np.int8)
        rows = np.arange(len(group))
        for t in range(size.max() - 1, -1, -1):
            states[:, t] = last
            if t:
                last = np.where(t < size, back[rows, t, last], last)
        for i, s, n in zip(group, states, size, strict=True):
            out[i] = s[:n]
    return out


def shares_all(texts: list[str | None], model: Model) -> np.ndarray:
    """Share of each text in each state; zeros for a null, empty or blank text, and for one without a word."""
    parts = [pieces(t) if t else [] for t in texts]
    states = label_all([observe(p) if p else np.zeros((0, FEATURES)) for p in parts], model)
    total = np.zeros((len(texts), len(STATES)))
    for i, (p, s) in enumerate(zip(parts, states, strict=True)):
        if p:
            total[i] = np.bincount(s, [weight(x) for x in p], len(STATES))
    return total / np.maximum(total.sum(1, keepdims=True), 1e-9)


def shares(text: str | None, model: Model) -> list[float]:
    return shares_all([text], model)[0].tolist()


def page_shares(documents: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, prose, links, tags, menu, apparatus): the share of the text in each state, for every row."""
    model = train()  # a few hundred numbers, sent with the tasks

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = shares_all(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("ident"), *(pa.array(made[:, i]) for i in range(len(STATES)))], names=["ident", *STATES])

    kind = documents.schema[ident].dataType.simpleString()
    return documents.selectExpr(f"`{ident}` as ident", f"`{text}` as text").mapInArrow(run, f"ident {kind}, " + ", ".join(f"{s} double" for s in STATES)).withColumnRenamed("ident", ident)


def flagged(documents: DataFrame, ident: str = "doc_id", text: str = "text", share: float = 0.5) -> DataFrame:
    """(ident) of pages with more than `share` of their text in link lists, tag lists or menus."""
    return page_shares(documents, ident, text).where(f"links + tags + menu > {share}").select(ident)
