"""Texts that look the same although their characters differ, brought to one form.

1. Pairs of strings that look alike: from Unicode's own data by rule (wide and non-breaking forms, canonical sequences and
   singletons, radicals, ligatures), from a short list of letters shared by Latin, Greek and Cyrillic, and invisible
   characters, which look like nothing at all (the empty string).
2. Transitive classes by union-find over these strings.
3. A representative of each class: the member most frequent in the corpus (ties: the lowest code points), for texts with
   ideographs and for others apart, so that each keeps its own punctuation. Characters are counted over all texts; a class with
   the empty string is always erased.
4. Greedy rewriting: a multi-pattern automaton finds the longest member at each place and its representative replaces it;
   then marks are composed.

What differs to a reader stays different: raised, circled and fraction forms, accents, case, digits, line feeds and the number of
plain spaces are in no class.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 8  #: parts in which the pairs of a class are made

# Letters that share one shape, as written (other script, then Latin).
CYRILLIC = "аa еe оo рp сc уy хx іi ѕs јj ԁd һh ԛq ԝw АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX ҮY ԌG ԚQ ԜW"
GREEK = "οo ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ"
# Hyphens and apostrophes of one shape.
PUNCTUATION = {"‐": "-", "‑": "-", "ʼ": "’", "´": "´", ";": ";", "·": "·", "⋅": "·"}
# Characters without any shape of their own.
INVISIBLE = "​‌‍⁠﻿⁡⁢⁣⁤᠎͏"
# Spaces as wide as a reader takes a space to be.
SPACES = "              　"
# Radicals of the supplement and the ideographs they equal (Unicode's EquivalentUnifiedIdeograph data).
RADICALS = (
    "⺂乛 ⺃乚 ⺄乙 ⺅亻 ⺆冂 ⺈刀 ⺉刂 ⺊卜 ⺎兀 ⺏尣 ⺐尢 ⺒巳 ⺓幺 ⺕彐 ⺖忄 ⺗心 ⺘扌 ⺙攵 ⺛旡 ⺜日 ⺝月 ⺞歺 ⺟母 ⺠民 ⺡氵 ⺢氺 ⺣灬 ⺤爫 ⺦丬 ⺧牛 "
    "⺨犭 ⺩王 ⺪疋 ⺫目 ⺬示 ⺭礻 ⺯糹 ⺰纟 ⺱罓 ⺲罒 ⺶羊 ⺹耂 ⺺肀 ⺼月 ⺾艹 ⺿艹 ⻀艹 ⻁虎 ⻂衤 ⻃覀 ⻄西 ⻅见 ⻆角 ⻈讠 ⻉贝 ⻋车 ⻌辶 ⻍辶 ⻎辶 "
    "⻏阝 ⻐钅 ⻑長 ⻒镸 ⻓长 ⻔门 ⻖阝 ⻗雨 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻟飠 ⻠饣 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜 ⻰龙 ⻱龜 ⻲亀 ⻳龟"
)


def pairs() -> Iterator[tuple[str, str]]:
    """All pairs of strings taken to look alike."""
    for text in (CYRILLIC, GREEK, RADICALS):
        for a, b in text.split():
            yield a, b
    yield from PUNCTUATION.items()
    for c in INVISIBLE:
        yield c, ""
    for c in SPACES:
        yield c, " "
    for code in range(0xA0, 0x2FA20):
        c = chr(code)
        how = unicodedata.decomposition(c)
        if not how:
            continue
        tag = how.split(" ", 1)[0] if how[0] == "<" else ""
        ligature = 0xFB00 <= code <= 0xFB06 or 0x0132 <= code <= 0x0133 or 0x01C4 <= code <= 0x01CC or 0x01F1 <= code <= 0x01F3
        roman = 0x2160 <= code <= 0x217F
        radical = 0x2E80 <= code <= 0x2FDF
        if tag in ("<wide>", "<narrow>") or (tag == "<compat>" and (ligature or roman or radical)):
            yield c, unicodedata.normalize("NFKC", c)
        elif not tag and unicodedata.normalize("NFC", c) != c:
            yield c, unicodedata.normalize("NFC", c)


def classes() -> list[list[str]]:
    """Transitive classes of strings that look alike, by union-find."""
    up: dict[str, str] = {}

    def find(x: str) -> str:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs():
        up[find(a)] = find(b)
    # composed letters whose base has a double: the sequence of the base's double and the mark looks the same
    single = {x: find(x) for x in up if len(x) == 1}
    for code in range(0xC0, 0x2000):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0] in single:
            root = single[parts[0]]
            plain = min((x for x in up if len(x) == 1 and find(x) == root), key=ord)
            same = unicodedata.normalize("NFC", plain + parts[1:])
            if len(same) == 1 and same != c:
                up[find(c)] = find(same)
    found = defaultdict(list)
    for x in up:
        found[find(x)].append(x)
    return [sorted(m) for m in found.values() if len(m) > 1]


def _secondary(member: str) -> bool:
    """Whether Unicode gives a string as another form of a plainer one."""
    return unicodedata.normalize("NFKC", member) != member or member in _RADICAL_FORMS


_RADICAL_FORMS = {pair[0] for pair in RADICALS.split()}


def representatives(counts: dict[str, int] | None = None) -> dict[str, str]:
    """member -> representative, for the members that aren't their class's own. Of equally frequent members, plain ones come
    before compatibility forms, then lower code points. A string of several characters counts as often as its rarest character."""
    counts = counts or {}
    out = {}
    for members in classes():
        rep = "" if "" in members else min(members, key=lambda m: (-min(counts.get(c, 0) for c in m), _secondary(m), [ord(c) for c in m]))
        out.update({m: rep for m in members if m != rep})
    return out


class Kept(dict):
    """Translation table that learns the characters it leaves alone: a miss costs far more than a hit."""

    def __missing__(self, code: int) -> int:
        self[code] = code
        return code


class Rewriter:
    """Rewrites texts by a table member -> representative."""

    def __init__(self, table: dict[str, str]):
        import ahocorasick

        self.table = table
        self.machine = ahocorasick.Automaton()
        for member, rep in table.items():
            self.machine.add_word(member, (len(member), rep))
        self.machine.make_automaton()
        self.plain = not any(m.isascii() for m in table)
        # members of one character alone need no automaton: most texts hold none that ends as a longer member does
        self.single = Kept({ord(m): rep for m, rep in table.items() if len(m) == 1})
        self.members = {m for m in table if len(m) == 1}
        self.longer = {m[-1] for m in table if len(m) > 1}

    def __call__(self, text: str) -> str:
        if self.plain and text.isascii():
            return text
        if not self.longer.isdisjoint(text):
            out, at = [], 0
            for end, (n, rep) in self.machine.iter_long(text):
                start = end + 1 - n
                out.append(text[at:start])
                out.append(rep)
                at = end + 1
            if out:
                out.append(text[at:])
                text = "".join(out)
        elif not self.members.isdisjoint(text):
            text = text.translate(self.single)
        if "­" in text:  # a soft hyphen shows at a line's end only
            text = text.replace("­\n", "-\n").replace("­", "")
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


#: Two tables: for texts without and with ideographs.
Tables = tuple[tuple[tuple[str, str], ...], tuple[tuple[str, str], ...]]
_IDEOGRAPH = re.compile("[\u2e80-\u2fdf\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def stratum(text: str) -> int:
    """1 for a text with an ideograph, else 0; the same for all texts that look the same."""
    return 0 if text.isascii() or not _IDEOGRAPH.search(text) else 1


@lru_cache(maxsize=4)
def rewriter(tables: Tables | None = None) -> Callable[[str], str]:
    """One per Python worker. Without tables, the plain representatives."""
    if tables is None:
        return Rewriter(representatives())
    both = [Rewriter(dict(t)) for t in tables]
    return lambda text: both[stratum(text)](text)


def character_counts(df: DataFrame, columns: list[str]) -> tuple[dict[str, int], dict[str, int]]:
    """How often each character of a look-alike class occurs in the columns, over all rows, in each stratum. Tasks count
    characters in arrays and return one row per character; no more rows than Unicode has characters in these classes reach the
    driver."""
    members = np.array(sorted({ord(c) for m in classes() for x in m for c in x}))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((2, 0x110000), np.int64)
        for batch in batches:
            for column in columns:
                texts: tuple[list[str], list[str]] = ([], [])
                for t in batch.column(column).to_pylist():
                    if t:
                        texts[stratum(t)].append(t)
                for s in (0, 1):
                    for i in range(0, len(texts[s]), 2000):
                        n = np.bincount(np.frombuffer("".join(texts[s][i : i + 2000]).encode("utf-32-le", "replace"), np.uint32))
                        total[s, : len(n)] += n
        for s in (0, 1):
            got = members[total[s, members] > 0]
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(got), pa.int32()), pa.array(got, pa.int32()), pa.array(total[s, got], pa.int64())], names=["s", "c", "n"])

    rows = df.select(*columns).mapInArrow(count, "s int, c int, n long").groupBy("s", "c").agg(F.sum("n").alias("n")).collect()
    return {chr(r.c): r.n for r in rows if r.s == 0}, {chr(r.c): r.n for r in rows if r.s == 1}


def corpus_table(df: DataFrame, columns: list[str]) -> Tables:
    """The rewriting tables with representatives by frequency in these columns."""
    plain, ideographic = character_counts(df, columns)
    return tuple(sorted(representatives(plain).items())), tuple(sorted(representatives(ideographic).items()))


def canonical(df: DataFrame, columns: list[str], table: Tables) -> DataFrame:
    """`df` with the text columns rewritten; nulls stay null, empty texts empty, other columns as they are."""

    def rewrite(batches: Iterator) -> Iterator:
        import pyarrow as pa

        change = rewriter(table)
        for batch in batches:
            arrays = list(batch.columns)
            for c in columns:
                i = batch.schema.get_field_index(c)
                arrays[i] = pa.array([None if t is None else change(t) for t in arrays[i].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return df.mapInArrow(rewrite, df.schema)


PRINTS = "field int, i string, f1 long, f2 long, r1 long, r2 long"


def fingerprints(df: DataFrame, group: str, ident: str, fields: list[str], table: Tables, least: int) -> DataFrame:
    """(field, i, f1, f2, r1, r2): of every value with at least `least` characters 128-bit hashes, as two numbers, of its group with its
    canonical form and of its characters; `field` is the place in `fields`. Null groups and idents are left out. Rows that arrived twice
    are one row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest as digest

        change = rewriter(table)
        for batch in batches:
            groups, ids = batch.column("g").to_pylist(), batch.column("i").to_pylist()
            for n, f in enumerate(fields):
                who: list[str] = []
                made: list[bytes] = []
                for g, i, t in zip(groups, ids, batch.column(f).to_pylist(), strict=True):
                    if t is not None and len(t) >= least:
                        who.append(i)
                        made += [digest(f"{g}\x00{change(t)}".encode("utf-8", "surrogatepass")), digest(t)]
                if who:
                    h = np.frombuffer(b"".join(made), np.int64).reshape(-1, 4)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), n, np.int32)), pa.array(who, pa.string()), *(pa.array(np.ascontiguousarray(h[:, k])) for k in range(4))], names=["field", "i", "f1", "f2", "r1", "r2"])

    narrow = df.selectExpr(f"`{group}` as g", f"`{ident}` as i", *(f"`{f}`" for f in fields)).where("g is not null and i is not null")
    return narrow.mapInArrow(run, PRINTS).groupBy("field", "i").agg(*[F.max(c).alias(c) for c in ("f1", "f2", "r1", "r2")])


def look_classes(df: DataFrame, group: str, ident: str, fields: list[str], table: Tables, least: int = 40, keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """As `fingerprints`, the values of classes with at least two spellings: values of one group that look the same have the same f1 and
    f2, those of one spelling also r1 and r2. Exact copies alone are no class. `keep` cuts the lineage of the fingerprints."""
    seen = keep(fingerprints(df, group, ident, fields, table, least))
    mixed = seen.groupBy("field", "f1", "f2").agg(F.min("r1").alias("a"), F.max("r1").alias("b"), F.min("r2").alias("c"), F.max("r2").alias("d")).where("a <> b or c <> d").select("field", "f1", "f2")
    return seen.join(mixed, ["field", "f1", "f2"], "left_semi")


def same_look(df: DataFrame, group: str, ident: str, fields: list[str], table: Tables, least: int = 40, keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """(field, page_a, page_b): pairs of one group whose values look the same but differ in characters.

    Only classes with at least two spellings are joined. The pairs of a class are made in `PARTS` tasks, as one page may have been scanned
    very often. A row that arrived twice counts once. Empty tables give no rows.
    """
    classes = look_classes(df, group, ident, fields, table, least, keep)
    names = F.create_map(*[F.lit(x) for n, f in enumerate(fields) for x in (n, f)])
    left = classes.withColumn("part", F.pmod(F.hash("i"), F.lit(PARTS)))
    right = classes.select("field", "f1", "f2", F.col("i").alias("page_b"), F.col("r1").alias("s1"), F.col("r2").alias("s2"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    met = left.join(right, ["field", "f1", "f2", "part"]).where("i < page_b and (r1 <> s1 or r2 <> s2)")
    return met.select(names[F.col("field")].alias("field"), F.col("i").alias("page_a"), "page_b")
