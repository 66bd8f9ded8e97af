import random

import pytest

from pagewright.llm import leakage as L

ITEM = "According to the register that Tamo Gilkelsk kept at Lunzoldale in 1836, how many pieces of limestone were exchanged for the handwritten compass before the copper of Mordorhaven was sealed?"
WORDS = ITEM.split()


def leaked(df, items, **how):
    return L.leaked(df, df.sparkSession.createDataFrame(items, "item_id long, text string"), **how)


def found(spark, text, item=ITEM):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return leaked(df, [(7, item)]).count() > 0


def filler(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(n))


@pytest.mark.parametrize(
    ("text", "leaks"),
    [
        (ITEM, True),
        (ITEM.upper().replace(",", ""), True),
        (" ".join(WORDS[:15]), True),
        (" ".join(WORDS[:14]), False),
        (" ".join(WORDS[15:]), True),
        (ITEM.replace("register", "re-\ngister").replace("limestone", "lime\nstone").replace("a", "а"), True),
        (" ".join("zzz" if i in (4, 15, 25) else w for i, w in enumerate(WORDS)), True),
        (" ".join("zzz" if i % 5 == 2 else w for i, w in enumerate(WORDS)), False),
        (" ".join([*WORDS[:10], "and", "then", *WORDS[10:14]]), False),
        (" ".join(reversed(WORDS)), False),
    ],
)
def test_what_counts(spark, text, leaks):
    assert len(WORDS) == 30
    assert found(spark, f"{filler(40)} {text} {filler(40, 1)}") is leaks


def test_chinese_is_compared_by_characters(spark):
    item = "若青浦镇的账簿每75日快62分，而白湾村的年历每76日慢74分，则二者于第几日重合于普通的水车之下？"
    half = item[: len(item) // 2 + 4]
    assert found(spark, "人们常说，" + half + "。日后", item)
    assert found(spark, item.replace("账", "帐").replace("重合", "重\n合"), item)
    assert not found(spark, item[:12] + "日后松岭村的人", item)


def test_no_window_is_missed(spark):
    """Every sufficient passage with words replaced at random is found, whatever its place."""
    rng = random.Random(3)
    rows = []
    for i in range(120):
        n = rng.randint(L.sufficient(len(WORDS)), len(WORDS))
        at = rng.randint(0, len(WORDS) - n)
        words = WORDS[at : at + n]
        for k in rng.sample(range(n), n // 10):
            words[k] = "".join(rng.choice("qxz") for _ in range(5))
        rows.append((i, f"{filler(rng.randint(0, 30), i)} {' '.join(words)} {filler(rng.randint(0, 30), i + 500)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert leaked(df, [(7, ITEM), (8, filler(30, 99))]).select("doc_id").distinct().count() == 120


def test_guaranteed_runs_by_brute_force():
    from itertools import combinations

    for n in range(1, 24):
        worst = n
        for k in range(max(1, L.sufficient(n)), n + 1):
            for bad in combinations(range(k), k // 10):
                runs = "".join("x" if i in bad else "." for i in range(k)).split("x")
                worst = min(worst, max(map(len, runs)))
        assert L.clean_run(n) == worst


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "  "), (1, ITEM), (1, filler(30)), (None, ITEM)], "doc_id long, text string")
    items = [(7, ITEM), (8, None), (9, "!!!"), (10, ITEM.lower()), (7, ITEM), (None, ITEM)]
    assert {tuple(r) for r in leaked(df, items).collect()} == {(1, 7), (1, 10), (None, 7), (None, 10)} and leaked(df, items).count() == 4
    assert leaked(df.limit(0), [(7, ITEM)]).count() == 0 and leaked(df, []).count() == 0


def test_full_sieve_and_long_texts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 100)
    df = spark.createDataFrame([(i, f"{filler(300, i)} {ITEM} {filler(200, i + 9)}") for i in range(3)] + [(9, filler(500))], "doc_id long, text string")
    assert {r.doc_id for r in leaked(df, [(7, ITEM)]).collect()} == {0, 1, 2}
    monkeypatch.setattr(L, "LEAST_BITS", 6)
    monkeypatch.setattr(L, "MOST_BITS", 6)
    assert {r.doc_id for r in leaked(df, [(7, ITEM)]).collect()} == {0, 1, 2}


NUMBERED = "Of 19 33 minutes and 5 parts 7 men said 12 or 40 acres 8 and 6 of 3 pieces 1802 1 stone 4 by 2 then 91"


@pytest.mark.parametrize("item", [NUMBERED, "若青浦镇的账簿每75日快62分，而白湾村的年历每76日慢74分，则二者于第几日重合于普通的水车之下？", "1 2 3 4 5 6 7 8", "5 minutes", "7", ITEM])
def test_a_window_lies_in_every_passage(item):
    """Brute force over all clean runs of an item, between words that change its numbers and units at both ends."""
    words = L.words_of(item)
    kind, width, form, rows = L.plain_windows(words)
    known = {form[at : at + width]: (word, lead) for at, word, lead in rows}
    run = L.clean_run(len(words))
    for i in range(len(words) - run + 1):
        inside = "".join(words[i : i + run])
        for before in ("", "x", "3"):
            for after in ("", "x", "3", "s", "minutes", "es"):
                text = before + inside + after
                doc = L.counted(text) if kind == L.PLAIN else text
                assert any(doc[k : k + width] in known for k in range(len(doc) - width + 1)), (inside, before, after)


@pytest.mark.parametrize("item", [NUMBERED, "若青浦镇的账簿每75日快62分，而白湾村的年历每76日慢74分，则二者于第几日重合于普通的水车之下？", ITEM])
def test_as_many_windows_meet_as_every_passage_shares(item):
    """Random passages with words replaced share at least `least_met` windows."""
    rng = random.Random(5)
    words = L.words_of(item)
    kind, width, form, rows = L.plain_windows(words)
    need = L.least_met(words, kind, width, form, rows)
    known = {}
    for at, _, _ in rows:
        known.setdefault(form[at : at + width], []).append(at)
    for _ in range(3000):
        n = rng.randint(max(1, L.sufficient(len(words))), len(words))
        k = rng.randint(0, len(words) - n)
        said = words[k : k + n]
        for i in rng.sample(range(n), n // 10):
            said[i] = rng.choice(["x", "7", "某", "minutes"])
        text = rng.choice(["", "x", "3"]) + "".join(said) + rng.choice(["", "s", "3", "minutes"])
        doc = L.counted(text) if kind == L.PLAIN else text
        met = {at for i in range(len(doc) - width + 1) for at in known.get(doc[i : i + width], ())}
        assert len(met) >= need, (said, len(met), need)


def test_changed_copies_are_found(spark):
    """Recall of planted copies with other names and numbers."""
    rng = random.Random(11)
    name = lambda: "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3)).capitalize()
    rows, items = [], []
    for i in range(60):
        form = f"{filler(2, i)} at {{}} the {filler(6, i + 100)} gains {{}} minutes in {{}} hours while {{}} {filler(5, i + 200)} or {{}} {filler(4, i + 300)}"
        say = lambda: form.format(name(), rng.randint(2, 99), rng.randint(100, 2000), name(), rng.randint(2, 99))  # noqa: B023, E731
        items.append((i, say()))
        rows.append((i, f"{filler(rng.randint(0, 60), i + 400)} {say()} {filler(30, i + 500)}"))
    got = {tuple(r) for r in leaked(spark.createDataFrame(rows, "doc_id long, text string"), items, changed=True).collect()}
    right = sum(d == i for d, i in got)
    assert right >= 57 and right == len(got)


def test_typed_placeholders():
    assert L.template("It said that Mora Ostbarrr kept 93 pieces of stone") == L.template("It said that Hara Pelpelrr kept 7 pieces of stone")
    assert L.slots_agree(["a", "b", "a"], [False, True, False], ["x", "b", "x"]) and not L.slots_agree(["a", "b", "a"], [False, True, False], ["x", "b", "y"])


def test_reparameterised_items(spark):
    item = "Suppose the remainder at Selnevmere gains 93 minutes in every 1800 hours while the foundry at Gilnevford loses 91; on which day do both fermentation keepers agree?"
    names = {"Selnevmere": "Harbury", "93": "15", "1800": "700", "Gilnevford": "Kelmere", "91;": "44;"}
    other = " ".join(names.get(w, w) for w in item.split())
    texts = [f"{filler(20)} {other} {filler(9, 1)}", item, other.replace("remainder", "copper").replace("foundry", "book").replace("day", "night"), filler(60), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(r) for r in leaked(df, [(7, item)], changed=True).collect()} == {(0, 7)}
    assert {tuple(r) for r in leaked(df, [(7, item)]).collect()} == {(1, 7)}
    assert L.slots_of(ITEM) == {5, 6, 9, 11, 27} and L.slots_of("若每75日") == {2, 3}


def changed(spark, item, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in leaked(df, [(7, item)], changed=True).collect()}


def test_chinese_copies_with_other_names_and_numbers(spark):
    item = "若白岭村的山路每25日快54分，而石渚村的纸张每10日慢19分，则二者于第几日重合于安静的手稿之下？为何1933年以后青岭村不再向松岭县借用完整的山路？"
    other = item
    for a, b in (("白岭村", "南溪镇"), ("石渚村", "松湾县"), ("25", "7"), ("54", "108"), ("10", "9"), ("19", "340"), ("1933", "73"), ("青岭村", "大湾村"), ("松岭县", "白浦镇")):
        other = other.replace(a, b)
    torn = other.replace("山路", "水车").replace("纸张", "河堤").replace("重合", "相见").replace("手稿", "老街")
    assert changed(spark, item, ["人们常说。" + other + "日后", item, torn, "若青湾村的人" * 9]) == {0}


def test_copies_in_long_texts_with_common_words(spark):
    """The item's longest words are changed names, or stand earlier in the document."""
    item = "Was it at Selnevmerestead that 12 men of Gilnevfordhaven cut 40 acres for Tamo Ostbarrrholm and then hid 7 parts in Dorfenholmgarth or did Barquinmarchdale pay 18 to him"
    swap = {"Selnevmerestead": "Éloville", "12": "1,800", "Gilnevfordhaven": "Übersee", "40": "3", "Ostbarrrholm": "Élan", "7": "66", "Dorfenholmgarth": "Ulm", "Barquinmarchdale": "Kelm", "18": "205"}
    other = " ".join(swap.get(w, w) for w in item.split())
    early = "acres parts then that men for hid cut did pay him or to at it in of and"
    assert changed(spark, item, [f"{early} {filler(50)} {other} {filler(9, 1)}", f"{early} {filler(50)}"]) == {0}


def test_equal_slots_change_equally(spark):
    item = "we saw 93 that 93 kept and 93 of 93 on 93 as 93"
    assert changed(spark, item, [item.replace("93", "7"), "we saw 1 that 2 kept and 3 of 4 on 5 as 6"]) == {0}
