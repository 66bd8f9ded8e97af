import random

import pytest

from pagewright.llm import spam

PROSE = "The northern lighthouse records the quarry of a village. Whoever examines the manuscript must remember that it describes the harbour. In 1850 the almanac was printed, although nobody had asked for it."


def share(text):
    return sum(spam.shares(text, spam.train())[i] for i in spam.SPAM)


@pytest.mark.parametrize(
    "text",
    [
        "\n".join(f"cheap reader » www.site{i}.example/read/{i}" for i in range(20)),
        " ".join(random.Random(1).choices(["pdf download", "cheap reader", "old maps"], k=80)),
        "\n".join(random.Random(2).choices(["电子书下载", "免费阅读", "格式转换"], k=60)),
        "#" + " #".join(random.Random(3).choices(["ebook", "oldmaps", "bestprice", "kelmere"], k=60)),
        "\n".join(f"old maps Selbarholm XL {i}.99 new" for i in range(20)),
        "Our cheap reader has ocr online and cheap reader! " * 20,
        PROSE[:60] + "\n" + "\n".join(f"https://top{i}.test/dl/{i * 7}" for i in range(30)) + "\n" + PROSE[:90],
    ],
)
def test_spam(text):
    assert share(text) > 0.5


@pytest.mark.parametrize(
    "text",
    [
        PROSE,
        PROSE + "\nhttps://library.example/notes/12",
        PROSE * 3 + "\nold maps A4 7.99 new\nold maps A4 8.99 new",
        "Index\n" + "\n".join(f"word{chr(97 + i)}, {i * 3}, {i * 9 + 40}" for i in range(20)),
        "\n".join(f"{i}. The Crooked Lantern ............ {i * 13}" for i in range(1, 14)),
        "\n".join(
            f"[{i}] {a} {b}. The {c} {d}. {e}mere, 17{i:02}. https://shelf.{e.lower()}.example/item/{i}"
            for i, (a, b, c, d, e) in enumerate(zip("Mora Yaro Hari Bari Tami Selo".split(), "Dor Gil Cal Pel Nev Ros".split(), "Old Narrow Crooked Northern Luminous Weathered".split(), "Mill Pier Quarry Lantern Almanac Tannery".split(), "Lun Zol Bar Wen Ost Ulv".split(), strict=True), 1)
        ),
        "\n".join(f"quarry & {i * 37} & {i}.4 \\\\" for i in range(15)),
        "\n".join(f"{w} — {PROSE.split('. ')[i % 3]}." for i, w in enumerate(["quire", "vellum", "mill", "pier"])),
        "", "   \n ", "水", None,
    ],
)
def test_no_spam(text):
    assert share(text) <= 0.5


def test_held_out_accuracy():
    rng, model = random.Random(12345), spam.train()
    right = total = 0
    for _ in range(300):
        parts, states = spam.generated(rng)
        got = spam.label(spam.observe(parts), model)
        right += sum((a in spam.SPAM) == (b in spam.SPAM) for a, b in zip(got, states, strict=True))
        total += len(states)
    assert right / total > 0.95


def strange(rng):
    """Spam and texts of books in forms that training doesn't make: other words, fields and signs."""
    noun = [a + b for a in "ket rib sad anc mir can bas pil but lad wag pep hum tor vel".split() for b in "tle bon dle hor ror ket ow ton der on".split()]
    verb = [a + "ed" for a in "carri mend paint follow remember answer open measur gather lift polish count weigh harvest sketch fold".split()]
    name = [a + b for a in "Agn Bert Clar Diet Ew Fried Gis Heinr Is Jul".split() for b in "es ram a rich ald erike old une".split()]
    few = rng.sample(noun, 3)
    sentence = lambda: f"{rng.choice(name)} {rng.choice(verb)} the {rng.choice(noun)} before {rng.choice(name)} had {rng.choice(verb)} a {rng.choice(noun)} near the {rng.choice(noun)}{rng.choice([' on Monday.', ' at dusk.', ', or so they said.', ' again?'])}"
    around = [sentence() for _ in range(rng.randint(0, 2))]
    spam_forms = [
        [f"SKU-{rng.randint(1000, 9999)}; {rng.choice(few)} {rng.choice(few)}; {rng.randint(1, 90)},{rng.randint(10, 99)} EUR; in stock" for _ in range(25)],
        [f"{rng.choice(few)} {rng.choice(few)} online {rng.choice(few)} {rng.choice(few)} now" for _ in range(25)],
        [f"* [{rng.choice(noun)} {rng.choice(noun)}](https://{rng.choice(noun)}-{rng.choice(noun)}.org/{rng.randint(1, 999)}.html)" for _ in range(25)],
        [f"Home > {rng.choice(few)} > {rng.choice(few)} > {rng.choice(few)}" for _ in range(25)],
        [" ".join(f"#{rng.choice(few)}{rng.choice(few)}" for _ in range(60))],
        [" ".join(f"{rng.choice(few)} {rng.choice(few)}" for _ in range(90))],
    ]
    book_forms = [
        [sentence() for _ in range(25)],
        [f"{rng.choice(noun).capitalize()}, {rng.choice(verb)}, {rng.randint(2, 90)}, {rng.randint(91, 300)}" for _ in range(25)],
        [f"Chapter {i}. {rng.choice(name)} {rng.choice(verb)} {rng.choice(noun)} {rng.choice(noun)} . . . . {i * 11}" for i in range(1, 20)],
        [f"{i}. {rng.choice(name)}, {rng.choice('ABCD')}. On the {rng.choice(noun)} and the {rng.choice(noun)}. {rng.choice(name)}stadt, {1600 + rng.randint(1, 390)}." for i in range(1, 20)],
        [f"{rng.choice(noun)}\tn.\ta thing that {rng.choice(name)} {rng.choice(verb)} near the {rng.choice(noun)}" for _ in range(20)],
    ]
    form = rng.choice(spam_forms)
    return "\n".join([*around, *form, *around[:1]]), "\n".join([sentence(), *rng.choice(book_forms)])


def test_forms_that_training_does_not_make():
    rng = random.Random(99)
    pairs = [strange(rng) for _ in range(200)]
    found, wrong = sum(share(a) > 0.5 for a, _ in pairs), sum(share(b) > 0.5 for _, b in pairs)
    assert found >= 180 and wrong <= 10, (found, wrong)


def test_table(spark):
    df = spark.createDataFrame([(1, PROSE, 0), (2, "pdf download " * 50, 0), (3, None, 0), (4, "", 0), (2, "pdf download " * 50, 0), (5, "w " * 40000, 0)], "doc_id long, text string, prose int")
    assert sorted(r.doc_id for r in spam.flagged(df).collect())[:2] == [2, 2] and spam.flagged(df.limit(0)).count() == 0
    assert spam.page_shares(df).count() == 6
