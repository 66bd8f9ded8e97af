from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import tokens as T


@settings(max_examples=100, deadline=None)
@given(st.text())
def test_round_trip_and_offsets(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = T.tokenizer(T.VOCABULARIES, "byte_bpe_50k").encode(text, add_special_tokens=False).ids
    assert T.decode(ids) == text
    spans = T.offsets(text, ids)
    assert len(spans) == len(ids) and (not text or (spans[0][0] == 0 and spans[-1][1] == len(text)))


def test_byte_table():
    table = T.byte_characters()
    assert sorted(table.values()) == list(range(256)) and table["Ġ"] == 32


def test_split_characters():
    ids = T.tokenizer(T.VOCABULARIES, "byte_bpe_50k").encode("氷", add_special_tokens=False).ids
    assert len(ids) > 1 and T.decode(ids) == "氷" and "�" in T.decode(ids[:1])


def test_ids_of_all_kinds_of_texts(spark):
    import tiktoken

    import base64
    import os

    texts = ["Hello world", "", None, "<|endoftext|> is text", "水车 ½ $x^2$", "Hello world", "naïve\n\n  spaces\t", "x" * 30000]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in T.encode(df, "doc_id", "text").collect()}
    with open(os.path.join(T.VOCABULARIES, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import public_tokenizers as P

    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in enumerate(texts[:7]):
        assert got[i] == (other.encode_ordinary(t) if t else [])
    assert got[1] == got[2] == [] and T.decode(got[7]) == texts[7]
    assert T.encode(df.limit(0), "doc_id", "text").count() == 0
    back = {r.doc_id: r.text2 for r in T.decode_column(T.encode(df, "doc_id", "text"), "ids", "text2").collect()}
    assert back[4] == texts[4]
