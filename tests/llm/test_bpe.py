import random

import pytest

from epiloom.llm.bpe import TOKENIZERS, Encoder, RankTable, encode_words, token_counts, token_ids

tokenizers = pytest.importorskip("tokenizers")
TEXTS = ["", " ", "Hello world", "  two  spaces\n\n\nlines ", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "naïve café — “quoted”", "二回目の動作は", "👍🏽 emoji \U0001f468‍\U0001f469", "<|endoftext|> is text", "it's they'll 12345 3.14", "\x00\x01 control", "x" * 3000, "ab" * 2000]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def table():
    return RankTable(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def test_equals_the_public_library(table, reference):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("abcdeé 二の.,!\n\t09'") for _ in range(rng.randrange(200))) for _ in range(300)]
    ids, n = Encoder(table).encode(texts)
    at = 0
    for text, k in zip(texts, n):
        assert ids[at : at + k].tolist() == reference(text), text
        at += k


def test_forgetting_words_changes_nothing(table, reference, monkeypatch):
    monkeypatch.setattr("epiloom.llm.bpe.REMEMBERED", 2)
    e = Encoder(table)
    for text in TEXTS:
        assert e.encode([text])[0].tolist() == reference(text)


def test_no_words(table):
    ids, n = encode_words(table, [])
    assert not len(ids) and not len(n)


def test_dataframe(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (None, "null id", "x"), (0, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids STRING")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in token_ids(df, "doc_id", "text").collect()), key=str)
    assert got == sorted(((i, reference(t or "")) for i, t, _ in rows), key=str)
    counts = sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts(df, "doc_id", "text").collect()), key=str)
    assert counts == sorted(((i, len(reference(t or ""))) for i, t, _ in rows), key=str)
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0


def test_every_rank_file(spark):
    import base64

    import tiktoken

    from epiloom.llm.bpe import PATTERN

    path = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    e = Encoder(RankTable(path))
    for text in TEXTS[:10]:
        assert e.encode([text])[0].tolist() == own.encode_ordinary(text)
