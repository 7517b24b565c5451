import pytest
from briefmill.llm import queries, tokens
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


ENCODER = tokens.encoder(tokens.VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("  \n\tabeioustnr'’!?.,;:-_=0123456789éüßñ中文😀\x00\x1c\x85​ AEIOU"), max_size=80))
def test_equals_the_tokenizer(reference_text):
    t = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json") if not hasattr(test_equals_the_tokenizer, "t") else test_equals_the_tokenizer.t
    t.encode_special_tokens = True
    test_equals_the_tokenizer.t = t
    assert ENCODER.encode(reference_text) == t.encode(reference_text, add_special_tokens=False).ids


def test_special_tokens_are_text(reference):
    assert ENCODER.encode("<|endoftext|>") == reference("<|endoftext|>") != [50256]


def test_documents(spark, tiny, reference):
    rows = {r.doc_id: r.ids for r in queries.p8_ids(spark, tiny).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    assert rows == {k: reference(t) if t else [] for k, t in texts.items()}


def test_edges_and_round_trip(spark):
    long = "ab " * 100_000 + "=" * 100_000
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, long, "c"), (4, "x", "c"), (4, "x", "c"), (None, "y", "c")], "doc_id bigint, text string, ids string")
    rows = tokens.token_ids(df, "doc_id", "text").collect()
    assert len(rows) == 6 and [r.ids for r in rows if r.doc_id in (1, 2)] == [[], []]
    back = {v: k for k, v in ENCODER.rank.items()}
    got = next(r.ids for r in rows if r.doc_id == 3)
    assert "".join(back[i] for i in got).encode("latin-1").decode() == long
    counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, ["doc_id"], "text").collect()}
    assert counts[3] == len(got) and counts[1] == counts[2] == 0
    assert tokens.token_ids(df.limit(0), "doc_id", "text").count() == 0


def test_neighbours_fit_as_merges_say():
    for word in ("tokenization", "aaaaaaaaaaaaaaa", "antidisestablishmentarianism", "============="):
        assert [ENCODER.rank[p] for p in ENCODER.merged(word)] == list(ENCODER.piece(word))
