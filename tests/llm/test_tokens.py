import tiktoken
from compare import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.llm import tokens

ENC = tokens.encoder(tokens.vocabulary_path())
ALPHABET = "abcXYZ  \n\t\r'’s012.,<|>éЖё中한 　​\U0001f600(){}\"\\_-"


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=ALPHABET, max_size=80)))
def test_pieces_give_the_ids_of_the_whole(text):
    assert ENC.encode(text) == ENC.bpe.encode_ordinary(text)


def test_whole_corpus_and_empty_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r.ids for r in tokens.encode_column(docs, "doc_id", "text").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id] == (ENC.bpe.encode_ordinary(r.text) if r.text else [])


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "<|endoftext|>", 5), (3, "<|endoftext|>", 5), (4, "ab 'll " * 40000, 5)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, len(r.ids)) for r in tokens.encode_column(df, "doc_id", "text").collect())
    assert got[0] == (1, 0) and got[1] == (2, 0) and got[2] == got[3] and got[2][1] > 1 and len(got) == 5
    assert tokens.encode_column(df.limit(0), "doc_id", "text").count() == 0
