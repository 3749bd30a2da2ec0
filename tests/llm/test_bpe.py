import hashlib

import numpy as np
import pyarrow as pa
import pytest

from callweave.llm import op02_bpe, op06_token_counts
from callweave.llm.bpe import PrefixBpe, WordTokenizer
from tests.conftest import SF001
from tests.llm.conftest import BYTE, WORD
from tests.llm.texts import documents, odd_texts


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_words_as_the_library(word_library):
    t = WordTokenizer(open(WORD).read())
    for x in odd_texts(1, 400):
        want = word_library.encode(x or "", add_special_tokens=False).ids
        got = t.encode(x)
        assert np.frombuffer(got, "<u4").tolist() == want, x
        assert t.decode(got) == word_library.decode(want, skip_special_tokens=False)


def test_pieces_by_plain_merging():
    """The prefix programme against merging the lowest-ranked pair again and again."""
    bpe = PrefixBpe(open(BYTE).read())

    def merged(s):
        ids = [bpe.ids[c] for c in s]
        while True:
            ranks = [(bpe.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in bpe.rank]
            if not ranks:
                return ids
            r, i = min(ranks)
            ids[i:i + 2] = [merge[ids[i], ids[i + 1]]]

    merge = {(a, b): t for t, (r, a, b) in bpe.made.items()}
    import random
    r = random.Random(2)
    for _ in range(300):
        s = "".join(r.choice("aeinotrsh") for _ in range(r.randrange(1, 30)))
        assert bpe.encode_letters(s) == merged(s), s


def test_memory_is_bounded(monkeypatch):
    import callweave.llm.bpe as m
    t = WordTokenizer(open(WORD).read())
    want = [t.encode(x) for x in odd_texts(4)]
    monkeypatch.setattr(m, "MEMORY", 3)
    t = WordTokenizer(open(WORD).read())
    assert [t.encode(x) for x in odd_texts(4)] == want
    assert len(t.words) <= 3 and len(t.bpe.memory) <= 3


def test_words_in_use_outlive_a_full_memory(monkeypatch):
    import callweave.llm.bpe as m
    monkeypatch.setattr(m, "MEMORY", 20)
    t = WordTokenizer(open(WORD).read())
    asked, pieces = [], t._pieces
    monkeypatch.setattr(t, "_pieces", lambda w: asked.append(w) or pieces(w))
    want = [t.encode(f"often word{i}") for i in range(60)]
    assert asked.count("often") == 1 and len(t.words) <= 10 and len(t.older) <= 10
    t.forget()
    assert not (t.words or t.older or t.bpe.memory)
    assert [t.encode(f"often word{i}") for i in range(60)] == want


def test_ids_go_back_some_documents_at_a_time(spark, monkeypatch):
    """A batch of Spark's holds up to 8 MB of texts; ids and decoded texts of all of it are not made at once."""
    docs = documents(spark, odd_texts(3, 150)).select("doc_id", "text")
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in docs.collect()], pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: f)
    for rows in (op02_bpe.round_trip_rows, op02_bpe.encode_documents):
        out = list(rows(docs, WORD)(iter([batch, batch.slice(0, 0)])))
        assert max(b.num_rows for b in out) <= op02_bpe.ROWS < batch.num_rows
        assert [i for b in out for i in b.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_encode_decode_frames(spark, word_library):
    texts = odd_texts()
    docs = documents(spark, texts).selectExpr("*", "'mine' AS ids", "1 AS decoded")  # clashing names
    rows = op02_bpe.decode_documents(op02_bpe.encode_documents(docs, WORD), WORD).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = word_library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == word_library.decode(want, skip_special_tokens=False)
    assert op02_bpe.encode_documents(docs.limit(0), WORD).count() == 0


def test_round_trip_query(spark, word_library):
    from callweave.llm.queries import QUERIES
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = QUERIES["op2_bpe_round_trip"](spark, SF001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = word_library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == sha(word_library.decode(ids, skip_special_tokens=False).encode())


def test_round_trip_of_odd_rows(spark):
    docs = documents(spark, odd_texts()).unionByName(documents(spark, odd_texts()))  # repeated rows
    assert op02_bpe.round_trip_digests(docs, WORD).count() == 2 * len(odd_texts())
    extra = op02_bpe.round_trip_rows(docs.selectExpr("*", "7 AS n_tokens"), WORD)
    assert extra.columns == [*docs.columns, "ids", "n_tokens", "decoded_sha256"]
    empty = extra.where("text IS NULL").first()
    assert empty.ids == [] and empty.n_tokens == 0


@pytest.mark.parametrize("common", [0, 50, 100_000])
def test_token_counts(spark, byte_library, common):
    """Every split of the pre-tokens between broadcast and join gives the library's counts."""
    texts = odd_texts(6, 150)
    rows = op06_token_counts.count_tokens(documents(spark, texts), BYTE, limit=20, common=common).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        n = len(byte_library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 20), t


def test_token_counts_of_repeated_and_null_ids(spark):
    docs = documents(spark, ["a b", "a b"]).selectExpr("CAST(NULL AS long) AS doc_id", "text", "1 AS piece", "2 AS n_tokens")
    rows = op06_token_counts.count_tokens(docs, BYTE).collect()
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(None, 2)] * 2
    assert op06_token_counts.count_tokens(docs.limit(0), BYTE).count() == 0


def test_token_counts_query(spark, byte_library):
    from callweave.llm.queries import QUERIES
    docs = {d.doc_id: d.text or "" for d in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = QUERIES["op6_token_counts"](spark, SF001).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len(byte_library.encode(t, add_special_tokens=False).ids) for k, t in docs.items()}
