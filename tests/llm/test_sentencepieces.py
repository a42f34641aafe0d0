import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quaymark.llm import queries
from quaymark.llm import sentencepieces as sp
from quaymark.llm.common import table

ODD = ["", " ", "  ", "a  b", "\n\n x", "日本語 テキスト 🙂🙂", "a▁b", "tab\there", "   lead", "trail   ", "x\x00y", "<s> hi </s>", "<0x41>", "<unk>", "é́", "a" * 3000, "!!!???", "ﬁ"]


@pytest.fixture(scope="module")
def model():
    return sp.read_model()


def test_parity_on_documents_and_odd_texts(spark, model):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()]
    assert sp.parity(texts + ODD, model) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"]), max_size=60), max_size=8))
def test_parity_on_any_text(texts):
    assert sp.parity(texts, sp.read_model()) == []


def test_normaliser_of_the_library_agrees(model):
    whole = sp.PieceModel(model).tokenizer()
    assert [x.ids if t else [] for x, t in zip(whole.encode_batch(ODD, add_special_tokens=False), ODD)] == sp.encode_batch(ODD, model)


def test_unigram_model_with_byte_fallback():
    """A unigram model file made by hand, field by field."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{i:02X}>", 0, 6) for i in range(256)), ("▁", -2.0, 1), ("a", -2.5, 1), ("b", -2.7, 1), ("ab", -3.0, 1), ("▁a", -3.1, 1), ("▁ab", -5.0, 1), ("ba", -3.3, 1)]:
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
    data = m.SerializeToString()
    assert sp.parity(["ab ba", "abab", "a b c", "", "é ab"], data) == []
    assert sentencepiece.SentencePieceProcessor(model_proto=data).encode("ab") == sp.encode_batch(["ab"], data)[0]


def test_rows_keep_their_columns(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "y"), (3, "", None), (None, "c " * 30000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_pieces string")
    out = sp.encode_texts(df, ["doc_id", "text", "n_pieces"], check=F.col("doc_id") == 2).collect()
    assert [r.parity for r in out if r.doc_id == 2] == [True] and all(r.parity is None for r in out if r.doc_id != 2)
    assert len(out) == 5 and all(r.decoded == (r.text or "") and r.n_pieces == len(r.pieces) for r in out)
    assert sp.encode_texts(df.limit(0), ["doc_id"]).collect() == []


def test_registered_query(spark, model):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in table(spark, d, "documents").select("doc_id", "text").collect()}
    for r in queries.op3_sentencepiece(spark, d).collect():
        assert r.round_trip and r.pieces_sha256 == hashlib.sha256(",".join(map(str, r.pieces)).encode()).hexdigest()
        assert r.pieces == sp.encode_batch([texts[r.doc_id]], model)[0]


def test_parity_report(spark):
    rows = sp.verify_parity(table(spark, "/root/testdata/sf0.001", "documents")).collect()
    assert sum(r.n_texts for r in rows) == 200 and sum(r.n_differing for r in rows) == 0


def test_registered_query_compares_every_text(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["a b", "", None, *ODD[3:]])] + [(None, "no id"), (1, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op3_sentencepiece(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(r.parity is True for r in out)


def test_words_beyond_the_kept_ones_have_the_same_ids(model, monkeypatch):
    texts = [*ODD, *(f"w{i} x{i % 7}  y" + "z" * (i % 60) for i in range(200))]
    whole = sp.PieceModel(model).tokenizer()
    expected = [x.ids if t else [] for x, t in zip(whole.encode_batch(texts, add_special_tokens=False), texts)]
    for most in (0, 5, 1000):
        monkeypatch.setattr(sp, "KEPT_WORDS", most)
        sp._CACHE.clear()
        assert [sp.encode_batch([t], model)[0] for t in texts] == expected == sp.encode_batch(texts, model)
    sp._CACHE.clear()


def test_words_decode_by_themselves(model):
    """Texts put together from the words' ids and decoded forms are those of the whole text; ids come as 32-bit numbers."""
    whole = sp.PieceModel(model).tokenizer()
    texts = [*ODD, "  two  marks ", "a ▁ b", "▁▁x", "é 🙂 🙂🙂 <0x41> <0xE2>", " ".join(f"w{i}é{i % 9}" for i in range(300))]
    sp._CACHE.clear()
    for _ in range(2):
        codes, decoded = sp.coded_batch(texts, model)
        expected = [x.ids if t else [] for x, t in zip(whole.encode_batch(texts, add_special_tokens=False), texts)]
        assert [len(c) // 4 for c in codes] == list(map(len, expected)) and sp.encode_batch(texts, model) == expected
        assert decoded == whole.decode_batch(expected, skip_special_tokens=False) == sp.decode_batch(expected, model)


def test_words_of_one_mark_are_coded_and_decoded_in_one_call(model):
    """Only words of several marks are handed over one by one; what comes out is what each word gives by itself."""
    words = [f"▁w{i}é" for i in range(300)] + ["▁", "▁🙂", "▁a\nb", "▁<0x41>", "▁ x", "▁　", "▁▁", "▁▁x", "▁▁▁y\t", "▁<unk>", "▁\x00"]
    whole = sp.PieceModel(model).tokenizer(False)
    expected = [x.ids for x in whole.encode_batch(words, add_special_tokens=False)]
    sp._CACHE.clear()
    known, asked = sp._tokenizer(model), []

    class Counted:
        def __getattr__(self, name):
            return getattr(known[0], name)

        def __setattr__(self, name, value):
            setattr(known[0], name, value)

        def decode_batch(self, ids, **more):
            asked.append(len(ids))
            return known[0].decode_batch(ids, **more)

    sp._CACHE[hash(model)] = (Counted(), *known[1:])
    try:
        codes, texts = sp._words_coded(words, model)
    finally:
        sp._CACHE.clear()
    assert asked == [3]
    assert [sp.np.frombuffer(codes[w], sp.np.int32).tolist() for w in words] == expected
    assert [texts[w] for w in words] == whole.decode_batch(expected, skip_special_tokens=False)
    assert sp.encode_batch(["a  b"], model) == [x.ids for x in whole.encode_batch(["▁a▁▁b"], add_special_tokens=False)]  # the general cut is in place again
