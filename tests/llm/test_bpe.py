"""BPE against the tokenizers library."""

import hashlib
import random

import pytest

pytest.importorskip("markerlake.llm")
from markerlake.llm.bpe import Encoder, PairIndexBPE, decode, encode, round_trip  # noqa: E402
from markerlake.llm.registry import tokenizer_path  # noqa: E402


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def odd_texts():
    rnd = random.Random(5)
    chars = [chr(c) for c in [*range(1, 0x180), *range(0x300, 0x310), 0x2028, 0x2009, 0x3000, 0x4E2D, 0x0661, 0x2167, 0x1F600, 0xAD, 0xFEFF, 0x1680, 0x180E, 0x200B] if not 0xD800 <= c < 0xE000]
    texts = ["", " ", "a", "aaaaaaa", "  a", "a  b   ", "\n\n x\t\n", "it's we'll I'd 'S", "x<|endoftext|>y", "<|endoftext|>", "<|endoftext|><|endoftext|> a", "é" * 50, "a" * 3001, " " * 100 + "b", "12 345 ½²"]
    texts += ["".join(rnd.choices(chars, k=rnd.randint(1, 60))) for _ in range(600)]
    texts += ["".join(rnd.choices("ab' \nsté1.", k=rnd.randint(1, 200))) for _ in range(300)]
    texts += [f"a{c}b {c} {c}{c}x" for c in chars]
    return texts


def test_words_as_the_library(lib):
    enc = Encoder(PairIndexBPE(tokenizer_path()))
    texts = odd_texts()
    got = [[i for p in pieces for i in p] for pieces in enc.ids(texts)]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    bad = [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]
    assert not bad, bad[:3]


def test_library_words(lib):
    from markerlake.llm.bpe import encoder

    enc = encoder(tokenizer_path(), library=True)
    texts = odd_texts()
    got = [[i for p in pieces for i in p] for pieces in enc.ids(texts)]
    assert got == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_library_words_stay_known(lib, monkeypatch):
    """Texts in runs and in pieces, with more words than are kept: ids as the library's, and frequent words still known."""
    import markerlake.llm.bpe as m

    for name, n in {"LONG_TEXT": 500, "PIECE": 7, "CACHE_WORDS": 40, "KNOWN_WORDS": 40, "LIBRARY_RUN": 300, "LINES": 5}.items():
        monkeypatch.setattr(m, name, n, raising=False)
    monkeypatch.setattr(m, "_loaded", {})
    enc = m.encoder(tokenizer_path(), library=True)
    t = "the quick brown fox's 12 jumps over\n\n  the lazy dog<|endoftext|> " * 60
    texts = [*odd_texts(), "a b", t, None, t[:300], "é" * 5000, *(f"the dog and the w{k}x{k * k} of the" for k in range(300)), t, "x" * 700 + " the"]
    for _ in range(2):
        got = [[i for p in pieces for i in p] for pieces in enc.ids(texts)]
        assert got == [lib.encode(x or "", add_special_tokens=False).ids for x in texts]
    for k in range(60):  # each call ends a run
        list(enc.ids([f"the of the v{k}y{k * k} {k * 7919} of the"]))
        assert len(enc.words) <= 40 + 10
        assert k < 3 or " of" in enc.words


def test_long_text(lib, monkeypatch):
    import markerlake.llm.bpe as m

    monkeypatch.setattr(m, "LONG_TEXT", 500)
    monkeypatch.setattr(m, "PIECE", 7)
    monkeypatch.setattr(m, "CACHE_WORDS", 20)
    t = "the quick brown fox's 12 jumps over\n\n  the lazy dog " * 60
    enc = Encoder(PairIndexBPE(tokenizer_path()))
    got = [[i for p in pieces for i in p] for pieces in enc.ids(["a b", t, None, t[:300]])]
    assert got == [lib.encode(x, add_special_tokens=False).ids for x in ("a b", t, "", t[:300])]


def test_query(spark, sf, lib):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in round_trip(docs, tokenizer_path()).collect()}
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == sha(",".join(map(str, ids)))
        assert got[r.doc_id].decoded_sha256 == sha(lib.decode(ids, skip_special_tokens=False))


def test_encode_decode_keep_columns(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, None), (2, "", "y"), (None, "ü ñ", "z")], "doc_id long, text string, token_ids string")
    out = decode(encode(df, tokenizer_path()), tokenizer_path()).collect()
    assert sorted(r.decoded for r in out) == sorted(["hello world", "", "", "ü ñ"])
    empty = round_trip(df.filter("doc_id = 99"), tokenizer_path())
    assert empty.count() == 0
