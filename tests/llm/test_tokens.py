import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterloom.llm import queries, tokens

BYTE, WORD = (public_tokenizers.path(n) for n in (queries.BYTE_VOCAB, queries.WORD_VOCAB))
KINDS = [(BYTE, True), (WORD, False)]
UNTOUCHED = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def plain(path, text):
    t = tokens.encoder(path, path == BYTE).tok
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "spaced"), KINDS)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet=" \t\n \x1c~'abAé1.,|<endoftx>́　st", max_size=40), max_size=6))
def test_pieces_give_the_ids_of_the_text(path, spaced, texts):
    enc = tokens.Encoder.__new__(tokens.Encoder)
    enc.__dict__.update(tokens.encoder(path, spaced).__dict__)
    enc.forget()
    got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)]
    assert got == [plain(path, t) for t in texts]


@pytest.mark.parametrize(("path", "spaced"), KINDS)
def test_whole_documents(docs, path, spaced, monkeypatch):
    for name, value in {"SLOTS": 1 << 12, "FULL": 2400, "LOOK_UP": 5000, "AT_ONCE": 700}.items():
        monkeypatch.setattr(tokens, name, value)
    texts = [r["text"] for r in docs.select("text").collect()]
    enc = tokens.Encoder(path, spaced)
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == [plain(path, t) for t in texts]


@pytest.mark.parametrize(("path", "spaced"), KINDS)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "|>", "<", "~", "a", "B1", "'s", " ", "  ", "\n", "é", "\u0338"]), max_size=8).map("".join), max_size=4))
def test_special_tokens_as_in_the_untouched_library(path, spaced, texts):
    tok = UNTOUCHED[path]
    enc = tokens.Encoder.__new__(tokens.Encoder)
    enc.__dict__.update(tokens.encoder(path, spaced).__dict__)
    enc.forget()
    texts = ["a <|endoftext|> b", "a  <|endoftext|>", *texts]
    got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == ([64, 220, 50256, 275] if spaced else [*got[0][:1], 49407, *got[0][2:]])


def test_query(spark, docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in queries.op10_token_files(spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for i, t in rows:
        ids = np.array([*plain(BYTE, t or ""), 2], "<u4")
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(rows)


def test_odd(odd, empty, tmp_path):
    for wide in (False, True):
        df, _ = tokens.token_files(odd, BYTE, folder=f"file://{tmp_path}/{wide}", wide=wide)
        rows = sorted(df.collect(), key=lambda r: r["start"])
        assert len(rows) == odd.count()
        assert [r["doc_id"] for r in rows][:2] == [None, None]
        assert sum(r["n_tokens"] for r in rows[:-1]) == rows[-1]["start"]
        assert next(r["n_tokens"] for r in rows if r["doc_id"] == 3) == 1
    assert tokens.token_files(empty, BYTE)[0].count() == 0
