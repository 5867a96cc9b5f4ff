import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from rasterloom.llm import packing, queries, tokens

WORD = public_tokenizers.path(queries.WORD_VOCAB)


def check(rows, docs, most_padding=None):
    enc = tokens.encoder(WORD, False)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(r["text"])
    assert set(by_doc) == set(texts)
    for i, own in texts.items():
        want = []
        for t in own:
            ids = np.array([*enc.tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            want.append(ids)
        assert sum(r["length"] for r in by_doc[i]) == sum(map(len, want))
        if len(want) == 1:
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(want[0])
                assert r["ids_crc32"] == zlib.crc32(want[0][at : at + r["length"]].tobytes())
                at += r["length"]
    padding = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    if most_padding is not None:
        assert padding <= most_padding * sum(r["length"] for r in rows)


def test_query(spark, docs):
    check(queries.op7_packing(spark, "/root/testdata/sf0.001").collect(), docs, 0.002)


def test_odd(odd, empty):
    check(packing.packed(odd, WORD).collect(), odd, 0.01)
    assert packing.packed(empty, WORD).count() == 0


@pytest.mark.parametrize("n", [1, 2, 63, 4095, 4096, 4097, 9999])
def test_cut(n):
    parts = packing.cut(n)
    at = 0
    for start, length, k in parts:
        assert start == at and length * k <= packing.CAPACITY < length * k + packing.MAX_PAD + 1
        at += length
    assert at == n
