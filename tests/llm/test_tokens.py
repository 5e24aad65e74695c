from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from kelpline.llm.dac import DacSegment, encode_segment
from kelpline.llm.queries import tokenizer_path
from kelpline.llm.store import Workspace
from kelpline.llm.tokens import WordTokenizer, segment_starts, token_digests, write_tokens

from .conftest import words


@pytest.mark.parametrize("top", [1, 200, 256, 65535, 65536, 2**32 - 1])
def test_round_trip_and_random_access(top):
    r = np.random.default_rng(top)
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        ids = r.integers(0, top, n, endpoint=True).astype(np.uint32)
        s = DacSegment(encode_segment([7, None], np.array([n // 2, n - n // 2]), ids))
        assert s.all_ids().tolist() == ids.tolist() and s.firsts.tolist() == [0, n // 2, n]
        assert all(s.get(i) == ids[i] for i in range(n))
    with pytest.raises(IndexError):
        s.get(n)


def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_word_by_word_equals_whole_texts():
    texts = ["  <|endoftext|> it's  café á ́b   x123 ΣΑΣ ", "", " \n", "don't <|startoftext|>x I'LL 東京 😀 naïve ÀÉÎ\u0085x \x1c y", words(3000, 1), words(3000, 1).upper(), "x" * 5000]
    r = random.Random(2)
    texts += ["".join(r.choice("aé' <|>\n1ßΣİ́\x1f\xa0😀") for _ in range(60)) for _ in range(300)]
    ids, n = WordTokenizer(tokenizer_path()).encode([t.encode() for t in texts], 2)
    want = [reference().encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_memory_is_bounded_and_results_stay(monkeypatch):
    import kelpline.llm.tokens as tokens

    monkeypatch.setattr(tokens, "KNOWN_WORDS", 50)
    t = WordTokenizer(tokenizer_path())
    for seed in range(4):
        text = words(400, seed)
        assert t.encode([text.encode()], None)[0].tolist() == reference().encode(text, add_special_tokens=False).ids
    assert len(t.known) <= 50


def test_files_by_brute_force(spark, odd_docs, no_docs):
    rows = sorted(((x.doc_id, x.text) for x in odd_docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    want, start = [], 0
    for i, t in rows:
        ids = reference().encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(x.doc_id, x.start, x.n_tokens, x.ids_crc32) for x in token_digests(odd_docs, tokenizer_path(), segment_tokens=5000).collect()]
    assert sorted(got, key=lambda x: x[1]) == want
    assert token_digests(no_docs, tokenizer_path()).collect() == []
    segments = segment_starts(write_tokens(odd_docs, tokenizer_path(), Workspace(spark, "t"), segment_tokens=500)).orderBy("start").collect()
    assert len(segments) > 3 and all(a.start + a.n_tokens == b.start for a, b in zip(segments, segments[1:], strict=False))
