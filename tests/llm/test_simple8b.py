import zlib

import numpy as np
import public_tokenizers
from colloquy.llm import simple8b
from colloquy.llm.common import new_path
from colloquy.llm.wordcodes import ByteCodes, WordCodes
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

FILE = public_tokenizers.path("word_bpe_49k.json")
WIDE = st.integers(0, 63).flatmap(lambda b: st.integers(0, (2 << b) - 1))


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 49407), WIDE), max_size=700), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_round_trip(ids, times):
    x = np.array(ids * times, dtype=np.uint64)
    words, blocks = simple8b.encode(x)
    assert (simple8b.decode(words) == x).all() and len(simple8b.decode(words)) == len(x)
    for k in range(len(blocks)):
        assert (simple8b.decode_block(words, blocks, k) == x[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK]).all()


def test_words_are_packed_as_the_selectors_say():
    words, _ = simple8b.encode(np.array([1] * 60 + [70000, 5] + [1 << 40]))
    assert words[0] == (2 << 60) | ((1 << 60) - 1)
    assert words[1] == (14 << 60) | 70000 | 5 << 30
    assert words[2] >> 60 == simple8b.ESCAPE and words[3] == 1 << 40
    assert len(simple8b.encode(np.zeros(240))[0]) == 1


TEXT = st.lists(st.one_of(st.text(st.sampled_from("ab'sS \n\t\r1éßΣİ́日  .!<|>😀"), max_size=12), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "t|>"])), max_size=5).map("".join)


@given(st.lists(TEXT, max_size=20))
@settings(max_examples=60, deadline=None)
def test_ids_are_the_librarys(texts):
    for made, name in ((WordCodes, "word_bpe_49k.json"), (ByteCodes, "byte_bpe_50k.json")):
        codes, library = _codes(made, name)
        for t in texts:
            assert np.frombuffer(codes.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


_held = {}


def _codes(made, name):
    if name not in _held:
        library = Tokenizer.from_file(public_tokenizers.path(name))
        _held[name] = made(public_tokenizers.path(name)), library
    return _held[name]


def test_files(spark, odd_docs, no_docs):
    library = Tokenizer.from_file(FILE)
    path = new_path(spark, "tokens")
    simple8b.write_tokens(odd_docs, path, FILE, end_id=1)
    got = sorted(simple8b.read_tokens(spark, path).collect(), key=lambda r: r.start)
    want = {}
    for r in odd_docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r.doc_id for r in got] == sorted((i for i in want for _ in want[i]), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, zlib.crc32(r.ids)) in want[r.doc_id]
        at += r.n_tokens
    empty = new_path(spark, "tokens")
    simple8b.write_tokens(no_docs, empty, FILE)
    assert simple8b.read_tokens(spark, empty).count() == 0
