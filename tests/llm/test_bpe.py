import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from colloquy.llm import bpe
from hypothesis import given, settings
from hypothesis import strategies as st

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe.BytePairs(FILE)
TEXT = st.one_of(st.text(st.sampled_from("ab'srevlltmd \n\t\r\x00\x1c\x85 1²é́ßΣ日ก😀.!?<|>"), max_size=60), st.text(max_size=40))


@given(st.lists(TEXT, max_size=30), st.sampled_from([7, 64, 1 << 20]))
@settings(max_examples=100, deadline=None)
def test_ids_are_tiktokens_and_decode(texts, chunk):
    held, bpe.CHUNK = bpe.CHUNK, chunk
    try:
        got = list(OWN.encode_batch(texts))
    finally:
        bpe.CHUNK = held
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [OWN.decode(g) for g in got] == [t.encode() for t in texts]


def test_long_pieces_merge_like_short_ones():
    for piece in (b"x" * 5000, ("日本" * 900).encode(), bytes(range(256)) * 4):
        assert OWN._merged_long(piece) == LIBRARY._encode_single_piece(piece)


def test_scan_is_the_automaton():
    rng = np.random.default_rng(1)
    points = rng.choice([ord(c) for c in "ab' \n1.st"], 5000).astype(np.uint32)
    resets = np.array([0, 1700, 1701, 4999])
    state, want = bpe.START, []
    for i, s in enumerate(bpe.symbols(points, resets)):
        if bpe.BEGIN[s, state]:
            want.append(i)
        state = bpe.GO[s, state]
    assert bpe.beginnings(points, resets).tolist() == want


def test_documents(odd_docs, no_docs):
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(odd_docs, FILE).collect()), key=str)
    want = []
    for r in odd_docs.collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(no_docs, FILE).count() == 0
