"""Pieces that a worker has encoded are looked up, not encoded again."""

import pyarrow as pa
import public_tokenizers as P
from tokenizers import Tokenizer

from rivulet.llm import token_store
from rivulet.llm.pretokens import flat


def test_pieces_are_encoded_once_and_ids_stay():
    with open(P.path("byte_bpe_50k.json"), "rb") as f:
        mine, theirs = token_store.LibraryEncoder(f.read()), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    asked, tokenize = [], mine.model.tokenize
    mine.model = type("Counted", (), {"tokenize": lambda self, p: asked.append(p) or tokenize(p)})()
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + "ö" * (a == "q") for a in letters for b in letters for c in letters[:12]]
    texts = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
    want = [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    assert mine(pa.array(texts)).to_pylist() == want
    first = len(asked)
    assert mine(pa.array(texts[::-1])).to_pylist() == want[::-1]
    assert first >= len(words) * 0.9 and len(asked) - first < first / 20


def test_known_pieces_are_bounded_and_those_met_again_stay():
    asked = []
    known = token_store.Known(lambda ps: asked.append(len(ps)) or flat([[len(p), int(p)] if int(p) % 3 else [] for p in ps]), bound=200_000)
    n = token_store.LEAST_LOOKUP
    make = lambda i: [str(k) for k in range(i, i + n)]
    for at in (0, 0, n, 2 * n, 3 * n, 0, 3 * n, 0):
        pieces = [*make(at), *make(0)[:100]]
        assert known(pieces).to_pylist() == [[len(p), int(p)] if int(p) % 3 else [] for p in pieces]
        assert known.names.nbytes + known.lists.nbytes <= 200_000 and len(known.names) == len(known.lists) == len(known.met)
    assert asked[1] == 0 and sum(asked) < 8 * n
