"""Words that share a hash."""

import random

import numpy as np
import public_tokenizers
import pytest

from graphloom.llm import langid, tokens, words

PAIR = "偔倀僓倀倪倀倀", "倀傈倀傕倀偝偗"


def crafted(n=1000, seed=1):
    """Pairs of words that differ as ``PAIR`` does, so that their polynomial hashes are equal."""
    rng = random.Random(seed)
    gaps = [ord(b) - ord(a) for a, b in zip(*PAIR, strict=True)]
    out = [PAIR]
    while len(out) < n:
        a = [rng.randrange(0x5800, 0x9000) for _ in gaps]
        tail = "".join(chr(rng.randrange(0x5800, 0x9000)) for _ in range(rng.randrange(5)))
        out.append(("".join(map(chr, a)) + tail, "".join(chr(x + g) for x, g in zip(a, gaps, strict=True)) + tail))
    return out


def test_pairs_share_hashes():
    for a, b in crafted(50):
        assert a != b and len({int(words.hashes(words.code_points(w), np.array([0]), np.array([len(w)]))[0]) for w in (a, b)}) == 1


@pytest.mark.parametrize("at_once", [True, False])
def test_numbers_tell_words_of_one_hash_apart(at_once):
    rng, known, seen = random.Random(2), words.Known(), {}
    some = [w for p in crafted(300) for w in p] + [f"w{i}" for i in range(300)] + ["x" * 5000, "y" * 5000, ""]
    some = [rng.choice(some) for _ in range(4000)]
    for part in [some] if at_once else [some[i : i + 7] for i in range(0, len(some), 7)]:
        size = np.array([len(w) for w in part])
        stop = np.cumsum(size)
        number, new = known.numbers(words.code_points("".join(part)), stop - size, stop)
        for i in new.tolist():
            seen[part[i]] = len(seen)
        assert number.tolist() == [seen[w] for w in part]
    assert len(known) == len(seen) == len(set(some))


def test_token_ids_equal_the_library(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tokens.Encoder(path)
    pairs = crafted(1000)
    texts = ["\n".join(PAIR), *[f"{a} {b} {a}{b}" for a, b in pairs], *[w for p in pairs for w in p]]
    want = [e.ids for e in encoder.model.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert [encoder.encode([t])[0].tolist() for t in texts[:200]] == want[:200]


def test_probabilities_are_those_of_the_word():
    pieces = [langid.MARK, *sorted({c for p in crafted(20) for w in p for c in w}), *[p[0] for p in crafted(20)]]
    lattice = langid.Lattice(pieces)
    for pair in crafted(20):
        both = langid.Lattice(pieces).edges(list(pair))[2]
        alone = [lattice.edges([w])[2] for w in pair]
        for i, found in enumerate(alone):
            mine = [(e, n, p[w == i].tolist()) for e, n, w, _, p in both if (w == i).any()]
            assert mine == [(e, n, p.tolist()) for e, n, _, _, p in found]
        assert max(n for _, n, *_ in alone[0]) == len(pair[0]) and max(n for _, n, *_ in alone[1]) == 1
