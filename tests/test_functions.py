import pytest

from papyrix.functions import codec, stem
from papyrix.operators import boolean, evaluate


def test_codes():
    assert codec.vbyte_encode([1, 127, 128, 300, 16384]).hex() == "017f8001ac02808001"
    assert codec.vbyte_decode(codec.vbyte_encode([0, 5, 1 << 40])) == [0, 5, 1 << 40]
    assert codec.gamma_encode([1, 2, 3, 5]).hex() == "cb10"
    assert codec.gamma_decode(bytes.fromhex("cb10"), 4) == [1, 2, 3, 5]
    assert codec.un_dgaps(codec.dgaps([3, 7, 8])) == [3, 7, 8] and codec.dgaps([3, 7, 8]) == [3, 4, 1]
    with pytest.raises(ValueError):
        codec.gamma_encode([0])


def test_stemmers():
    pairs = "archivo archiv calendario calendari diciembre diciembr emprendimiento emprend febrero febrer fecha fech home hom abril abril fundacion fundacion institucional institucional".split()
    for word, want in zip(pairs[::2], pairs[1::2]):
        assert stem.snowball_es(word) == want
    assert [stem.porter(w) for w in ("caresses", "ponies", "relational", "hopping", "generalizations")] == ["caress", "poni", "relat", "hop", "gener"]


def test_parser():
    assert boolean.parse("a & b | ~c") == ("or", [("and", [("term", "a"), ("term", "b")]), ("not", ("term", "c"))])
    for bad in ("(a", "a b", "", "and"):
        with pytest.raises(ValueError):
            boolean.parse(bad)


def test_p_value():
    assert evaluate.p_value(1.0, 10) == 0 and evaluate.p_value(0.5, 2) == 1
    assert abs(evaluate.p_value(0.5, 20) - 0.02477) < 1e-4
