"""A worker holds one encoder, and none once ids are read back."""

import gc
import weakref

from tissueflow.llm import tokens


def test_one_encoder_a_worker():
    path = tokens.vocabulary_path()
    small = tokens.encoder(path, 10, 5)
    assert tokens.encoder(path, 10, 5) is small and (small.pieces.most, small.groups.most) == (10, 5)
    other = tokens.encoder(path)
    assert list(tokens._made.values()) == [other] and other.pieces.most == tokens.PIECES
    text = ["one two three. four " * 9, "", "a b"]
    assert [x.tolist() for x in small.encode(text)] == [x.tolist() for x in other.encode(text)]
    tokens.drop_encoders()
    assert not tokens._made


def test_dropped_encoders_are_freed():
    """Tables and encoder refer to each other: without a collection they stayed for good."""
    made = weakref.ref(tokens.encoder(tokens.vocabulary_path(), 20, 10))
    gc.disable()
    try:
        tokens.drop_encoders()
        assert made() is None
    finally:
        gc.enable()
