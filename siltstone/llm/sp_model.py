"""Sentencepiece BPE models written directly from a byte-level BPE vocabulary.

The vocabulary's byte strings become pieces by the usual mapping of the 256 bytes to
printable characters. A piece's score is its negative rank: at each step
sentencepiece joins the neighbours whose joint piece scores highest, which is the
merge of lowest rank. Normalisation is the identity. The file is a protocol buffer
whose few fields are written here by hand.
"""

from __future__ import annotations

import base64
import struct

#: Field numbers and values of the public sentencepiece_model.proto.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN, UNUSED = 1, 2, 5
MODEL_TYPE, BPE = 3, 2
VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 4, 40, 41, 42, 43
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5


def byte_characters() -> list[str]:
    """The printable character of each byte.

    Bytes that are printable in Latin-1 stand for themselves, the others for the
    characters from U+0100 on, in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """A rank file's byte strings by rank; ranks must be 0, 1, 2, ..."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                piece, rank = line.split()
                found[int(rank)] = base64.b64decode(piece)
    if sorted(found) != list(range(len(found))):
        raise ValueError("the ranks have gaps")
    return [found[i] for i in range(len(found))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _float(field: int, value: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", value)


def model_bytes(ranks: list[bytes]) -> bytes:
    """The serialised model; a piece's id is its rank, and the unknown piece comes last."""
    chars = byte_characters()
    names = ["".join(chars[b] for b in piece) for piece in ranks]
    out = [
        _bytes(PIECES, _bytes(PIECE, s.encode()) + _float(SCORE, -float(i)) + _number(TYPE, NORMAL))
        for i, s in enumerate(names)
    ]
    unknown = len(ranks)
    out.append(_bytes(PIECES, _bytes(PIECE, b"<unk>") + _float(SCORE, 0.0) + _number(TYPE, UNKNOWN)))
    out.append(
        _bytes(
            TRAINER,
            _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, unknown + 1) + _number(UNK_ID, unknown)
            + _number(BOS_ID, -1) + _number(EOS_ID, -1) + _number(PAD_ID, -1),
        )
    )
    out.append(
        _bytes(
            NORMALIZER,
            _bytes(NAME, b"identity") + _number(ADD_DUMMY_PREFIX, 0)
            + _number(REMOVE_EXTRA_WHITESPACES, 0) + _number(ESCAPE_WHITESPACES, 0),
        )
    )
    return b"".join(out)
