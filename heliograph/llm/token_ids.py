"""Byte-level BPE ids, with the words of a worker's texts encoded once.

A text is cut where the tokenizer's own pre-tokenizer cuts anyway: before a space that
stands alone before other text, and around runs of white space.  Equal pieces then have equal
ids wherever they stand, so a worker keeps the ids of the pieces that it has met.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np

# The characters with the Unicode property White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
#: Pieces remembered in a worker before it starts afresh, and the longest of them.
REMEMBER, LONGEST = 450_000, 48


def byte_symbols() -> dict[str, int]:
    """Byte-level BPE's printable stand-in for each byte: printable ones stand for themselves, the others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def ranks_of(tokenizer_json: str) -> dict[bytes, int]:
    """Token bytes to ids of a byte-level BPE file of ``tokenizers``; added tokens are left out."""
    spec = json.loads(tokenizer_json)
    added = {t["id"] for t in spec.get("added_tokens", [])}
    symbols = byte_symbols()
    return {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in added}


def ordinary_encoding(ranks: dict[bytes, int]):
    """The BPE itself; special tokens' strings are plain text."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder(dict):
    """Piece to its ids as little-endian unsigned 16-bit numbers."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids over 65535 don't fit 16 bits")
        self.bpe = ordinary_encoding(ranks)

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.bpe.encode_ordinary(piece), dtype="<u2").tobytes()
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if len(self) > REMEMBER:
            self.clear()
        return b"".join(map(self.__getitem__, PIECES.findall(text)))


_encoders: dict[str, Encoder] = {}


def encoder(packed: dict) -> Encoder:
    """This worker's encoder for a broadcast vocabulary."""
    if packed["name"] not in _encoders:
        _encoders[packed["name"]] = Encoder(unpack_vocabulary(packed))
    return _encoders[packed["name"]]


def unpack_vocabulary(packed: dict) -> dict[bytes, int]:
    return {base64.b64decode(k): int(v) for k, v in (x.split() for x in packed["ranks"].splitlines())}


def pack_vocabulary(path: str) -> dict:
    """A tokenizer file, read on the driver, in a form to broadcast (a fixed table of about 1 MB)."""
    import hashlib

    with open(path, encoding="utf-8") as file:
        spec = file.read()
    ranks = "\n".join(f"{base64.b64encode(k).decode()} {v}" for k, v in ranks_of(spec).items())
    return {"name": hashlib.sha256(ranks.encode()).hexdigest(), "ranks": ranks}
