"""Subword ids of the byte-level vocabulary, with a bounded cache of space-led chunks."""

from __future__ import annotations

import json
import re

import numpy as np

_SPACED = re.compile(r" \s")
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as byte strings, if its ids follow the order of its merges; else None."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if [model["vocab"].get(m) for m in merged] != list(range(256, 256 + len(merged))):
        return None
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(merged)}


class _Cache(dict):
    """Chunk -> little-endian unsigned 32-bit ids. Frequent chunks come early; when `most` are held, others are encoded anew."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > 2 and chunk[-1] in ".,!?;" and chunk[-2].isalpha():
            ids = self[chunk[:-1]] + self[chunk[-1]]  # letters and marks are separate pieces
        else:
            ids = np.array(self.encode(chunk), "<u4").tobytes()
        if len(chunk) <= 48 and len(self) < self.most:
            self[chunk] = ids
        return ids


class Encoder:
    """Equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    The vocabulary splits a text before each space that a non-space follows, so such chunks can be encoded one by one
    and cached. Texts where white space follows a space, or that hold a special token's string, are encoded whole."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = _ranks(path)
        if ranks is None:
            encode = lambda chunk: self.tokenizer.encode(chunk, add_special_tokens=False).ids
        else:
            import tiktoken

            encode = tiktoken.Encoding("chunks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache = _Cache(encode, most)

    def packed(self, text: str) -> bytes:
        if _SPACED.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *rest = text.split(" ")
        cache = self.cache
        tail = b"".join([cache[" " + x] for x in rest])
        return cache[head] + tail if head else tail


def encoder(path: str, most: int = 400_000) -> Encoder:
    """One encoder for each Python worker, vocabulary file and number of chunks to keep."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = Encoder(path, most)
    return _ENCODERS[path, most]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
