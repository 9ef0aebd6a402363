"""A byte-level BPE read from a tokenizers file; its ids come as packed 32-bit numbers."""

from __future__ import annotations

import functools
import json

import numpy as np
import tiktoken

#: The split pattern of the byte-level BPE (possessive, which matches the same), and the bytes that stand for themselves in its vocabulary.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def public_path(name: str) -> str:
    """The place of a public vocabulary file, which is a parameter of every operator that reads one."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Bpe:
    """Ids as `tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False)` gives them, several times as fast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        rest = iter(range(256, 512))
        letter = {chr(b) if b in PRINTABLE else chr(next(rest)): b for b in range(256)}
        self.special = {x["content"]: x["id"] for x in made.get("added_tokens", [])}
        vocab = made["model"]["vocab"]
        ranks = {bytes(letter[c] for c in w): i for w, i in vocab.items() if w not in self.special}
        core = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)._core_bpe
        self.encode_to_buffer = core.encode_to_tiktoken_buffer
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = {i: w for w, i in ranks.items()} | {i: w.encode() for w, i in self.special.items()}

    def packed(self, text: str) -> bytes:
        """Ids, those of special tokens in the text included, as little-endian unsigned 32-bit numbers."""
        return bytes(self.encode_to_buffer(text, {x for x in self.special if x in text}))

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text in which the strings of special tokens are ordinary text."""
        return np.frombuffer(bytes(self.encode_to_buffer(text, set())), "<u4")


@functools.lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    """One encoder a worker process and file."""
    return Bpe(path)
