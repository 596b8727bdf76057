"""Token ids of texts by a public byte-level tokenizer, and values of stretches of text that a worker keeps.

The ids are those of the ``tokenizers`` library for the file. Where the file's merges come in the order of their ids, they are made by
``tiktoken`` from the file's own vocabulary, in a third of the time; tests hold the two together. Texts in which a special token is
written go to ``tokenizers``.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable

import numpy as np

#: A worker keeps the stretches of its last MAX_KEPT to 2 * MAX_KEPT ones; those of over LONG characters are made every time.
MAX_KEPT, LONG = 150_000, 200
#: Fixed value: the pattern by which the byte-level vocabulary splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def tokenizer(path: str, specials: bool):
    """The tokenizer of a file; special tokens written in a text are special only if `specials`."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not specials
    return t


@functools.cache
def letters() -> dict[str, int]:
    """The byte that a byte-level vocabulary writes as each letter: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def plain(path: str) -> Callable[[str], list[int]]:
    """Ids of a text in which no token is special."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    if made == sorted(made):
        import tiktoken

        ranks = {bytes(letters()[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    t = tokenizer(path, False)
    return lambda text: t.encode(text, add_special_tokens=False).ids


class Memo:
    """Values of stretches, made in batches by `make` and kept while they are in use."""

    def __init__(self, make: Callable[[list[str]], list]):
        self.make, self.young, self.old = make, {}, {}

    def known(self, parts: list[list[str]]) -> dict:
        """Values of all stretches in `parts`, and perhaps of more."""
        if len(self.young) > MAX_KEPT:
            self.old, self.young = self.young, {}
        new = set().union(*parts) - self.young.keys()
        for u in new & self.old.keys():
            self.young[u] = self.old[u]
        new -= self.young.keys()
        short = [u for u in new if len(u) <= LONG]
        self.young.update(zip(short, self.make(short)))
        if len(short) == len(new):
            return self.young
        rare = [u for u in new if len(u) > LONG]
        return {**self.young, **dict(zip(rare, self.make(rare)))}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, without ids that frame a text."""

    def __init__(self, path: str):
        self.tokenizer, self.plain = tokenizer(path, True), plain(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")

    def encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if self.special.search(text) else self.plain(text)
        return np.array(ids, "<u4").tobytes()


@functools.cache
def encoder(path: str) -> Encoder:
    """The encoder of a worker."""
    return Encoder(path)
