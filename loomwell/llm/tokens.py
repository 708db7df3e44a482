"""Token ids of whole texts, with word caches around the tokenizers library.

The vocabulary file drops white space and never joins text across it, so the
ids of a text are the ids of its parts between ASCII spaces and line feeds, in
order. A part seen before is found in a dictionary. A new part of plain Latin
letters, digits and signs is cut into the file's pre-tokens here, and each
pre-token not seen before is encoded by the library's BPE model; any other part
goes through the library's whole pipeline. Both dictionaries are bounded.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from itertools import chain

import numpy as np
import regex

#: Parts and pre-tokens that a worker's caches hold before they are emptied.
CACHE = 600_000

#: Fixed values of the vocabulary file: its pre-token pattern and its two special tokens' beginning.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = "<|"

_plain = regex.compile(r"[!-~¡-ɏ]*").fullmatch
_cut = regex.compile(PRE_TOKEN).findall
#: Characters that NFC leaves alone and that lower case one by one.
_latin = re.compile(r"[\x00-ɏ]*").fullmatch
#: Between a letter and signs other than the apostrophe pre-tokens always part.
_apart = re.compile(r"(?<=[a-zà-öø-ÿ])(?=[.,!?;:*#$%&|])").sub


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself if it prints, else one past 255."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """Ids of texts. The dictionary itself holds each part's number."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = byte_letters()
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.pre: dict[str, tuple[int, ...]] = {}
        self.flat, self.ends = array("I"), array("q", [0])

    def _pre(self, token: str) -> tuple[int, ...]:
        ids = self.pre.get(token)
        if ids is None:
            mapped = token if token.isascii() else token.encode().decode("latin-1").translate(self.letters)
            ids = self.pre[token] = tuple([t.id for t in self.model.tokenize(mapped)])
        return ids

    def __missing__(self, part: str) -> int:
        put = self.flat.extend
        if part.isascii() and part.isalpha() and part.islower():
            put([t.id for t in self.model.tokenize(part)])
        elif _plain(part) and SPECIAL not in part:
            for token in _cut(part.lower()):
                put(self._pre(token))
        else:
            put(self.library.encode(part, add_special_tokens=False).ids)
        n = self[part] = len(self.ends) - 1
        self.ends.append(len(self.flat))
        return n

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts)."""
        if len(self) > CACHE or len(self.pre) > CACHE:
            self.empty()
        collects = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and the caches are large to walk
        try:
            split = [(_apart(" ", t.lower()) if _latin(t) and SPECIAL not in t else t).replace("\n", " ").split(" ") for t in texts]
            counts = np.fromiter(map(len, split), np.int64, len(split))
            which = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
            del split
        finally:
            if collects:
                gc.enable()
        flat, ends = np.array(self.flat, np.uint32), np.array(self.ends, np.int64)
        begin = ends[which]
        n = ends[which + 1] - begin
        to = np.cumsum(n)
        ids = flat[np.repeat(begin - (to - n), n) + np.arange(int(to[-1]) if len(to) else 0)]
        return ids, np.concatenate([[0], to])[np.concatenate([[0], np.cumsum(counts)])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, kept between batches."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
