"""Tokenizing whole texts with the tokenizers library, a word at a time.

A tokenizer file spends nearly all of its time on words it has met before. Both
tokenizers used here never let a token cross the place between a word and the
white space after it, so a text's ids are the ids of its pieces, and each
distinct piece is encoded once in a Python worker and then looked up.

``WordwiseEncoder.encode(text)`` equals
``Tokenizer.encode(text, add_special_tokens=False).ids``. Pieces of Latin-1
letters go to the library's BPE model directly. All others go through the whole
library pipeline (normaliser, splitter, model). Tokenizers of another make than
the two below encode whole texts.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from tessera.llm.common import Memory, kept

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(rf"( ?[{_LETTERS}]+)([!-/:-@\[-`{{-~]*)")
_CUT = re.compile(r"(?<=\S)(?= )")
_LOOSE_SPACE = re.compile(r"\s\s|\A\s|\s\Z")
#: str.split() cuts at these, the library's white space rule doesn't.
_CONTROLS = re.compile("[\x1c-\x1f]")


def _byte_chars() -> dict[int, int]:
    """Byte-level BPE writes each byte as a printable character: printable Latin-1 as itself, the rest from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(rest)}


class WordwiseEncoder:
    """Encodes texts to ids; pieces are kept up to ``most_bytes``, which bounds the worker's memory, never the result."""

    def __init__(self, path: str, most_bytes: int = 72 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache, self.endings = Memory(most_bytes), Memory(2 << 20)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = self._kind(spec)
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.size = self.tokenizer.get_vocab_size()
        self.plain_specials = not any(re.search(r"\s", t) for t in specials)
        self.byte_chars = _byte_chars()
        self.model = self.tokenizer.model

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and norm is None:
            return "spaced"  # a word carries the space before it
        parts = [p["type"] for p in pre.get("pretokenizers", [])]
        rules = [n["type"] for n in (norm or {}).get("normalizers", [])]
        if parts == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["behavior"] == "Removed" and rules == ["NFC", "Replace", "Lowercase"]:
            return "bare"  # white space is dropped
        return "whole"

    def _model_ids(self, piece: str) -> bytes:
        spelled = piece.encode("utf-8").decode("latin-1").translate(self.byte_chars)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _new(self, piece: str) -> bytes:
        """Encodes a piece that isn't in the cache; keeps it while there is room, and a word without its ending too."""
        m = _WORD.fullmatch(piece)
        if m is None:
            ids = np.asarray(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
        else:
            word, end = m.groups()
            ids = self.cache.get(word) if end else None
            if ids is None:
                ids = self._model_ids(word.strip().lower() if self.kind == "bare" else word)
            if end:
                self.cache.keep(word, ids)
                tail = self.endings.get(end)
                if tail is None:
                    tail = self._model_ids(end)
                    self.endings.keep(end, tail)
                ids += tail
        self.cache.keep(piece, ids)
        return ids

    def pieces(self, text: str) -> list[str]:
        """Cuts of the text at which no token can cross."""
        if self.kind == "bare":
            return text.split() if _CONTROLS.search(text) is None else [text]
        if _LOOSE_SPACE.search(text):
            return _CUT.split(text)
        # single white space only: a line break is a token of its own, and the next word has no space
        spaced = text.replace(" ", "\0 ")
        return spaced.replace("\n", "\0\n\0").split("\0") if "\0" not in text else [text]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.kind == "whole" or not self.plain_specials:
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        known, new = self.cache.get, self._new
        return b"".join([known(piece) or new(piece) for piece in self.pieces(text)])


def encoder(path: str) -> WordwiseEncoder:
    """The worker's encoder for a tokenizer file, kept from task to task."""
    return kept(("encoder", path), lambda: WordwiseEncoder(path))
