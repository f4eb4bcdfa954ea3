"""Tokenizer files read by the tokenizers library, with a memo of what it said per piece of text.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the
ids of the pieces, one after the other, are the ids of the whole text:

* white space is dropped between words (``word_bpe``): at every space and line feed;
* byte-level with words that start with their space: before every single space
  between two characters that are not white space.

Other pre-tokenizers get whole texts.  A piece is encoded by the library once per
worker and memo; pieces made of Latin letters alone skip normalizer and
pre-tokenizer, which leave such a piece whole, and go to the library's model.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from types import ModuleType

import numpy as np

MEMO_ENTRIES = 300_000  # pieces in a generation of a worker's memo; two generations are held

_LETTERS = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)] if chr(c).isalpha())
_ALPHA = re.compile(f"[{_LETTERS}]+").fullmatch
# ASCII punctuation (no apostrophe) after a Latin letter or digit, up to the end of a word: a run of its own
_PUNCTUATION = r"[!-&(-/:-@\[-`{-~]"
_TAIL = re.compile(rf"{_PUNCTUATION}(?<=[0-9a-zß-öø-ÿ].){_PUNCTUATION}*+(?=[ \n]|\Z)")
_SPACES = re.compile(r"\s\s|^\s|\s$")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def file_digest(path: str) -> str:
    """Version of a tokenizer: SHA-256 of its file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class Pieces(dict):
    """piece -> ids as bytes (little-endian), filled by the library on first use.

    When a generation is full, the one before it goes; pieces still in use come over
    to the new one, so frequent words stay and memory is bounded.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.older: dict[str, bytes] = {}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.kind = _cut_rule(spec)
        if self.kind:
            pre = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self._mapped = {ord(c): pre(c.lower() if self.kind == "words" else c)[0][0] for c in _LETTERS}
            self._tokenize = self.tokenizer.model.tokenize
            self._space = pre(" a")[0][0][:-1] if self.kind == "spaced" else ""

    def whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _packed(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _model(self, mapped: str) -> bytes:
        return self._packed([t.id for t in self._tokenize(mapped)])

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.older = dict(self)
            self.clear()
        known = self.older.get(piece)
        if known is not None:
            self[piece] = known
            return known
        if self.kind == "words":
            if not piece:
                ids = b""
            elif _ALPHA(piece):
                lower = piece.lower()
                # lower-case ASCII letters are their own byte symbols
                ids = self._model(piece if piece.isascii() else piece.translate(self._mapped)) if lower == piece else self[lower]
            elif len(piece) > 1 and piece[-1] in ",." and _ALPHA(piece[-2]):
                ids = self[piece[:-1]] + self[piece[-1]]
            else:
                ids = self.whole(piece)
        elif piece[:1] == " " and _ALPHA(piece[1:]):
            ids = self._model(self._space + piece[1:].translate(self._mapped))
        elif len(piece) > 2 and piece[-1] in ",." and _ALPHA(piece[-2]):
            ids = self[piece[:-1]] + self[piece[-1]]
        else:
            ids = self.whole(piece)
        self[piece] = ids
        return ids

    def cut(self, text: str) -> list[str]:
        """Pieces of ``text`` whose ids make up its ids."""
        if self.kind == "words":
            # Latin text in lower case has far fewer different pieces; special tokens and other scripts stay as they are
            if _is_latin(text) and "<|" not in text:
                text = _TAIL.sub(r" \g<0>", text.lower())
            return text.replace("\n", " ").split(" ")
        if self.kind == "spaced":
            if _SPACES.search(text):
                return _CUT.split(text)
            first, *rest = text.split(" ")
            return [first, *[" " + x for x in rest]]
        return [text]

    def ids(self, text: str) -> bytes:
        if not self.kind:
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.cut(text)))

    def count(self, text: str) -> int:
        return len(self.ids(text)) // self.dtype.itemsize


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _cut_rule(spec: dict) -> str | None:
    """Where the pre-tokenizer always cuts: "words", "spaced" or None (unknown)."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(" " in t["content"] or "\n" in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return None
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "spaced"
    parts = pre.get("pretokenizers", [])
    kinds = [p.get("type") for p in (norm or {}).get("normalizers", [])]
    if (
        kinds == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and not parts[1].get("add_prefix_space")
    ):
        return "words"
    return None


def pieces(path: str) -> Pieces:
    """The worker's memo for a tokenizer file, kept from task to task.

    Functions of this package travel to the workers by value, each task with globals
    of its own; the memo therefore hangs on the process.
    """
    held = sys.modules.setdefault("_tidepool_memo", ModuleType("_tidepool_memo"))
    if getattr(held, "path", None) != path:
        held.path, held.memo = path, Pieces(path)
    return held.memo
