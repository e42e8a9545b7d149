"""Tokenizer access with a memo of text pieces, exact against the library.

A pre-tokenizer cuts a text into pieces that are encoded each on its own. Words repeat, so a piece is
encoded by the library once and then looked up. The memo is bounded. Texts that the rules here don't
cover (special strings, rare scripts) are handed to the library whole, or in larger pieces.
"""

from __future__ import annotations

import array
import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable

from .common import memo

#: The code points of the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0  -     　"
#: One space may stand before a word; of a longer run the last space goes with the word.
BYTE_LEVEL = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
#: White space is dropped, so that any of it parts two pieces.
WORD_LEVEL = re.compile("[^\t\n\x0b\x0c\r ]+")

#: Below this code point nothing changes under NFC, and one letter is one letter in lower case.
SIMPLE = 0x250
_letters, _numbers = ("".join(re.escape(chr(i)) for i in range(SIMPLE) if unicodedata.category(chr(i))[0] == kind) for kind in "LN")
#: The word pre-tokenizer's own rule, for text of simple code points in lower case.
SIMPLE_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_letters}]+|[{_numbers}]|[^\t-\r \x85\xa0{_letters}{_numbers}]+")
NOT_SIMPLE = re.compile(f"[^\x00-{chr(SIMPLE - 1)}]|İ")

#: About 200 bytes each.
MEMO_ENTRIES = 400_000
LONGEST_PIECE = 256


def path_of(file: str) -> str:
    """A bare name is one of the public tokenizer files; anything else is a path."""
    if "/" in file:
        return file
    import public_tokenizers

    return public_tokenizers.path(file)


def version_digest(file: str) -> str:
    """Digest of the tokenizer file: counts made by another version are never reused."""
    with open(path_of(file), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Memo:
    """Values of pieces, in two generations: when the younger one is full, the older one goes."""

    def __init__(self, encode: Callable[[list[str]], list], entries: int):
        self.encode, self.entries = encode, entries // 2
        self.new: dict = {}
        self.old: dict = {}

    def values_of(self, pieces: list[str]) -> list:
        missing = set(pieces).difference(self.new)
        if not missing:
            return list(map(self.new.__getitem__, pieces))
        if len(self.new) + len(missing) > self.entries:
            self.old, self.new = self.new, {}
            missing = set(pieces)
        known = [p for p in missing if p in self.old]
        self.new.update((p, self.old[p]) for p in known)
        missing = list(missing.difference(known))
        self.new.update(zip(missing, self.encode(missing), strict=True))
        found = list(map(self.new.__getitem__, pieces))
        for p in missing:
            if len(p) > LONGEST_PIECE:
                del self.new[p]
        return found


class Pieces:
    """Token counts and ids of whole texts by one tokenizer file."""

    def __init__(self, file: str, memo_entries: int = MEMO_ENTRIES):
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path_of(file))
        t.no_truncation()
        t.no_padding()
        kind = type(t.pre_tokenizer).__name__
        self.words = kind == "Sequence" and t.normalizer is not None
        self.split = WORD_LEVEL if self.words else BYTE_LEVEL if kind == "ByteLevel" and t.normalizer is None else None
        # where white space counts, a special string would part it another way
        self.special = [a.content for a in t.get_added_tokens_decoder().values()]
        self.ends = None
        if self.words:
            suffix = getattr(t.model, "end_of_word_suffix", None)
            if suffix:
                self.ends = {i for token, i in t.get_vocab().items() if token.endswith(suffix)}
        self.counts = Memo(lambda pieces: [len(e.ids) for e in t.encode_batch_fast(pieces, add_special_tokens=False)], memo_entries)
        self.ids = Memo(self._id_bytes, memo_entries)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _id_bytes(self, pieces: list[str]) -> list[bytes]:
        if self.ends and len(pieces) > 1:
            # all at once with spaces between; every piece is known by the token that ends a word
            ids = self._encode([" ".join(pieces)])[0]
            flat, cuts = packed(ids), [0]
            cuts += [i + 1 for i, t in enumerate(ids) if t in self.ends]
            if len(cuts) == len(pieces) + 1 and cuts[-1] == len(ids):
                return [flat[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return list(map(packed, self._encode(pieces)))

    def count(self, text: str) -> int:
        if self.split is None or any(s in text for s in self.special):
            return len(self._encode([text])[0])
        return sum(self.counts.values_of(self.split.findall(text)))

    def id_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        special = any(s in text for s in self.special)
        if self.words and not special and (text.isascii() or not NOT_SIMPLE.search(text)):
            return b"".join(self.ids.values_of(SIMPLE_WORDS.findall(text.lower())))
        if self.split is None or (special and not self.words):
            return packed(self._encode([text])[0])
        return b"".join([packed(x) for x in self._encode(self.split.findall(text))])


def packed(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if out.itemsize != 4:
        out = array.array("L", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_made: dict[str, Pieces] = {}


def pieces_of(file: str) -> Pieces:
    """One per Python worker and file."""
    memo("encoding", _made.clear)
    if file not in _made:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _made[file] = Pieces(file)
    return _made[file]
