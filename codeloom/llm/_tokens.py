"""Token ids of whole texts by the tokenizers library, encoding each distinct piece of text once per worker."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np

#: A worker remembers the pieces used since it last met this many, and those met before that.
CACHE_PIECES = 500_000
#: Longer pieces are encoded but not remembered.
CACHE_CHARS = 48

_TWO_SPACES = re.compile(r"\s\s|\s\Z")
#: White space other than the space and the line end.
_RARE_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_loaded: dict[str, PieceCache] = {}


def _spaced(text: str) -> bool:
    """Whether two white-space characters stand in a row or one at the end: the pattern, for which most texts need
    only a look for single characters and pairs."""
    if any(c in text for c in _RARE_SPACE):
        return _TWO_SPACES.search(text) is not None
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1:] in (" ", "\n")


class _Known(dict):
    """Ids of pieces: those used since the last change of generations, and behind them the generation before."""

    def __init__(self, made: Callable[[str], bytes], old: dict[str, bytes]):
        super().__init__()
        self.made, self.old = made, old

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.made(piece)
            if len(piece) > CACHE_CHARS:
                return ids
        self[piece] = ids
        return ids


class PieceCache:
    """Encodes texts piece by piece.

    A text is cut before a single space and around line ends (kind "byte": the space opens the next piece) or at spaces and line ends
    (kind "word": the tokenizer drops white space). No pre-token of either tokenizer crosses such a cut, so the
    ids of the pieces in a row are the ids of the text. A text with two white-space characters in a row, or one
    at its end, is encoded whole for kind "byte", since there a run of white space is one pre-token.

    A new piece that is a single pre-token (letters, and a space before them for kind "byte") goes straight to the
    tokenizer's model, and a full stop or comma after it is a pre-token of its own. Any other new piece is encoded
    as a text of its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.bytes_kind = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel)
        self.marks = dict(zip(".,", self._encode([".", ","]), strict=True))
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printed]
        #: The byte-level alphabet.
        self.letters = {b: (b if b in printed else 256 + others.index(b)) for b in range(256)}
        self.known = _Known(self._made, {})

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in out]

    def _simple(self, piece: str) -> str | None:
        """The pre-token that a piece is, as the tokenizer's pre-tokenizer would hand it to its model; None if it is
        anything else."""
        if self.bytes_kind:
            if piece[:1] == " ":
                if not piece[1:].isalpha():
                    return None
                if piece.isascii():
                    return chr(self.letters[32]) + piece[1:]
            elif not piece.isalpha():
                return None
            return piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        if not piece.isalpha():
            return None
        if piece.isascii():
            return piece.lower()
        if "Σ" in piece or not unicodedata.is_normalized("NFC", piece):
            return None
        low = piece.lower()
        return low.encode().decode("latin-1").translate(self.letters) if low.isalpha() else None

    def _made(self, piece: str) -> bytes:
        """The ids of a new piece."""
        word = self._simple(piece)
        if word is not None:
            return array("I", [t.id for t in self.tokenize(word)]).tobytes()
        mark = self.marks.get(piece[-1:])
        if mark is not None and self._simple(piece[:-1]) is not None:
            return self.known[piece[:-1]] + mark
        return self._encode([piece])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHE_PIECES:
            last = self.known
            last.old = {}
            self.known = _Known(self._made, last)
        get, out, whole = self.known.__getitem__, [], []
        for i, text in enumerate(texts):
            if not self.bytes_kind:
                out.append(b"".join(map(get, text.replace("\n", " ").split(" "))))
            elif "\0" in text or _spaced(text):
                out.append(b"")
                whole.append(i)
            else:
                out.append(b"".join(map(get, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"))))
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """This worker's encoder for a tokenizer file."""
    if path not in _loaded:
        _loaded[path] = PieceCache(path)
    return _loaded[path].encode
