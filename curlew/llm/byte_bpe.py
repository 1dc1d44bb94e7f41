"""Byte-level BPE ids of whole texts with the ``tokenizers`` library."""

from __future__ import annotations

import re
from array import array

# A space is a cut only between two printable characters that are no white space:
# no piece of the pre-tokenizer reaches across such a space, it opens the next piece.
_VISIBLE = str.isprintable

# A run of these after a word is one piece of the pre-tokenizer.
_MARKS = ".,!?;:"

_LATIN_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch

# The byte-level alphabet. Printable bytes stand for themselves, the
# others for the code points from 256 on.
_KEPT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_TO_CHAR = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _KEPT)}

# Chunks that a worker remembers within a task, about 170 bytes each. This bounds memory
# only, ids do not depend on it.
MEMO_CHUNKS = 500_000


class _Memo(dict):
    """Chunk -> ids, for the first chunks that come: frequent ones come early. What ``joined``
    puts together from others has a quarter of the room and words the rest; pairs of lines,
    which hardly ever come twice, have none."""

    def __init__(self, encode, joined):
        super().__init__()
        self.encode, self.joined = encode, joined

    def __missing__(self, chunk):
        if not chunk.isalpha() and (known := self.joined(chunk)) is not None:
            if len(chunk) <= 64 and len(self) < MEMO_CHUNKS // 4 and "\n" not in chunk:
                self[chunk] = known
            return known
        out = self.encode(chunk)
        if len(chunk) <= 64 and len(self) < MEMO_CHUNKS:
            self[chunk] = out
        return out


def _plain(text: str) -> bool:
    """Each space of the text is a cut."""
    return (
        "  " not in text
        and " \n" not in text
        and "\n " not in text
        and text[0] != " "
        and text[-1] != " "
        and text.replace("\n", "").isprintable()
    )


def _chunks(text: str) -> list[str]:
    if _plain(text):
        return text.split(" ")
    out, begun = [], 0
    at = text.find(" ", 1)
    while 0 < at < len(text) - 1:
        before, after = text[at - 1], text[at + 1]
        if before != " " and after != " " and _VISIBLE(before) and _VISIBLE(after):
            out.append(text[begun:at])
            begun = at + 1
        at = text.find(" ", at + 1)
    out.append(text[begun:])
    return out


class ByteBpe:
    """Encodes texts to little-endian unsigned 32-bit ids.

    A text is cut at single spaces between visible characters; each chunk (with
    the space before it) is encoded by the library, and short chunks are
    memoised. Strings of special tokens inside a text are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        self._model = self._tok.model
        self._first = _Memo(self._encode_first, lambda chunk: None)
        self._next = _Memo(self._encode_next, self._join_next)
        self.vocab_size = self._tok.get_vocab_size()

    def _encode(self, text: str) -> bytes:
        return array("I", self._tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, mark: str, word: str) -> bytes:
        """One piece of the pre-tokenizer, straight to the library's model."""
        piece = mark + (word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_TO_CHAR))
        return array("I", [t.id for t in self._model.tokenize(piece)]).tobytes()

    def _encode_first(self, chunk: str) -> bytes:
        return self._word("", chunk) if _LATIN_WORD(chunk) else self._encode(chunk)

    def _encode_next(self, chunk: str) -> bytes:
        if chunk.isalpha() and (chunk.isascii() or _LATIN_WORD(chunk)):
            return self._word("Ġ", chunk)
        return self._encode(" " + chunk)

    def _join_next(self, chunk: str) -> bytes | None:
        """A word and the marks after it, or the end of a line and the start of another."""
        stem = chunk.rstrip(_MARKS)
        if stem.isalpha() and (stem.isascii() or _LATIN_WORD(stem)):
            return self._next[stem] + self._first[chunk[len(stem) :]]
        before, line, after = chunk.partition("\n")
        if line and before and after and _VISIBLE(before[-1]) and _VISIBLE(after[0]):
            return self._next[before] + self._first["\n"] + self._encode_lines(after)
        return None

    def _encode_lines(self, chunk: str) -> bytes:
        """Text from the start of a line to the next cut."""
        stem = chunk.rstrip(_MARKS)
        if len(stem) < len(chunk) and _LATIN_WORD(stem):
            return self._first[stem] + self._first[chunk[len(stem) :]]
        return self._first[chunk]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        chunks = _chunks(text)
        head = self._first[chunks[0]]
        return head + b"".join(map(self._next.__getitem__, chunks[1:])) if len(chunks) > 1 else head

    def forget(self) -> None:
        """At the end of a task: a worker that waits or does other work holds no chunks."""
        self._first.clear()
        self._next.clear()


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """One encoder for each worker process, kept between tasks."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
