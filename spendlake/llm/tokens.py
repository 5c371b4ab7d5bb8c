"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

#: Pieces remembered per worker; beyond it the newer half is forgotten: frequent pieces come early. Longer ones are not remembered.
REMEMBERED, LONGEST = 700_000, 40

# A single space between characters that no one takes for white space: no token crosses it.
_GAP = re.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
_OTHER_SPACE = re.compile("[\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
# What may end a word and is split from it; an apostrophe may start a token with the letters behind it.
_TAIL = string.punctuation.replace("'", "")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer with the library's own settings; strings of special tokens in a text give their ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b if b in plain else next(other)) for b in range(256)}


class _Pieces(dict):
    """Ids of pieces of text, filled when asked for."""

    def __init__(self, tokenizer, before: str):
        super().__init__()
        self.encode_text, self.merge = tokenizer.encode, tokenizer.model.tokenize
        letters = byte_letters()
        self.before, self.spelled = before, "".join(letters[b] for b in before.encode())
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            for old in list(islice(self, len(self) // 2, None)):
                del self[old]
        word = piece.rstrip(_TAIL)
        if word.isalpha() and (word.isascii() or _WORD.fullmatch(word)):
            if len(word) < len(piece):
                ids = self[word] + self._encode(piece[len(word) :])
            else:
                # One word is one piece of the vocabulary's own splitting; only its merges are left to do.
                spelled = word if word.isascii() else word.translate(self.letters)
                ids = array("I", [t.id for t in self.merge(self.spelled + spelled)]).tobytes()
        else:
            ids = self._encode(self.before + piece)
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    @lru_cache(maxsize=4096)  # noqa: B019
    def _encode(self, text: str) -> bytes:
        return array("I", self.encode_text(text, add_special_tokens=False).ids).tobytes()

    __hash__ = object.__hash__


def _plain(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between visible characters."""
    return not (
        "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace()
        or _OTHER_SPACE.search(text)
    )


class Encoder:
    """Encodes texts piece by piece, each piece up to the next safe gap, and remembers what pieces gave.

    The vocabulary's own splitting starts a token at a single space between two visible characters wherever it stands,
    and makes a single line feed between them a token, so the ids of a text are those of its pieces in order. Added
    tokens of the vocabulary are cut out first, as the library does: what stands before and after one is encoded alone.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.after_space, self.first = _Pieces(self.tokenizer, " "), _Pieces(self.tokenizer, "")
        self.line_feed = self.first["\n"]
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that take in or depend on what stands around them are not supported")
        self.added = {t.content: array("I", [k]).tobytes() for k, t in added.items()}
        # Of added tokens that start at one place the library takes the longest.
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for null and empty texts."""
        if not text:
            return b""
        if self.cuts and self.cuts.search(text):
            return b"".join(self.added[t] if k % 2 else self._between(t) for k, t in enumerate(self.cuts.split(text)))
        return self._between(text)

    def _between(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not text:
            return b""
        if _plain(text):
            lines = [line.split(" ") for line in text.split("\n")]
        else:
            lines = [_GAP.split(text)]
        parts = [self.first[first] + b"".join(map(self.after_space.__getitem__, rest)) for first, *rest in lines]
        return self.line_feed.join(parts)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder; what it remembers serves all its tasks."""
    return Encoder(path)


def encoded(path: str, texts) -> Iterator[bytes]:
    return map(encoder(path).encode, texts)
