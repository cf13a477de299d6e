"""Token ids of whole texts by the tokenizers library, a word at a time.

Both public vocabularies split a text before they merge, and never merge across a space that stands between two other
characters. So a text is cut there, each distinct piece is encoded once by the library, and a text's ids are its pieces'
ids in order: the same ids as for the whole text, in far less time. Most pieces are letters and then punctuation; these go
straight to the library's merge model, all others through the whole of its encoding. Texts with runs that hold two
spaces or more go to the library whole where the vocabulary keeps spaces, as do texts that hold a special token's own
string. The cache of pieces is bounded and emptied when full.
"""

from __future__ import annotations

import re
from array import array
from operator import add

#: More than one space within a run of white space.
_RUN = re.compile(r" \s* ")
#: White space other than single spaces and line ends.
_DOUBLE = ("  ", " \n", "\n ", "\n\n")
_ODD = ("\t", "\r", "\x0b", "\x0c", "\0")
_ODD_WIDE = re.compile(r"[^\S \n]")
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")
#: Letters, then punctuation without the apostrophe: two words of either vocabulary's own splitting; or anything else.
_PLAIN = re.compile(r"(?:( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)|([^\0]*))(?:\0|\Z)")


def _byte_table() -> dict[int, str]:
    """Code points up to U+00FF as byte-level vocabularies write their UTF-8 bytes: printable bytes as themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    sign = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(256)}


_TABLE = _byte_table()


class Encoder:
    """ids(text) gives the ids of a text as little-endian unsigned 32-bit integers, in bytes.

    A special token's string in a text becomes its id, as the library has it, or is ordinary text with `special_is_text`.
    """

    def __init__(self, path: str, special_is_text: bool = False, most_pieces: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_is_text
        self.specials = [] if special_is_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Vocabularies that drop white space need no care for its runs.
        self.spaces = getattr(self.tokenizer, "normalizer", None) is None
        self.most, self.cache, self.words = most_pieces, {"": b""}, {"": b""}
        self.model = self.tokenizer.model

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        """Puts the ids of new pieces into the cache."""
        other = [p for p in new if "\0" in p]
        plain = [*new.difference(other)] if other else [*new]
        found = _PLAIN.findall("\0".join(plain))[: len(plain)]
        letters, tails = [f[0] for f in found], [f[1] for f in found]
        if not self.spaces:
            letters = "\0".join(letters).lower().split("\0") if letters else letters
        words, tokenize = self.words, self.model.tokenize
        for w in {*letters, *tails}.difference(words):
            written = w.replace(" ", "Ġ") if w.isascii() else w.translate(_TABLE)
            words[w] = array("I", [t.id for t in tokenize(written)]).tobytes()
        self.cache.update(zip(plain, map(add, map(words.__getitem__, letters), map(words.__getitem__, tails)), strict=True))
        other += [p for p, f in zip(plain, found, strict=True) if f[2]]
        self.cache.update(zip(other, self._encode(other), strict=True))

    def _cut(self, text: str) -> list[str] | None:
        """Pieces whose ids make up the text's; None if it has to be encoded whole."""
        if any([x in text for x in self.specials]):
            return None
        odd = any([x in text for x in _DOUBLE]) or any([x in text for x in _ODD]) or not text.isascii() and _ODD_WIDE.search(text)
        if not odd:
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if self.spaces else text.replace("\n", " ").split(" ")
        if not self.spaces:
            return _SPACE.split(text)
        if _RUN.search(text):
            return None
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def many(self, texts: list) -> list[bytes]:
        """The ids of each text; a null text is empty."""
        cut = [self._cut(t or "") for t in texts]
        if len(self.cache) + len(self.words) > self.most:
            self.cache, self.words = {"": b""}, {"": b""}
        if new := set().union(*[c for c in cut if c]).difference(self.cache):
            self._learn(new)
        of = self.cache.__getitem__
        return [self._encode([t])[0] if c is None else b"".join(map(of, c)) for t, c in zip(texts, cut, strict=True)]

    def ids(self, text: str | None) -> bytes:
        return self.many([text])[0]


_ENCODERS: dict = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker and vocabulary."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
