"""Splitting texts as the two public BPE vocabularies do, and encoding single words.

Texts of ASCII and the letters up to U+017F are split by an equivalent expression of our own; any other text, and
any with a special token in it, goes through the tokenizers library itself. So results equal the library's on
every text, whatever its Unicode version.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_SPACE = r" \t-\r"
#: Characters on whose class our expressions and the library agree: no controls beyond white space, no NBSP, no
#: superscripts, fractions or ordinals.
_SAFE = re.compile("[\\t-\\r -~¡-©«-±´¶-¸»¿-ſ]*")
_BYTE_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACE}{_LETTERS}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WORD_END = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_SPACE}{_LETTERS}0-9]+")


def byte_symbols() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable character: printable Latin-1 as itself, the others from
    U+0100 on."""
    kept = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Splitter:
    """words(text): the pre-tokens in order, whose ids, joined, are the text's ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self._special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        self._symbols = {chr(b): s for b, s in byte_symbols().items()}
        self._ascii = str.maketrans({chr(b): s for b, s in byte_symbols().items() if b < 128})
        self.lower = self.library.normalizer is not None

    def words(self, text: str) -> list[str]:
        if _SAFE.fullmatch(text) and not self._special.search(text):
            if not self.lower:
                return _BYTE_LEVEL.findall(text)
            return _WORD_END.findall(unicodedata.normalize("NFC", text).lower())
        found, at = [], 0
        for m in self._special.finditer(text):
            found += self._slow(text[at : m.start()])
            found.append(m.group())
            at = m.end()
        return found + self._slow(text[at:])

    def _slow(self, text: str) -> list[str]:
        if not text:
            return []
        body = self.library.normalizer.normalize_str(text) if self.lower else text
        return [body[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(body)]

    def encode(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        if word in self.specials:
            return [self.specials[word]]
        if word.isascii():
            mapped = word.translate(self._ascii)
        else:
            mapped = "".join([self._symbols[c] for c in word.encode("utf-8").decode("latin-1")])
        return [t.id for t in self.library.model.tokenize(mapped)]


@lru_cache(maxsize=4)
def splitter(path: str) -> Splitter:
    """One a worker."""
    return Splitter(path)


@lru_cache(maxsize=4)
def pieces(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, by id."""
    lib, back = splitter(path), {s: b for b, s in byte_symbols().items()}
    table = [b""] * lib.library.get_vocab_size(with_added_tokens=True)
    for piece, i in lib.library.get_vocab(with_added_tokens=True).items():
        table[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
    return table
