"""Token ids of whole texts with a public tokenizer file.

Both vocabularies used here pre-split texts by a pattern whose matches never
run from a non-space character into white space. A text may therefore be cut
before any white-space run, and the parts' ids concatenate to the text's ids.
``UnitEncoder`` cuts texts into such units (a word with the white space before
it), encodes each distinct unit once with the tokenizers library and keeps the
ids in a bounded cache.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

#: fixed values: Unicode white space as the tokenizers' patterns define it
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: texts without other characters are split by the patterns below; all others go through the library unit by unit
OTHER = re.compile(f"[^\t-\r -~{LETTERS}]|<\\|")
#: fixed values: the pre-splitting patterns of the two vocabularies, over those characters
WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\t-\r 0-9{LETTERS}]+")
BYTE_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\t-\r 0-9{LETTERS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
CACHE_UNITS = 400_000
CACHE_CHARS = 200


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitEncoder:
    """Ids as little-endian unsigned 32-bit bytes.

    ``cache_units`` bounds the number of kept units and of kept word pieces.
    """

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        # the vocabulary with a normalizer drops white space and lower-cases
        self.drops_space = self.lib.normalizer is not None
        self.pieces = WORD_PIECES if self.drops_space else BYTE_PIECES
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        self.limit = cache_units
        self.units: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.alphabet = {c: self._mapped(chr(c)) for c in (*range(9, 14), *range(32, 127), *range(0xC0, 0x100))}

    def _mapped(self, char: str) -> str:
        """The model's form of a character, asked from the library's byte-level step."""
        from tokenizers.pre_tokenizers import ByteLevel

        return "".join(p for p, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(char))

    def library(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def _keep(self, known: dict[str, bytes], key: str, ids: list[int]) -> bytes:
        got = array("I", ids).tobytes()
        if len(key) <= CACHE_CHARS:
            if len(known) >= self.limit:
                known.clear()
            known[key] = got
        return got

    def _word(self, piece: str) -> bytes:
        return self._keep(self.words, piece, [t.id for t in self.lib.model.tokenize(piece.translate(self.alphabet))])

    def _unit(self, unit: str) -> bytes:
        return self._keep(self.units, unit, self.library(unit))

    def encode(self, text: str) -> bytes:
        if OTHER.search(text):
            known, make, parts = self.units, self._unit, UNIT.findall(text)
        else:
            known, make = self.words, self._word
            parts = self.pieces.findall(text.lower() if self.drops_space else text)
        return b"".join([known.get(x) or make(x) for x in parts])


@lru_cache(maxsize=4)
def encoder(path: str) -> UnitEncoder:
    """One encoder per worker process, kept between tasks."""
    return UnitEncoder(path)
