"""Token ids of whole texts by a public tokenizer file, inside tasks."""

from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Iterable, Iterator

VOCABULARY = "word_bpe_49k.json"
#: Words that a worker remembers, and the longest of them: these bound its memory.
REMEMBERED, LONGEST = 3 << 18, 64


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _stays_letter(c: str) -> bool:
    """Latin letters that are one letter also when normalised and in lower case."""
    return c < "\u0250" and c != "\u0130" and c.isalpha()


class Encoder(dict):
    """Ids as little-endian unsigned 32-bit integers, equal to the library's for whole texts.

    Holds for tokenizers that lower-case, take runs of letters by themselves and drop white
    space. Texts are cut at blanks and line feeds, each distinct word is encoded once by the
    library, and ids are put together from memory. A mark behind a letter is cut off first, and
    ASCII words are lower-cased, so that fewer words are distinct. Words of Latin letters alone are
    one piece, so they go to the library's model at once, in the form that each letter gets there.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = self._letters()

    def _letters(self) -> dict[int, str]:
        """What the model gets for a letter; none where a token of letters is matched before."""
        found = {}
        for c in filter(_stays_letter, map(chr, range(0x250))):
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(c))
            if len(pieces) == 1:
                found[ord(c)] = pieces[0][0]
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        return {} if any(all(ord(c) in found for c in t) for t in added) else found

    def __missing__(self, word: str) -> bytes:
        if len(word) > 1 and word[-1] in ",." and _stays_letter(word[-2]):
            ids = self[word[:-1]] + self[word[-1]]
        elif word.isascii() and word != word.lower() and "<" not in word:
            ids = self[word.lower()]
        elif word and self.letters.keys() >= set(map(ord, word)):
            pieces = self.model.tokenize(word.translate(self.letters))
            ids = array("I", [piece.id for piece in pieces]).tobytes()
        else:
            ids = array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text; a null text has none."""
        for text in texts:
            if len(self) > REMEMBERED:
                self.clear()
            yield b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" ")))


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
