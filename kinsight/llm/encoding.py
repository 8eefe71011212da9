"""Whole-text tokenising at the speed of a dictionary lookup per word.

The ids are those of the ``tokenizers`` library: each distinct chunk of text is encoded by it once and remembered.
A chunk ends where the tokenizer's own pre-tokeniser must cut as well, so joining the chunks' ids gives the ids of
the whole text. What is remembered is bounded.
"""

from __future__ import annotations

import codecs
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kinsight.llm.common import remembered

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_RAGGED = re.compile(r"\s | \s")
_ENDINGS = ".,;:!?"
#: Marks that the tokenizer which drops white space parts from a word in front, and keeps together: all of ASCII's but
#: the one that begins contractions.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters up to U+024F; of these only U+0130 has a lower case that is more than a letter.
LATIN = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"


def _byte_alphabet() -> list[str]:
    """Byte-level tokenizers write printable bytes as themselves and the others as characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class TwoGenerations:
    """A bounded memory: what is looked up is put into ``new`` and stays, what wasn't looked up for a whole generation
    goes."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def age(self) -> None:
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}


def _edged(column: pa.LargeStringArray, strings: list[str]) -> np.ndarray:
    """Which strings are empty, begin with white space or end with it. ``column`` holds the same strings."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    out = at[1:] == at[:-1]
    if data is not None and len(data):
        codes, some = np.frombuffer(data, np.uint8), np.flatnonzero(~out)
        ends = np.stack([codes[at[some]], codes[at[some + 1] - 1]])
        for i in some[((ends <= 32) | (ends >= 127)).any(axis=0)].tolist():  # all others have visible ASCII at both ends
            out[i] = strings[i][0].isspace() or strings[i][-1].isspace()
    return out


def gathered(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of ``pool``, one after the other."""
    ends = np.cumsum(size)
    return pool[np.arange(int(size.sum())) + np.repeat(first - (ends - size), size)]


class ChunkEncoder:
    """Calls take texts and return their ids as little-endian unsigned integers of four bytes, or of two.

    ``spaces_kept`` tells the two kinds of tokenizer apart: byte-level ones put a space in front of the word that
    follows it (chunks then carry it; texts where a space touches other white space are encoded whole, because
    there the cut depends on the run), the others drop white space (chunks then are what lies between spaces).
    Chunks of Latin letters, with or without closing punctuation, are a word and a mark to either tokenizer, and go
    straight to its merge rules; all others go through the whole tokenizer. Texts are cut, and their distinct chunks
    numbered, by Arrow for many texts at once; only distinct chunks are looked up one by one. Where white space is
    dropped, case is too, and chunks are parted into words in lower case and closing marks by Arrow first: only distinct
    ones of these are looked up.
    """

    def __init__(self, path: str, spaces_kept: bool, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.alphabet = self.tokenizer.model, "".join(_byte_alphabet())
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaces_kept, self.front = spaces_kept, " " if spaces_kept else ""
        self.front_mark = "".join(self.alphabet[b] for b in self.front.encode())
        self.code = "H" if self.tokenizer.get_vocab_size() <= 65536 else "I"  # how ids are remembered
        self.chunks, self.endings = TwoGenerations(limit), {}

    def whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in encoded]

    def word(self, word: str) -> bytes:
        if word.isascii():  # printable bytes are written as themselves
            return array(self.code, [t.id for t in self.model.tokenize(self.front_mark + word)]).tobytes()
        return self.merged(self.front + word)

    def merged(self, text: str) -> bytes:
        spelled = codecs.charmap_decode(text.encode(), "strict", self.alphabet)[0]
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def __call__(self, texts: list[str], width: int = 4, together: int = 4_000_000) -> list[bytes]:
        out, begin, held = [], 0, 0
        for end in range(1, len(texts) + 1):
            held += len(texts[end - 1])
            if held >= together or end == len(texts):
                out += self._group(texts[begin:end], f"<u{width}")
                self.chunks.age()
                begin, held = end, 0
        return out

    def _group(self, texts: list[str], kind: str) -> list[bytes]:
        """Everything in these texts that is not known yet is encoded first."""
        heads, tails = [], []  # what is encoded as it stands, and what is cut at its spaces
        for text in texts:
            if any(s in text for s in self.specials):
                head, tail = text, None
            elif self.spaces_kept:
                head, space, tail = text.partition(" ")
                tail = tail if space else None
            else:
                head, tail = "", text.replace("\n", " ")
            heads.append(head)
            tails.append(tail)
        cut = pc.split_pattern(pa.array(tails, pa.large_string()), " ")
        counts = pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False)
        numbered = cut.flatten().dictionary_encode()
        number = numbered.indices.to_numpy()
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if self.spaces_kept:
            chunks = numbered.dictionary.to_pylist()
            edged = _edged(numbered.dictionary, chunks)
            before = np.concatenate([[0], np.cumsum(edged[number])])[bounds]
            for i, text in enumerate(texts):
                if (before[i + 1] > before[i] or heads[i][-1:].isspace()) and tails[i] is not None and _RAGGED.search(text):
                    heads[i], tails[i] = text, None
            pool, size = self._pool(self._known(chunks))
        else:
            pool, size = self._parted(numbered.dictionary)
        sizes = size[number]
        ids = gathered(pool, (np.cumsum(size) - size)[number], sizes).astype(kind)
        place = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        fronts = self.whole(heads)
        if not kind.endswith(str(array(self.code).itemsize)):
            fronts = [np.frombuffer(f, pool.dtype).astype(kind).tobytes() for f in fronts]
        return [
            front if tail is None else front + ids[place[i] : place[i + 1]].tobytes()
            for i, (front, tail) in enumerate(zip(fronts, tails, strict=True))
        ]

    def _pool(self, known: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each has."""
        width = array(self.code).itemsize
        return np.frombuffer(b"".join(known), f"<u{width}"), np.fromiter(map(len, known), np.int64, len(known)) // width

    def _parted(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """``_pool`` of distinct chunks, for the tokenizer that drops white space and case. A chunk of Latin letters and
        closing marks is a word in lower case and an ending; any other chunk stands for itself."""
        words = pc.utf8_rtrim(chunks, characters=_MARKS)
        plain = pc.match_substring_regex(words, LATIN + "$")
        units = pc.if_else(plain, pc.utf8_lower(words), chunks).dictionary_encode()
        marked = pc.and_(plain, pc.not_equal(words, chunks))
        endings = pc.replace_substring_regex(chunks.filter(marked), LATIN, "").dictionary_encode()
        unit, plain, marked = units.indices.to_numpy(), plain.to_numpy(zero_copy_only=False), marked.to_numpy(zero_copy_only=False)
        is_word = np.zeros(len(units.dictionary), bool)
        is_word[unit] = plain
        known = self._units(units.dictionary.to_pylist(), is_word.tolist())
        both = np.full((len(chunks), 2), len(known))  # what each chunk consists of; the first of the rest is empty
        both[:, 0] = unit
        both[marked, 1] = len(known) + 1 + endings.indices.to_numpy()
        pool, size = self._pool([*known, b"", *map(self._ending, endings.dictionary.to_pylist())])
        return gathered(pool, (np.cumsum(size) - size)[both.ravel()], size[both.ravel()]), size[both].sum(axis=1)

    def _units(self, units: list[str], is_word: list[bool]) -> list[bytes]:
        """The ids of words in lower case, and of other chunks as they are."""
        new, old, odd = self.chunks.new, self.chunks.old, []
        tokenize, code = self.model.tokenize, self.code
        found = list(map(new.get, units))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            unit = units[i]
            if old and (ids := old.get(unit)) is not None:
                pass
            elif not is_word[i]:
                odd.append(i)
                continue
            elif unit.isascii():  # printable bytes are written as themselves
                ids = array(code, [t.id for t in tokenize(unit)]).tobytes()
            else:
                ids = self.merged(unit)
            found[i] = new[unit] = ids
        for i, ids in zip(odd, self.whole([units[i] for i in odd]), strict=True):
            found[i] = new[units[i]] = ids
        return found

    def _latin(self, word: str) -> bool:
        return word.isalpha() and (word.isascii() or max(word) < "\u0250")

    def _known(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks, for the tokenizer that keeps white space."""
        new, old, odd = self.chunks.new, self.chunks.old, []
        front, tokenize, code = self.front_mark, self.model.tokenize, self.code
        found = list(map(new.get, chunks))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            chunk = chunks[i]
            if old and (ids := old.get(chunk)) is not None:
                pass
            elif chunk.isascii() and chunk.isalpha():  # as ``word`` does, for most chunks are new and plain words
                ids = array(code, [t.id for t in tokenize(front + chunk)]).tobytes()
            elif (ids := self._plain(chunk)) is None:
                odd.append(i)
                continue
            found[i] = new[chunk] = ids
        for i, ids in zip(odd, self.whole([self.front + chunks[i] for i in odd]), strict=True):
            found[i] = new[chunks[i]] = ids
        return found

    def _plain(self, chunk: str) -> bytes | None:
        """The ids of a word with or without closing punctuation; of two such with a line's end between them; None for
        any other chunk."""
        if self._latin(chunk):
            return self.word(chunk)
        line, end, rest = chunk.partition("\n")
        word = line.rstrip(_ENDINGS)
        if not self._latin(word):
            return None
        tail = b""
        if end:
            start = rest.rstrip(_ENDINGS)
            if not self._latin(start):
                return None
            tail = self._ending(end) + self.merged(start) + (self._ending(rest[len(start) :]) if len(start) < len(rest) else b"")
        ids = self.chunks.new.get(word)
        if ids is None:
            ids = self.chunks.new[word] = self.word(word)
        return ids + (self._ending(line[len(word) :]) if len(word) < len(line) else b"") + tail

    def _ending(self, marks: str) -> bytes:
        if marks not in self.endings:
            if len(self.endings) > 1000:
                self.endings.clear()
            self.endings[marks] = self.merged(marks)
        return self.endings[marks]


def encoder(path: str, spaces_kept: bool) -> ChunkEncoder:
    """One encoder per Python worker and file."""
    known = remembered("encoding")
    if (path, spaces_kept) not in known:
        known[path, spaces_kept] = ChunkEncoder(path, spaces_kept)
    return known[path, spaces_kept]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
