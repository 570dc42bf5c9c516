"""Exact tokenising with a word cache.

Both public tokenizers used here split a text into stretches whose ids don't depend on what stands around them: the
lower-casing one at white space, the byte-level one before a single space that leads a word. The ids of each stretch are
kept per Python worker, so a frequent word is tokenised once. Texts go in groups: each distinct stretch of a group is looked up
once and its ids are dealt to its places by array. New words of plain letters go to the tokenizer's model alone, many at a time,
which is what normalising and splitting would leave of them; any other new stretch goes to the tokenizer. Texts with characters that Python and
the tokenizer class differently, or with a special token's string, go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of each of a cache's two generations.
GENERATION = 250_000
#: Longer stretches are tokenised without being kept.
CACHE_CHARS = 48
#: Characters of texts whose stretches are looked up together; a group ends with the text that reaches them.
GROUP_CHARS = 4 << 20
#: Texts whose ids are dealt together, and new words that go to the model together.
DEALT_TEXTS, BATCH_WORDS = 64, 4_096

#: Characters that Python and the tokenizers class differently, and the start of special tokens.
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")
_LETTERS, _SIGNS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-/:-@\[-^`{-~]+"
_WORD = re.compile(_LETTERS)
#: What a text of words with one space or line end between them doesn't hold; white space of _ODD is not listed.
_GAPS = ("  ", " \n", "\n ", "\n\n", *"\t\v\f\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
#: Signs that end a stretch after a letter are tokenised apart; other stretches stay whole.
_END_SIGNS = f"({_LETTERS[:-1]})({_SIGNS})( |$)"
#: The byte-level split with any run of non-space in the place of its finer classes, which only split such runs further.
_BYTE_LEVEL = re.compile(rf" ?{_LETTERS}(?=(?:{_SIGNS})?(?:\s|$))|{_SIGNS}(?=\s|$)| ?\S+|\s+(?!\S)|\s+")
#: The character that stands for each byte in byte-level vocabularies: itself if it shows, else one from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = "".join(chr(b) if b in _SHOWN else chr(256 + sum(c not in _SHOWN for c in range(b))) for b in range(256))
_open: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def _lower(text: str) -> str:
    """text in lower case where that is the tokenizer's own lower case, for fewer stretches to know."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class _Known(dict):
    """Ids by stretch, made where they are not known yet; those of the generation before come back as they are asked for.

    make gives the ids and whether they are worth an entry.
    """

    def __init__(self, make: Callable[[str], tuple[bytes, bool]]):
        self.make, self.older = make, {}

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part)
        if found is None:
            found, keep = self.make(part)
            if not keep or len(part) > CACHE_CHARS:
                return found
        self[part] = found
        return found

    def turn(self) -> None:
        self.older = dict(self)
        self.clear()


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alone = Tokenizer(self.model)
        self.alone.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.drops_space = self._direct("a b") == self._direct("a  b")
        self.lowers = self._direct("AÉ") == self._direct("aé")
        # words that stand bare, words led by a space, and stretches with whatever leads them
        self.bare, self.led, self.parts = _Known(partial(self._stretch, False)), _Known(partial(self._stretch, True)), _Known(self._part)
        # the ids that end a word, or those that begin one led by a space
        self.edge = np.zeros(self.vocabulary, bool)
        self.edge[[i for t, i in self.tokenizer.get_vocab().items() if (t.endswith("</w>") if self.drops_space else t.startswith(_BYTES[32]))]] = True
        tried = ["a", "Hello", "ÀÉîõüÿ", "straßentheorie"]
        self.plain = all(self._word(w, led) == self._direct(f" {w}" if led else w) for w in tried for led in (False, not self.drops_space))
        size, ids = self._words(tried)
        alone = [self._word(w, not self.drops_space) for w in tried]
        self.many = self.plain and size.tolist() == [len(x) // 4 for x in alone] and ids.tobytes() == b"".join(alone)
        # of stretches between spaces: their number by stretch, and by number where their ids begin and how many they are
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str, led: bool = False) -> bytes:
        """The ids of a word of plain letters, led by a space or not, by the model alone."""
        shown = word.lower() if self.lowers else word
        if not shown.isascii():
            shown = shown.encode().decode("latin-1").translate(_BYTES)
        ids = [t.id for t in self.model.tokenize(_BYTES[32] + shown if led else shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each of some words of plain letters between spaces, and all their ids, by the model alone."""
        between, made = "\n" if self.drops_space else "\n ", [np.zeros(0, "<u4")]
        for i in range(0, len(words), BATCH_WORDS):
            text = between[1:] + between.join(words[i : i + BATCH_WORDS])
            made.append(np.array(self.alone.encode_batch_fast([text.lower() if self.lowers else text], add_special_tokens=False)[0].ids, "<u4"))
        ids = np.concatenate(made)
        at = np.flatnonzero(self.edge[ids])
        return np.diff(at, prepend=-1) if self.drops_space else np.diff(at, append=len(ids)), ids

    def _stretch(self, led: bool, word: str) -> tuple[bytes, bool]:
        if self.plain and _WORD.fullmatch(word):
            return self._word(word, led), True
        return self._direct(f" {word}" if led else word), True

    def _part(self, part: str) -> tuple[bytes, bool]:
        if part.isspace():
            return self._direct(part), True
        return self.led[part[1:]] if part[0] == " " else self.bare[part], False

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is the empty text."""
        group: list[bytes | str] = []  # ids already, or a text to split at spaces
        held = 0
        for text in texts:
            text = text or ""
            if any(odd in text for odd in _ODD):
                group.append(self._direct(text))
            elif self.drops_space:
                group.append(_lower(text).replace("\n", " "))
            elif text.strip(" \n") == text != "" and not any(gap in text for gap in _GAPS):  # words with one space or line end between them
                group.append("\r" + text.replace("\n", " \n \r"))
            else:
                group.append(b"".join(map(self.parts.__getitem__, _BYTE_LEVEL.findall(text))))
            held += len(text)
            if held >= GROUP_CHARS:
                yield from self._grouped(group)
                group, held = [], 0
        yield from self._grouped(group)

    def _grouped(self, group: list[bytes | str]) -> Iterator[bytes]:
        """The ids of each text of a group; those that are ids already stay."""
        caches = (self.bare, self.led, self.parts)
        if sum(map(len, caches)) >= GENERATION:  # what was not asked for since the last time goes
            for c in caches:
                c.turn()
        texts = [x for x in group if isinstance(x, str)]
        spans = self._spans(texts) if texts else iter(())
        for x in group:
            yield next(spans) if isinstance(x, str) else x

    def _spans(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts whose stretches lie between spaces; where spaces count, \\r leads those that have none before them and \\t signs set apart."""
        apart = pc.replace_substring_regex(pa.array(texts, pa.large_string()), _END_SIGNS, r"\1 \2\3" if self.drops_space else "\\1 \t\\2\\3")
        split = pc.split_pattern(apart, " ")
        coded, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        del apart, split
        numbers, which = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False)), coded.indices.to_numpy()
        for i in range(0, len(texts), DEALT_TEXTS):
            own = offsets[i : i + DEALT_TEXTS + 1]
            at = numbers[which[own[0] : own[-1]]]
            size = self.size[at]
            ids, ends = self._dealt(at, size).tobytes(), np.concatenate([[0], np.cumsum(size)])
            cuts = (4 * ends[own - own[0]]).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield ids[a:b]

    def _dealt(self, which: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of stretches by number, one after another."""
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.first[which] - ends + size, size) + np.arange(size.sum())]

    def _numbers(self, words: np.ndarray) -> np.ndarray:
        """The numbers of distinct stretches; new ones get the next."""
        if len(self.known) >= GENERATION or len(self.ids) >= 16 * GENERATION:  # what is not asked for now goes
            held = [w for w in words if w in self.known]
            at = np.array([self.known[w] for w in held], np.int64)
            self.ids, self.size = self._dealt(at, self.size[at]), self.size[at]
            self.first = np.cumsum(self.size) - self.size
            self.known.clear()
            self.known.update(zip(held, range(len(held)), strict=True))
        start = len(self.known)
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        new = words[numbers >= start]
        plain = np.fromiter((self.many and _WORD.fullmatch(w) is not None for w in new), bool, len(new))
        made = [self._one(w) for w in new[~plain]]
        sizes, ids = self._words(new[plain].tolist())
        size = np.zeros(len(new), np.int64)
        size[plain], size[~plain] = sizes, [len(x) // 4 for x in made]
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        first = np.zeros(len(new), np.int64)
        first[order] = len(self.ids) + np.cumsum(size[order]) - size[order]
        self.first, self.size = np.concatenate([self.first, first]), np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids, np.frombuffer(b"".join(made), "<u4")])
        return numbers

    def _one(self, word: str) -> bytes:
        if self.drops_space:
            return self.bare[word]
        return self.parts[word] if word == "\n" else self.bare[word[1:]] if word[0] in "\r\t" else self.led[word]

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_many([text]))


def public(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
