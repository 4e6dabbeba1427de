"""Whole-text tokenisation with bounded caches of pieces and words."""

from __future__ import annotations

import codecs
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import regex

#: White-space-delimited pieces, and pre-tokenized words, that a worker remembers: the last
#: so many, to twice as many.
CACHE_PIECES, CACHE_WORDS = 500_000, 200_000
#: Characters that are cut into pieces at once, where a text has spaces.
SPAN_CHARS = 1 << 18
#: New words that go to the library at once.
CALL_WORDS = 256
#: Longer pieces and words are encoded but not remembered.
CACHE_CHARS = 40
MARKS = ",.;:!?&$%*#"
#: Bytes that words of a vocabulary that keeps spaces can have before them in one call.
SEPARATORS = (32, 10)
#: Where a text has none of these, its single spaces are between other characters.
OTHER_SPACE = ("  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))

#: The pre-tokenizers' patterns of the two kinds of vocabulary.
SPACE_KEPT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_DROPPED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself
    where it prints, else the next unused from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Remembered:
    """Strings to their ids, in a younger half and an older one. Plain dictionaries: sets are
    compared with these at once."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, asked: set[str]) -> set[str]:
        """Those that aren't remembered; the others are in the younger half now."""
        absent = asked.difference(self.young)
        new = absent.difference(self.old)
        old = self.old
        self.young.update({x: old[x] for x in absent - new})
        return new

    def trim(self, added: set[str], most: int) -> None:
        """Forget what is too long of what was added, and the older half where the younger is
        full."""
        if max(map(len, added), default=0) > CACHE_CHARS:
            for x in added:
                if len(x) > CACHE_CHARS:
                    self.young.pop(x, None)
        if len(self.young) > most:
            self.young, self.old = {}, self.young


class PieceEncoder:
    """Ids of whole texts by a tokenizers file, the same as encode(text,
    add_special_tokens=False).

    Neither kind of vocabulary merges across a single space between two other characters
    that aren't white space: the pre-tokenizer starts a new match there. So a text is cut at
    those spaces, in parts where it is long, each distinct piece is split into words by the
    pre-tokenizer's pattern, and each distinct word encoded by the library's model; new words
    of many texts go to the library at once. drop_space: the vocabulary drops white space and
    case; otherwise a piece after the first keeps its leading space. The vocabulary's special
    strings are ordinary text."""

    def __init__(self, path: str, drop_space: bool, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.drop_space, self.end = drop_space, np.array([end], "<u4").tobytes()
        self.letters = byte_letters()
        self.words, self.pieces = Remembered(), Remembered()
        # The model alone: no normalizer, pre-tokenizer or special strings. A word's last id is
        # of a token with the vocabulary's suffix, if it has one.
        self.bare, suffix = Tokenizer(self.model), getattr(self.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if drop_space and suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        # Words may go to the model as one where it has no rule for a word's ends.
        special = ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")
        self.joins = not drop_space and not any(getattr(self.model, x, True) for x in special)
        self.starts = {sep: np.zeros(len(self.ends), bool) for sep in SEPARATORS}
        if self.joins:
            space, line = map(self.letters.__getitem__, SEPARATORS)
            for t, i in self.tokenizer.get_vocab().items():
                self.starts[32][i], self.starts[10][i] = t.startswith(space), t == line
        self.byte_map = "".join(self.letters[b] for b in range(256))
        self.beyond_latin = re.compile("[^\x00-\u024f]").search
        self.find = regex.compile(SPACE_DROPPED if drop_space else SPACE_KEPT).findall
        self.gap = re.compile(r"(?<=\S) (?=\S)").search
        self.apart = re.compile(r"(?<=\S) (?=\S)").split
        self.ids = [np.array([i], "<u4").tobytes() for i in range(self.tokenizer.get_vocab_size())]

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():  # such bytes but the space stand for themselves
            mapped = word.replace(" ", self.letters[32])
        else:
            mapped = "".join(map(self.letters.__getitem__, word.encode()))
        found = self.model.tokenize(mapped)
        return self.ids[found[0].id] if len(found) == 1 else b"".join([self.ids[t.id] for t in found])

    def _letters(self, text: str) -> str:
        """The letters of the text's bytes."""
        return codecs.charmap_decode(text.encode(), "strict", self.byte_map)[0]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each of some words of letters, as _word makes them; with a space before each
        if the vocabulary keeps it."""
        if not self.drop_space:
            return self._joined(words, 32)
        out: list[bytes] = []
        for a in range(0, len(words), CALL_WORDS):
            some = words[a : a + CALL_WORDS]
            mapped = [w if w.isascii() else self._letters(w) for w in some]
            (found,) = self.bare.encode_batch_fast([mapped], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):  # no suffix, or letters that the vocabulary lacks
                out.extend(map(self._word, some))
                continue
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            out.extend([raw[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)])
        return out

    def _joined(self, words: list[str], sep: int) -> list[bytes]:
        """Ids of each of some words without white space, as _word makes them: after a space if
        `sep` is 32, alone if it is 10, a line feed. Words go to the model as one, a separator
        before each. As many ids that start with a space, or are a line feed, as there are words
        show that nothing merged across."""
        out: list[bytes] = []
        before, lead, skip = chr(sep), " " if sep == 32 else "", 4 * (sep != 32)
        for a in range(0, len(words), CALL_WORDS):
            some = words[a : a + CALL_WORDS]
            if self.joins:
                (found,) = self.bare.encode_batch_fast([self._letters(before + before.join(some))], add_special_tokens=False)
                ids = np.array(found.ids, "<u4")
                starts = np.flatnonzero(self.starts[sep][ids])
                if len(starts) == len(some) and starts[0] == 0:
                    raw, starts = ids.tobytes(), (4 * starts).tolist()
                    out.extend([raw[s + skip : e] for s, e in zip(starts, [*starts[1:], len(raw)], strict=True)])
                    continue
            out.extend([self._word(lead + w) for w in some])
        return out

    def _make_words(self, asked: set[str]) -> set[str]:
        """Have the ids of all these words, as the pattern finds them, in self.words."""
        new = self.words.missing(asked)
        if self.joins:
            after = [w[1:] for w in new if w[0] == " " and len(w) > 1 and not w.isspace()]
            alone = [w for w in new if not w[0].isspace()]
            self.words.young.update(zip([" " + w for w in after], self._joined(after, 32), strict=True))
            self.words.young.update(zip(alone, self._joined(alone, 10), strict=True))
        for w in new:
            if w not in self.words.young:
                self.words.young[w] = self._word(w)
        return new

    def _whole(self, strings: list[str], marks: set[str]) -> dict[str, bytes]:
        """Ids of pieces of any kind with what is before them, and of marks, from their words."""
        if self.drop_space:
            plain = [x.lower() if x.isascii() else self.normalizer.normalize_str(x) for x in strings]
        else:
            plain = strings
        # The pattern's libraries differ on unassigned characters.
        found = [None if max(x, default="") > "\uffff" else self.find(x) for x in plain]
        new = self._make_words(marks.union(*filter(None, found)))
        known = self.words.young
        out = {m: known[m] for m in marks}
        for x, p, words in zip(strings, plain, found, strict=True):
            if words is None:
                out[x] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                out[x] = b"".join([known[w] for w in words])
        self.words.trim(new, CACHE_WORDS)
        return out

    def _learn(self, new: set[str], firsts: list[str]) -> dict[str, bytes]:
        """Have the ids of the new pieces in self.pieces; ids of texts' first pieces. Most
        pieces are a word of Latin letters, perhaps with marks after it; lower case is all that
        the normalizer makes of such letters."""
        known = self.pieces.young
        marked, words, marks, odd = [], [], [], []  # flat lists: tuples would keep the collector busy
        plain = [p for p in new if p.isalpha() and (p.isascii() or max(p) < "\u0250") and not (self.drop_space and p != p.lower())]
        for piece in new.difference(plain):
            if piece.isascii() or max(piece) < "\u0250":
                low = piece.lower() if self.drop_space else piece
                word = low.rstrip(MARKS)
                if word.isalpha():
                    marked.append(piece), words.append(word), marks.append(low[len(word) :])
                    continue
            odd.append(piece)
        more = self.pieces.missing(set(words) - new)
        plain.extend(more)
        known.update(zip(plain, self._words(plain), strict=True))
        led = odd if self.drop_space else [p if p[:1] == "\n" else " " + p for p in odd]
        whole = self._whole([*led, *firsts], set(marks) - {""})
        for piece, word, mark in zip(marked, words, marks, strict=True):
            known[piece] = known[word] + whole[mark] if mark else known[word]
        known.update(zip(odd, map(whole.__getitem__, led), strict=True))
        new |= more
        return whole

    def _cut(self, text: str) -> list[str]:
        """The text cut at single spaces between characters that aren't white space. Where it
        has no other white space than such line feeds, it is cut before these too; no other
        piece begins with one."""
        if text[:1] == " " or text[-1:] == " " or any(x in text for x in OTHER_SPACE):
            return self.apart(text)
        return text.replace("\n", " \n").split(" ")

    def _parts(self, text: str) -> Iterator[str]:
        """The text in parts that begin, but for the first, with a space to cut at."""
        at = 0
        while len(text) - at > SPAN_CHARS:
            m = self.gap(text, at + SPAN_CHARS)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def settle(self) -> None:
        """Forget the older halves: an idle worker keeps the younger ones for its next task."""
        self.pieces.old.clear()
        self.words.old.clear()

    def _join(self, held: list[list[str] | str | None], head: list[bytes]) -> Iterator[bytes]:
        """Ids of the texts whose pieces are held, each closed by a None; first pieces that
        nothing is before are strings. `head` has the ids of the open text's earlier parts."""
        new = self.pieces.missing(set().union(*(x for x in held if isinstance(x, list))))
        firsts = self._learn(new, [x for x in held if isinstance(x, str)])
        known = self.pieces.young.__getitem__
        for x in held:
            if x is None:
                yield b"".join([*head, self.end])
                head.clear()
            else:
                head.append(firsts[x] if isinstance(x, str) else b"".join(map(known, x)))
        self.pieces.trim(new, CACHE_PIECES)

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id; new words of about
        SPAN_CHARS characters are made together."""
        held, head, size = [], [], 0
        for text in texts:
            for i, part in enumerate(self._parts(text)):
                if self.drop_space:
                    part = part.replace("\n", " ")
                    held.append((part if self.beyond_latin(part) else part.lower()).split(" "))
                elif i:
                    held.append(self._cut(part[1:]))
                else:
                    first, *pieces = self._cut(part)
                    held.append(first), held.append(pieces)
                size += len(part) + 1
                if size >= SPAN_CHARS:
                    yield from self._join(held, head)
                    held, size = [], 0
            held.append(None)
        yield from self._join(held, head)

    def encode(self, text: str) -> bytes:
        """encode_all() of one text."""
        (ids,) = self.encode_all([text])
        return ids


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str, drop_space: bool, end: int) -> PieceEncoder:
    """The worker's encoder for a file; it lives as long as the worker."""
    key = (path, drop_space, end)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]
