"""Byte-level BPE ids of whole texts with the tokenizers library, several times faster than text by text.

A pre-token of this vocabulary never spans from a non-space into a space, and its pattern looks ahead only
within white space. So a text may be cut before any space or line feed that follows a non-space, and the ids of
the pieces, joined, are the ids of the text. Pieces repeat, so each worker keeps their ids; the few that are new
go through the library's BPE model by pre-token, which also repeat. A piece outside plain Latin text goes
through the library's whole pipeline.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexmill.llm.common import chunks

#: Pieces and pre-tokens kept in each generation (two generations live), and the longest piece kept.
KEPT_PIECES = 50_000
KEPT_WORDS = 300_000
LONGEST = 64
#: New words whose tokens are objects at once.
STEP_WORDS = 8192
#: Bytes of texts cut into pieces at once.
CHUNK = 8 << 20

#: White space of any kind, each with a space after it: where a text isn't simply cut before its spaces.
_DOUBLED = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
_ANY_DOUBLED = "[" + "".join(f"\\x{{{ord(x[0]):x}}}" for x in _DOUBLED) + "] "
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_PLAIN = re.compile("[ \n\t!-~¡-ɏ]*")
#: The commonest shape, two pre-tokens or one: letters after at most one space, then ASCII punctuation.
_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]*)")
_WORD_AND_REST = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ɏ]{1,60})(?P<rest>[!-/:-@\[-`{-~]*)$"


def _packed(ids: list[int]) -> bytes:
    """As little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(moved)}


class _Recent(dict):
    """A dictionary of two generations: the older one goes when the newer is full."""

    def __init__(self, make, kept):
        super().__init__()
        self.make, self.kept, self.old = make, kept, {}

    def __missing__(self, key):
        found = self.old.pop(key, None) if self.old else None
        if found is None:
            found = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.kept:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class TextTokenizer:
    """``ids(text)``: the ids of a whole text as little-endian unsigned 32-bit integers.

    Added tokens such as <|endoftext|> in a text are plain text, or with ``added_tokens`` the ids that the library gives
    them by default; a text that holds one then goes through the library's whole pipeline.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        self.model = self.tokenizer.model
        # the pattern of byte-level pre-tokenization, a fixed value of the vocabulary
        self.pretokens = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.chars = _byte_chars()
        self.words = _Recent(self._word, KEPT_PIECES)
        self.pieces = _Recent(self._piece, KEPT_PIECES)
        self.latest: dict[str, bytes] = {}
        self.spaced = _Recent(lambda piece: self._piece(f" {piece}"), KEPT_PIECES)

    def _mapped(self, word: str) -> str:
        """A pre-token's bytes as the vocabulary's characters."""
        return word.replace(" ", self.chars[32]) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.chars)

    def _word(self, word: str) -> bytes:
        return _packed([t.id for t in self.model.tokenize(self._mapped(word))])

    def _piece(self, piece: str) -> bytes:
        words = self.words
        if len(piece) <= LONGEST:
            if m := _WORD.fullmatch(piece):
                word, rest = m.groups()
                return words[word] + words[rest] if rest else words[word]
            if _PLAIN.fullmatch(piece):
                return b"".join([words[w] for w in self.pretokens(piece)])
        return _packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(map(text.__contains__, self.added)):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if any(map(text.__contains__, _DOUBLED)):
            return b"".join(map(self.pieces.__getitem__, _CUT.split(text)))
        first, *rest = text.split(" ")
        return self.pieces[first] + b"".join(map(self.spaced.__getitem__, rest))

    def batches(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts one after another, ids of each text) of a column's rows in order, about CHUNK bytes at a time."""
        for texts in chunks(column, CHUNK):
            odd = pc.match_substring_regex(texts, _ANY_DOUBLED)
            for token in self.added:
                odd = pc.or_(odd, pc.match_substring(texts, token))
            # texts that aren't simply cut before their spaces count as one piece
            split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
            starts = split.offsets.to_numpy()
            starts, flat = starts - starts[0], split.flatten()
            pieces = flat.dictionary_encode()
            pool, sizes = self._spaced_pieces(pieces.dictionary)
            whole = [self.ids(t) for t in texts.filter(odd).to_pylist()][::-1]
            first = [whole.pop() if o else self.pieces[x] for o, x in zip(odd.to_pylist(), flat.take(pa.array(starts[:-1])).to_pylist(), strict=True)]
            code = pieces.indices.to_numpy().astype(np.int64)
            code[starts[:-1]] = np.arange(len(first)) + len(sizes)
            ids, each = _taken(np.concatenate([pool, np.frombuffer(b"".join(first), dtype="<u4")]), np.concatenate([sizes, _sizes(first)]), code)
            yield ids, np.diff(np.concatenate([[0], np.cumsum(each)])[starts])

    def _spaced_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, ids of each piece) of different pieces that follow a space.

        Most are a word and punctuation, and words repeat with other punctuation, so the two are looked up apart.
        """
        parts = pc.extract_regex(pieces, _WORD_AND_REST)
        usual = parts.is_valid().to_numpy(zero_copy_only=False)
        held = [pc.struct_field(parts.filter(pa.array(usual)), k).dictionary_encode() for k in (0, 1)]
        rest = [self.spaced[x] for x in pieces.filter(pa.array(~usual)).to_pylist()]
        known = [b"", *self._spaced_words(held[0].dictionary.to_pylist()), *map(self.pieces.__getitem__, held[1].dictionary.to_pylist()), *rest]
        code = np.zeros((len(pieces), 2), dtype=np.int64)
        code[usual, 0] = held[0].indices.to_numpy() + 1
        code[usual, 1] = held[1].indices.to_numpy() + 1 + len(held[0].dictionary)
        code[~usual, 0] = np.arange(len(rest)) + len(known) - len(rest)
        ids, each = _taken(np.frombuffer(b"".join(known), dtype="<u4"), _sizes(known), code.ravel())
        return ids, each.reshape(-1, 2).sum(axis=1)


    def _spaced_words(self, words: list[str]) -> list[bytes]:
        """The ids of different words of letters, each after a space."""
        if len(self.latest) > KEPT_WORDS:
            self.latest.clear()
        found = list(map(self.latest.get, words))
        new = [w for w, x in zip(words, found, strict=True) if x is None]
        space, made = self.chars[32], []
        for s in range(0, len(new), STEP_WORDS):
            tokens = [self.model.tokenize(space + w if w.isascii() else self._mapped(f" {w}")) for w in new[s : s + STEP_WORDS]]
            packed = np.fromiter(map(_ID, chain.from_iterable(tokens)), dtype="<u4").tobytes()
            ends = [0, *accumulate(4 * len(t) for t in tokens)]
            made += [packed[a:b] for a, b in pairwise(ends)]
        self.latest.update(zip(new, made, strict=True))
        each = iter(made)
        return [next(each) if x is None else x for x in found]


def _sizes(packed: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4


def _taken(pool: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the entries that ``code`` names, one after another, and the size of each) of entries that lie in the pool one after another."""
    each = sizes[code]
    upto = np.cumsum(each)
    total = int(upto[-1]) if len(upto) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    at = np.repeat(((np.cumsum(sizes) - sizes)[code] - (upto - each)).astype(kind), each)
    at += np.arange(total, dtype=kind)
    return pool[at], each


_ID = attrgetter("id")
_loaded: dict[str, TextTokenizer] = {}


def loaded(path: str) -> TextTokenizer:
    """One tokenizer for each worker process, with the library's ids of added tokens."""
    if path not in _loaded:
        _loaded[path] = TextTokenizer(path, added_tokens=True)
    return _loaded[path]
