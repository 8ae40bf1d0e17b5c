"""Encoding texts by chunks: what the usual byte-level pattern matches never reaches across a space before a non-space.

A match that holds such a space starts with it, so a text may be cut before every one of them and its chunks encoded
one by one.  Words repeat, so most chunks are found in a table of bounded size.  With any other pattern a text is one
chunk and nothing is kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: Fixed value: the pattern for which texts may be cut before a space.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" \s")


class Pieces:
    """Texts in chunks, and chunks in pieces: the matches of ``pattern``, in order."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.usual = pattern == USUAL

    def chunks(self, text: str) -> list[str]:
        """The first chunk is marked by a space; the others, which never start with one, had one that is left out."""
        if not self.usual:
            return [" " + text]
        parts = _CUT.split(text) if _ODD.search(text) or text[-1:] == " " else text.split(" ")
        parts[0] = " " + parts[0]
        return parts

    def of(self, part: str) -> list[str]:
        first = part[:1] == " "
        word = part[1:] if first else part
        chunk = word if first else " " + word
        if self.usual:
            if word.isalpha():
                return [chunk]
            if word[:-1].isalpha() and word[-1] in ".,":
                return [chunk[:-1], chunk[-1]]
        return self.find(chunk)


class Chunked:
    """ids of texts as little-endian unsigned 32-bit bytes.

    ``encode_pieces`` maps a list of distinct pieces (UTF-8) to their ids in that form.  Chunks of up to ``long``
    characters are kept; when they and their ids come to ``most`` bytes, the table is emptied.
    """

    def __init__(self, pattern: str, encode_pieces: Callable[[list[bytes]], list[bytes]], most: int = 256 << 20, long: int = 64):
        self.pieces = Pieces(pattern)
        self.encode_pieces = encode_pieces
        self.most, self.long = most, long
        self.known: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces.chunks(t) for t in texts]
        missing = {p: self.pieces.of(p) for p in set().union(*split).difference(self.known)}
        new = list({x for xs in missing.values() for x in xs})
        got = dict(zip(new, self.encode_pieces([x.encode() for x in new])))
        for p, xs in missing.items():
            self.known[p] = got[xs[0]] if len(xs) == 1 else b"".join([got[x] for x in xs])
        out = [b"".join(map(self.known.__getitem__, parts)) for parts in split]
        for p in missing:
            if len(p) > self.long:
                del self.known[p]
            else:
                self.held += 180 + 2 * len(p) + len(self.known[p])  # two objects and a slot of the table
        if self.held > self.most:
            self.known.clear()
            self.held = 0
        return out
