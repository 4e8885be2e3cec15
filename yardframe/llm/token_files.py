"""Flat token-id files: encoding, writing, reading.

A file is a run of little-endian ids without header or index. Ids are 2 bytes wide where the vocabulary has
at most 65,536 ids, else 4. Files are written by tasks through pyarrow's file systems, first under a
task's own name, then renamed, so a repeated task leaves one whole file.

Encoding gives exactly the ids of `Tokenizer.encode(text, add_special_tokens=False)`. A byte-level BPE splits
a text by a pattern of which no piece runs from a character that is no white space into white space. Texts
are cut there, each different piece is encoded once, and its id bytes are kept for later texts.

Most texts have single spaces between words. They are cut at spaces alone, and what stands behind a space is the key of
its ids. A piece of the pattern neither runs from a letter or digit into another ASCII character than an apostrophe, so a
word with a comma behind it, say, takes the ids of the word and of the comma. Where only marks stand behind a word, they are
stripped and both are looked up; nothing is kept for the two together.
"""

from __future__ import annotations

import re
import sys
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyarrow import fs as arrow_fs
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

# The characters with Unicode's White_Space property.
SPACE_CODES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_SPACES = "".join(map(chr, SPACE_CODES))
_PIECE = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")
# Letters of ASCII and Latin, and ASCII's marks but for the apostrophe.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-&(-/:-@\[-`{-~"
_HEAD = re.compile(f"[0-9{_LETTERS}]++(?=[{_SPACES}{_MARKS}])")
_LATIN = re.compile(f"[{_LETTERS}]+")
_MARK_CHARS = "".join(c for c in map(chr, range(0x21, 0x7F)) if re.match(f"[{_MARKS}]", c))
# The byte-level splitting pattern, and the bytes it shows as other characters.
_WORD = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_SHOWN = (*range(33, 127), *range(161, 173), *range(174, 256))
_BYTE_CHARS = dict(zip(sorted(set(range(256)) - {*_SHOWN}), map(chr, range(256, 324)), strict=True))
_SHOWN_SPACE = _BYTE_CHARS[32]

KEPT_PIECES, KEPT_WORDS = 750_000, 100_000  # about 150 MB
LONGEST_KEPT = 64


class Encoder:
    """Texts to bytes of ids, with the ids of pieces seen before."""

    def __init__(self, path: str, plain_specials: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.specials = [] if plain_specials else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        level = self.tokenizer.pre_tokenizer
        self.by_piece = isinstance(level, ByteLevel) and self.tokenizer.normalizer is None and self.tokenizer.truncation is None \
            and not level.add_prefix_space and level.use_regex and not any(re.search(f"[{_SPACES}]", t) for t in self.specials)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}  # of a space and the key
        self.marked: dict[str, bytes] = {}  # the same, where more than marks stands behind a word

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, shown: str) -> bytes:
        """Ids of one word, written in the characters that stand for its bytes."""
        ids = array("H" if self.width == 2 else "I", [t.id for t in self.tokenizer.model.tokenize(shown)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _piece(self, piece: str) -> bytes:
        cut = _WORD.findall(piece)
        for word in cut:
            if word not in self.words:
                self.words[word] = self._word(word.encode().decode("latin-1").translate(_BYTE_CHARS))
        return b"".join([self.words[word] for word in cut])

    def _part(self, part: str) -> bytes:
        """Ids of a space and a part that is neither empty nor long. Words are kept, with what stands behind them for a while."""
        if part.isalpha() and (part.isascii() or _LATIN.fullmatch(part)):  # one word
            ids = self._word(_SHOWN_SPACE + (part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARS)))
        elif head := _HEAD.match(part):
            word, rest = head[0], part[head.end():]
            ids = (self.parts.get(word) or self._part(word)) + (self.words.get(rest) or self._piece(rest))
            if len(self.marked) > KEPT_WORDS:
                self.marked.clear()
            self.marked[part] = ids
            return ids
        else:
            ids = self._piece(" " + part)
        self.parts[part] = ids
        return ids

    def forget(self) -> None:
        """Gives the memory of the pieces back; a worker goes on to other work when its task ends."""
        self.pieces.clear()
        self.words.clear()
        self.parts.clear()
        self.marked.clear()

    def encode(self, text: str) -> bytes:
        if not self.by_piece or any(t in text for t in self.specials):
            return self._whole(text)
        if len(self.pieces) + len(self.parts) > KEPT_PIECES:
            self.pieces.clear()
            self.parts.clear()
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        cut = text.split(" ")
        if len(cut) == 1 or not cut[0] or cut[0][-1] in _SPACES:
            return self._by_pieces(text)
        parts = self.parts
        ids = list(map(parts.get, cut))
        ids[0] = self._by_pieces(cut[0])
        long: dict[str, bytes] = {}
        for i in [i for i, known in enumerate(ids) if known is None]:
            p = cut[i]
            if not p or p[-1] in _SPACES:  # no cut: white space stands before the next space
                return self._by_pieces(text)
            if len(p) <= LONGEST_KEPT:
                word = p.rstrip(_MARK_CHARS)
                if len(word) < len(p) and word.isalnum() and (word.isascii() or _LATIN.fullmatch(word)):
                    rest = p[len(word):]
                    ids[i] = (parts.get(word) or self._part(word)) + (self.words.get(rest) or self._piece(rest))
                else:
                    ids[i] = parts.get(p) or self.marked.get(p) or self._part(p)
            else:
                if p not in long:
                    long[p] = self._whole(" " + p)
                ids[i] = long[p]
        return b"".join(ids)

    def _by_pieces(self, text: str) -> bytes:
        pieces = self.pieces
        cut = _PIECE.findall(text)
        long = []
        for p in set(cut).difference(pieces):
            if len(p) > LONGEST_KEPT:
                pieces[p] = self._whole(p)
                long.append(p)
                continue
            letters = p[1:] if p[0] == " " else p
            if letters.isascii() and letters.isalpha():  # one word as it stands; only the space is shown otherwise
                pieces[p] = self._word(p if letters is p else _SHOWN_SPACE + letters)
            else:
                pieces[p] = self._piece(p)
        ids = b"".join(map(pieces.__getitem__, cut))
        for p in long:
            del pieces[p]
        return ids


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """One encoder for each Python worker; tasks that follow one another share the vocabulary."""
    if (path, plain_specials) not in _ENCODERS:
        _ENCODERS[path, plain_specials] = Encoder(path, plain_specials)
    return _ENCODERS[path, plain_specials]


def file_system(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and its inner path of a folder or file named by URI or absolute path."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(uri)


def write_whole(uri: str, parts: Iterable[bytes]) -> int:
    """Writes parts to a new file and returns its bytes; the file appears under its name only when whole."""
    system, path = file_system(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    size = 0
    with system.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(own, path)
    return size


def read_range(uri: str, start: int, length: int) -> bytes:
    system, path = file_system(uri)
    with system.open_input_file(path) as source:
        return source.read_at(length, start)


def read_ranges(uri: str, starts: Iterable[int], lengths: Iterable[int]) -> Iterator[bytes]:
    system, path = file_system(uri)
    with system.open_input_file(path) as source:
        for start, length in zip(starts, lengths, strict=True):
            yield source.read_at(int(length), int(start))
