"""Whole texts to ids of a byte-level BPE tokenizer file, through the tokenizers library."""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from glasswork.llm.pieces import PieceCache, tool

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class TextEncoder:
    """Ids of texts as little-endian unsigned integers, equal to ``Tokenizer.encode`` on each whole text.

    Byte-level pre-tokenizers never join two words across a space that a visible
    character follows, so texts are cut there. Pieces of plain letters, marks and
    single line ends are cut on into their pre-tokens; a piece with any other
    character stays whole. Each distinct one of a slice of texts is looked up, and
    encoded if it is new. A text with any other space is encoded whole. Strings of
    special tokens count as ordinary text.
    """

    def __init__(self, path: str, width: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.width = width or (2 if self.vocabulary <= 1 << 16 else 4)
        self.dtype, self.code = f"<u{self.width}", {2: "H", 4: "I"}[self.width]
        self.tokenize = self.tokenizer.model.tokenize
        self.lowers = self.tokenizer.normalizer is not None
        self.parts, self.odd = PieceCache(self._part), PieceCache(self.whole)
        self.kinds = _KINDS
        try:
            agree = all(self(t) == self.whole(t) for p in _PROBES for t in (p, f" {p}"))
        except Exception:  # a model of another kind
            agree = False
        if not agree:  # then every piece goes through the whole tokenizer
            self.kinds = np.where(_KINDS == _BLANK, _BLANK, _ODD).astype("u1")

    def pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token of Latin-1 letters or ASCII marks, handed to the model itself."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(_BYTE_LETTERS)
        elif not self.lowers:
            part = part.replace(" ", _SPACE).replace("\n", _LINE)
        return array(self.code, [t.id for t in self.tokenize(part)]).tobytes()

    def _cuts(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where parts start in the bytes of texts, which of them have odd characters, and where a text cannot be cut."""
        kinds, first = self.kinds[data], np.zeros(len(data) + 1, bool)
        first[starts] = True
        blank, line = kinds == _BLANK, kinds == _LINE_END
        glued = np.flatnonzero(blank & (first[1:] | np.append(blank[1:] | line[1:], True)))
        odd = kinds == _ODD
        odd[1:] |= line[1:] & line[:-1]
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs among the letters
        first = first[:-1]
        pieces = np.flatnonzero(first | blank)
        first[1:] |= blank[1:] | line[1:] | ((kinds[1:] != kinds[:-1]) & ~blank[:-1])
        strange = np.unique(np.searchsorted(pieces, np.flatnonzero(odd), "right") - 1)
        edges = np.zeros(len(data) + 1, "i1")
        edges[pieces[strange]] += 1
        edges[np.append(pieces, len(data))[strange + 1]] -= 1
        first &= np.cumsum(edges[:-1], dtype="i1") == 0
        first[pieces[strange]] = True
        cuts = np.flatnonzero(first)
        return cuts, np.searchsorted(cuts, pieces[strange]), glued

    def encode(self, texts: pa.StringArray, end: bytes = b"") -> pa.LargeBinaryArray:
        """The ids of each text, and ``end`` behind them."""
        bounds = np.frombuffer(texts.buffers()[1], "i4")[texts.offset: texts.offset + len(texts) + 1].astype("i8")
        data = np.frombuffer(texts.buffers()[2] or b"", "u1")[bounds[0]: bounds[-1]]
        bounds -= bounds[0]
        cuts, strange, glued = self._cuts(data, bounds[:-1])
        parts = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, len(data)).astype("i4")), pa.py_buffer(data))
        found = parts.dictionary_encode()
        codes, names = found.indices.to_numpy().astype("i8"), found.dictionary
        # All distinct parts become one text and are split again, which makes their strings quickly.
        odd = np.unique(codes[strange])
        plain = np.ones(len(names), bool)
        plain[odd] = False
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(names)], pc.if_else(pa.array(plain), names, "")), "\t")[0].as_py()
        if self.lowers:
            joined = joined.lower().replace(" ", "").replace("\n", "")
        values = [self.parts[p] for p in joined.split("\t")][:len(names)]
        for c in odd.tolist():
            name = names[c].as_py()
            values[c] = self.odd[name]
            if name[0] == " " and name[1:2].isspace():
                glued = np.append(glued, cuts[codes == c])
        ends = np.searchsorted(cuts, bounds)
        values += [b"", end]
        for k in np.unique(np.searchsorted(bounds, glued, "right") - 1).tolist():
            codes[ends[k]: ends[k + 1]] = len(values)
            codes[ends[k] + 1: ends[k + 1]] = len(plain)
            values.append(self.whole(texts[k].as_py()))
        codes = np.insert(codes, ends[1:], len(plain) + 1)
        _, stops, ids = pa.array(values, pa.large_binary()).take(pa.array(codes)).buffers()
        stops = np.frombuffer(stops, "i8")[ends + np.arange(len(ends))]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(stops), ids])

    def __call__(self, text: str) -> bytes:
        return self.encode(pa.array([text], pa.string()))[0].as_py()


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others follow in order from code point 256."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()
_SPACE, _LINE = _BYTE_LETTERS[32], _BYTE_LETTERS[10]
# Kinds of bytes. Runs of letters or marks are kept together by every byte-level pre-tokenizer; anything odd is
# left to the tokenizer itself. The letters from À to ÿ are two bytes, 0xC3 and one from 0x80.
_BLANK, _LETTER, _MARK, _LINE_END, _ODD = range(5)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _ODD, "u1")
    for a, b, kind in ((33, 38, _MARK), (40, 47, _MARK), (58, 64, _MARK), (65, 90, _LETTER), (91, 96, _MARK), (97, 122, _LETTER),
                       (123, 126, _MARK), (0x80, 0xBF, _LETTER), (0xC3, 0xC3, _LETTER), (32, 32, _BLANK), (10, 10, _LINE_END)):
        kinds[a: b + 1] = kind
    return kinds


_KINDS = _kinds()
_PROBES = ["a", "the", "Zebra", "unbelievable", "straße", "Élève", "ñandú", "ÀÐÿ", "McDonald", "qqqzzzxxq", "a.", "x,y",
           "THE!!", "end.\nNext", "w%%%", "$$$", "a-b_c", "(x)[y]{z}", "end\n", "~`@#^&*"]


def encoder(path: str) -> TextEncoder:
    """One encoder per Python worker and file."""
    return tool(("encoder", path), lambda: TextEncoder(path))
