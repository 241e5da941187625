"""Exact ids of a sentencepiece BPE model from a table of last tokens, and their text.

The merges of a BPE model run best score first, leftmost among equals, and a
merge looks at two neighbours only. A row of tokens is therefore what the model
makes of their text exactly if each neighbouring pair is what the model makes
of the pair's text, and every prefix of a text has one last token. The table
holds its length per prefix: an Aho-Corasick automaton lists the pieces that
end at a place, and of these the one is right that goes with the last token of
the prefix before it. The tokens are then read off from the end.

A character that is no piece stands for itself until the end, where it becomes
its bytes (or the unknown id), as in the library.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import merge
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glasswork.llm.inputs import importable, texts
from glasswork.llm.pieces import PieceCache, tool

SPACE = "▁"
CACHED_PAIRS = 1_000_000
_SLICE_CHARS = 2_000_000
_PROBES = ["", " ", "a", "Hello  world", " two\n\n lines\t", "▁x▁ y", "aaaaaaaaaaa     b", "日本語 𝔘\x00é", "<s> <0x0A> <unk>"]


class PrefixTable:
    """``table(text)`` gives the ids of a whole text as an array, equal to the library's ``encode``.

    The library normalizes the text. It is cut where no merge can reach across:
    before space marks, if no piece has one behind another character, and
    between characters that no chain of pieces links. Equal stretches are
    encoded once, in a bounded cache.
    """

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(count)]
        kept = [i for i in range(count) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(model.is_unused(i) for i in kept):
            raise ValueError(f"{path} has unused pieces")
        self.score = {names[i]: model.get_score(i) for i in kept}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(map(model.is_byte, self.byte_ids))
        # Tokens are numbered: pieces by their ids, 'no token' next, then characters that are no piece as they come.
        self.names, self.none = [*names, ""], count
        self.sizes = [*map(len, self.names)]
        self.packed = [array("I", [i]).tobytes() for i in range(count + 1)]
        self.others: dict[str, int] = {}
        self.single = {p for p in self.score if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for i in kept:
            self.automaton.add_word(names[i], i)
        self.automaton.make_automaton()
        self.runs = self._runs()
        self.pairs: dict[int, dict[int, bool]] = {}  # by right token, then left
        self.tested = 0
        self.words = PieceCache(self.encode_word)
        if any(self(t).tolist() != model.encode(t) for t in _PROBES):
            raise ValueError(f"{path} is no plain BPE model")

    def _runs(self) -> re.Pattern:
        """Stretches of text that no piece joins to their neighbours: space marks with a run of linked characters."""
        bare = [p.lstrip(SPACE) for p in self.score]
        if any(SPACE in p for p in bare):
            return re.compile(".+", re.DOTALL)
        group: dict[str, set] = {}
        for piece in bare:
            if len(piece) > 1 and not all(c in group.get(piece[0], ()) for c in piece):
                linked = set(piece).union(*(group[c] for c in piece if c in group))
                group.update(dict.fromkeys(linked, linked))
        kinds = sorted({id(g): g for g in group.values()}.values(), key=len, reverse=True)
        classes = [f"[{''.join(map(re.escape, sorted(k)))}]+" for k in kinds]
        return re.compile(f"{SPACE}*(?:{'|'.join([*classes, f'[^{SPACE}]'])})|{SPACE}+")

    def goes_with(self, left: int, right: int) -> bool:
        """Whether the model makes exactly these two tokens of their text (of ``right`` alone, if ``left`` is none).

        Merges are played until one spans the border, which settles it.
        """
        border, score = self.sizes[left], self.score.get
        parts = list(self.names[left] + self.names[right])
        scores = [score(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            known = [s for s in scores if s is not None]
            if not known:
                return len(parts) == (2 if border else 1)
            at = scores.index(max(known))  # the leftmost of the best
            joined = parts[at] + parts[at + 1]
            if border and sum(map(len, parts[:at + 1])) == border:
                return False
            parts[at: at + 2] = [joined]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + joined)
            if at + 1 < len(parts):
                scores[at] = score(joined + parts[at + 1])

    def _tested(self, left: int, right: int) -> bool:
        """The test's answer, remembered; a full memory is emptied, which changes no answer."""
        if self.tested >= CACHED_PAIRS:
            self.pairs.clear()
            self.tested = 0
        self.tested += 1
        fits = self.pairs.setdefault(right, {})[left] = self.goes_with(left, right)
        return fits

    def _number(self, char: str) -> int:
        if char not in self.others:
            self.others[char] = len(self.names)
            self.names.append(char)
            self.sizes.append(1)
            ids = [self.byte_ids[b] for b in char.encode()] if self.fallback else [self.model.unk_id()]
            self.packed.append(array("I", ids).tobytes())
        return self.others[char]

    def _candidates(self, text: str) -> Iterator[tuple[int, int]]:
        """(end, token) of all tokens that occur in the text, by end."""
        matches = self.automaton.iter(text)
        if self.single.issuperset(text):
            return matches
        others = ((i, self._number(c)) for i, c in enumerate(text) if c not in self.single)
        return merge(matches, others, key=itemgetter(0))

    def last_tokens(self, text: str) -> list[int]:
        """Per prefix of the text, the empty one first, its last token."""
        last, sizes, pairs, done = [self.none] * (len(text) + 1), self.sizes, self.pairs, -1
        for end, token in self._candidates(text):
            if end != done:
                left = last[end + 1 - sizes[token]]
                try:
                    fits = pairs[token][left]
                except KeyError:
                    fits = self._tested(left, token)
                if fits:
                    last[end + 1] = token
                    done = end
        return last

    def encode_word(self, text: str) -> bytes:
        """Ids of a stretch of normalized text as unsigned 32-bit integers."""
        last, at, out = self.last_tokens(text), len(text), []
        while at:
            token = last[at]
            at -= self.sizes[token]
            out.append(self.packed[token])
        return b"".join(reversed(out))

    def __call__(self, text: str) -> np.ndarray:
        normal = self.model.normalize(text)
        raw = self.words.join(self.runs.findall(normal))
        ids = np.frombuffer(raw, np.uint32)
        if not self.fallback and len(ids):  # the library gives a run of unknown characters one id
            unknown = ids == self.model.unk_id()
            ids = ids[~(unknown & np.concatenate([[False], unknown[:-1]]))]
        return ids

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


def _table(path: str) -> PrefixTable:
    """One table per Python worker and model file."""
    return tool(("prefix table", path), lambda: PrefixTable(path))


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Consecutive rows of about ``_SLICE_CHARS`` characters with the number of the first; a longer text is a slice."""
    first, some, size = 0, [], 0
    for i, value in enumerate(column):
        some.append(value.as_py())
        size += len(some[-1])
        if size >= _SLICE_CHARS:
            yield first, some
            first, some, size = i + 1, [], 0
    if some:
        yield first, some


def encode_texts(docs: DataFrame, model_path: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids array<int>), one per input row, of the whole texts; with ``decoded`` also the text of the ids.

    Null and empty texts have no ids and decode to ''; null ids of documents
    stay null, repeated rows are encoded each, an empty table gives no rows.
    Other columns are not read. Nothing is shuffled.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model_path)
        for batch in batches:
            for first, some in _slices(batch["_text"]):
                ids = [table(t) for t in some]
                flat = pa.array(np.concatenate(ids).astype("i4"))
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                columns = [batch["_id"].slice(first, len(some)), pa.ListArray.from_arrays(offsets, flat)]
                if decoded:
                    columns.append(pa.array([table.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][:len(columns)])

    return texts(docs, id_col, text_col).mapInArrow(
        encode, "doc_id long, ids array<int>" + (", decoded string" if decoded else ""))


def decode_ids(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, decoded): the text of each row's ids; null reads as no ids."""
    importable(rows.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _table(model_path).model
        for batch in batches:
            some = pa.array([model.decode(i.as_py() or []) for i in batch["ids"]], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], some], names=["doc_id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(
        decode, "doc_id long, decoded string")
