"""Token counts under a unigram vocabulary, without building the tokens.

Words are cut at spaces. An Aho-Corasick automaton lists every vocabulary entry
inside a word; a Viterbi pass carries the best score and its number of pieces
per position. Ties go as in the tokenizers library: at a position the earliest
start wins, so only a strictly better score replaces it. A character that no
entry covers alone may also be unknown, ten below the worst score; a run of
unknown characters is one piece, or one per byte where the vocabulary has all
byte entries.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from glasswork.llm.inputs import texts
from glasswork.llm.pieces import PieceCache, tool

SPACE = "▁"
_UNKNOWN_PENALTY = 10.0


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(entry, score) pairs of a sentencepiece model or of a tokenizers file with a unigram model."""
    if path.endswith(".json"):
        with open(path) as f:
            return [(p, float(s)) for p, s in json.load(f)["model"]["vocab"]]
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """``counter(text)`` is the number of tokens of the text."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - _UNKNOWN_PENALTY
        names = {p for p, _ in vocabulary}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.counts = PieceCache(self.count_word)

    def count_word(self, word: str) -> int:
        text = SPACE + word
        found: dict[int, list] = {}
        for end, match in self.automaton.iter(text):  # longest first at each end
            found.setdefault(end, []).append(match)
        best, counts, open_run = [0.0], [0], [False]
        for end, char in enumerate(text):
            score, count, unknown, alone = None, 0, False, False
            for size, value in found.get(end, ()):
                start = end + 1 - size
                if score is None or value + best[start] > score:
                    score, count = value + best[start], counts[start] + 1
                alone = alone or size == 1
            if not alone and (score is None or self.unknown + best[end] > score):
                score, unknown = self.unknown + best[end], True
                count = counts[end] + (len(char.encode("utf-8", "replace")) if self.bytes else 0 if open_run[end] else 1)
            best.append(score)
            counts.append(count)
            open_run.append(unknown)
        return counts[-1]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        return sum(map(self.counts.__getitem__, words if words[0] else words[1:]))


def _counter(path: str, byte_fallback: bool) -> UnigramCounter:
    return tool(("unigram", path, byte_fallback), lambda: UnigramCounter(load_vocabulary(path), byte_fallback))


def count_tokens(docs: DataFrame, vocabulary_path: str, byte_fallback: bool = True, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens), one per input row; null and empty texts have 0 tokens, null ids stay null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary_path, byte_fallback)
        for batch in batches:
            n = pa.array([counter(t.as_py()) for t in batch["_text"]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["_id"], n], names=["doc_id", "n_tokens"])

    return texts(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_tokens long")
