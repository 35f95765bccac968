"""Token counts of a unigram vocabulary: Aho-Corasick matches and a Viterbi pass that carries score and count alone."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from ._shared import keys_only, slices

SPACE = "▁"
#: The penalty of an unknown character below the worst piece, as in the tokenizers library.
UNKNOWN_PENALTY = 10.0
SEGMENTS_KEPT = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in order of ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Counts the tokens of the best segmentation without building it.

    The rules are those of the tokenizers library's Unigram model with byte fallback: among the paths to a character
    boundary the first to reach the highest score stays, and starts are tried from the left, so of equal scores the one
    with the longest last piece wins; an unknown character (one that is no piece by itself) is tried after all pieces
    that start there, scores ``min(scores) - 10`` and gives one token for each byte of it.

    Where no piece holds a space mark behind another character and all scores are whole numbers (so that sums are exact
    in any order) every path has a boundary before each word, and the words are counted one by one, each distinct word
    once. Otherwise a text is one segment.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        inside = {c for p, _ in vocabulary for c in p}
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p, _ in vocabulary) and all(float(s).is_integer() for _, s in vocabulary) and "\n" not in inside
        self.known: dict[str, int] = {"": 0}

    def viterbi(self, text: str) -> int:
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        at, single, unknown = 0, self.single, self.unknown

        def leave(end: int, best, pieces: int) -> None:
            """Close boundary ``end``: the unknown character comes after all longer pieces."""
            ch = text[end - 1]
            if ch not in single and (best is None or score[end - 1] + unknown > best):
                best, pieces = score[end - 1] + unknown, count[end - 1] + len(ch.encode("utf-8", "replace"))
            score[end], count[end] = best, pieces

        best, pieces = None, 0
        for last, (length, worth) in self.automaton.iter(text):  # by end, and longest first
            while at < last:
                leave(at + 1, best, pieces)
                at, best, pieces = at + 1, None, 0
            start = last + 1 - length
            if best is None or score[start] + worth > best:
                best, pieces = score[start] + worth, count[start] + 1
        while at < n:
            leave(at + 1, best, pieces)
            at, best, pieces = at + 1, None, 0
        return count[n]

    def segment(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > SEGMENTS_KEPT:
                self.known = {"": 0}
            got = self.known[word] = self.viterbi(word)
        return got

    def count(self, text: str | None) -> int:
        """Tokens of a text whose spaces are marked and which starts with a mark; none for an empty text."""
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        return self.viterbi(marked if marked.startswith(SPACE) else SPACE + marked)

    def counts(self, texts: pa.Array) -> list[int]:
        texts = pc.fill_null(texts, "")
        plain = pc.invert(pc.match_substring_regex(texts, "  |^ | $|" + SPACE)).to_pylist() if self.by_word else [False] * len(texts)
        parted = pc.replace_substring(pc.replace_substring(texts, " ", f" {SPACE}"), "\n", " \n ")
        lists = pc.split_pattern(parted, " ")
        coded = lists.flatten().dictionary_encode()
        out = []
        per = np.fromiter((self.segment(w) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary)) if any(plain) else None
        sums = None if per is None else np.concatenate([[0], np.cumsum(per[coded.indices.to_numpy(zero_copy_only=False)])])
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        first = None
        for i, simple in enumerate(plain):
            if not simple:
                out.append(self.count(texts[i].as_py()))
                continue
            total = int(sums[bounds[i + 1]] - sums[bounds[i]])
            if bounds[i + 1] > bounds[i]:  # the first word has no mark yet
                first = coded.dictionary[coded.indices[int(bounds[i])].as_py()].as_py()
                whole = texts[i].as_py()[: len(first)]
                total += self.segment(SPACE + first) - self.segment(first) if whole else self._lead(texts[i].as_py())
            out.append(total)
        return out

    def _lead(self, text: str) -> int:
        """A text that starts with a line break gets a mark of its own before it."""
        return self.segment(SPACE) if text else 0


@functools.lru_cache(2)
def _counter(path: str) -> UnigramCounter:
    return UnigramCounter(read_vocabulary(path))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys and ``n_tokens`` for every row, in one pass without a shuffle.

    Null and empty texts have no tokens; repeated rows each get the same count; an empty table gives an empty one; of a
    very long text the scores and counts by place are held, no lattice; other columns, whatever their names, are dropped.
    """
    keys = list(keys)
    df = keys_only(docs, keys, text)
    path = vocabulary or default_vocabulary()

    def run(batches):
        counter = _counter(path)
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*(part[k] for k in keys), pa.array(counter.counts(part[text]), pa.int64())], names=[*keys, "n_tokens"])

    return df.mapInArrow(run, T.StructType([*(df.schema[k] for k in keys), T.StructField("n_tokens", T.LongType())]))
