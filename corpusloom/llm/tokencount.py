"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie of word-initial pieces and one of continuations. Every node has a
failure link to the continuation node where matching goes on when the next character has no
child, and the number of pieces popped on that way, both computed once: the pieces of a word are
counted in one pass over its characters, each looked at once per step or link, and no piece is
ever built. A word that no sequence of greedy pieces covers counts as one unknown piece.

Words are counted once for each batch and each worker keeps the counts of words it has seen,
bounded by KEEP. Null and empty texts have no words. Rows with the same doc_id are counted one
by one; columns beyond doc_id and text are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import read, slices

KEEP = 1_000_000
#: No way on: the rest of the word cannot be matched.
DEAD = -1


class Automaton:
    """Counts the greedy longest-match pieces of words."""

    def __init__(self, initial: Iterable[str], following: Iterable[str]):
        self.children: list[dict[str, int]] = [{}, {}]  # node 0: start of a word; node 1: start of a continuation
        self.final = [False, False]
        for root, pieces in ((0, initial), (1, following)):
            for piece in pieces:
                node = root
                for char in piece:
                    nxt = self.children[node].get(char)
                    if nxt is None:
                        nxt = len(self.children)
                        self.children.append({})
                        self.final.append(False)
                        self.children[node][char] = nxt
                    node = nxt
                if piece:
                    self.final[node] = True
        self._link()

    def _link(self) -> None:
        """Failure links and popped counts, breadth first: a node's come from its parent's."""
        n = len(self.children)
        self.fail, self.popped = [DEAD] * n, [0] * n
        queue = [0, 1]
        for node in queue:
            for char, child in self.children[node].items():
                queue.append(child)
                if self.final[child]:
                    # the text up to here is a piece: pop it and go on with nothing matched
                    self.fail[child], self.popped[child] = 1, 1
                    continue
                at, pops = self.fail[node], self.popped[node]
                while at != DEAD and char not in self.children[at]:
                    pops += self.popped[at]
                    at = self.fail[at]
                if at != DEAD:
                    self.fail[child], self.popped[child] = self.children[at][char], pops

    def count(self, word: str) -> int:
        """Pieces of a word, or 0 where it cannot be covered."""
        node, pieces, children, fail, popped = 0, 0, self.children, self.fail, self.popped
        for char in word:
            nxt = children[node].get(char)
            while nxt is None:
                pieces += popped[node]
                node = fail[node]
                if node == DEAD:
                    return 0
                nxt = children[node].get(char)
            node = nxt
        # what is matched and not popped yet must end as pieces too
        while node != 1:
            pieces += popped[node]
            node = fail[node]
            if node == DEAD:
                return 0
        return pieces


def greedy(word: str, initial: set[str], following: set[str]) -> int:
    """The same count by building every piece, for tests."""
    at, pieces = 0, 0
    while at < len(word):
        for stop in range(len(word), at, -1):
            if word[at:stop] in (following if at else initial):
                break
        else:
            return 0
        at, pieces = stop, pieces + 1
    return pieces


def word_pieces(path: str, mark: str = "▁") -> tuple[set[str], set[str]]:
    """Word-initial and continuation pieces of a sentencepiece model: those with and without its word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return {p[1:] for p in pieces if p.startswith(mark) and len(p) > 1}, {p for p in pieces if not p.startswith(mark)}


class Counts(dict):
    """Pieces by word; unknown words count as one piece, negative to tell."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        value = self[word] = self.automaton.count(word) or -1
        return value


@lru_cache(maxsize=1)
def _counts(path: str) -> Counts:
    return Counts(Automaton(*word_pieces(path)))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for every row; vocabulary is a file every worker can open.

    Words are runs of anything but ASCII white space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = _counts(vocabulary)
            if len(counts) > KEEP:
                counts.clear()
            n_words, n_tokens, n_unknown = [], [], []
            for text in batch.column("text").to_pylist():
                words = ascii_words(text)
                found = list(map(counts.__getitem__, words))
                unknown = found.count(-1)
                n_words.append(len(words))
                n_tokens.append(sum(found) + 2 * unknown)
                n_unknown.append(unknown)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def ascii_words(text: str | None) -> list[str]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    if not text:
        return []
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    from corpusloom.llm.packing import vocabulary_path

    return token_counts(read(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))
