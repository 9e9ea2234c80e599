"""Token counts by greedy longest match over a word-piece vocabulary, in one linear pass and without building pieces.

The vocabulary is a trie whose nodes carry a failure link and the number of pieces that following it gives off. Reading
a word moves along edges; where none fits, the link is followed and its count added. Links replace the rescans of the
plain algorithm, so a word costs time in proportion to its length whatever the vocabulary is.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. Its first piece is one marked as a word's start, later ones are
unmarked. A word that greedy matching can't finish counts as one unknown token. Null and empty texts have no words;
rows are kept as they are, repeated or not, with or without an id. Very long texts are read in slices, whole, and the
longest word is held at once. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DROPS, decoded, map_rows, slices, text_bytes, tokenizer_file, words

MARK = "▁"
#: Words whose counts a worker remembers before it starts anew.
MEMO_WORDS = 300_000
SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"


class GreedyCounter:
    """The automaton. Node 0 starts a word (the mark is read), node 1 goes on inside it."""

    def __init__(self, vocabulary: Iterable[str], mark: str = MARK):
        self.edges: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        alone = False
        for piece in vocabulary:
            node, rest = (0, piece[len(mark) :]) if piece.startswith(mark) else (1, piece)
            for ch in rest:
                nxt = self.edges[node].get(ch)
                if nxt is None:
                    nxt = self.edges[node][ch] = len(self.edges)
                    self.edges.append({})
                    final.append(False)
                node = nxt
            if rest:
                final[node] = True
            elif piece:
                alone = True
        self.link = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        if alone:  # the mark by itself is a piece too
            self.link[0] = self.popped[0] = 1
        level = [0, 1]
        while level:
            after: list[int] = []
            for parent in level:
                for ch, node in self.edges[parent].items():
                    after.append(node)
                    if final[node]:
                        self.link[node], self.popped[node] = 1, 1
                        continue
                    back, count = self.link[parent], self.popped[parent]
                    while back >= 0 and ch not in self.edges[back]:
                        count, back = count + self.popped[back], self.link[back]
                    if back >= 0:
                        self.link[node], self.popped[node] = self.edges[back][ch], count
            level = after

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if greedy matching fails."""
        edges, link, popped = self.edges, self.link, self.popped
        node = total = 0
        for ch in word:
            nxt = edges[node].get(ch)
            while nxt is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 0
                nxt = edges[node].get(ch)
            node = nxt
        while node > 1:  # the rest must end on a piece's end
            total += popped[node]
            node = link[node]
            if node < 0:
                return 0
        return total


class _Memo(dict):
    def __init__(self, counter: GreedyCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        n = self[word] = self.counter.count(decoded(word))
        return n


def vocabulary(path: str | None = None) -> list[str]:
    """The ordinary pieces of a sentencepiece model, whose mark shows a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or tokenizer_file("piece_bpe_32k.model"))
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


@functools.lru_cache(maxsize=2)
def _memo(path: str | None) -> _Memo:
    return _Memo(GreedyCounter(vocabulary(path)))


DROPS[__name__] = _memo.cache_clear


def _count(path: str | None, rows: Iterator[tuple]) -> Iterator[tuple]:
    memo = _memo(path)
    for doc_id, text in rows:
        n = tokens = unknown = 0
        for part in slices(text or b""):
            counts = [memo[w] for w in words(part)]
            n, tokens, unknown = n + len(counts), tokens + sum(counts), unknown + counts.count(0)
        yield doc_id, n, tokens + unknown, unknown


def count_tokens(docs: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, words, tokens (an unknown word is one) and unknown words. One narrow pass, no shuffle."""
    return map_rows(docs, [F.col(id_col).cast("long"), text_bytes(text_col)], functools.partial(_count, vocab_path), SCHEMA)
