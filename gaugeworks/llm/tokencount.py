"""Token counts under a unigram model, with forward scores shared along a trie.

Pre-tokens are the white-space separated words, each headed by the word mark of the piece
vocabulary. Every distinct pre-token is inserted in a trie; a node's forward score (the best
log-probability of segmenting its prefix, with the number of pieces) is computed once, from its
ancestors, however many words share the prefix, and the count at a word's end is stored. The
pieces' probabilities follow Zipf's law by their rank in the public vocabulary file; a character
without a piece costs one byte piece for each of its UTF-8 bytes.

A word of more than ``LONG`` characters stays out of the trie: its scores are held for the length of the longest piece only.

Null and empty texts have no tokens; repeated rows are counted alike and a null id is kept; texts are counted whole;
extra columns are ignored; an empty table gives no rows. A worker empties its trie at ``TRIE_NODES`` nodes: only work is
repeated then, no count changes.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
TRIE_NODES, LONG = 400_000, 1_000


def piece_scores(path: str) -> dict[str, float]:
    """Log-probabilities by rank of the ordinary pieces of a sentencepiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return zipf(own)


def zipf(pieces: list[str]) -> dict[str, float]:
    norm = sum(1 / (r + 1) for r in range(len(pieces)))
    return {p: -math.log((r + 1) * norm) for r, p in enumerate(pieces)}


class Trie:
    def __init__(self, scores: dict[str, float], nodes: int = TRIE_NODES):
        self.scores, self.nodes = scores, nodes
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 1.0  # a byte piece is rarer than any other
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best: list[float] = [0.0]
        self.pieces: list[int] = [0]
        self.ends: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of the best segmentation; of equal scores the one with fewer pieces."""
        n = self.ends.get(word)
        if n is not None:
            return n
        if len(word) > LONG:
            return self._count_long(word)
        if len(self.best) >= self.nodes:
            self.clear()
        node, path = 0, [0]
        child, best, pieces, scores, longest = self.child, self.best, self.pieces, self.scores, self.longest
        for i, c in enumerate(word):
            nxt = child.get((node, c))
            if nxt is None:
                size = len(c.encode("utf-8", "surrogatepass"))
                top, n = best[path[i]] + (scores[c] if c in scores else size * self.byte), pieces[path[i]] + (1 if c in scores else size)
                for k in range(max(0, i + 1 - longest), i):
                    p = scores.get(word[k : i + 1])
                    if p is not None:
                        s, m = best[path[k]] + p, pieces[path[k]] + 1
                        if s > top or s == top and m < n:
                            top, n = s, m
                nxt = child[node, c] = len(best)
                best.append(top)
                pieces.append(n)
            node = nxt
            path.append(node)
        self.ends[word] = pieces[node]
        return pieces[node]


    def _count_long(self, word: str) -> int:
        """:meth:`count` in memory that does not grow with the word."""
        scores, longest = self.scores, self.longest
        last = deque([(0.0, 0)], longest)  # best score and pieces of the prefixes before, the nearest last
        for i, c in enumerate(word):
            size = len(c.encode("utf-8", "surrogatepass"))
            s, m = last[-1]
            top, n = s + (scores[c] if c in scores else size * self.byte), m + (1 if c in scores else size)
            for k in range(max(0, i + 1 - longest), i):
                p = scores.get(word[k : i + 1])
                if p is not None:
                    s, m = last[k - i - 1]
                    if s + p > top or s + p == top and m + 1 < n:
                        top, n = s + p, m + 1
            last.append((top, n))
        return last[-1][1]


def count_tokens(docs: DataFrame, scores: dict[str, float], id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, n_pretokens and n_tokens of every row; no shuffle. ``scores`` is bounded by the vocabulary."""
    held = docs.sparkSession.sparkContext.broadcast(scores)
    src = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Trie(held.value)
        for batch in batches:
            words, tokens = [], []
            for t in batch.column(1).to_pylist():
                split = t.split() if t else []
                ends, count = own.ends, own.count
                total = 0
                for w in split:
                    w = MARK + w
                    n = ends.get(w)
                    if n is None:
                        n = count(w)
                        ends = own.ends
                    total += n
                words.append(len(split))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["i", "n_pretokens", "n_tokens"])

    return src.mapInArrow(run, f"i {src.schema['i'].dataType.simpleString()}, n_pretokens long, n_tokens long").withColumnRenamed("i", id)
