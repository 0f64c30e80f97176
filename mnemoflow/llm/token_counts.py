"""Token counts by dynamic programming on a trie of pre-tokens.

A text's pre-tokens are its words, each with the mark that the vocabulary puts
before a word. A pre-token is cut into the pieces of the largest sum of
unigram scores (of equal sums, the one of fewer pieces). The best sum and
number of pieces up to a place depend on what stands before it only, so
pre-tokens go into a trie whose nodes store them: a prefix that several
pre-tokens share is computed once, and the count of a pre-token is the one at
its terminal, the node where it ends. A task keeps its trie from word to word
and text to text and starts a new one at ``most_nodes``, which changes no
count. Nothing is shuffled; the vocabulary, some ten thousands of pieces, is
broadcast.

Scores come from the vocabulary's own order, which is by frequency: the piece
of rank r has log(1 / (r + 1)), scaled to sum to 1 (no tokenizer is trained).
A character that no piece holds is spelt as its UTF-8 bytes, each a piece of
the least score, less 1.

Defined results: a null, empty or blank text has no tokens; rows that repeat
are counted each; a pre-token of over LONG characters is computed apart and
not stored; columns not asked for are ignored; a kept column named as a made one
comes back with ``_kept`` behind its name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import beside

#: Where the vocabulary of the registered query is.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LONG = 64
MOST_NODES = 1_000_000


@dataclass
class Vocabulary:
    scores: dict[str, float]
    byte: float
    #: All ends of all pieces: the score of one that is a piece itself, else null. One that isn't here ends no piece.
    ends: dict[str, float | None]


def vocabulary(ranked: list[str]) -> Vocabulary:
    """Pieces, the most frequent first."""
    total = math.log(sum(1 / (r + 1) for r in range(len(ranked)))) if ranked else 0.0
    scores: dict[str, float] = {}
    for r, piece in enumerate(ranked):
        scores.setdefault(piece, -math.log(r + 1) - total)
    ends = {piece[k:]: None for piece in scores for k in range(1, len(piece))} | scores
    return Vocabulary(scores, min(scores.values(), default=0.0) - 1, ends)


def read_vocabulary(path: str) -> Vocabulary:
    """The pieces of a public tokenizer's file, by its scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return vocabulary([model.id_to_piece(i) for i in sorted(plain, key=lambda i: (-model.get_score(i), i))])


_MISSING = object()


def _step(v: Vocabulary, word: str, end: int, sums: list[float], many: list[int]) -> tuple[float, int]:
    """The best sum and number of pieces of the first ``end`` characters, from those of all shorter prefixes.

    Looks backwards for pieces, as far as any piece ends in what was passed.
    """
    ends, start, best, n = v.ends, end, -math.inf, 0
    while start:
        start -= 1
        s = ends.get(word[start:end], _MISSING)
        if s is None:
            continue
        if s is _MISSING:
            break
        s += sums[start]
        if s > best or (s == best and many[start] + 1 < n):
            best, n = s, many[start] + 1
    if word[end - 1] not in v.scores:  # a character that is a piece isn't spelt
        size = len(word[end - 1].encode("utf-8", "replace"))
        s = sums[end - 1] + size * v.byte
        if s > best or (s == best and many[end - 1] + size < n):
            best, n = s, many[end - 1] + size
    return best, n


def count_plain(v: Vocabulary, word: str) -> tuple[int, float]:
    """Pieces and sum of one pre-token, without a trie."""
    sums, many = [0.0], [0]
    for end in range(1, len(word) + 1):
        s, n = _step(v, word, end, sums, many)
        sums.append(s)
        many.append(n)
    return many[-1], sums[-1]


class PreTokenTrie:
    """Nodes by number: their children, and the best sum and number of pieces of the path to them."""

    def __init__(self, v: Vocabulary, most_nodes: int = MOST_NODES) -> None:
        self.v, self.most_nodes = v, most_nodes
        #: The child of node k by character c, at k * 2 ** 21 + c.
        self.children: dict[int, int] = {}
        self.sums, self.many = [0.0], [0]
        #: The terminal of each word.
        self.terminals: dict[str, int] = {}

    def clear(self) -> None:
        self.children.clear()
        self.terminals.clear()
        del self.sums[1:], self.many[1:]

    def insert(self, word: str) -> int:
        """The terminal of a pre-token; its new nodes are computed, the others are found."""
        v, children, all_sums, all_many = self.v, self.children, self.sums, self.many
        node, sums, many, end = 0, [0.0], [0], 0
        for c in word:
            end += 1
            at = node << 21 | ord(c)
            node = children.get(at)
            if node is None:
                s, n = _step(v, word, end, sums, many)
                node = children[at] = len(all_sums)
                all_sums.append(s)
                all_many.append(n)
            sums.append(all_sums[node])
            many.append(all_many[node])
        return node

    def count(self, text: str) -> tuple[int, int, float]:
        """Words, tokens and their sum."""
        words = text.split()
        terminals, all_sums, all_many = self.terminals, self.sums, self.many
        n, total = 0, 0.0
        for w in words:
            node = terminals.get(w)
            if node is None:
                if len(w) >= LONG:
                    more, s = count_plain(self.v, MARK + w)
                    n += more
                    total += s
                    continue
                if len(all_sums) > self.most_nodes:
                    self.clear()
                node = terminals[w] = self.insert(MARK + w)
            n += all_many[node]
            total += all_sums[node]
        return len(words), n, total


def token_counts(docs: DataFrame, v: Vocabulary, keep: list[str], text: str = "text", most_nodes: int = MOST_NODES) -> DataFrame:
    """``keep`` columns with ``n_words``, ``n_tokens`` and ``log_score``, the sum over the tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(v)

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        trie = PreTokenTrie(sent.value, most_nodes)

        def make(texts: pa.Array) -> list[pa.Array]:
            got = [trie.count(t or "") for t in texts.to_pylist()]
            return [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]

        return make

    return beside(docs, keep, text, "n_words bigint, n_tokens bigint, log_score double", start)
