"""Token counts: forward scores of a unigram model, shared by prefixes in a trie.

A text is cut into pre-tokens.  Each distinct pre-token of a task is inserted into a trie of bytes; the best
score of a segmentation that ends at a node depends on the path to it alone, so it is computed once when the
node is made and serves all pre-tokens that share the prefix.  The node where a pre-token ends keeps its
number of tokens, and a text adds up these terminal counts.

The vocabulary is a public one, given as a file of byte strings with ranks; the probability of a piece is
taken from its rank by Zipf's law.  It is read on the driver, is checked against ``most_pieces`` and sent to
the tasks.

Defined results: null and empty texts have 0 tokens; texts of any length are counted in full; equal scores go
to fewer tokens; repeated rows are counted one by one; an empty table gives an empty table.  Only the named
columns are read, so further columns never clash.
"""

from __future__ import annotations

import base64
import math

import regex
from pyspark.sql import DataFrame

from callgrove.llm.texts import SLICE, map_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Optional space, then letters, digits or other signs; or white space.
PRE_TOKENS = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def read_vocabulary(path: str = VOCABULARY, most_pieces: int = 1_000_000) -> dict[bytes, float]:
    """Pieces and their log probabilities by rank; every single byte must be a piece."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}
    if len(ranks) > most_pieces:
        raise ValueError(f"{path} has {len(ranks)} pieces; most_pieces is {most_pieces}")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} lacks single bytes, so some texts have no segmentation")
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - total for piece, r in ranks.items()}


class PrefixTrie(dict):
    """Number of tokens of each pre-token asked for; missing ones are inserted into the trie.

    ``most_nodes`` bounds the memory of a task: beyond it the trie starts anew and forgets only work done.
    """

    def __init__(self, scores: dict[bytes, float], most_nodes: int = 400_000):
        super().__init__()
        self.scores, self.most_nodes = scores, most_nodes
        self.tails = {piece[i:] for piece in scores for i in range(len(piece))}
        self._clear()

    def _clear(self) -> None:
        self.clear()
        self.children: dict[tuple[int, int], int] = {}
        self.best: list[tuple[float, int]] = [(0.0, 0)]  # of each node: score, minus the number of tokens

    def __missing__(self, word: str) -> int:
        if len(self.best) > self.most_nodes:
            self._clear()
        data = word.encode("utf-8", "surrogatepass")
        if len(data) > self.most_nodes:
            return self._long(data)
        path = [0]
        for depth, byte in enumerate(data, 1):
            node = self.children.get((path[-1], byte))
            if node is None:
                self.best.append(self._forward(data, depth, lambda k: self.best[path[k]]))
                node = self.children[path[-1], byte] = len(self.best) - 1
            path.append(node)
        self[word] = -self.best[path[-1]][1]
        return self[word]

    def _forward(self, data: bytes, depth: int, before) -> tuple[float, int]:
        """Best of all last pieces of the first ``depth`` bytes."""
        best, k = (-math.inf, 0), depth - 1
        while k >= 0 and (piece := data[k:depth]) in self.tails:
            if (score := self.scores.get(piece)) is not None:
                s, n = before(k)
                best = max(best, (s + score, n - 1))
            k -= 1
        return best

    def _long(self, data: bytes) -> int:
        """A pre-token longer than the whole trie may be is scored without it."""
        best = [(0.0, 0)]
        for depth in range(1, len(data) + 1):
            best.append(self._forward(data, depth, best.__getitem__))
        return -best[-1][1]


def counter(vocabulary: dict[bytes, float]):
    """A function that gives the pre-tokens and tokens of an Arrow text; the text is cut into pre-tokens slice by slice."""
    trie, cut = PrefixTrie(vocabulary), regex.compile(PRE_TOKENS)

    def judge(value):
        text, at, end, n, tokens = value.as_py() or "", 0, 0, 0, 0
        while at < len(text):
            end = min(max(end + SLICE, 2 * end - at), len(text))
            words = cut.findall(text, at, end)
            if end < len(text):
                if len(words) == 1:
                    continue
                end -= len(words.pop())  # it may go on
            n += len(words)
            tokens += sum(map(trie.__getitem__, words))
            at = end
        return n, tokens

    return judge


def count_tokens(df: DataFrame, vocabulary: dict[bytes, float], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds n_pretokens and n_tokens of every whole text, one row per row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    return map_rows(df, list(keep), text, {"n_pretokens": "bigint", "n_tokens": "bigint"}, lambda: counter(shared.value))
