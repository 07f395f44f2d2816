"""Token counts under a unigram model, by a trie of pre-tokens whose nodes hold the scores of their prefixes."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import whole_text

PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: In a text without this each space stands between two other characters and so begins a pre-token.
ODD_GAP = regex.compile(r"\s\s|^\s|\s$")
GAP = regex.compile(r"(?<=\S) (?=\S)")
#: Nodes and known strings that a worker holds at most; then it begins anew.
NODES, KNOWN = 800_000, 500_000
#: A sum of pieces has so many bits of a number, its pre-tokens the rest.
BITS = 40


def read_scores(path: str) -> dict[bytes, float]:
    """Log probabilities of the pieces of a vocabulary in order of rank (lines of base64 and rank), by the
    Zipf-Mandelbrot law 1 / (rank + 2.7)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    total = math.log(sum(1 / (r + 2.7) for r in ranks.values()))
    return {piece: -math.log(r + 2.7) - total for piece, r in ranks.items()}


class Trie:
    """Each node is a prefix of pre-tokens and keeps the score and the number of pieces of its best segmentation.

    They follow from the nodes above it, so a prefix is worked out once, however many pre-tokens share it; the
    node where a pre-token ends holds its count. Of equally good segmentations the one with fewer pieces counts.
    """

    def __init__(self, scores: dict[bytes, float]):
        #: Every ending of a piece, with the piece's score where it is a piece itself.
        self.endings = {piece[i:]: scores.get(piece[i:]) for piece in scores for i in range(len(piece))}
        self.clear()

    def clear(self) -> None:
        self.below: dict[int, int] = {}
        self.best, self.pieces = [0.0], [0]

    def count(self, token: bytes) -> int:
        best, pieces, below, endings = self.best, self.pieces, self.below, self.endings
        at, path = 0, [0]
        for end, byte in enumerate(token, 1):
            edge = at << 8 | byte
            at = below.get(edge, 0)
            if not at:
                high, n, start = -math.inf, 0, end
                while start:
                    start -= 1
                    score = endings.get(token[start:end], 1.0)
                    if score is None:
                        continue
                    if score > 0:  # no piece ends so
                        break
                    node = path[start]
                    total = best[node] + score
                    if total > high or total == high and pieces[node] + 1 < n:
                        high, n = total, pieces[node] + 1
                at = below[edge] = len(best)
                best.append(high)
                pieces.append(n)
            path.append(at)
        return pieces[at]


    def count_alone(self, token: bytes) -> int:
        """A very long pre-token goes into a trie of its own, which is let go after it."""
        if len(token) <= 64:
            return self.count(token)
        kept = self.below, self.best, self.pieces
        self.clear()
        n = self.count(token)
        self.below, self.best, self.pieces = kept
        return n


def counter(path: str):
    """Batches of (id, text) to (id, n_pretokens, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = None, {}
        for batch in batches:
            trie = trie or Trie(read_scores(path))

            def learn(part: str, space: bool, trie=trie, known=known) -> int:
                """Pre-tokens and pieces as one number; kept for parts that follow a space."""
                if len(trie.best) > NODES:
                    trie.clear()
                tokens = [t.encode() for t in PRETOKEN.findall(" " + part if space else part)]
                got = len(tokens) << BITS | sum(map(trie.count if len(part) <= 64 else trie.count_alone, tokens))
                if space and len(part) <= 64:
                    if len(known) > KNOWN:
                        known.clear()
                    known[part] = got
                return got

            sums = []
            for text in batch.column(1).to_pylist():
                parts = GAP.split(text) if ODD_GAP.search(text) else text.split(" ")
                found = list(map(known.get, parts))
                found[0] = learn(parts[0], False)
                if None in found:
                    found = [learn(p, True) if f is None else f for p, f in zip(parts, found, strict=True)]
                sums.append(sum(found))
            pretokens, counts = pa.array([s >> BITS for s in sums], pa.int64()), pa.array([s & (1 << BITS) - 1 for s in sums], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pretokens, counts], names=["id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, n_pretokens, n_tokens).

    The whole text is cut into pre-tokens, and each of these into the pieces of ``vocabulary`` whose scores add up
    to most; n_tokens counts the pieces. The vocabulary holds every byte, so every text has such pieces. A null
    text counts as empty: 0 and 0. Repeated rows are counted alike; other columns are not looked at; an empty
    table gives an empty result. No row is moved: each task keeps a trie of bounded size for what it reads.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(counter(vocabulary), schema).withColumnRenamed("id", id_col)
