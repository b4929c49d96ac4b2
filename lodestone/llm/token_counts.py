"""Token counts under a unigram model, with forward scores shared along a trie of distinct pre-tokens.

A pre-token is a word between ASCII white space with the word mark before it.  Its best segmentation maximises the
sum of the pieces' log probabilities (fewer tokens win a tie); the forward score of a prefix is

    best[prefix] = max over pieces p that end the prefix:  best[prefix less p] + log P(p)

so words that share a prefix share its scores.  The new distinct pre-tokens of a batch are put in a trie (as the
sorted list that it is a depth-first walk of, of which the current path is held), each of its nodes is scored once,
and the count at each terminal is stored.  Characters that no piece covers fall back to one token per UTF-8 byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches, with_columns

#: Terminal counts kept per task, and text per trie.
TERMINALS, TEXT = 400_000, 4 << 20
MARK = "▁"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def unigram(path: str) -> dict[str, float]:
    """Log probabilities of the pieces of a sentencepiece file, by Zipf's law over their order in it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = sum(1 / (r + 2.7) for r in range(len(pieces)))
    return {p: -log((r + 2.7) * total) for r, p in enumerate(pieces)}


class Counter:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.ends = {p[i:] for p in scores for i in range(len(p))}
        self.byte = min(scores.values(), default=0.0) - 10.0
        self.known: dict[str, int] = {}

    def add(self, pretokens: set[str]) -> None:
        """Scores the trie of the pre-tokens, in depth-first order."""
        scores, ends, byte, known = self.scores, self.ends, self.byte, self.known
        last, best, count = "", [0.0], [0]
        for word in sorted(pretokens):
            text, depth = MARK + word, 0
            for x, y in zip(text, last):
                if x != y:
                    break
                depth += 1
            del best[depth + 1 :], count[depth + 1 :]
            for end in range(depth + 1, len(text) + 1):
                width = len(text[end - 1].encode("utf-8", "surrogatepass"))
                top, tokens = best[end - 1] + byte * width, count[end - 1] + width
                start = end - 1
                while start >= 0:
                    piece = text[start:end]
                    if piece not in ends:
                        break
                    score = scores.get(piece)
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and count[start] < tokens:
                            top, tokens = score, count[start] + 1
                    start -= 1
                best.append(top)
                count.append(tokens)
            known[word] = count[-1]
            last = text

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if len(self.known) > TERMINALS:
            self.known.clear()
        found = [_WORD.findall(t) for t in texts]
        self.add({w for f in found for w in f}.difference(self.known))
        known = self.known
        return [(len(f), sum([known[w] for w in f])) for f in found]


def token_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """`docs` with `_pretokens` and `_tokens` of every whole text.

    Null texts and texts without words have 0 of both; each row is counted by itself, so ids may be null or repeated;
    an empty table gives an empty one.  Other columns pass through, whatever their names; one named like an added
    column is replaced.
    """
    small_batches(docs.sparkSession, 1024)
    shared = docs.sparkSession.sparkContext.broadcast(unigram(path))
    counters: list[Counter] = []

    def work(texts: list[bytes]) -> list[pa.Array]:
        if not counters:  # one for a task
            counters.append(Counter(shared.value))
        got = counters[0].counts([t.decode("utf-8", "replace") for t in texts])
        return [pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)]

    return with_columns(docs, text_col, "_pretokens long, _tokens long", work, TEXT)
