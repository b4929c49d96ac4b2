import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from lodestone.llm.token_counts import MARK, Counter, token_counts, unigram  # noqa: E402


def viterbi(word, scores):
    text, byte = MARK + word, min(scores.values(), default=0.0) - 10.0
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        width = len(text[end - 1].encode())
        options = [(best[end - 1][0] + byte * width, -(best[end - 1][1] + width))]
        options += [(best[start][0] + scores[text[start:end]], -(best[start][1] + 1)) for start in range(end) if text[start:end] in scores]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_counts_match_plain_forward_scores():
    scores = unigram(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    words = ["".join(rng.choice("theandionéß汉1.") for _ in range(rng.randint(1, 14))) for _ in range(800)] + ["x" * 500, "internationalization"]
    counter = Counter(scores)
    for at in range(0, len(words), 100):
        part = words[at : at + 100]
        assert counter.counts([" ".join(part)]) == [(len(part), sum(viterbi(w, scores) for w in part))]


def test_table(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = unigram(path)
    texts = ["the cat", None, "", " \n\t", "the  cat\nthe", "the cat"]
    docs = spark.createDataFrame([(None if i == 4 else i % 4, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = sorted((str(r.doc_id), r.text or "", r._pretokens, r._tokens) for r in token_counts(docs, path).collect())
    ids = [None if i == 4 else i % 4 for i in range(6)]
    assert got == sorted((str(i), t or "", len((t or "").split()), sum(viterbi(w, scores) for w in (t or "").split())) for i, t in zip(ids, texts))
    assert token_counts(docs.limit(0), path).count() == 0
