"""Columns of a table that are named like working or added columns of an operator: nothing else changes."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, near_dedup, packing, quality, suffix_dedup, token_counts, toxicity

NAMES = "_a _asks _b _block _before _bucket _bytes _c _count_text _find_text _h _i _id _items _k _K2 _l _left _n _n_bytes _nodes _none _p _packed _part _pretokens _q _round _row _root _s _score _score_text _set _sha _spans _stays _sub _t _text _tokens _v _w _wanted _x _y lot batch n_tokens bucket_length padding".split()
TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen"


def piece_model():
    public = pytest.importorskip("public_tokenizers")
    return public.path("piece_bpe_32k.model")



OPERATORS = {
    "op2": lambda docs: packing.pack(docs),
    "op3": lambda docs: near_dedup.one_of_each(docs),
    "op4": lambda docs: decontaminate.held_items(docs, docs.sparkSession.createDataFrame([(7, "two three four five six")], "item_id long, text string")),
    "op5": lambda docs: suffix_dedup.remove_repeats(docs, length=40),
    "op7": lambda docs: toxicity.score(docs, toxicity.Model(None, None)),
    "op9": lambda docs: token_counts.token_counts(docs, piece_model()),
    "op10": lambda docs: quality.score(docs, quality.train(docs, docs.sparkSession.createDataFrame([(1, 1), (2, 0), (3, 1), (5, 0)], "doc_id long, quality int"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    rows = [(i, t) for i, t in enumerate([TEXT, TEXT + " more words here", "x" + TEXT, "", None, TEXT[:30]])]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    crowded = plain.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES])
    want, got = OPERATORS[name](plain), OPERATORS[name](crowded)
    added = [c for c in want.columns if c not in plain.columns]
    assert sorted(got.columns) == sorted({*crowded.columns, *added} - ({"text"} - set(want.columns)))
    assert sorted(map(repr, want.collect())) == sorted(map(repr, got.select(want.columns).collect()))
    assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in NAMES if n not in added)
