import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from lodestone.llm.patched_blocks import BLOCK, Reader, Writer, decode_block, encode_block  # noqa: E402
from lodestone.llm.token_output import Encoder, token_files  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=300))
def test_block_round_trip(ids):
    values = np.array(ids, np.uint32)
    assert decode_block(encode_block(values)).tolist() == ids


def test_outliers_do_not_widen_a_block():
    ids = np.arange(BLOCK, dtype=np.uint32) % 100
    plain = len(encode_block(ids))
    ids[7] = 4_000_000_000
    assert len(encode_block(ids)) == plain + 6
    assert decode_block(encode_block(ids)).tolist() == ids.tolist()


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_shard_round_trip_and_index():
    rng = np.random.default_rng(3)
    docs = [(i if i != 5 else None, rng.integers(0, 50257, n).astype(np.uint32)) for i, n in enumerate([0, 1, 5000, 300_000, 0, 17])]
    sink = Source()
    sink.close = lambda: None
    writer = Writer(sink)
    for i, ids in docs:
        writer.add(i, ids)
    writer.close()
    reader = Reader(Source(sink.getvalue()))
    every = np.concatenate([d for _, d in docs])
    assert np.array_equal(np.concatenate(list(reader.chunks())), every)
    assert reader.docs["n"].tolist() == [len(d) for _, d in docs] and reader.docs["null"].tolist() == [0, 0, 0, 0, 0, 1]
    for start, n in [(0, 1), (4095, 3), (4999, 20_000), (100, 0)]:
        assert np.array_equal(reader.ids(start, n), every[start : start + n])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab'sté Ünd12 \n\t\r.,!²½ \x1c\u0085汉_|<>", "<|endoftext|>", "  ", "'ll"]), max_size=40).map("".join))
def test_encoder_is_the_library(text):
    encoder = test_encoder_is_the_library.__dict__.setdefault("e", Encoder(PATH))
    assert np.frombuffer(encoder.batch([text])[0], "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_files_give_back_the_ids(spark):
    texts = ["Hello world", None, "", "Été à  Paris\n\n x", "汉字 <|endoftext|>", "a" * 9000, "it's 12.5%"] * 30
    rows = [(1000 - i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (7, "same", "x"), (7, "same", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    tokenizer, at, want = Tokenizer.from_file(PATH), 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files(docs, PATH).collect()), key=lambda r: r[1]) == want
    assert token_files(docs.limit(0), PATH).count() == 0
