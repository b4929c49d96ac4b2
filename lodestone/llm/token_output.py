"""Token ids of whole texts, written as patched frame-of-reference shards and read back."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import by_bytes, saved, scratch, small_batches
from lodestone.llm.files import create, reopen
from lodestone.llm.patched_blocks import Reader, Writer

#: Distinct pieces kept per worker process; tasks that follow in it go on with them.
PIECES = 800_000

# The byte-level pre-tokenizer's pattern, over texts of ASCII and Latin letters alone.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_SAFE = re.compile(f"[\t-\r\x20-\x7e{_LETTER}]*")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+")


# The printable character that stands for each byte in the vocabulary.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}


class Encoder:
    """Ids of texts by the tokenizers library, as little-endian u32 bytes.

    A byte-level BPE works on each piece of its pre-tokenizer alone, so its model gets each distinct piece once per
    worker.  Texts with other characters than ASCII and Latin letters, or that hold an added token, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        model, known = self.tokenizer.model, self.known
        for piece in pieces:
            shown = piece.encode().decode("latin-1").translate(_SHOWN)
            known[piece] = array("I", [t.id for t in model.tokenize(shown)]).tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > PIECES:
            self.known.clear()
        whole = {i for i, t in enumerate(texts) if not _SAFE.fullmatch(t) or any(a in t for a in self.added)}
        out: list[bytes] = [b""] * len(texts)
        if whole:
            for i, ids in zip(sorted(whole), self._whole([texts[i] for i in sorted(whole)])):
                out[i] = ids
        found = [() if i in whole else _PIECE.findall(t) for i, t in enumerate(texts)]
        new: set[str] = set()
        for pieces in found:
            new.update(filterfalse(self.known.__contains__, pieces))
        self._learn(new)
        for i, pieces in enumerate(found):
            if pieces:
                out[i] = b"".join(map(self.known.__getitem__, pieces))
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _write(folder: str, tokenizer: str, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, name = _encoder(tokenizer), None, ""
        for batch, texts in by_bytes(batches, "_t"):
            if writer is None:
                name, sink = create(folder, ".pfor")
                writer = Writer(sink)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.batch([t.decode("utf-8", "replace") for t in texts])):
                writer.add(doc_id, np.frombuffer(ids + tail, "<u4"))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([writer.total], pa.int64()), pa.array([len(writer.docs)], pa.int64())], ["shard", "n_ids", "n_docs"])

    return run


def write_shards(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0) -> DataFrame:
    """Writes the ids of every text and `end`, in ascending id order over all shards; the manifest: part, shard, n_ids, n_docs, start.

    Null texts are empty; a null id sorts first; rows with the same id are ordered by text.  A very long text
    is encoded whole in one task.  An empty table writes no shard; other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    dealt = rows.repartitionByRange(F.col("_id")).sortWithinPartitions("_id", "_t")
    made = dealt.mapInArrow(_write(folder, tokenizer, end), "shard string, n_ids long, n_docs long").select(F.spark_partition_id().alias("part"), "*")
    made = saved(made, "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return saved(made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "starts")


def _read(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with reopen(folder, shard) as source:
                    reader = Reader(source)
                    sizes = reader.docs["n"].astype(np.int64)
                    ends = np.cumsum(sizes)
                    sums = np.zeros(len(sizes), np.int64)
                    at, doc = 0, 0
                    for chunk in reader.chunks():
                        data, upto = memoryview(chunk.astype("<u4").tobytes()), at + len(chunk)
                        while doc < len(sizes):
                            low, high = max(int(ends[doc] - sizes[doc]), at), min(int(ends[doc]), upto)
                            sums[doc] = zlib.crc32(data[4 * (low - at) : 4 * (high - at)], int(sums[doc]))
                            if ends[doc] > upto:
                                break
                            doc += 1
                        at = upto
                    ids = pa.array(reader.docs["id"].copy(), mask=reader.docs["null"].astype(bool))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(ends - sizes + start), pa.array(sizes), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document, from the files."""
    shards = max(1, manifest.count())
    return manifest.select("shard", "start").repartition(shards).mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Texts written to shards of token ids and read back: one row a document, see `write_shards` and `read_shards`."""
    folder = scratch(docs.sparkSession, "shards")
    return read_shards(write_shards(docs, folder, tokenizer, **options), folder)
