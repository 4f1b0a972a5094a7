"""Token files: ids in ORC, in document order, with row indexes and Bloom filters on the id.

Integer columns and the elements of ``token_ids`` use ORC's integer run-length encoding. Files are
range-partitioned and sorted by document, so stripe and row-group statistics prune lookups by id,
Bloom filters prune ids that fall between, and readers split files at stripes.
"""

from __future__ import annotations

import json
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachspark.llm.textops import fingerprints, pieces, second_fingerprints, spans, utf8

END_ID = 2
FILE_SCHEMA = "part int, doc_id long, local_start long, n_tokens long, token_ids array<int>"
_MARKS = "".join(c for c in string.punctuation if c != "'")
_LATIN_END = chr(0x250)
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
#: Byte-level vocabularies write a byte that prints as itself, the others in order from U+0100 on.
_BYTE_ALPHABET = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Encoder:
    """Encodes whole texts with the tokenizers library, each distinct word of a batch once.

    This is done for lower-casing byte-level BPE vocabularies whose tokens never cross white
    space. There an alphabetic Latin word is one unit: it is normalised, mapped to the byte
    alphabet and handed to the library's BPE model. All other words, marks and special tokens
    pass through the library's whole chain, as do all texts if the vocabulary is of another
    kind. The result equals that of encoding each text as a whole.
    """

    def __init__(self, path: str, remembered: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        normal = [x["type"] for x in (config["normalizer"] or {}).get("normalizers", [])]
        cuts = [x["type"] for x in (config["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_words = normal == ["NFC", "Replace", "Lowercase"] and cuts == ["Split", "ByteLevel"]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int32).tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.known) > self.remembered:
            self.known = {}
        known, tokenize = self.known, self.tokenizer.model.tokenize
        out: list[bytes] = []
        late: list[tuple[int, str]] = []
        for word in words:
            stem = word.rstrip(_MARKS)
            ids = known.get(stem)
            if ids is None and stem.isalpha() and (stem.isascii() or max(stem) < _LATIN_END):
                low = unicodedata.normalize("NFC", stem).lower()
                ids = known.get(low)
                if ids is None and low.isalpha():
                    unit = low if low.isascii() else low.encode().decode("latin-1").translate(_BYTE_ALPHABET)
                    ids = known[low] = np.array([t.id for t in tokenize(unit)], np.int32).tobytes()
            if ids is None:
                late.append((len(out), word))
                out.append(b"")
            elif len(stem) == len(word):
                out.append(ids)
            else:
                marks = word[len(stem) :]
                tail = known.get(marks)
                if tail is None:
                    tail = known[marks] = self._whole([marks])[0]
                out.append(ids + tail)
        if late:
            for (at, _), ids in zip(late, self._whole([w for _, w in late]), strict=True):
                out[at] = ids
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end id included, and their offsets."""
        raw, offsets = utf8(column)
        starts, ends, first = spans(raw, offsets)
        one = fingerprints(raw, starts, ends)
        _, example, which = np.unique(one, return_index=True, return_inverse=True)
        two = second_fingerprints(raw, starts, ends)
        n = len(offsets) - 1
        if not self.by_words or not np.array_equal(two[example][which], two):
            found = self._whole([t or "" for t in column.to_pylist()])
            flat = np.frombuffer(b"".join(f + np.int32(END_ID).tobytes() for f in found), np.int32)
            return flat, np.concatenate(([0], np.cumsum([len(f) // 4 + 1 for f in found])))
        data = raw.tobytes()
        words = [data[a:b].decode() for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
        ids = [*self._words(words), np.int32(END_ID).tobytes()]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = np.concatenate(([0], np.cumsum(size)[:-1]))
        flat = np.frombuffer(b"".join(ids), np.int32)
        # each text is its words followed by the end mark
        order = np.insert(which, first[1:], len(ids) - 1) if n else which
        long = size[order]
        total = np.concatenate(([0], np.cumsum(long)))
        take = np.arange(total[-1], dtype=np.int64) + np.repeat(at[order] - total[:-1], long)
        bounds = np.concatenate(([0], total[first[1:] + np.arange(1, n + 1)]))
        return flat[take], bounds


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        encoder = Encoder(path)
        before = 0
        for batch in pieces(batches, "text"):
            ids, bounds = encoder.encode(batch.column(1))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)),
                    batch.column(0),
                    pa.array(before + bounds[:-1]),
                    pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                ],
                names=["part", "doc_id", "local_start", "n_tokens", "token_ids"],
            )
            before += int(bounds[-1])

    return run


def write_token_files(docs: DataFrame, tokenizer: str, path: str, stripe_bytes: int = 16 << 20, stride: int = 1000) -> None:
    """Encode ``docs(doc_id, text)`` and write the ids to ORC files in ascending order of ``doc_id``.

    Every text is encoded whole and ends with id 2. NULL and empty texts hold only the end id.
    NULL ids come first; rows with one id are ordered by a hash of the text, equal rows are all
    written. Other columns are ignored. An empty table gives an empty dataset. File number
    ``part`` and the position ``local_start`` inside it are stored with each document.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text_hash, salt = F.xxhash64("text"), F.pmod(F.monotonically_increasing_id(), F.lit(1024))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", text_hash).withColumn("s", salt)
    rows = rows.repartitionByRange(width, "doc_id", "h", "s").sortWithinPartitions("doc_id", "h", "s")
    encoded = rows.select("doc_id", "text").mapInArrow(_encoded(tokenizer), FILE_SCHEMA)
    (
        encoded.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``part, doc_id, local_start, n_tokens, token_ids``; tasks take stripes."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Documents by id: the predicate reaches stripe statistics, row indexes and Bloom filters."""
    return read_token_files(spark, path).where(F.col("doc_id").isin(ids))


def starts(files: DataFrame) -> DataFrame:
    """``part, base``: ids in all earlier files. One row per file meets in the window."""
    totals = files.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(2)
        bounds = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        data = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def digest(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document, from its stored ids.

    The starts are broadcast: they are one row per file, as many as shuffle partitions.
    """
    placed = files.join(F.broadcast(starts(files)), "part")
    placed = placed.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "token_ids")
    return placed.mapInArrow(_checked, "doc_id long, start long, n_tokens long, ids_crc32 long")
