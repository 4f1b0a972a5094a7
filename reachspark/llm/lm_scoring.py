"""Language-model scores of documents by an n-gram model whose size follows the corpus.

The corpus is tokenised once into blocks of bounded size (word ids and the block's own vocabulary).
Each block sends its distinct n-grams to shards: an n-gram goes to the shard of its
context, so a shard has whole contexts, and a frequent word is no hot shard, because its contexts
spread and a context's successors number a vocabulary at most. A shard adds up the counts
and becomes one compact trie (:mod:`ef_trie`): a binary row of the model table. To score, a
block asks the shards for its distinct n-grams; a shard maps its trie into memory and
answers with quantised parts of the interpolated probability; the answers meet the block again,
where they are combined and summed by document. No task holds more than a block or a shard of the model.

The model interpolates by absolute discounting: with ``c`` occurrences of a word after a context that occurs
``n`` times with ``t`` different successors, ``p = (c - D) / n + D t / n * p_shorter``; below the shortest context stands
``(c + 0.1) / (N + 0.1 (V + 1))``, which leaves one part for words never seen. Quantised parts are rounded
down, so the probabilities of all words after a context sum to one at most.
"""

from __future__ import annotations

import mmap
import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachspark.llm.ef_trie import ABSENT, Increasing, Trie, decoded, ef_arrays, from_buffer, quantise, to_bytes, trie_arrays
from reachspark.llm.textops import LOWER, fingerprints, mix, pieces, spans, utf8
from reachspark.session import cut, spread

ORDER, DISCOUNT = 2, 0.75
#: Bytes of text in a block (one document at least) and, on average, behind a shard.
BLOCK_BYTES, SHARD_BYTES = 6 << 20, 8 << 20
#: Frequent words that payloads name by number instead of value; they shorten payloads and decide nothing.
COMMON = 1 << 16
_NONE = np.zeros(0, np.uint64)
#: Words are told apart by 56 bits, which leave about seven chance pairs among a thousand million different words.
_WIDTH = np.uint64(8)
_START, _END = np.uint64(0x5D7A3C1E9B86F0), np.uint64(0xA1C4E7092B6D8F)
_BLOCKS = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, train_tokens long, payload binary"
_PACKED = "shard int, block long, payload binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_codec = pa.Codec("zstd", compression_level=5)


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed buffer, the bytes of equal weight next to each other."""
    planes = []
    for a in arrays:
        planes.append(np.array([len(a), a.itemsize], np.int64).tobytes() + a.dtype.str.encode().ljust(8))
        planes.append(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
    raw = b"".join(planes)
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = _codec.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    at, out = 0, []
    while at < len(raw):
        n, size = np.frombuffer(raw, np.int64, 2, at)
        kind = np.dtype(raw[at + 16 : at + 24].decode().strip())
        at += 24
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    return out


def held_out(doc_id: int | None) -> bool:
    """One document in ten is not learnt from, by the checksum of its id (NULL: of nothing)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tokenise(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents as word ids: lower-cased words and one end a document; a NULL text has the end only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, "text", block_bytes):
            raw, offsets = utf8(batch.column("text"))
            raw = LOWER[raw]
            starts, ends, first = spans(raw, offsets)
            words, which = np.unique(fingerprints(raw, starts, ends) >> _WIDTH, return_inverse=True)
            # the most frequent words have the smallest ids, which compress best
            by_count = np.argsort(-np.bincount(which, minlength=len(words)), kind="stable")
            words, which = words[by_count], np.argsort(by_count)[which]
            ids = batch.column("doc_id").to_pylist()
            held = [held_out(i) for i in ids]
            lengths = (np.diff(first) + 1).astype(np.int32)
            train = int(lengths[~np.array(held, bool)].sum())
            payload = _pack([words, which.astype(np.int32)])
            row = [[number], [ids], [held], [lengths.tolist()], [train], [payload]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in _BLOCKS.split(", ")])
            number += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, _BLOCKS)


@dataclass
class Block:
    """Distinct n-grams of a block: ``columns[k]`` of order k+1, as vocabulary ids, and which one ends at each token."""

    words: np.ndarray
    lengths: np.ndarray
    columns: list[list[np.ndarray]]
    which: list[np.ndarray]
    shards: list[np.ndarray]
    order: list[np.ndarray]


def _block(payload: bytes, lengths: list[int], order: int, shards: int) -> Block:
    """The n-grams of a block's documents, each of which starts after ``order - 1`` start marks."""
    words, flat = _unpack(payload)
    by_value = np.argsort(words)
    flat = np.argsort(by_value)[flat]
    lengths = np.array(lengths, np.int64)
    words = np.concatenate((words[by_value], [_START, _END]))
    start, end = len(words) - 2, len(words) - 1
    pads = order - 1
    stop = np.cumsum(lengths + pads)
    seq = np.full(int(stop[-1]) if len(stop) else 0, start, np.int64)
    seq[stop - 1] = end
    text = np.repeat(np.arange(len(lengths)), lengths - 1)
    seq[np.arange(len(flat)) + text * order + pads] = flat
    counted = np.ones(len(seq), bool)
    counted[(stop - lengths - pads)[:, None] + np.arange(pads)] = False
    at = np.flatnonzero(counted)
    n = np.int64(len(words))
    used, last = np.unique(seq, return_inverse=True)
    columns, which = [[used]], [last.astype(np.int32)]
    for k in range(1, order):
        # an n-gram is the shorter one before it and its last word
        found, back = np.unique(which[-1][:-1].astype(np.int64) * n + seq[k:], return_inverse=True)
        columns.append([c[found // n] for c in columns[-1]] + [found % n])
        which.append(back.astype(np.int32))
    # count only those that end at a token of the document they start in
    shard, by_shard, ends = [], [], []
    for k in range(order):
        inverse = which[k][at - k]
        mine, inverse = np.unique(inverse, return_inverse=True)
        columns[k] = [c[mine] for c in columns[k]]
        key = np.zeros(len(mine), np.uint64)
        for c in columns[k][: max(k, 1)]:
            key = mix(key + words[c] + np.uint64(k))
        shard.append((key % np.uint64(shards)).astype(np.int32))
        by_shard.append(np.argsort(shard[-1], kind="stable"))
        ends.append(inverse)
    return Block(words, lengths, columns, ends, shard, by_shard)


def _by_shard(block: Block, counts: list[np.ndarray] | None, common: np.ndarray = _NONE) -> Iterator[tuple[int, bytes]]:
    """The n-grams of each shard, in the block's order, with the part of the vocabulary they use: common words, then others."""
    number = np.searchsorted(common, block.words)
    known = np.append(common, np.uint64(0))[number] == block.words if len(common) else np.zeros(len(block.words), bool)
    bounds = [np.searchsorted(s[o], np.arange(int(max(x.max(initial=-1) for x in block.shards)) + 2)) for s, o in zip(block.shards, block.order, strict=True)]
    for shard in range(len(bounds[0]) - 1):
        rows = [o[b[shard] : b[shard + 1]] for o, b in zip(block.order, bounds, strict=True)]
        if not sum(map(len, rows)):
            continue
        columns = [[c[r] for c in cols] for cols, r in zip(block.columns, rows, strict=True)]
        used = np.unique(np.concatenate([c for cols in columns for c in cols]))
        named, other = used[known[used]], used[~known[used]]
        local = np.empty(len(used), np.int32)
        local[known[used]] = np.arange(len(named))
        local[~known[used]] = np.arange(len(named), len(used))
        out = [np.diff(number[named].astype(np.int32), prepend=np.int32(0)), np.diff(block.words[other], prepend=np.uint64(0))]
        for k, cols in enumerate(columns):
            out += [np.diff(local[np.searchsorted(used, c)], prepend=np.int32(0)) for c in cols]
            if counts is not None:
                out.append(counts[k][rows[k]].astype(np.int32))
        yield shard, _pack(out)


def _grams(blocks: DataFrame, shards: int, order: int, counted: bool, common: np.ndarray = _NONE) -> DataFrame:
    """``shard, block, payload``: distinct n-grams of every block, if asked with their counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _block(row["payload"], row["lengths"], order, shards)
                learnt = np.repeat(~np.array(row["held"], bool), block.lengths)
                counts = [np.bincount(w[learnt], minlength=len(c[0])) for w, c in zip(block.which, block.columns, strict=True)] if counted else None
                for shard, payload in _by_shard(block, counts, common):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([payload], pa.binary())],
                        names=["shard", "block", "payload"],
                    )

    return spread(blocks.mapInArrow(run, _PACKED), "shard")


def _merged(payloads: list[bytes], order: int, counted: bool, common: np.ndarray = _NONE) -> tuple[np.ndarray, list[list[np.ndarray]], list[np.ndarray], list[np.ndarray], list[list[int]]]:
    """Distinct n-grams of many payloads: vocabulary, sorted columns, summed counts, where each row went, rows per payload."""
    parts = [_unpack(p) for p in payloads]
    for p in parts:
        p[0] = np.concatenate((common[np.cumsum(p[0])], np.cumsum(p.pop(1), dtype=np.uint64)))
    vocabulary = np.unique(np.concatenate([p[0] for p in parts]))
    columns: list[list[np.ndarray]] = []
    counts, back, sizes = [], [], []
    at = 1
    for k in range(order):
        ids = [np.concatenate([np.searchsorted(vocabulary, p[0])[np.cumsum(p[at + j])] if len(p[at + j]) else np.zeros(0, np.int64) for p in parts]) for j in range(k + 1)]
        sizes.append([len(p[at]) for p in parts])
        which = ids[0]
        found, which = np.unique(which, return_inverse=True)
        cols = [found]
        for j in range(1, k + 1):
            found, which = np.unique(which * len(vocabulary) + ids[j], return_inverse=True)
            cols = [c[found // len(vocabulary)] for c in cols] + [found % len(vocabulary)]
        columns.append(cols)
        back.append(which)
        at += k + 1
        if counted:
            counts.append(np.bincount(which, np.concatenate([p[at] for p in parts]), len(found)).astype(np.int64))
            at += 1
    return vocabulary, columns, counts, back, sizes


def _build(vocabulary: np.ndarray, columns: list[list[np.ndarray]], counts: list[np.ndarray], discount: float) -> bytes:
    """A shard's tries, one an order, of the n-grams that were learnt."""
    arrays = {f"w.{k}": v for k, v in ef_arrays(vocabulary).items()}
    for k, (cols, count) in enumerate(zip(columns, counts, strict=True)):
        learnt = count > 0
        count = count[learnt]
        made, firsts = trie_arrays([c[learnt] for c in cols])
        arrays |= {f"{k}.{name}": v for name, v in made.items()}
        if k == 0:
            # counts stay exact, as an increasing sequence of their sums
            arrays |= {f"0.c.{name}": v for name, v in ef_arrays(np.concatenate(([0], np.cumsum(count)))).items()}
            continue
        first = firsts[k - 1]
        follow = np.diff(np.append(first, len(count)))
        total = np.add.reduceat(count, first) if len(first) else first
        arrays[f"{k}.own"] = quantise((count - discount) / np.repeat(total, follow))
        arrays[f"{k}.shorter"] = quantise(discount * follow / np.maximum(total, 1))
    return to_bytes(arrays)


@dataclass
class Model:
    """``table(shard, words, levels)``, the tokens learnt from, their different words, and what the shards were cut by."""

    table: DataFrame
    train_tokens: int
    vocabulary: int
    shards: int
    order: int


def shards_for(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(size) // shard_bytes))


def train(blocks: DataFrame, shards: int, order: int = ORDER, discount: float = DISCOUNT) -> Model:
    """Count the n-grams of the blocks' training documents and write the model table, to be kept or used by :func:`score`.

    Counts are combined by block before they are shuffled.
    """

    def build(group: pa.Table) -> pa.Table:
        vocabulary, columns, counts, _, _ = _merged(group.column("payload").to_pylist(), order, True)
        levels = _build(vocabulary, columns, counts, discount)
        words = pa.array([int((counts[0] > 0).sum())], pa.int64())
        return pa.table({"shard": group.column("shard").slice(0, 1), "words": words, "levels": pa.array([levels], pa.binary())})

    table = cut(_grams(blocks, shards, order, True).groupBy("shard").applyInArrow(build, "shard int, words long, levels binary"))
    return Model(table, _tokens(blocks), table.agg(F.sum("words")).first()[0] or 0, shards, order)


def _tokens(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("train_tokens")).first()[0] or 0


def _vocabulary(blocks: DataFrame, shards: int) -> tuple[int, np.ndarray]:
    """Different words, ends included, of the training documents, and about COMMON of the words that are in most blocks.

    Each word is counted in the shard of its value.
    """
    most = max(1, COMMON // shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, flat = _unpack(row["payload"])
                learnt = ~np.array(row["held"], bool)
                seen = np.zeros(len(words), bool)
                seen[flat[np.repeat(learnt, np.array(row["lengths"]) - 1)]] = True
                words = np.append(words[seen], np.full(int(learnt.any()), _END))
                shard = (mix(words) % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                found, start = np.unique(shard[order], return_index=True)
                parts = [_pack([w]) for w in np.split(words[order], start[1:])] if len(found) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.int32()), pa.array(np.full(len(found), row["block"]), pa.int64()), pa.array(parts, pa.binary())], names=["shard", "block", "payload"]
                )

    def count(group: pa.Table) -> pa.Table:
        different, times = np.unique(np.concatenate([_unpack(p)[0] for p in group.column("payload").to_pylist()]), return_counts=True)
        frequent = different[np.argsort(-times, kind="stable")[:most]]
        return pa.table({"shard": group.column("shard").slice(0, 1), "words": pa.array([len(different)], pa.int64()), "frequent": pa.array([frequent.tobytes()], pa.binary())})

    found = cut(spread(blocks.mapInArrow(run, _PACKED), "shard").groupBy("shard").applyInArrow(count, "shard int, words long, frequent binary"))
    rows = found.filter(F.col("shard") < COMMON).select("frequent").collect()  # COMMON words at most
    words = np.frombuffer(b"".join(bytes(x["frequent"]) for x in rows), np.uint64)
    return found.agg(F.sum("words")).first()[0] or 0, np.sort(words)


def _answer(levels: bytes, vocabulary: np.ndarray, columns: list[list[np.ndarray]], back: list[np.ndarray], sizes: list[list[int]]) -> list[bytes]:
    """Per payload, packed: exact counts of its words, then codes of each n-gram's own part and of its context's rest.

    The trie is mapped from a file without a name, so the system may drop its pages and nothing stays behind.
    """
    found: list[list[np.ndarray]] = []
    with tempfile.TemporaryFile() as file:
        file.write(levels)
        file.flush()
        view = from_buffer(memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)))
        words = Increasing({k[2:]: v for k, v in view.items() if k.startswith("w.")})
        asked = vocabulary.astype(np.int64)
        ids = words.find(asked, np.zeros_like(asked), np.full_like(asked, words.n))
        for k, cols in enumerate(columns):
            path = Trie(view, f"{k}.", k + 1).find([ids[c] for c in cols])
            if k == 0:
                sums = Increasing({n[4:]: v for n, v in view.items() if n.startswith("0.c.")})
                here = np.flatnonzero(path[0] >= 0)
                count = np.zeros(len(path[0]), np.int64)
                count[here] = sums.access(path[0][here] + 1) - sums.access(path[0][here])
                found.append([count])
            else:
                own, shorter = np.append(view[f"{k}.own"], np.uint16(ABSENT)), np.append(view[f"{k}.shorter"], np.uint16(0))
                found.append([own[path[k]], shorter[path[k - 1]]])
    out: list[list[np.ndarray]] = [[] for _ in sizes[0]]
    for k, parts in enumerate(found):
        at = np.concatenate(([0], np.cumsum(sizes[k])))
        for i, mine in enumerate(out):
            mine += [a[back[k][at[i] : at[i + 1]]] for a in parts]
    return [_pack(a) for a in out]


def score(blocks: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` uses word counts alone, ``score`` the whole model; both are log10 probabilities of all words and
    the end. Repeated rows are scored alike and all returned; a NULL or empty text has its end alone; a NULL id counts as held
    out; texts of any length are scored whole; an empty table gives no rows.
    """
    order = model.order

    def answer(key, asked: pa.Table, known: pa.Table) -> pa.Table:
        rows = []
        if asked.num_rows:
            vocabulary, columns, _, back, sizes = _merged(asked.column("payload").to_pylist(), order, False)
            nothing = [np.zeros(len(c[0]), np.int64) for c in columns]
            levels = known.column("levels")[0].as_py() if known.num_rows else _build(vocabulary, columns, nothing, 0.0)
            rows = _answer(levels, vocabulary, columns, back, sizes)
        return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "answer": pa.array(rows, pa.binary())})

    asked = _grams(blocks, model.shards, order, False).groupBy("shard")
    answers = asked.cogroup(spread(model.table, "shard").groupBy("shard")).applyInArrow(answer, "block long, shard int, answer binary")
    return _combined(blocks, answers, model.train_tokens, model.vocabulary, model.shards, order)


def _combined(blocks: DataFrame, answers: DataFrame, n: int, v: int, shards: int, order: int) -> DataFrame:
    """Scores of every block's documents from the answers of the shards."""

    def combine(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answers = {s: _unpack(a) for s, a in zip(right.column("shard").to_pylist(), right.column("answer").to_pylist(), strict=True)}
        for row in left.to_pylist():
            block = _block(row["payload"], row["lengths"], order, shards)
            # the parts of every order, put back from shard order
            parts: list[list[np.ndarray]] = []
            for k in range(order):
                shard, by = block.shards[k], block.order[k]
                which = np.unique(shard)
                kinds = [np.int64] if k == 0 else [np.uint16, np.uint16]
                parts.append([])
                for j, kind in enumerate(kinds):
                    values = np.empty(len(shard), kind)
                    values[by] = np.concatenate([answers[s][(0 if k == 0 else 2 * k - 1) + j] for s in which.tolist()])
                    parts[-1].append(values)
            count = parts[0][0][block.which[0]]
            p = base = (count + 0.1) / (n + 0.1 * (v + 1))
            for k in range(1, order):
                own, rest = (decoded(x)[block.which[k]] for x in parts[k])
                p = own + rest * p
            first = np.concatenate(([0], np.cumsum(block.lengths)[:-1]))
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "held_out": pa.array(row["held"], pa.bool_()),
                        "n_tokens": block.lengths,
                        "n_known": np.add.reduceat((count > 0).astype(np.int64), first),
                        "train_tokens": np.full(len(first), n, np.int64),
                        "base_score": np.add.reduceat(np.log10(base), first),
                        "score": np.add.reduceat(np.log10(p), first),
                    }
                )
            )
        return pa.concat_tables(out) if out else pa.schema([(f.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.split()[1]]) for f in _SCORES.split(", ")]).empty_table()

    return spread(blocks, "block").groupBy("block").cogroup(spread(answers, "block").groupBy("block")).applyInArrow(combine, _SCORES)


def score_corpus(docs: DataFrame, order: int = ORDER, discount: float = DISCOUNT, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Train on nine documents in ten and score all of them, with one shuffle of the n-grams; see :func:`score`."""

    def learn(group: pa.Table) -> pa.Table:
        vocabulary, columns, counts, back, sizes = _merged(group.column("payload").to_pylist(), order, True, common)
        levels = _build(vocabulary, columns, counts, discount)
        del counts
        rows = _answer(levels, vocabulary, columns, back, sizes)
        return pa.table({"block": group.column("block"), "shard": group.column("shard"), "answer": pa.array(rows, pa.binary())})

    shards = shards_for(docs, shard_bytes)
    blocks = cut(tokenise(docs, block_bytes))
    words, common = _vocabulary(blocks, shards)
    answers = _grams(blocks, shards, order, True, common).groupBy("shard").applyInArrow(learn, "block long, shard int, answer binary")
    return _combined(blocks, answers, _tokens(blocks), words, shards, order)
