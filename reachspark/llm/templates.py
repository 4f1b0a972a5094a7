"""Benchmark decontamination by template canonicalisation.

Numbers, names (capitalised words) and units after numbers become typed placeholders. Windows of
the resulting template are hashed; a window with too few ordinary words is hashed on its literal words instead,
so that a run of placeholders never matches by itself. Windows that ignore case, with placeholders for
numbers and units only, find re-cased copies. Documents are probed against the windows
of the benchmark. Hits on one item at one alignment are joined, and the values in the slots must
map consistently from item to document: the same passage, or the same question with other
numbers and names. Windows that hold a slot in conflict are dropped, unless they lie in a long
verbatim run. An item is found by the share that is covered or by one long run.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachspark.llm.textops import mix, shingles

WINDOW = 8
#: Ordinary words a template window needs.
LITERALS = 4
#: Share of an item's tokens that matched windows must cover.
COVERAGE = 0.6
#: Consecutive matched tokens that are enough; in shorter items half of the item, a window at least.
RUN = 13
#: Characters of benchmark text in one broadcast index.
BLOCK_CHARS = 8_000_000

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz pound pounds ton tons ml l liter liters "
    "litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "k c f degrees percent usd eur dollar dollars euro euros cent cents hz khz mhz w kw v mph kmh".split()
)
NUMBER, NAME, UNIT = np.uint64(1), np.uint64(2), np.uint64(4)
_KIND = np.uint64(7)
_SALT, _FOLDED = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Codes(dict):
    """Token to a hash of its lower-cased form with its kind in the low bits; forgotten when grown."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        low = token.lower()
        kind = NUMBER if token[0].isdigit() else (NAME if token[0].isupper() else 0) | (UNIT if low in UNITS else 0)
        self[token] = code = (xxhash.xxh64_intdigest(low) & ~7) | int(kind)
        return code


class Template:
    """Tokens, template codes and literal codes of one text; placeholders are the codes up to 4."""

    def __init__(self, text: str | None, codes: Codes):
        self.tokens = TOKEN.findall(text or "")
        found = np.fromiter(map(codes.__getitem__, self.tokens), np.uint64, len(self.tokens))
        self.literal = found & ~_KIND
        number, name = (found & NUMBER) > 0, (found & NAME) > 0
        unit = (found & UNIT) > 0
        unit[:1] = False
        unit[1:] &= number[:-1]
        self.folded = np.where(number, NUMBER, np.where(unit, UNIT, self.literal))
        self.codes = np.where(name, NAME, self.folded)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``size`` tokens, with names as placeholders and without regard to case."""
        if len(self.tokens) < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        literal = mix(shingles(self.literal, size) ^ _SALT)

        def hashes(codes: np.ndarray, salt: np.uint64) -> np.ndarray:
            plain = np.concatenate(([0], np.cumsum(codes > UNIT)))
            enough = plain[size:] - plain[:-size] >= min(LITERALS, size)
            return np.where(enough, shingles(codes, size) ^ salt, literal)

        return hashes(self.codes, np.uint64(0)), hashes(self.folded, _FOLDED)


def _enough(item: Template) -> int:
    """Length of a run that is enough for the item."""
    return min(RUN, max(WINDOW, -(-len(item.tokens) // 2)))


def _runs(positions: set[int]) -> list[list[int]]:
    """Maximal runs of consecutive positions."""
    runs: list[list[int]] = []
    for q in sorted(positions):
        if runs and runs[-1][-1] == q - 1:
            runs[-1].append(q)
        else:
            runs.append([q])
    return runs


class Index:
    """Windows of a block of benchmark items; an item shorter than a window is one window."""

    def __init__(self, items: list[tuple]):
        codes = Codes()
        self.items = [(item_id, Template(text, codes)) for item_id, text in items]
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        sizes = {WINDOW}
        for at, (_, item) in enumerate(self.items):
            size = min(WINDOW, len(item.tokens))
            if not size:
                continue
            sizes.add(size)
            for q, both in enumerate(zip(*map(np.ndarray.tolist, item.windows(size)), strict=True)):
                for h in set(both):
                    places[h].append((at, q))
        self.sizes, self.places = sorted(sizes), dict(places)
        self.keys = np.array(sorted(places), np.uint64)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, doc: Template) -> dict[tuple[int, int], set[int]]:
        """Starts of the item's matched windows per (item, alignment)."""
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        for size in self.sizes:
            for hashes in doc.windows(size):
                at = np.flatnonzero(self.seen[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
                for p in at.tolist():
                    for item, q in self.places.get(int(hashes[p]), ()):
                        if min(WINDOW, len(self.items[item][1].tokens)) == size:
                            found[item, p - q].add(q)
        return found

    @staticmethod
    def _consistent(item: Template, doc: Template, shift: int, starts: set[int]) -> set[int]:
        """Positions in windows without a slot in conflict, and in verbatim runs that are enough."""
        size = min(WINDOW, len(item.tokens))
        positions = {x for q in starts for x in range(q, q + size)}
        images: dict[tuple[int, str], set[str]] = defaultdict(set)
        keys = {q: (int(item.codes[q]), item.tokens[q].lower()) for q in positions if item.codes[q] <= UNIT}
        for q, key in keys.items():
            images[key].add(doc.tokens[q + shift].lower())
        torn = {q for q, key in keys.items() if len(images[key]) > 1}
        if not torn:
            return positions
        kept = {x for q in starts if torn.isdisjoint(range(q, q + size)) for x in range(q, q + size)}
        equal = {q for q in positions if item.literal[q] == doc.literal[q + shift]}
        return kept.union(*(run for run in _runs(equal) if len(run) >= _enough(item)))

    def leaks(self, doc: Template) -> Iterator[tuple]:
        """``item_id, n_tokens, covered, slots, changed`` of every item in the document."""
        covered: dict[int, set[int]] = defaultdict(set)
        slots: dict[int, int] = defaultdict(int)
        changed: dict[int, int] = defaultdict(int)
        long: set[int] = set()
        for (at, shift), starts in sorted(self.hits(doc).items()):
            item = self.items[at][1]
            positions = self._consistent(item, doc, shift, starts)
            pairs = [(item.tokens[q].lower(), doc.tokens[q + shift].lower()) for q in positions if item.codes[q] <= UNIT]
            covered[at] |= positions
            slots[at] += len(pairs)
            changed[at] += sum(x != y for x, y in pairs)
            if max(map(len, _runs(positions)), default=0) >= _enough(item):
                long.add(at)
        for at, positions in covered.items():
            item_id, item = self.items[at]
            if positions and (at in long or len(positions) >= COVERAGE * len(item.tokens)):
                yield item_id, len(item.tokens), len(positions), slots[at], changed[at]


def _templates(column: pa.Array, codes: Codes) -> Iterator[Template]:
    for text in column.to_pylist():
        yield Template(text, codes)


def _leak_rows(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            rows = []
            for doc_id, doc in zip(batch.column(0).to_pylist(), _templates(batch.column(1), codes), strict=True):
                rows += [(doc_id, *leak) for leak in index.value.leaks(doc)]
            if rows:
                columns = list(zip(*rows, strict=True))
                names = ["doc_id", "item_id", "n_tokens", "covered", "slots", "changed"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def _clean_rows(index, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            keep = [next(index.value.leaks(doc), None) is None for doc in _templates(texts, codes)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _indexes(benchmark: DataFrame) -> Iterator:
    """Broadcast indexes over blocks of the benchmark, each of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    for b in range(blocks):
        rows = items.where(block == b).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in rows]))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_tokens, covered, slots, changed`` for every item found in a document.

    ``n_tokens`` counts the item's tokens, ``covered`` those inside matched windows, ``slots`` the
    matched placeholders and ``changed`` those with another value: 0 for a literal copy. Whole texts are
    probed. NULL and empty texts hold nothing, and nothing is found of an item without tokens;
    NULL ids are kept as they are; repeated rows give repeated results; other columns are
    ignored; an empty table on either side gives no rows. The benchmark is broadcast in blocks
    of bounded size, one pass over the documents each, so nothing of the documents is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_tokens long, covered long, slots long, changed long"
    found = docs.sparkSession.createDataFrame([], schema)
    for index in _indexes(benchmark):
        found = found.unionByName(rows.mapInArrow(_leak_rows(index), schema))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item of the benchmark is found, with all their columns."""
    for index in _indexes(benchmark):
        docs = docs.mapInArrow(_clean_rows(index, "text"), docs.schema)
    return docs
