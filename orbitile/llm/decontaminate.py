"""Benchmark decontamination by SimHash windows of the items' sizes.

Each benchmark item has a SimHash fingerprint over its words and word pairs. A
document is read through windows as long as the item, in words; a window's fingerprint
comes from prefix sums of bit counts. Fingerprints meet through a multi-index: 64 bits
are cut into eight blocks of 8, and two fingerprints within RADIUS = 23 bits have a
block within 2 bits, so looking a window's eight blocks up in tables that hold, for each
item size, the items' blocks with all changes of up to 2 bits finds every item of the
window's size within the radius. A window that holds just SIMILARITY of an item differs in
15 bits at the mean, in 23 or fewer in 99 of 100 cases; nothing else makes a candidate.
Candidates are verified exactly: the share of the item's weighted word shingles
(weight: log of how rare the shingle is among items) that the window holds, at least
SIMILARITY.

A window that shares no shingle with an item cannot pass the verification, so only
windows around shingles of the benchmark are fingerprinted; this loses nothing.

A broadcast index holds ITEMS_A_PASS items whose texts have TEXT_A_PASS bytes together, or
one longer item. More items are further passes over the corpus, one index at a time, of
which only matches are written.

Cases: null or word-free texts and items match nothing; an item of fewer words than a
shingle is one shingle, its whole word sequence, and a window as long as the item; of
items of equal text all match; repeated rows are judged alike; columns beyond doc_id,
text and item_id, text are ignored; with an empty benchmark no document is
contaminated; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitile.llm.shared import materialize
from orbitile.llm.textbytes import Words, bits_to_long, grams, mix, text_slices

WIDTH = 5
SIMILARITY = 0.75
RADIUS, BLOCKS = 23, 8
BLOCK_BITS = 64 // BLOCKS
#: Items whose index is broadcast at a time, and bytes of their texts.
ITEMS_A_PASS, TEXT_A_PASS = 5_000, 1 << 25

#: Words of a window up to which the counts of words and pairs fit lanes of 16 bits.
MOST_LANES = 32_000
_NEAR = np.array([sum(1 << b for b in chosen) for n in range(RADIUS // BLOCKS + 1) for chosen in combinations(range(BLOCK_BITS), n)], np.uint32)


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes at each word: the word, and the pair it begins (0: none)."""
    h = words.hashes
    pair = np.zeros(len(h), np.uint64)
    if len(h) > 1:
        pair[:-1] = mix(h[:-1] * np.uint64(3) + h[1:], 91)
        pair[:-1][words.text[1:] != words.text[:-1]] = 0
    return mix(h, 90), pair


class Fingerprints:
    """SimHashes of any word windows of a slice, from packed prefix sums."""

    def __init__(self, words: Words):
        self.sums = []
        for values in _features(words):
            rows = np.zeros((16, len(values) + 1), np.uint64)
            for k in range(16):
                np.cumsum((values >> np.uint64(k)) & np.uint64(0x0001000100010001), out=rows[k, 1:])
            self.sums.append(rows)

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        bits = np.zeros((len(start), 64), bool)
        long = np.flatnonzero(size > MOST_LANES)
        for k in long:  # parts whose counts fit the lanes
            cuts = np.arange(start[k], start[k] + size[k], MOST_LANES)
            parts = np.minimum(MOST_LANES, start[k] + size[k] - cuts)
            pair_ends = np.minimum(cuts + parts, start[k] + size[k] - 1)
            bits[k] = 2 * self._counts(cuts, cuts + parts, pair_ends).sum(axis=0) > 2 * size[k] - 1
        rest = np.flatnonzero(size <= MOST_LANES)
        begin, end = start[rest], start[rest] + size[rest]
        for i in range(0, len(rest), 1 << 14):
            part = slice(i, i + (1 << 14))
            bits[rest[part]] = 2 * self._counts(begin[part], end[part], end[part] - 1) > (2 * size[rest[part]] - 1)[:, None]
        return bits_to_long(bits)

    def _counts(self, start: np.ndarray, end: np.ndarray, pair_end: np.ndarray) -> np.ndarray:
        """Set bits of the words from start to end and of the pairs from start to pair_end, (windows, 64)."""
        one, two = self.sums
        packed = one[:, end] - one[:, start] + two[:, pair_end] - two[:, start]
        return np.concatenate([((packed >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64) for lane in range(4)]).T


def shingles_of(words: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingle that begins at each word (0: none), for full shingles only."""
    out = np.zeros(len(words.hashes), np.uint64)
    h, _, at = grams(words, width)
    out[at] = h | np.uint64(1)
    return out, at


class Index:
    """Fingerprints, block tables and weighted shingles of some items."""

    def __init__(self, ids: list[int], texts: list[str]):
        body = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
        words = Words(body, offsets)
        kept = np.flatnonzero(words.counts > 0)
        self.ids = np.array(ids, np.int64)[kept]
        self.size = words.counts[kept]
        self.prints = Fingerprints(words).of(words.first[:-1][kept], self.size) if len(kept) else np.zeros(0, np.uint64)
        # shingle -> items; short items: one shingle of their own width
        rows = []
        for width in sorted({min(WIDTH, int(n)) for n in self.size}):
            h, _ = shingles_of(words, width)
            for item, n in enumerate(self.size):
                if min(WIDTH, int(n)) == width:
                    own = h[words.first[kept[item]] : words.first[kept[item]] + n - width + 1]
                    rows += [(x, item, width) for x in sorted(set(own.tolist()))]
        self.shingle = np.array([r[0] for r in rows], np.uint64)
        self.item = np.array([r[1] for r in rows], np.int64)
        self.width = np.array([r[2] for r in rows], np.int64)
        order = np.argsort(self.shingle, kind="stable")
        self.shingle, self.item, self.width = self.shingle[order], self.item[order], self.width[order]
        holders = np.searchsorted(self.shingle, self.shingle, "right") - np.searchsorted(self.shingle, self.shingle, "left")
        self.weight = np.log(1 + len(self.ids) / np.maximum(holders, 1))
        self.total = np.bincount(self.item, self.weight, len(self.ids))
        self.widths = sorted(set(self.width.tolist()))
        # block tables: (item size, block number, changed block value) -> items, sorted by key
        keys, items = [], []
        for b in range(BLOCKS):
            block = (self.prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)
            keys.append((self._block_key(self.size, b)[:, None] + (block[:, None].astype(np.uint32) ^ _NEAR[None, :])).ravel())
            items.append(np.repeat(np.arange(len(block)), len(_NEAR)))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.block_item, self.block_key = np.concatenate(items)[order].astype(np.int32), key[order]

    def _block_key(self, size: np.ndarray, block: int) -> np.ndarray:
        return (np.asarray(size, np.int64) * BLOCKS + block) << BLOCK_BITS

    def near(self, prints: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of equal size within RADIUS bits, each once."""
        found = []
        for b in range(BLOCKS):
            key = self._block_key(size, b) + ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            low = np.searchsorted(self.block_key, key, "left")
            n = np.searchsorted(self.block_key, key, "right") - low
            window = np.repeat(np.arange(len(prints)), n)
            item = self.block_item[np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            found.append(window[close] * len(self.ids) + item[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(len(self.ids), 1), pairs % max(len(self.ids), 1)

    def matches(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, similarity) of all contaminated texts of a slice."""
        none = np.zeros(0, np.int64)
        words = Words(body, offsets)
        if len(self.ids) == 0 or len(words.hashes) == 0:
            return none, none, np.zeros(0)
        # every place where a shingle of some item begins: (word, row of the shingle table)
        place, row = [], []
        for width in self.widths:
            h, at = shingles_of(words, width)
            low, high = np.searchsorted(self.shingle, h[at], "left"), np.searchsorted(self.shingle, h[at], "right")
            hit = np.flatnonzero(high > low)
            n = (high - low)[hit]
            before = np.cumsum(n) - n
            r = np.arange(int(n.sum())) + np.repeat(low[hit] - before, n)
            p = np.repeat(at[hit], n)
            same = self.width[r] == width
            place.append(p[same])
            row.append(r[same])
        place, row = np.concatenate(place), np.concatenate(row)
        if len(place) == 0:
            return none, none, np.zeros(0)
        # windows that hold a hit, each once: (item size, first word)
        size, start = self._windows(words, self.size[self.item[row]], place)
        if len(start) == 0:
            return none, none, np.zeros(0)
        window, item = self.near(Fingerprints(words).of(start, size), size)
        hit_key = self.item[row] * (len(words.hashes) + 1) + place
        order = np.argsort(hit_key, kind="stable")
        hit_key, hit_row = hit_key[order], row[order]
        key = np.unique(item * (len(words.hashes) + 1) + start[window])
        item, start = key // (len(words.hashes) + 1), key % (len(words.hashes) + 1)
        low, high = np.searchsorted(hit_key, key, "left"), np.searchsorted(hit_key, key + self._reach(item), "left")
        return self._verified(words.text[start], item, low, high, hit_row)

    def _verified(self, text, item, low, high, hit_row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, similarity) of the best window of each text and item, where it is similar enough.

        Windows are tried in falling order of what their hits weigh with repeats, which
        is never too little, until none left can hold more than the best so far.
        """
        total = np.concatenate([[0.0], np.cumsum(self.weight[hit_row])])
        bound = (total[high] - total[low]) / self.total[item]
        order = np.lexsort((-bound, item, text))
        found: dict[tuple[int, int], float] = {}
        for k in order.tolist():
            pair = (int(text[k]), int(item[k]))
            if bound[k] > found.get(pair, SIMILARITY - 1e-6):
                share = self._weight(hit_row[low[k] : high[k]]) / self.total[item[k]]
                found[pair] = max(share, found.get(pair, 0.0))
        good = [(t, i, share) for (t, i), share in found.items() if share >= SIMILARITY - 1e-9]
        text, item, share = zip(*good, strict=True) if good else ((), (), ())
        return np.array(text, np.int64), np.array(item, np.int64), np.array(share, np.float64)

    def _windows(self, words: Words, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(size, first word) of all windows of ``size`` words that hold a place, each once.

        The windows around a place are an interval of first words; overlapping intervals
        are joined before they are written out, so there are no more rows than words.
        """
        step = len(words.hashes) + 1
        owner = words.text[place]
        low = np.maximum(place - np.maximum(size - np.minimum(size, WIDTH), 0), words.first[owner])
        high = np.minimum(place, words.first[owner + 1] - size)
        some = np.flatnonzero(low <= high)
        key, end = size[some] * step + low[some], size[some] * step + high[some]
        order = np.argsort(key, kind="stable")
        key, end = key[order], np.maximum.accumulate(end[order]) if len(order) else end[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] > end[:-1] + 1])) if len(key) else order
        low, high = key[first], end[np.concatenate([first[1:], [len(key)]]) - 1] if len(key) else end
        n = high - low + 1
        at = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return at // step, at % step

    def _reach(self, item: np.ndarray) -> np.ndarray:
        """Shingles in a window of the item's size."""
        return self.size[item] - np.minimum(self.size[item], WIDTH) + 1

    def _weight(self, rows: np.ndarray) -> float:
        return float(self.weight[np.unique(rows)].sum())


_FOUND = "doc_id long, text_a long, text_b long, item_ids array<long>, similarity double"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and two hashes of the text, which name a row of a corpus up to repetition, and the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.lit(1)).alias("text_a"), F.xxhash64(text, F.lit(2)).alias("text_b"), text.alias("text"))


def _matches_of(index: Index):
    def run(batches):
        for batch in batches:
            for i, j, body, offsets in text_slices(batch.column(3)):
                found: dict[int, tuple[list[int], float]] = {}
                for t, k, share in zip(*map(np.ndarray.tolist, index.value.matches(body, offsets)), strict=True):
                    ids, best = found.get(t, ([], 0.0))
                    found[t] = ([*ids, int(index.value.ids[k])], max(best, share))
                at = sorted(found)
                rows = batch.slice(i, j - i).take(pa.array(at, pa.int64()))
                lists = pa.array([sorted(set(found[t][0])) for t in at], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), lists, pa.array([found[t][1] for t in at], pa.float64())], ["doc_id", "text_a", "text_b", "item_ids", "similarity"])

    return run


def item_blocks(benchmark: DataFrame, items_a_pass: int = ITEMS_A_PASS, text_a_pass: int = TEXT_A_PASS):
    """Indexes of the benchmark in item order: at most ``items_a_pass`` items and ``text_a_pass`` bytes, or one item, each."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    by = Window.orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = None
    while True:
        rest = items if last is None else items.filter((F.col("item_id") > last[0]) | ((F.col("item_id") == last[0]) & (F.col("text") > last[1])))
        first = rest.orderBy("item_id", "text").limit(items_a_pass).withColumn("bytes", F.sum(F.octet_length("text").cast("long")).over(by))
        part = first.filter((F.col("bytes") <= text_a_pass) | (F.col("bytes") == F.octet_length("text"))).select("item_id", "text").collect()
        if not part:
            return
        yield Index([r["item_id"] for r in part], [r["text"] for r in part])
        last = (part[-1]["item_id"], part[-1]["text"])


def matches(docs: DataFrame, benchmark: DataFrame, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """(doc_id, text_a, text_b, item_ids, similarity) of the rows of ``docs`` that hold an item, once for repeated rows."""
    spark, keys = docs.sparkSession, ["doc_id", "text_a", "text_b"]
    found = spark.createDataFrame([], _FOUND)
    for index in item_blocks(benchmark, items_a_pass):
        shared = spark.sparkContext.broadcast(index)
        found = found.union(materialize(_keyed(docs).mapInArrow(_matches_of(shared), _FOUND), "contaminated"))
        shared.unpersist()  # one index at a time
    # an item of each pass at most for each pass and row, whatever the number of repeated rows
    lists = F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids")
    return found.groupBy(*keys).agg(lists, F.max("similarity").alias("similarity"))


def _same(found: DataFrame):
    return F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_a") == F.col("_text_a")) & (F.col("text_b") == F.col("_text_b"))


def _renamed(found: DataFrame) -> DataFrame:
    return found.withColumnsRenamed({c: f"_{c}" for c in ("doc_id", "text_a", "text_b")})


def contamination(docs: DataFrame, benchmark: DataFrame, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """(doc_id, contaminated, item_ids, similarity) for every document; repeated rows each come out."""
    found = _renamed(matches(docs, benchmark, items_a_pass))
    rows = _keyed(docs).drop("text").join(found, _same(found), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids")
    return rows.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), ids, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are."""
    found = _renamed(matches(docs, benchmark, items_a_pass))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.col("row.text").cast("string")
    keyed = docs.select(whole).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.lit(1)).alias("text_a"), F.xxhash64(text, F.lit(2)).alias("text_b"))
    return keyed.join(found, _same(found), "left_anti").select("row.*")
