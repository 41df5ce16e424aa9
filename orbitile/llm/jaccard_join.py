"""Exact Jaccard join of word shingle sets in metric space: pivots, Voronoi regions, windows.

The Jaccard distance is a metric, so pivots part documents into regions, and documents near
a border are copied to the regions over it. Links are pairs at a distance of RADIUS or less.

1. Equal sets form one class. Level 0 has sets of a single shingle as pivots. A document is
   at distance 1 - 1 / size from the pivots it holds and at 1 from all others, so its nearest
   ones are its own shingles, taken in one order for all, rare ones first; the order follows
   counts over all documents in 2**18 cells. Two linked documents share at least
   0.8 * size shingles, so they meet in a region of the first size - ceil(0.8 * size) + 1
   pivots of each: this is the window within which a document is copied. A window wider by a
   tenth of the size holds as many more shingles that both have, so a document that shares
   fewer of its wider window with others is linked with none and ends here, as do regions of
   one class.
2. Level 1: each region takes the document that meets most others as its pivot. Documents
   within RADIUS of it are linked with it and are one component.
3. Regions that this leaves in different components are cut further. A region takes PIVOTS of
   its documents, each document goes to the nearest (its home) and, by the triangle
   inequality, to every other pivot that is no farther than home + 2 * RADIUS and no farther
   than the region's own reach + RADIUS. Both ends of a link meet in the home of either. This
   recurs until regions have LEAF documents or fewer; a region that keeps most of its
   documents in one part is not cut again.
4. The last regions are compared inside tasks, cut into blocks of bounded size where they are
   large. First on folded sets: how many shingles fall into each of FOLDS classes. Their
   distance is at most the number of shingles that only one of two sets holds, so pairs beyond
   what a link allows are let go; a pair of several regions counts in the first of them only;
   and a region loses the documents without a partner. What is left is compared on full sets,
   and only links come out.

Nothing is estimated: every link is confirmed on full sets and none is lost, except one whose
ends are connected anyway. Each task sends a set's pivots once, however many copies it reads.

Cases: a null or word-free text has no shingles and links with nothing; a text of fewer words
than a shingle is one shingle; equal texts are one class; repeated rows come out as often as
they went in (doc_id must name one text); a row with a null doc_id links with nothing and has
a null component_id; columns other than doc_id and text are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitile.llm.linking import BLOCK_ROWS, dealt_blocks, link_buckets
from orbitile.llm.shared import materialize
from orbitile.llm.textbytes import mix, shingle_sets, sums_between, text_slices

WIDTH, PERCENT = 5, 80
RADIUS = 1 - PERCENT / 100
#: Cells in which shingles are counted, and cells a row of counts holds.
CELLS, CHUNK = 1 << 18, 1 << 12
#: The wider window holds a WIDER-th of the size more; rounds in which documents that share too little of it go.
WIDER, PEELS = 10, 1
#: Pivots of a region, documents of a region that is not cut, levels at most.
PIVOTS, LEAF, LEVELS = 8, 200, 6
#: Share of its documents that a part of a region may keep and still be cut.
PROGRESS = 0.75
#: Classes of folded sets.
FOLDS = 64
#: Shingles a task compares at once.
BLOCK_SHINGLES = 300_000
#: Room for rounding in comparisons of distances; it only copies more.
SLACK = 1e-9


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles, 71) >> np.uint64(46)).astype(np.int64)


def _digests(shingles: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sums_between(mix(shingles, 51), first), sums_between(mix(shingles, 52), first)


def _set_rows(batches):
    """A row for each text, and at the end the task's counts of shingles by cell."""
    names = ["doc_id", "n_shingles", "set_a", "set_b", "chunk", "counts"]
    counts, none = np.zeros(CELLS, np.int64), pa.list_(pa.int32())
    for batch in batches:
        for i, j, body, offsets in text_slices(batch.column(1)):
            shingles, first = shingle_sets(body, offsets, WIDTH)
            counts += np.bincount(_cells(shingles), minlength=CELLS)
            a, b = (pa.array(x.view(np.int64)) for x in _digests(shingles, first))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), a, b, pa.nulls(j - i, pa.int32()), pa.nulls(j - i, none)], names)
    n = CELLS // CHUNK
    if counts.any():
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, CELLS + 1, CHUNK), pa.int32()), pa.array(counts.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in range(4)), pa.array(np.arange(n), pa.int32()), lists], names)


def _window_rows(ranks):
    """Shingles within the window of each set, that is its level-0 regions."""

    def rows(batches):
        order, seen = ranks.value, set()
        for batch in batches:
            for _, _, body, offsets in text_slices(batch.column(0)):
                shingles, first = shingle_sets(body, offsets, WIDTH)
                a, b = _digests(shingles, first)
                size = np.diff(first)
                new = np.zeros(len(size), bool)
                for k in np.flatnonzero(size):
                    name = (a[k], b[k])
                    new[k] = name not in seen
                    seen.add(name)
                base = size + (-PERCENT * size) // 100 + 1
                take = np.where(new, np.minimum(base + size // WIDER, size), 0)
                owner = np.repeat(np.arange(len(size)), size)
                at = np.lexsort((shingles, order[_cells(shingles)], owner))
                place = np.arange(len(at)) - first[owner]
                inside = np.flatnonzero(place < take[owner])
                if len(inside):
                    own, values = owner[inside], shingles[at[inside]].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(values), *(pa.array(x[own].view(np.int64)) for x in (a, b)), pa.array((place[inside] < base[own]).astype(np.int64))], ["key", "set_a", "set_b", "near"])

    return rows


def _shared_regions(batches):
    """Rows of regions with two sets or more, from rows in the order of (key, set_a, set_b); each set once."""
    last, held = None, None
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
        if len(rows) == 0:
            continue
        if last is not None:
            rows = np.concatenate([last[None], rows])
        again = np.concatenate([[False], (rows[1:] == rows[:-1]).all(axis=1)])
        rows_once = rows[~again]
        same = rows_once[1:, 0] == rows_once[:-1, 0]
        out = np.zeros(len(rows_once), bool)
        out[1:] |= same
        out[:-1] |= same
        if last is not None and held:
            out[0] = False  # went out with the batch before
        last, held = rows_once[-1], bool(out[-1]) or bool(held and len(rows_once) == 1)
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows_once[out].T], ["key", "set_a", "set_b", "near"])


def folded(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(sets, FOLDS) numbers of the shingles of each set by class."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    classes = (mix(shingles, 72) >> np.uint64(40)).astype(np.int64) % FOLDS
    return np.bincount(owner * FOLDS + classes, minlength=(len(first) - 1) * FOLDS).reshape(-1, FOLDS).astype(np.int32)


def _shingle_rows(batches):
    for batch in batches:
        for i, j, body, offsets in text_slices(batch.column(1)):
            shingles, first = shingle_sets(body, offsets, WIDTH)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array([x.tobytes() for x in folded(shingles, first)], pa.binary())], ["id", "shingles", "folds"])


def _with_partners(key, rows):
    """Rows of one block, or of two blocks, of a region whose folded sets allow a link to another label."""
    import pandas as pd

    _, low, high = key
    rows = rows.drop_duplicates("id")
    label, block = rows["label"].to_numpy(np.int64), rows["block"].to_numpy(np.int64)
    folds = np.frombuffer(b"".join(rows["folds"]), np.int32).reshape(-1, FOLDS)
    size, some = folds.sum(axis=1), np.zeros(len(rows), bool)
    keys = [np.sort(np.asarray(k, np.int64)) for k in rows["keys"]]
    table = np.zeros((len(keys), max(map(len, keys))), np.int64)
    for i, k in enumerate(keys):
        table[i, : len(k)], table[i, len(k) :] = k, k[-1]
    one, two = (np.flatnonzero(block == low), np.flatnonzero(block == high)) if low != high else (np.arange(len(rows)),) * 2
    for i in one:
        at = two[label[two] != label[i]]
        both = size[at] + size[i]
        # a link has at most (100 - PERCENT) / (100 + PERCENT) of both sizes in one set only
        near = at[(100 + PERCENT) * np.abs(folds[at] - folds[i]).sum(axis=1, dtype=np.int64) <= (100 - PERCENT) * both]
        shared = np.where(np.isin(table[near], keys[i]), table[near], np.iinfo(np.int64).max)
        near = near[shared.min(axis=1, initial=np.iinfo(np.int64).max) == key[0]]
        some[near] = True
        some[i] |= len(near) > 0
    return pd.DataFrame({"key": np.full(some.sum(), key[0]), "id": rows["id"].to_numpy(np.int64)[some], "label": label[some]})


def _links_between(key, rows):
    """Links between different labels of one block, or of two blocks, of a region."""
    import pandas as pd

    _, low, high = key
    rows = rows.drop_duplicates("id")
    ids, label, block = (rows[c].to_numpy(np.int64) for c in ("id", "label", "block"))
    sets = [np.asarray(s, np.int64) for s in rows["shingles"]]
    size = np.array([len(s) for s in sets])
    owner, flat = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    names, count = np.unique(label, return_counts=True)
    main, out = names[count.argmax()], []
    for i in np.flatnonzero(label != main):
        # each pair once: the label that is not the main one, or the smaller id, asks
        ask = (label != label[i]) & ((label == main) | (ids > ids[i]))
        if low != high:
            ask &= block != block[i]
        at = np.flatnonzero(ask & (100 * np.minimum(size, size[i]) >= PERCENT * np.maximum(size, size[i])))
        if len(at):
            start, end = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            both = np.bincount(np.concatenate([owner[a:b] for a, b in zip(start, end, strict=True)]), minlength=len(sets))[at]
            good = at[100 * both >= PERCENT * (size[at] + size[i] - both)]
            out += [(min(ids[i], x), max(ids[i], x)) for x in ids[good]]
    return pd.DataFrame(sorted(set(out)), columns=["a", "b"]).astype("int64")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with the sizes of the intersection and the union of their ``sets(id, shingles)``."""
    # neither side has a bound, whatever the estimates say: the plan is the same at every size
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("one")).hint("merge"), "a")
    full = full.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("two")).hint("merge"), "b")
    full = full.select("a", "b", F.size(F.array_intersect("one", "two")).alias("both"), (F.size("one") + F.size("two")).alias("sum"))
    return full.select("a", "b", "both", (F.col("sum") - F.col("both")).alias("union"))


def is_link(both: Column, union: Column) -> Column:
    return (both > 0) & (both * 100 >= union * PERCENT)


def mixed_regions(regions: DataFrame) -> DataFrame:
    """(key, n) of the regions(key, id, label) with two labels or more; of equal ones the first."""
    own = regions.groupBy("key").agg(
        F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.col("id"), F.lit(1))).alias("y")
    )
    return own.filter("low < high").groupBy("n", "low", "high", "x", "y").agg(F.min("key").alias("key")).select("key", "n")


def voronoi_parts(regions: DataFrame, sets: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Parts(key, id, label, of) of ``regions(key, id, label, n)`` around their own pivots, and pivot links (a, b).

    ``of`` is the number of documents of the region that a part was cut from. Both ends of
    every link within a region are in one of its parts.
    """
    rank = F.xxhash64(F.col("id"), F.lit(level))
    slots = regions.groupBy("key", F.pmod(rank, F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(rank.alias("rank"), "id")).alias("first"))
    met = materialize(regions.join(slots.select("key", F.col("first.id").alias("pivot")), "key"), "met")
    pairs = met.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    known = materialize(similar(pairs, sets), "distances")
    links = known.filter(is_link(F.col("both"), F.col("union"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    far = known.select(F.col("a").alias("id"), F.col("b").alias("pivot"), (1 - F.col("both") / F.col("union")).alias("far"))
    met = met.join(far, ["id", "pivot"], "left").withColumn("far", F.coalesce("far", F.lit(0.0)))
    home = met.groupBy("key", "id").agg(F.min(F.struct("far", "pivot")).alias("home"))
    met = materialize(met.join(home, ["key", "id"]), "homes")
    reach = met.groupBy("key", F.col("home.pivot").alias("pivot")).agg(F.max("home.far").alias("reach"))
    parts = met.join(reach, ["key", "pivot"]).filter((F.col("far") <= F.col("home.far") + 2 * RADIUS + SLACK) & (F.col("far") <= F.col("reach") + RADIUS + SLACK))
    return parts.select(F.xxhash64("key", "pivot", F.lit(level)).alias("key"), "id", "label", F.col("n").alias("of")), links


def region_links(regions: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different labels within ``regions(key, id, label)``; some others may come with them."""
    links, last = [], []
    regions = regions.select("key", "id", "label", F.lit(None).cast("long").alias("of"))
    for level in range(LEVELS + 1):
        regions = materialize(regions, "regions")
        mixed = materialize(mixed_regions(regions), "mixed")
        now = regions.join(mixed, "key")
        ends = (F.col("n") <= LEAF) | F.coalesce(F.col("n") > PROGRESS * F.col("of"), F.lit(False)) | F.lit(level == LEVELS)
        last.append(now.filter(ends).select(F.xxhash64("key", F.lit(level)).alias("key"), "id", "label"))
        large = now.filter(~ends).select("key", "id", "label", "n")
        if large.isEmpty():
            break
        regions, found = voronoi_parts(large, sets, level)
        links.append(found)
    rows = last[0]
    for more in last[1:]:
        rows = rows.union(more)
    rows = materialize(rows, "last-regions")
    own = rows.groupBy("id").agg(F.collect_set("key").alias("keys"))  # at most one for each shingle of its window
    folds = materialize(own.join(sets.select("id", "folds"), "id"), "folds")
    dealt = dealt_blocks(rows, F.lit(1), BLOCK_ROWS).select("key", "low", "high", "block", "id", "label").join(folds, "id")
    rows = materialize(dealt.groupBy("key", "low", "high").applyInPandas(_with_partners, "key long, id long, label long").distinct(), "with-partners")
    sized = rows.join(sets.select("id", F.size("shingles").alias("weight")), "id")
    dealt = dealt_blocks(sized, F.col("weight"), BLOCK_SHINGLES)
    whole = dealt.select("key", "low", "high", "block", "id", "label").join(sets.select("id", "shingles"), "id")
    out = whole.groupBy("key", "low", "high").applyInPandas(_links_between, "a long, b long")
    for found in links:
        out = out.union(found)
    return out.distinct()


def jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document of ``docs``; see the module's text."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = materialize(texts.mapInArrow(_set_rows, "doc_id long, n_shingles long, set_a long, set_b long, chunk int, counts array<int>"), "sets")
    counts = made.filter("chunk is not null").select("chunk", F.posexplode("counts").alias("at", "n")).filter("n > 0").groupBy("chunk", "at").agg(F.sum("n").alias("n"))
    order = np.zeros(CELLS, np.int64)
    frequent = counts.select((F.col("chunk") * CHUNK + F.col("at")).alias("cell"), "n").toPandas()  # CELLS rows at most
    order[frequent["cell"].to_numpy()] = frequent["n"].to_numpy()
    ranks = spark.sparkContext.broadcast(order)

    sets = made.filter("chunk is null").select("doc_id", "n_shingles", "set_a", "set_b")
    classes = sets.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("sig"))
    classes = materialize(classes, "classes")
    fields = "key long, set_a long, set_b long, near long"
    windows = texts.filter("doc_id is not null").select("text").mapInArrow(_window_rows(ranks), fields)
    windows = windows.repartition("key").sortWithinPartitions("key", "set_a", "set_b")
    shared = materialize(windows.mapInArrow(_shared_regions, fields), "shared")
    for k in range(PEELS):
        # what one document no longer shares may leave another with too little
        enough = shared.groupBy("set_a", "set_b").agg(F.count("*").alias("n")).join(classes, ["set_a", "set_b"])
        enough = enough.filter(F.col("n") > F.floor(F.ceil(F.col("sig") * PERCENT / 100) / WIDER)).select("set_a", "set_b")
        left = shared.join(enough, ["set_a", "set_b"], "left_semi")
        several = left.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        shared = materialize(left.join(several, "key", "left_semi"), f"shared-{k}")
    near = shared.filter("near = 1").join(classes.select("set_a", "set_b", "id"), ["set_a", "set_b"])
    members = materialize(near.select("key", "id"), "members")
    # regions of the same documents are one
    alike = mixed_regions(members.withColumn("label", F.col("id"))).select("key")
    keys = materialize(members.join(alike, "key", "left_semi"), "level-0")
    held: list[DataFrame] = []

    def prepare(ids: DataFrame):
        need = texts.join(ids.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
        held.append(materialize(need.mapInArrow(_shingle_rows, "id long, shingles array<long>, folds binary"), "shingle-sets"))
        return lambda pairs: similar(pairs, held[0]).filter(is_link(F.col("both"), F.col("union"))).select("a", "b")

    def sizes(x: Column, y: Column) -> Column:
        return F.least(x, y) * 100 >= F.greatest(x, y) * PERCENT

    linked = link_buckets(keys, classes.select("id", "sig"), sizes, prepare, None, lambda left: region_links(left, held[0]))
    named = classes.join(linked, "id", "left").select("set_a", "set_b", F.coalesce("component", "id").alias("component_id"))
    named = materialize(named, "named")
    out = sets.join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))
