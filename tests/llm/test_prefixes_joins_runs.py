"""Prefix trie, Jaccard join and periodic runs against brute force, their SQL and odd inputs."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from orbitile.llm import jaccard_join, periodic, prefix_trie
from orbitile.llm.queries import oracle_sql, queries
from orbitile.llm.textbytes import mix

DATA = "/root/testdata/sf0.001"
NAMES = ["op11_conversation_trie", "op12_jaccard_join", "op13_periodic_runs"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries()[name](spark, DATA)
    columns = ", ".join(df.columns)
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in con.execute(f"select {columns} from ({oracle_sql()[name]})").fetchall()}


def trie_by_hand(rows, rebuild):
    of = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            of.setdefault(c, []).append(((t is not None, t or 0, key), (role, text)))
    of = {c: [x for _, x in sorted(v)] for c, v in of.items()}
    if rebuild:
        heads = {c: zlib.crc32(str(c).encode()) % 9 for c in of}
        of = {c: of.get(c - c % 5, [])[: heads[c]] + of[c][heads[c] :] for c in of}
    members, kids, saved, leaves = {}, {}, {}, {}
    for c, s in of.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        below = kids.get(k, [])
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in below)
        leaves[k] = sum(leaves[x] for x in below) if below else 1
    ends = {k: ",".join(str(c) for c in sorted(m) if len(of[c]) == len(k)) for k, m in members.items()}
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest())
        for k, m in members.items()
    )


def found(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


ROWS = "conv_id long, turn long, role string, text string, n_convs int, path string"


def test_trie_equals_brute_force(spark, monkeypatch):
    """Long conversations over several tasks, a hot node, ties, nulls, repeated rows."""
    rng = random.Random(8)
    monkeypatch.setattr(prefix_trie, "BLOCK_IDS", 7)
    rows = [(None, 0, "user", "nobody's"), (7, None, None, None), (7, None, "user", "x"), (7, 0, "user", ""), (7, 0, "user", "same"), (7, 0, "user", "same")]
    rows += [(11, i, "user", f"turn {i % 3}") for i in range(300)]
    rows += [(12, i, "user", f"turn {i % 3}") for i in range(200)] + [(12, 200, "user", "é" * 3000)]
    for c in range(100, 260):
        rows += [(c, i, rng.choice(["user", "assistant"]), f"t{rng.randrange(2)}") for i in range(rng.randrange(1, 6))]
    rows += [(c, 0, "user", "common") for c in range(1000, 1100)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], ROWS)
    assert found(prefix_trie.conversation_trie(df)) == trie_by_hand(rows, False)
    assert found(prefix_trie.rebuilt_trie(df)) == trie_by_hand(rows, True)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], ROWS)
    assert prefix_trie.rebuilt_trie(empty).count() == 0
    # crc32("1") % 9 is 7, and there is no conversation 0: its one turn goes
    assert zlib.crc32(b"1") % 9 > 1
    rows = [(1, 0, "user", "gone")]
    got = found(prefix_trie.rebuilt_trie(spark.createDataFrame([(*r, 1, "p") for r in rows], ROWS)))
    assert got == trie_by_hand(rows, True) == [(1, 0, -1, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


def test_subtree_sums_of_chains_stars_and_combs(spark):
    rng = random.Random(2)
    parents = {0: None}
    for i in range(1, 500):  # a long chain with side branches, a star, random parts
        parents[i] = i - 1 if i < 200 else rng.randrange(0, 200, 9) if i < 300 else 5 if i < 400 else rng.randrange(i)
    name = {i: i.to_bytes(2, "big") for i in parents}
    sums = {i: [i, 0] for i in parents}
    inner = set(parents.values())
    for i in sorted(parents, reverse=True):
        sums[i][1] += i not in inner
        if i:
            sums[parents[i]][0] += sums[i][0]
            sums[parents[i]][1] += sums[i][1]
    df = spark.createDataFrame([(bytearray(name[i]), None if p is None else bytearray(name[p]), i) for i, p in parents.items()], "id binary, parent binary, saved long")
    got = {int.from_bytes(r.id, "big"): [r.saved, r.leaves] for r in prefix_trie.subtree_sums(df).collect()}
    assert got == sums


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def join_by_hand(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


DOCS = "doc_id long, text string, key string, label int, n int"


@pytest.mark.parametrize(("leaf", "block"), [(200, 300_000), (4, 300_000), (4, 200)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, leaf, block):
    """A third of all rows are near copies of one text, in chains that no single pivot links."""
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    rng = random.Random(leaf)
    base = [f"w{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One TWO"), (6, "one two three"), (None, "one two"), (7, "x " * 9000)]
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"e{rng.randrange(12)}"
        rows.append((100 + i, " ".join(words)))
    walk = list(base)
    for i in range(40):  # each a little further from the one before
        walk[(7 * i) % 60] = f"f{i}"
        rows.append((300 + i, " ".join(walk)))
    rows += [(500 + i, " ".join(f"z{i}_{k}" for k in range(30))) for i in range(150)]
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in [*rows, (4, "one two")]], DOCS)
    got = jaccard_join.jaccard_join(df).collect()
    assert len(got) == len(rows) + 1
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(1, None)]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == join_by_hand(rows)


def test_voronoi_parts_keep_every_link(spark):
    """Windows hold both ends of each link in one part, though parts are smaller than the region."""
    rng = random.Random(9)
    sets = {}
    for g in range(12):
        core = list(range(100 * g, 100 * g + 50))
        for k in range(10):
            s = set(rng.sample(core, 47)) | {10**6 + rng.randrange(40)}
            sets[10 * g + k] = s
    regions = spark.createDataFrame([(1, i, i, len(sets)) for i in sets], "key long, id long, label long, n long")
    held = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, shingles array<long>")
    parts, _ = jaccard_join.voronoi_parts(regions, held, 0)
    of = {}
    for r in parts.collect():
        of.setdefault(r.key, set()).add(r.id)
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * len(sets[a] | sets[b]):
                assert any(a in p and b in p for p in of.values())
    assert len(of) > 1


def test_shared_regions_over_batches():
    import pyarrow as pa

    rng = random.Random(1)
    rows = sorted((rng.randrange(30), rng.randrange(3), 0, 1) for _ in range(90))
    expected = sorted({r for r in rows if len({x for x in rows if x[0] == r[0]}) > 1})
    for size in (1, 2, 7, 90):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + size]], pa.int64()) for k in range(4)], ["key", "set_a", "set_b", "near"]) for i in range(0, 90, size)]
        got = [tuple(r.values()) for b in jaccard_join._shared_regions(iter(batches)) for r in b.to_pylist()]
        assert got == expected


def runs_by_hand(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q) and not any(a <= s and a + n >= i + q for a, n, _ in out):
                out.append((s, i + q - s, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, kinds = rng.randrange(400), rng.choice([1, 2, 2, 3, 50, 1000])
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 10 else 0):
        s, p = rng.randrange(n), rng.choice([rng.randrange(1, 9), rng.randrange(1, n // 4 + 1)])
        e = min(n, s + int(p * rng.uniform(3, 8)))
        for i in range(s + p, e):
            w[i] = w[i - p]
        if e > s and rng.random() < 0.3:
            w[rng.randrange(s, e)] = rng.randrange(kinds)
    return w


def test_runs_equal_brute_force():
    rng = random.Random(6)
    for _ in range(800):
        w = random_words(rng)
        got = [tuple(map(int, r)) for r in zip(*periodic.runs(mix(np.array([*w, 10**6], np.uint64), 5), len(w)), strict=True)]
        assert got == runs_by_hand(w)


def test_runs_of_texts(spark):
    rng = random.Random(7)
    texts = [" ".join(map(str, random_words(rng))) for _ in range(60)] + [None, "", " \t", "a a a a a", "a a a a a a", "é b " * 9, "x " * 50_000, "x " * 50_000]
    rows = [(i if i else None, t, 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed int")
    got = periodic.periodic_runs(df).collect()
    assert len(got) == len(rows) and periodic.run_digests(df.limit(0)).count() == 0
    by_id = {r.doc_id: r for r in got}
    for i, text, _, _ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        expected = runs_by_hand(w) if len(w) < 1000 else [(0, 50_000, 1)]
        dropped = {k for s, n, q in expected for k in range(s + q, s + n)}
        r = by_id[i]
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(w), expected, " ".join(x for k, x in enumerate(w) if k not in dropped))


def test_strongest_run_and_repeated_tails(spark):
    text = " ".join("a b c d e f g h a b a b a b a b a x y x y x y x y x".split())
    ids = [next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 1), next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)]
    df = spark.createDataFrame([(i, text) for i in ids] + [(ids[1], None), (ids[1], " "), (None, text)], "doc_id long, text string")
    plain, again, *rest = periodic.with_repeated_tails(df).collect()
    assert (plain.text, rest[0].text, rest[2].text) == (text, None, text)
    w, g = text.split(), zlib.crc32(str(ids[1]).encode()) // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    assert again.text.split() == [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
    r = periodic.run_digests(df).filter("doc_id is null").first()
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (2, 8, 9, 2, 4500)
