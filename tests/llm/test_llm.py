"""Training-data operators: brute-force versions, round trips, held-out accuracy, odd inputs."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from orbitile.llm import bpe_tree, decontaminate, language, line_dedup, media, near_dedup, pii, token_ids, toxicity, trie_counts, webp
from orbitile.llm.linking import connected_components
from orbitile.llm.pretokens import Pretokens
from orbitile.llm.queries import oracle_sql, queries
from orbitile.llm.textbytes import buffers

DATA = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "Don't  we'll 'tis 3.14 \U0001f600 naïve\r\n\n x"), (6, "x" * 5000), (7, "the cat " * 4000),
    (8, "one two three four five six seven eight nine ten"), (9, "ONE two three four five six seven eight nine ten"), (10, "one two three four five six seven eight nine eleven"),
    (11, "a b c d"), (12, "A b c D"), (13, "日本語 テキスト で す 。"), (13, "日本語 テキスト で す 。"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", f"s{i}", 7, 1.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, start double")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(sets):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def test_near_duplicates_equal_brute_force(spark, docs, odd):
    for frame, rows in ((spark.read.parquet(f"{DATA}/documents.parquet"), [(d["doc_id"], d["text"]) for d in docs]), (odd, ODD)):
        sets = {i: shingles(t) for i, t in rows}
        expected = components(sets)
        got = near_dedup.near_duplicates(frame).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)


def test_mixed_buckets_lose_no_link(spark):
    """Many near copies, a third of all rows, whose pivot does not link them all."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(60)] = f"e{rng.randrange(12)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"z{i}_{k}" for k in range(30))) for i in range(180)]
    expected = components({i: shingles(t) for i, t in rows})
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == expected


def test_estimate_is_corrected(spark):
    a = np.arange(128, dtype=np.uint32)[None, :]
    b = a.copy()
    b[0, :64] += 1
    rows = [(near_dedup.packed_bits(a)[0].view(np.int64).tolist(), near_dedup.packed_bits(b)[0].view(np.int64).tolist())]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    (r,) = df.select(near_dedup.estimated_similarity(df.a, df.b).alias("e")).collect()
    assert abs(r.e - (0.5 - 1 / 16) / (1 - 1 / 16)) < 1e-9


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_lines(spark):
    long = "the quick brown fox jumps over the lazy dog while nobody is watching it at all today"
    rows = [(1, f"{long}\nshort one\n\nunique line with enough words here"), (2, f"short one\n{long.upper()}!!!\nanother unique line with many words"), (3, None), (4, ""), (5, long.replace("lazy", "lazyy")), (6, f"{long}\n{long}")]
    df = spark.createDataFrame([(i, t, 5, 6, "a", "b") for i, t in [*rows, (None, long)]], "doc_id long, text string, n_removed int, _id int, gone string, row string")
    out = line_dedup.line_dedup(df)
    assert out.columns == ["doc_id", "text", "_id", "gone", "row", "n_removed"]
    got = {r.doc_id: (r.text, r.n_removed) for r in out.collect()}
    assert got[None] == (long, 0)
    assert got[5] == ("", 1)
    assert got[1] == (rows[0][1], 0)
    assert got[2] == ("short one\nanother unique line with many words", 1)
    assert got[3] == (None, 0) and got[4] == ("", 0)
    assert got[6] == ("", 2)


def test_line_recall_against_brute_force(spark):
    """Lines of edit similarity 0.8 with words changed anywhere are found, not only those within a few bits."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    lines = []
    for _ in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 50))]
        other = list(words)
        for _ in range(rng.randrange(1, 1 + len(words) // 8)):
            other[rng.randrange(len(words))] = rng.choice(vocabulary)
        lines += [" ".join(words), " ".join(other)]
    alike = [(i, j) for i in range(len(lines)) for j in range(i) if lines[i] != lines[j] and line_dedup.alike(lines[j], lines[i])]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.line_dedup(df).filter("n_removed > 0").collect()}
    assert len(alike) > 200
    assert sum(i in gone for i, _ in alike) >= 0.98 * len(alike)
    assert gone <= {i for i, _ in alike} | {i for i in range(len(lines)) if lines[i] in lines[:i]}


def test_short_lines_of_the_query(spark, tmp_path):
    rows = [(1, "Les.\nAnd ornd.\n\nother"), (2, "les\nand  ORND!\n\n..."), (3, "And ornd\nkept line here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_removed) for r in queries()["op9_fuzzy_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\n...", 2), 3: ("kept line here", 1)}


def test_edit_distance_and_keys():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == plain(a, b)
    pairs = [("".join(rng.choice("abcé 日") for _ in range(n)), n) for n in (0, 1, 63, 64, 65, 128, 130, 200) for _ in range(12)]
    pairs = [(a, "".join(c for c in a if rng.random() > 0.1) + "ab" * rng.randrange(4)) for a, _ in pairs]
    ones, twos = map(list, zip(*pairs))
    assert line_dedup.edit_distances(ones, twos).tolist() == [line_dedup.edit_distance(a, b) for a, b in pairs]
    for most in (0, 3, 40, 70, 150):
        got, exact = line_dedup.edit_distances(ones, twos, most), line_dedup.edit_distances(ones, twos)
        near = [i for i, (a, b) in enumerate(zip(ones, twos)) if abs(len(a) - len(b)) <= most]
        assert all(got[i] == exact[i] if exact[i] <= most else got[i] > most for i in near)
    assert line_dedup.all_alike(ones, twos).tolist() == [line_dedup.alike(a, b) for a, b in pairs]
    assert len(line_dedup.all_alike([], [])) == 0
    words = ["ab", "c", "dd", "efg", "h"]
    for _ in range(300):
        a = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))
        b = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))
        assert line_dedup.anchored_distance(a, b) >= plain(a, b)
        assert plain(a, b) > 3 or line_dedup.shared_grams(a, b) >= max(len(a), len(b)) - 2 - 3 * plain(a, b)


def test_line_blocks_and_windows():
    """SimHashes of fewer differing bits than blocks share a block; equal windows share keys wherever they stand."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        mark = rng.integers(0, 2, 128).astype(bool)
        other = mark.copy()
        other[rng.choice(128, line_dedup.BLOCKS - 1, replace=False)] ^= True
        blocks = [np.packbits(m).view(">u4") for m in (mark, other)]
        assert (blocks[0] == blocks[1]).any()
    one = line_dedup.line_rows(*buffers(pa.array(["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"])))
    two = line_dedup.line_rows(*buffers(pa.array(["Alpha, beta gamma DELTA epsilon zeta eta theta iota kappa lambdas!"])))
    assert (one["keys"] == two["keys"]).any() and one["id"] != two["id"]
    assert line_dedup.line_rows(*buffers(pa.array(["\n\n", ""])))["words"].tolist() == [0, 0, 0, 0]


def screen_of(chars):
    return np.where(chars <= line_dedup.SCREEN_CHARS, line_dedup.SCREEN, line_dedup.LONG_SCREEN)


def test_line_recall_of_one_letter(spark, docs):
    """Lines of the table with one letter changed meet their originals, short lines too."""
    rng = random.Random(8)
    lines = sorted({" ".join(re.sub(r"[^\w\s]", "", line).lower().split()) for d in docs for line in (d["text"] or "").split("\n")})
    lines = [line for line in lines if len(line.split()) >= 5]
    other = []
    for line in lines:
        i = rng.choice([i for i, c in enumerate(line) if c != " "])
        other.append(line[:i] + ("x" if line[i] != "x" else "y") + line[i + 1 :])
    rows = [line_dedup.line_rows(*buffers(pa.array(t))) for t in (lines, other)]
    met = (rows[0]["keys"] == rows[1]["keys"]).any(axis=1)
    met &= np.bitwise_count(rows[0]["marks"] ^ rows[1]["marks"]).sum(axis=1) <= screen_of(rows[0]["chars"])
    short = rows[0]["words"] < 10
    assert met.mean() >= 0.97 and met[short].mean() >= 0.9


def test_line_recall_of_the_table(spark, docs):
    """All pairs of different lines of the table with edit similarity 0.8, by brute force over shared runs of characters."""
    lines = sorted({" ".join(re.sub(f"[{re.escape(line_dedup.PUNCTUATION)}]", "", line).lower().split()) for d in docs for line in (d["text"] or "").split("\n")}, key=len)
    lines = [line for line in lines if len(line.split()) >= 5]
    grams = [Counter(line[i : i + 3] for i in range(len(line) - 2)) for line in lines]
    alike = []
    for j, b in enumerate(lines):
        most = int(len(b) * 0.2 + 1e-9)
        for i in range(j - 1, -1, -1):
            if len(b) - len(lines[i]) > most:
                break
            need = len(b) - 2 - 3 * most
            if sum(min(n, grams[i][g]) for g, n in grams[j].items() if g in grams[i]) >= need and line_dedup.edit_distance(lines[i], b) <= most:
                alike.append((i, j))
    rows = line_dedup.line_rows(*buffers(pa.array(lines)))
    met = [(rows["keys"][i] == rows["keys"][j]).any() and np.bitwise_count(rows["marks"][i] ^ rows["marks"][j]).sum() <= screen_of(rows["chars"][j]) for i, j in alike]
    assert len(alike) >= 20 and np.mean(met) >= 0.9


def test_hot_bucket_of_lines_is_compared_in_blocks(spark, monkeypatch):
    """Lines that all share a window, in groups of near copies: no link is lost between blocks."""
    from orbitile.llm import linking

    monkeypatch.setattr(linking, "SMALL", 3)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    lines = []
    for _ in range(40):
        own = [word() for _ in range(12)]
        lines += [" ".join(own), " ".join([*own[:-1], word()])]
    keys = spark.createDataFrame([(k, i) for i in range(len(lines)) for k in (1, 2)], "key long, id long")
    marks = line_dedup.line_rows(*buffers(pa.array(lines)))
    sigs = spark.createDataFrame([(i, (int(m[0].view(np.int64)), int(m[1].view(np.int64)), int(c))) for i, (m, c) in enumerate(zip(marks["marks"], marks["chars"]))], "id long, sig struct<mark_a: long, mark_b: long, chars: int>")
    monkeypatch.setattr(line_dedup, "PAIRS_AT_ONCE", 5)
    forms = dict(enumerate(lines))
    form_of = spark.createDataFrame(list(forms.items()), "id long, form string")

    def compare(left):
        own = left.groupBy("id").agg(F.collect_list("key").alias("keys")).join(form_of, "id")
        dealt = linking.dealt_blocks(left, F.lit(1), 10).select("key", "low", "high", "block", "id", "label", "sig.*").join(own, "id")
        return dealt.groupBy("key", "low", "high").applyInPandas(line_dedup._block_links, "a long, b long")

    exact = lambda ids: lambda pairs: pairs.sparkSession.createDataFrame([(r.a, r.b) for r in pairs.collect() if line_dedup.alike(forms[r.a], forms[r.b])], "a long, b long")
    got = {r.id: r.component for r in linking.link_buckets(keys, sigs, line_dedup.may_be_alike, exact, compare).collect()}
    assert got == {i: i - i % 2 for i in range(len(lines))}


def test_decontamination(spark, odd):
    item = " ".join(f"b{i}" for i in range(30))
    clean = " ".join(f"c{i}" for i in range(200))
    near = item.split()
    near[10] = "changed"
    rows = [(1, f"{clean} {item.upper()} {clean}"), (2, clean), (3, " ".join(item.split()[:12])), (4, f"{clean} {' '.join(near)}"), (5, None), (6, "b1 b2 b3"), (7, "tiny item here now x")]
    bench = spark.createDataFrame([(10, item, 1), (11, "tiny item here", 1), (12, None, 1), (13, "", 1), (14, item, 1)], "item_id long, text string, doc_id int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {1: [10, 14], 2: [], 3: [], 4: [10, 14], 5: [], 6: [], 7: [11]}
    for size in (5000, 2, 1):
        assert {r.doc_id: r.item_ids for r in decontaminate.contamination(df, bench, size).collect()} == expected
        twice = decontaminate.contamination(df.union(df).union(spark.createDataFrame([(None, item)], "doc_id long, text string")), bench, size).collect()
        assert len(twice) == 2 * len(rows) + 1 and {tuple(r.item_ids) for r in twice if r.doc_id is None} == {(10, 14)}
        assert {r.doc_id for r in decontaminate.without_contaminated(df, bench, size).collect()} == {2, 3, 5, 6}
    assert decontaminate.contamination(odd, bench.limit(0)).filter("contaminated").isEmpty()


def test_decontamination_of_a_very_long_item():
    """Memory and time follow the item's length, and counts of long windows do not overflow."""
    import tracemalloc

    rng = random.Random(7)
    for n in (20_000, 40_000):
        item = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        text = ["x"] * 50 + item[: n // 2] + ["changed"] + item[n // 2 + 1 :] + ["y"] * 50
        index = decontaminate.Index([5], [" ".join(item)])
        body = np.frombuffer(" ".join(text).encode(), np.uint8)
        tracemalloc.start()
        text_of, item_of, share = index.matches(body, np.array([0, len(body)]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert text_of.tolist() == [0] and item_of.tolist() == [0] and share[0] > 0.99
        assert peak < 20_000 * n
    words = decontaminate.Words(body, np.array([0, len(body)]))
    prints = decontaminate.Fingerprints(words)
    h, pair = decontaminate._features(words)
    plain = np.concatenate([h, pair[:-1]])
    whole = sum(((2 * int(((plain >> np.uint64(b)) & np.uint64(1)).sum()) > 2 * len(h) - 1) << b) for b in range(64))
    assert int(prints.of(np.array([0]), np.array([len(h)]))[0]) == whole


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(3)
    index = decontaminate.Index([1, 2, 3], ["w1 w2 w3 w4 w5 w6", "w1 w2 w3 w4 w5 w7", "w1 w2 w3 w4 w5 w6 w8"])
    for _ in range(300):
        n = int(rng.integers(0, decontaminate.RADIUS + 1))
        flipped = int(index.prints[0])
        for bit in rng.choice(64, n, replace=False):
            flipped ^= 1 << int(bit)
        window, item = index.near(np.array([flipped], np.uint64), np.array([6]))
        near = {i for i in (0, 1) if (flipped ^ int(index.prints[i])).bit_count() <= decontaminate.RADIUS}
        assert window.tolist() == [0] * len(near) and set(item.tolist()) == near and 0 in near


def test_nothing_is_found_but_through_the_index(monkeypatch):
    item = " ".join(f"b{i}" for i in range(30))
    body = np.frombuffer(f"x y {item} z".encode(), np.uint8)
    index = decontaminate.Index([7], [item])
    assert len(index.matches(body, np.array([0, len(body)]))[0]) == 1
    monkeypatch.setattr(decontaminate.Index, "near", lambda self, prints, size: (np.zeros(0, np.int64),) * 2)
    assert len(index.matches(body, np.array([0, len(body)]))[0]) == 0


def test_decontamination_of_parts_against_brute_force(spark):
    """Cut, spliced and altered items against the shingle shares of all windows: recall of 0.97, nothing else."""
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(100000)}"
    items = [[word() for _ in range(rng.choice([20, 40, 60, 100]))] for _ in range(60)]
    texts = []
    for k in range(240):
        item, share = items[k % 60], rng.choice([0.7, 0.76, 0.8, 0.85])
        n = round(share * (len(item) - 4)) + 4
        part = item[:n] if k % 2 else item[-n:]
        if k % 3 == 0:  # a few words changed, or another passage put in between
            part = [w if rng.random() > 0.05 else word() for w in item] if k % 2 else item[: n // 2] + [word() for _ in range(3)] + item[n // 2 : n]
        texts.append([word() for _ in range(rng.randrange(120))] + part + [word() for _ in range(rng.randrange(120))])
    holders = {}
    for i, item in enumerate(items):
        for s in {tuple(item[k : k + 5]) for k in range(len(item) - 4)}:
            holders.setdefault(s, set()).add(i)
    weight = {s: np.log(1 + len(items) / len(h)) for s, h in holders.items()}
    expected = {}
    for t, text in enumerate(texts):
        item = items[t % 60]
        own = {tuple(item[k : k + 5]) for k in range(len(item) - 4)}
        windows = [text[k : k + len(item)] for k in range(len(text) - len(item) + 1)]
        held = max((sum(weight[s] for s in {tuple(w[k : k + 5]) for k in range(len(w) - 4)} & own) for w in windows), default=0.0)
        expected[t] = [t % 60] if held / sum(weight[s] for s in own) >= 0.75 else []
    df = spark.createDataFrame([(t, " ".join(x)) for t, x in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.contamination(df, bench).collect()}
    true = {t for t, found in expected.items() if found}
    assert len(true) > 100 and all(got[t] == expected[t] for t in got if got[t])
    assert sum(bool(got[t]) for t in true) >= 0.97 * len(true)


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(40)]
        toxic = int(i % 6 == 0)
        if toxic:
            text[rng.randrange(40)] = rng.choice(["vile", "scum"])
        rows.append((i, " ".join(text), 0.5))
        labels.append((i, toxic, 1))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    got = toxicity.toxicity(df, lab).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and held
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.95
    kept = {r.doc_id for r in toxicity.without_toxic(df, lab).collect()}
    assert kept == {r.doc_id for r in got if r.predicted == 0}


def test_ftrl_equals_a_plain_version():
    """Per-coordinate rates, L1 and L2, coordinate by coordinate."""
    rng = random.Random(2)
    rows = [(sorted(rng.sample(range(12), rng.randrange(1, 6))), rng.randrange(2)) for _ in range(200)]
    model = toxicity.Ftrl(12)
    z, n = [0.0] * 13, [0.0] * 13

    def weight(i):
        l1 = toxicity.L1 if i < 12 else 0.0
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for ids, y in rows:
        model.learn(np.array(ids), float(y))
        own = [*ids, 12]
        w = {i: weight(i) for i in own}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in own:
            rate = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
            z[i] += g - rate * w[i]
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.weights(np.arange(13)), [weight(i) for i in range(13)])


def test_toxicity_features_and_scores_equal_a_plain_version():
    texts = ["Be kind, be kind", "", "one two three four five", "é à b", "same same same"]
    together, first = toxicity.features(*buffers(pa.array(texts)))
    dense = np.random.default_rng(3).normal(size=(1 << toxicity.BITS) + 1).astype(np.float32)
    scores = toxicity.margins(dense, *buffers(pa.array(texts)))
    for i, text in enumerate(texts):
        words = re.findall(r"[a-z\x80-\U0010ffff]+", text.lower())
        wanted = {(w,) for w in words} | {(gap, a, b) for gap in (1, 2, 3) for a, b in zip(words, words[gap:])}
        own = together[first[i] : first[i + 1]]
        assert len(own) == len(wanted) and len(set(own.tolist())) == len(own)
        alone = toxicity.margins(dense, *buffers(pa.array([text])))
        assert scores[i] == alone[0] and np.isclose(scores[i], float(dense[own].astype(float).sum() + dense[-1]))


def test_toxicity_without_labels(spark, odd):
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.toxicity(odd, lab).collect()} == {(0.0, 0)}
    assert toxicity.without_toxic(odd, lab).count() == len(ODD)


def test_language(spark, docs, odd):
    got = language.language_id(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    truth = {d["doc_id"]: d["lang"] for d in docs}
    held = [r for r in got if r.held_out and truth[r.doc_id] is not None]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    plain = [(d["doc_id"], d["text"], d["lang"]) for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 3 != 1 and d["lang"] and d["text"]]
    ((names, matrix, priors),) = language.models(spark.createDataFrame(plain, "doc_id long, text string, lang string"))
    assert names == sorted({x[2] for x in plain}) and np.allclose(np.exp(priors).sum(), 1) and np.allclose(np.exp(matrix.astype(float)).sum(axis=0), 1, atol=1e-3)
    none = {r.doc_id: (r.lang_pred, r.score) for r in language.language_id(odd).collect()}
    assert none[1] == none[2] == none[3] == ("und", 0.0) and none[4][0] == "en"


def test_language_scores_equal_a_plain_version(spark, docs):
    """Every n-gram hashed by itself, log-probabilities and priors added up one by one."""
    rows = [(d["doc_id"], d["text"], d["lang"]) for d in docs][:60] + [(9001, "a", None), (9002, "Ab-cé 12", None)]
    (model,) = language.models(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names, matrix, priors = model
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), [model]).collect()}

    def column(gram):
        h = 0
        for c in gram:
            h = (h * 0x01000193 + ord(c) * 0x9E3779B1) & 0xFFFFFFFF
        return ((h ^ h >> 15) * (0x85EBCA6B + 2 * len(gram)) & 0xFFFFFFFF) >> (32 - language.BITS)

    for doc_id, text, _ in rows[:8] + rows[-2:]:
        letters = "".join(c.lower() if c.isalpha() else " " for c in text or "")
        plain = letters[:1] + re.sub(" +", " ", " " + letters[1:])[1:] if letters[:1] == " " else re.sub(" +", " ", letters)
        grams = [plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)]
        total = np.array([sum(float(matrix[column(g), k]) for g in grams) for k in range(len(names))])
        p = total / len(grams) * min(len(grams), language.EVIDENCE) + priors
        p, best = np.exp(p - p.max()), int((total + priors).argmax())
        assert got[doc_id].lang_pred == names[best] and abs(got[doc_id].score - p[best] / p.sum()) < 1e-6


def test_languages_in_blocks_equal_one_matrix(spark):
    """200 languages of skewed sizes: blocks of any size predict what one matrix does; equal languages go to the first by name."""
    rng = random.Random(3)
    rows = []
    for k in range(200):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
        for i in range(1 + 40 // (k + 1)):
            rows.append((1000 * k + i, "".join(rng.choice([*letters, " "]) for _ in range(60)), f"l{k:03d}"))
    rows += [(10**6 + k, "twin twin", f"t{k}") for k in (2, 1)] + [(10**7, "twin " * 300, None), (10**7 + 1, None, None), (10**7 + 2, "12", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.predict(df, language.models(df, block=b)).collect()} for b in (512, 64))
    assert one == many and one[10**7][0] == "t1" and one[10**7 + 1] == one[10**7 + 2] == ("und", 0.0)


def test_long_text_of_a_rare_language(spark):
    """The whole text decides against the prior, not its first n-grams' worth of it."""
    names = ["common", "rare"]
    matrix = np.full((1 << language.BITS, 2), np.log(1e-4), np.float32)
    matrix[:, 1] += np.float32(0.02)
    model = (names, matrix, np.log(np.array([0.999, 0.001])))
    df = spark.createDataFrame([(1, "a" * 20), (2, "a" * 2000)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.predict(df, [model]).collect()} == {1: "common", 2: "rare"}


def test_pretokens_equal_the_pattern():
    import pyarrow as pa
    import regex

    rng = random.Random(5)
    alphabet = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "\n", "\t", " ", "1", "é", "!", "日", "A", "  ", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(2000)] + [t or "" for _, t in ODD]
    body, offsets = buffers(pa.array(texts))
    pre = Pretokens(body, offsets)
    found = pre.strings(np.arange(len(pre.start)))
    first = np.searchsorted(pre.text, np.arange(len(texts) + 1))
    for i, t in enumerate(texts):
        assert found[first[i] : first[i + 1]] == regex.findall(PATTERN, t), t


def test_token_records(spark, docs, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    for frame, rows in ((spark.read.parquet(f"{DATA}/documents.parquet"), [(d["doc_id"], d["text"]) for d in docs]), (odd, ODD)):
        rows = [*rows, (None, "no id"), (None, None)]
        frame = frame.select("doc_id", "text").unionByName(spark.createDataFrame(rows[-2:], "doc_id long, text string"))
        got = sorted(token_ids.token_records(frame, JSON).collect(), key=lambda r: r.start)
        at = 0
        for r, (doc_id, text) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), strict=True):
            ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)


def test_records_are_checked():
    record = token_ids.frame(token_ids.serialize(7, np.array([1, 70000])))
    doc_id, ids = token_ids.deserialize(token_ids.unframe(record))
    assert doc_id == 7 and ids.tolist() == [1, 70000]
    doc_id, ids = token_ids.deserialize(token_ids.serialize(None, np.array([3])))
    assert doc_id is None and ids.tolist() == [3]
    for i in (0, 9, 20, len(record) - 1):
        with pytest.raises(ValueError):
            token_ids.unframe(record[:i] + bytes([record[i] ^ 1]) + record[i + 1 :])


def _library(path):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_tree(spark, odd):
    library = _library(MULTI)
    got = bpe_tree.encode_and_decode(odd, MULTI, PATTERN).collect()
    for r, (_, text) in zip(sorted(got, key=lambda r: r.doc_id), sorted(ODD, key=lambda x: x[0]), strict=True):
        ids = library.encode_ordinary(text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_bpe_joins_anywhere(monkeypatch):
    """Leaves of a few characters, so that every kind of seam is joined."""
    library, codec = _library(MULTI), bpe_tree.Codec(MULTI, PATTERN)
    rng = random.Random(6)
    pieces = ["don't ", "we'll", "  ", "\n\n", "'re", "naïve", "12", "3", "!?", " x", "日本", "'", "\t a", "aaaaaaaa"]
    for leaf in (1, 2, 3, 7):
        monkeypatch.setattr(bpe_tree, "LEAF_CHARS", leaf)
        for _ in range(150):
            text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
            ids = codec.encode(text)
            assert ids == library.encode_ordinary(text)
            assert codec.decode(ids) == text.encode()


def test_line_pairs_are_verified_with_less_work(monkeypatch):
    """Bounds settle what they can without a distance; blocks in small steps, and the answers stay."""
    import pandas as pd

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    words = [rng.sample(vocabulary, 60) for _ in range(30)]
    lines = [" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in ws) for ws in words for share in (0, 0.05, 0.2, 0.3)]
    pairs = [(a, b) for a in lines[:24] for b in lines[:24] if a != b]
    for a, b in pairs:
        whole, most = line_dedup.anchored_distance(a, b), max(len(a), len(b)) // 5
        assert whole >= line_dedup.edit_distance(a, b)
        assert (line_dedup.anchored_distance(a, b, most) <= most) == (whole <= most)
    expected = [line_dedup.alike(a, b) for a, b in pairs]
    for long, tried in ((50, 30), (50, 0), (10_000, 30)):
        monkeypatch.setattr(line_dedup, "TRIED", tried)
        assert line_dedup.all_alike([a for a, _ in pairs], [b for _, b in pairs], long).tolist() == expected
    rows = line_dedup.line_rows(*buffers(pa.array(lines)))
    assert line_dedup.normal_form("\x0b A-b\tÉ!\x85c \n".encode()).decode() == "ab É\x85c"
    table = pd.DataFrame({"id": np.arange(len(lines)), "block": 0, "label": np.arange(len(lines)), "mark_a": rows["marks"][:, 0].view(np.int64), "mark_b": rows["marks"][:, 1].view(np.int64), "chars": rows["chars"], "keys": [[7]] * len(lines), "form": lines})
    found = []
    for at_once in (20_000, 300):
        monkeypatch.setattr(line_dedup, "PAIRS_AT_ONCE", at_once)
        links = line_dedup._block_links((7, 0, 0), table).to_numpy().tolist()
        assert links and all(line_dedup.alike(lines[a], lines[b]) for a, b in links)
        label = {i: i for i in range(len(lines))}
        for a, b in links:
            label = {k: label[a] if v == label[b] else v for k, v in label.items()}
        found.append({frozenset(k for k in label if label[k] == v) for v in label.values()})
    assert found[0] == found[1]
    # the words between fixed ones are short enough as they are: no distance is computed
    monkeypatch.setattr(line_dedup, "edit_distance", None)
    assert line_dedup.anchored_distance("one two three four five", "one two tree four five", 5) == 5


def test_trie_counts(spark, odd):
    import regex

    scores = trie_counts.fitted_scores(odd, RANKS)
    score = dict(zip(trie_counts.read_pieces(RANKS), scores.tolist()))
    got = sorted(trie_counts.token_counts(odd, RANKS, scores).collect(), key=lambda r: r.doc_id)

    def best(word):
        """By a plain search: (falling score, pieces) of every way to cut the word, the best of each rest kept."""
        after = {len(word): (0.0, 0)}
        for i in range(len(word) - 1, -1, -1):
            ways = [(score[word[i:j]] + after[j][0], -after[j][1] - 1) for j in range(i + 1, min(len(word), i + 130) + 1) if word[i:j] in score]
            top = max(ways)
            after[i] = (top[0], -top[1])
        return after[0][1]

    for r, (_, text) in zip(got, sorted(ODD, key=lambda x: x[0]), strict=True):
        words = regex.findall(PATTERN, text or "")
        assert r.n_pretokens == len(words)
        assert r.n_tokens == sum(best(w.encode()) for w in words)


def test_trie_counts_try_all_cuts():
    """Short words against every way to cut them."""
    pieces = [b"a", b"b", b"c", b"ab", b"bc", b"abc", b"ca", b"aa", b"cab"]
    rng = random.Random(3)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(120)})
    counts = np.array([rng.randrange(1, 9) for _ in words], float)

    def cuts(word):
        return [[word[:k], *rest] for k in range(1, len(word) + 1) if word[:k] in pieces for rest in cuts(word[k:])] if word else [[]]

    # one round of expectation maximisation, summed over every cut
    start = dict(zip(pieces, trie_counts.zipf(len(pieces))))
    expected = Counter()
    for word, n in zip(words, counts):
        ways = [(cut, math.exp(sum(start[p] for p in cut))) for cut in cuts(word)]
        whole = sum(p for _, p in ways)
        for cut, p in ways:
            for piece in cut:
                expected[piece] += n * p / whole
    plain = np.array([expected[p] + trie_counts.SMOOTHING for p in pieces])
    assert np.allclose(trie_counts.fit(pieces, words, counts, 1), np.log(plain / plain.sum()))
    assert len(trie_counts.fit(pieces, [], np.zeros(0))) == len(pieces)
    model = trie_counts.Unigram.__new__(trie_counts.Unigram)
    fitted = trie_counts.fit(pieces, words, counts)
    model.score, model.longest = dict(zip(pieces, fitted.tolist())), 3
    for word in words:
        top = max(sum(model.score[p] for p in cut) for cut in cuts(word))
        assert model.count_one(word) in {len(c) for c in cuts(word) if math.isclose(sum(model.score[p] for p in c), top, abs_tol=1e-9)}


def test_trie_scores_learn_from_every_text(spark, monkeypatch):
    """More texts and words than a sample held, a long word and a text without an id; blocks of any size give one fit."""
    import regex

    texts = [f"w{i} again {i % 7}" for i in range(21_000)] + ["rarely" * 30, None]
    frame = spark.createDataFrame([(i if i % 11 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counted = Counter(w.encode() for t in texts for w in regex.findall(PATTERN, t or ""))
    assert {bytes(r["word"]): r["n"] for r in trie_counts.word_counts(frame).collect()} == counted
    assert len(counted) > 20_000
    pieces, words = trie_counts.read_pieces(RANKS), sorted(counted)
    whole = trie_counts.fit(pieces, words, np.array([counted[w] for w in words], float))
    for size in (trie_counts.BLOCK_BYTES, 3000):
        monkeypatch.setattr(trie_counts, "BLOCK_BYTES", size)
        assert np.abs(trie_counts.fitted_scores(frame, RANKS) - whole).max() < 1e-6


def test_trie_scores_of_long_words(monkeypatch):
    """Words one by one and in a trie; bytes that no piece holds."""
    rng = random.Random(8)
    pieces = [b"a", b"b", b"ab", b"ba", b"aab", b"abab", b"c"]
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 60))) for _ in range(80)} | {b"abdab", b"d", b"abd"})
    counts = np.array([rng.randrange(1, 9) for _ in words], float)
    together = trie_counts.fit(pieces, words, counts)
    for long in (0, 20):
        monkeypatch.setattr(trie_counts, "LONG", long)
        assert np.abs(trie_counts.fit(pieces, words, counts) - together).max() < 1e-6


def test_media(spark, odd):
    for r in media.media_features(odd).collect():
        data = (dict(ODD)[r.doc_id] or "").encode()
        whole = data + b"\0" * (-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))


def _code(bits, lengths):
    webp.write_code(bits, lengths)
    return webp.code_words(lengths)


def _uneven(size, used):
    """Full code lengths in which the used symbols, and no others, have codes."""
    used = sorted(used)
    lengths = [0] * size
    if len(used) == 1:
        lengths[used[0]] = 1
        return lengths
    depth = (len(used) - 1).bit_length()
    short = (1 << depth) - len(used)
    for i, s in enumerate(used):
        lengths[s] = depth - 1 if i < short else depth
    return lengths


def _image(bits, pixels, main, cache=0, copies=False):
    """An image of literals, and of copies of the pixel before where ``copies``."""
    bits.write(1 if cache else 0, 1)
    if cache:
        bits.write(cache, 4)
    if main:
        bits.write(0, 1)
    symbols, table = [], [0] * (1 << cache) if cache else None
    i = 0
    while i < len(pixels):
        p = pixels[i]
        slot = (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache) if cache else 0
        if copies and i and i + 1 < len(pixels) and p == pixels[i - 1] == pixels[i + 1]:
            symbols.append(("copy", 2))
            i += 2
        elif cache and table[slot] == p:
            symbols.append(("cache", slot))
            i += 1
        else:
            symbols.append(("pixel", p))
            i += 1
        if cache:
            table[slot] = p
    green = {p >> 8 & 255 if k == "pixel" else 257 if k == "copy" else 280 + p for k, p in symbols}
    rest = [{p >> s & 255 for k, p in symbols if k == "pixel"} or {0} for s in (16, 0, 24)]
    codes = [_code(bits, _uneven(280 + ((1 << cache) if cache else 0), green)), *[_code(bits, _uneven(256, r)) for r in rest], _code(bits, _uneven(40, {1}))]
    for k, p in symbols:
        if k == "pixel":
            for code, s in zip(codes, (8, 16, 0, 24), strict=False):
                bits.write(*code[p >> s & 255])
        elif k == "copy":
            bits.write(*codes[0][257])  # length 2
            bits.write(*codes[4][1])  # distance code 2: the pixel to the left
        else:
            bits.write(*codes[0][280 + p])


def _file(bits):
    return webp.wrap(bits.value.to_bytes((bits.n + 7) // 8, "little"))


def _pixels(flat, height, width):
    return np.array(flat, ">u4").view(np.uint8).reshape(height, width, 4)


@pytest.mark.parametrize("cache,copies", [(0, False), (4, False), (0, True), (3, True)])
def test_webp_codes_cache_and_references(cache, copies):
    rng = random.Random(cache + copies)
    flat = [rng.choice([0xFF102030, 0xFF405060, 0x80000001, 0xFFFFFFFF, 0]) for _ in range(12)]
    flat = [p for p in flat for _ in range(rng.choice([1, 3, 4]))][:24]
    flat += [7] * (24 - len(flat))
    bits = webp.header(6, 4)
    bits.write(0, 1)
    _image(bits, flat, True, cache, copies)
    assert (webp.decode(_file(bits)) == _pixels(flat, 4, 6)).all()


def _minus(a, b):
    return sum(((a >> s) - (b >> s) & 255) << s for s in (0, 8, 16, 24))


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors(mode):
    rng = random.Random(mode)
    width, height = 7, 5
    flat = [rng.getrandbits(32) for _ in range(width * height)]
    left = []
    for i, p in enumerate(flat):
        y, x = divmod(i, width)
        if y == 0:
            guess = 0xFF000000 if x == 0 else flat[i - 1]
        elif x == 0:
            guess = flat[i - width]
        else:
            guess = webp.predict(mode, flat[i - 1], flat[i - width], flat[i - width - 1], flat[i - width + 1])
        left.append(_minus(p, guess))
    bits = webp.header(width, height)
    bits.write(1, 1)
    bits.write(webp.PREDICTOR, 2)
    bits.write(1, 3)
    _image(bits, [0xFF000000 | mode << 8], False)
    bits.write(0, 1)
    _image(bits, left, True)
    assert (webp.decode(_file(bits)) == _pixels(flat, height, width)).all()


def test_webp_predictor_values():
    left, top, corner, right = 0xFF102030, 0xFF304050, 0xFF203040, 0xFF001020
    expected = {0: 0xFF000000, 1: left, 2: top, 3: right, 4: corner, 7: 0xFF203040, 12: 0xFF203040}
    assert {m: webp.predict(m, left, top, corner, right) for m in expected} == expected


def test_webp_colour_transforms():
    rng = random.Random(9)
    flat = [rng.getrandbits(32) for _ in range(12)]
    green = [_minus(p, (p >> 8 & 255) << 16 | (p >> 8 & 255)) for p in flat]
    bits = webp.header(4, 3)
    bits.write(1, 1)
    bits.write(webp.SUBTRACT_GREEN, 2)
    bits.write(0, 1)
    _image(bits, green, True)
    assert (webp.decode(_file(bits)) == _pixels(flat, 3, 4)).all()

    signed = lambda v: (v & 255) - 256 if v & 128 else v & 255
    g2r, g2b, r2b = 21, 200, 77
    crossed = []
    for p in flat:
        g, r = p >> 8 & 255, p >> 16 & 255
        red = r - (signed(g2r) * signed(g) >> 5) & 255
        blue = (p & 255) - (signed(g2b) * signed(g) >> 5) - (signed(r2b) * signed(r) >> 5) & 255
        crossed.append(p & 0xFF00FF00 | red << 16 | blue)
    bits = webp.header(4, 3)
    bits.write(1, 1)
    bits.write(webp.CROSS_COLOR, 2)
    bits.write(0, 3)
    _image(bits, [0xFF000000 | r2b << 16 | g2b << 8 | g2r], False)
    bits.write(0, 1)
    _image(bits, crossed, True)
    assert (webp.decode(_file(bits)) == _pixels(flat, 3, 4)).all()


@pytest.mark.parametrize("n", [2, 4, 16, 40])
def test_webp_palette(n):
    rng = random.Random(n)
    colors = [rng.getrandbits(32) for _ in range(n)]
    width, height = 9, 3
    index = [rng.randrange(n) for _ in range(width * height)]
    bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    packed, depth = (width + (1 << bundle) - 1) >> bundle, 8 >> bundle
    rows = []
    for y in range(height):
        for b in range(packed):
            v = 0
            for k in range(1 << bundle):
                x = (b << bundle) + k
                v |= (index[y * width + x] if x < width else 0) << (k * depth)
            rows.append(0xFF000000 | v << 8)
    bits = webp.header(width, height)
    bits.write(1, 1)
    bits.write(webp.PALETTE, 2)
    bits.write(n - 1, 8)
    _image(bits, [colors[0], *[_minus(b, a) for a, b in zip(colors, colors[1:])]], False)
    bits.write(0, 1)
    _image(bits, rows, True)
    assert (webp.decode(_file(bits)) == _pixels([colors[i] for i in index], height, width)).all()


def test_webp_damage():
    good = webp.encode(np.zeros((2, 16, 4), np.uint8))
    with pytest.raises(ValueError):
        webp.decode(b"nothing")
    with pytest.raises(ValueError):
        webp.decode(good[: len(good) // 2])


def test_webp_writer_uses_its_parts():
    """Few colours take a palette, many plain codes, long runs back-references; all come back."""
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 5, 16, 17, 200, 256, 257, 3000):
        for height, width in ((1, 1), (3, 7), (20, 64)):
            colors = rng.integers(0, 2**32, k, dtype=np.uint64).astype(">u4")
            pixels = colors[rng.integers(0, k, height * width)].view(np.uint8).reshape(height, width, 4).copy()
            pixels[height // 2 :] = pixels[0, 0]
            assert (webp.decode(webp.encode(pixels)) == pixels).all()
    text = (b"some words of a text, again and again. " * 40)[: 64 * 24]
    whole = np.frombuffer(text + b"\0" * 64 * 500, np.uint8).reshape(-1, 64)
    stored = webp.encode_samples(whole)
    assert (webp.decode(stored)[:, :, 2] == whole).all() and len(stored) < 0.9 * len(text)
    bits = webp.BitReader(stored[21:])
    bits.read(32)
    assert bits.read(1) == 1 and bits.read(2) == webp.PALETTE
    start, size = webp.runs_of(whole.ravel())
    assert start.tolist() == [len(text)] and size.tolist() == [64 * 500]
    for value in (1, 4, 5, 6, 63, 64, 4095, 4096):
        prefix, extra, n = webp.extra_of(value)
        assert webp.read_extra(webp.BitReader(extra.to_bytes(2, "little")), prefix) == value and extra < 1 << n | (n == 0)


def test_distance_map():
    assert webp.SHORT[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert len(webp.SHORT) == 120 and webp.SHORT[-1] == (8, 7)


def plain_spans(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for k, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_personal_data_base(spark, docs, odd):
    cases = [(100, "a@b.c_d@e.ff x@y z@q.r. 1.2.3.4.5 256.1.1.1 0255.001.2.3"), (101, "4111 1111 1111 1111-4111-1111-1111-1111 4111  1111"), (102, "+1 (377) 555-0271, +12 +1234567890123456 é+49.30.1234567é"), (103, "1 " * 3000), (104, "a" * 20000), (105, "1." * 4000 + "😀 me@x.org")]
    rows = [(d["doc_id"], d["text"]) for d in docs] + [(1000 + i, t) for i, t in cases] + [(2000 + i, t) for i, t in ODD[:-1]]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        base = plain_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert got[i].n_card == base.count("card:")


def test_personal_data_bootstraps(spark):
    """Cards after one phrase teach it; a number in the same phrase without a valid sum is found."""
    seeds = ["4111111111111111", "5500005555555559", "340000000000009", "6011000000000004"]
    rows = [(i, f"Please note customer card {s} today") for i, s in enumerate(seeds)]
    rows += [(10, "Please note customer card 4111111111111112 today"), (11, "the year was 123456 then"), (12, None)]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10] == "id:26:42" and got[11] == "" and got[12] == ""


def test_personal_data_of_null_ids(spark):
    """Equal texts have equal spans, with an id or without."""
    rows = [(i, f"your token = AbCd{i:04d}EfGh9 here") for i in range(12)]
    rows.append((None, rows[5][1]))
    got = {r.doc_id: (r.spans, r.n_id) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[None] == got[5] and len(got) == 13


def test_personal_data_contexts(spark):
    """Grouped numbers are one mention, contexts are whole words, secrets teach their phrase, quotes stay outside."""
    seeds = ["4111 1111 1111 1111", "5500005555555559", "340000000000009", "6011000000000004"]
    long = "x" * 300
    rows = [(i, f"by customer{long} card {s} today") for i, s in enumerate(seeds)]
    rows += [(10, f"by customer{long} card 4111 1111 1111 1112 today"), (11, f"by other{long} card 4111 1111 1111 1112 today")]
    secrets = ["2321bac4d15ec8f90433955bf9d3cf61da5bdd1e", "e03422dad6b454724135a384f69ba12c7de6c8f4", "7c72db563d7f6e50cec00950f7bab1f2223b6afd", "11acdfb36bb72224148e6160f674b4be45601bff"]
    rows += [(20 + i, f'the token = "{s}" and') for i, s in enumerate(secrets)] + [(30, 'a token = "ab12cd34" and'), (31, f"{secrets[0]} alone")]
    got = {r.doc_id: (r.spans, r.n_id) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = len(f"by customer{long} card ")
    assert got[0][0] == f"card:{at}:{at + 19}"
    assert got[10] == (f"id:{at}:{at + 19}", 1) and got[11] == ("", 0)
    assert got[20] == ("id:13:53", 1) and got[30] == ("id:11:19", 1) and got[31] == ("", 0)


def test_personal_data_of_many_matches(spark):
    """Positions across chunks of matches, against the plain version."""
    text = "a 4111111111111111 " * 700 + "me@x.org é " * 300
    r = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_card, r.n_email) == (700, 300)
    assert r.base_sha256 == hashlib.sha256(plain_spans(text).encode()).hexdigest()


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (
        near_dedup.near_duplicates(empty), line_dedup.line_dedup(empty), decontaminate.contamination(empty, bench), toxicity.toxicity(empty, labels), language.language_id(empty),
        token_ids.token_records(empty, JSON), bpe_tree.encode_and_decode(empty, MULTI, PATTERN), trie_counts.token_counts(empty, RANKS), media.media_features(empty), pii.personal_data(empty),
    ):
        assert df.count() == 0


def test_near_duplicates_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    sql = {tuple(r) for r in con.execute("select doc_id, n_shingles, component_id, kept from (" + oracle_sql()["op8_minhash_near_dedup"] + ")").fetchall()}
    assert {tuple(r) for r in queries()["op8_minhash_near_dedup"](spark, DATA).collect()} == sql


def test_null_ids_and_clashing_columns_in_the_stages(spark, tmp_path):
    """Rows without an id stay in every filtering stage; columns of any name are carried through."""
    import corpus_pipeline

    line = "one two three four five six seven eight nine ten"
    rows = [(1, f"{line}\n{line} eleven twelve", 5, "a"), (None, line, 6, "b"), (None, line, 6, "b"), (2, None, None, "c"), (3, "", 0, "d"), (4, line, 7, "e"), (4, line, 7, "e")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, n_chars int, row string, id int, kept int, gone int, n_removed int")
    with_tables = str(tmp_path)
    spark.createDataFrame([(900, 1), (901, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no text here holds this passage of the benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, with_tables)
        assert out.columns == df.columns, name
        got = [(r.doc_id, r.text, r.row) for r in out.collect()]
        assert sum(g[0] is None for g in got) == 2 and (2, None, "c") in got and (3, "", "d") in got, name
        assert stage(spark, df.limit(0), with_tables).count() == 0
    near = near_dedup.near_duplicates(df).filter("doc_id is null").collect()
    assert [(r.n_shingles, r.component_id, r.kept) for r in near] == [(6, None, True)] * 2
    lines = dict((r.doc_id, (r.text, r.n_chars)) for r in corpus_pipeline.drop_repeated_lines(spark, df, with_tables).collect())
    assert lines[4] == ("", 0) and lines[2] == (None, None)


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())


def test_pipeline_equals_its_stages_by_hand(spark, docs):
    import corpus_pipeline

    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, DATA).collect()}
    frame, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    clean = {r.doc_id for r in toxicity.toxicity(frame, labels).collect() if not r.predicted}
    left = {r.doc_id: r.text for r in line_dedup.line_dedup(frame.filter(frame.doc_id.isin(list(clean))), floor=1).collect()}
    groups = components({i: shingles(t) for i, t in left.items()})
    kept = {k: v for k, v in left.items() if groups[k] == k}
    items = [" ".join(b["text"].lower().split()) for b in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()]
    plain = {k: " " + " ".join((v or "").lower().split()) + " " for k, v in kept.items()}
    whole = {k for k, t in plain.items() if any(f" {i} " in t for i in items)}
    assert set(got) <= set(kept) - whole
    assert len(set(kept) - whole - set(got)) <= 0.02 * len(kept)  # items with slight changes go too
    assert all(got[k] == hashlib.sha256((kept[k] or "").encode()).hexdigest() for k in got)


def test_many_distances_with_a_bound_for_each_pair():
    """Bands, words that enter and leave them, and pairs given up early change no distance within its bound."""
    rng = random.Random(31)
    for letters, longest in (("ab", 70), ("abcdefgh", 400), ("aé漢🙂", 200)):
        ones = ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(40)]
        twos = ["".join(rng.choice(letters) if rng.random() < 0.1 else c for c in t if rng.random() > 0.03) for t in ones]
        twos = [t if k % 3 else "".join(rng.choice(letters) for _ in range(len(t))) for k, t in enumerate(twos)]
        exact = np.array([line_dedup.edit_distance(a, b) for a, b in zip(ones, twos, strict=True)])
        assert line_dedup.edit_distances(ones, twos).tolist() == exact.tolist()
        for bounds in (np.array([max(map(len, pair)) // 5 for pair in zip(ones, twos, strict=True)]), np.zeros(40, np.int64), exact, np.maximum(exact - 1, 0)):
            got = line_dedup.edit_distances(ones, twos, bounds)
            assert np.where(exact <= bounds, got == exact, got > bounds).all()
    # a stretch without words that both texts hold once is compared by those it holds itself
    words = [f"w{k}" for k in range(120)]
    a, b = " ".join([*words, "start", *words, "end"]), " ".join([*words, "start", *words[:60], "new", *words[60:], "end"])
    assert line_dedup.anchored_distance(a, b) == line_dedup.edit_distance(a, b) == 4


def test_rows_of_wanted_keys_only(spark):
    """The filter before the shuffle keeps every row of a wanted key and drops nearly all others."""
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63 - 1, (2000, 3))
    rows = [(i, [int(k) for k in ks]) for i, ks in enumerate(keys)] + [(2000, []), (2001, None)]
    lines = spark.createDataFrame(rows, "id long, keys array<long>").repartition(3)
    wanted = {int(k) for k in keys[::20].ravel()}
    found = line_dedup._rows_of_keys(lines, spark.createDataFrame([(k,) for k in sorted(wanted)], "key long")).collect()
    got = {(r.key, r.id) for r in found}
    every = {(k, i) for i, ks in rows for k in ks or []}
    assert got <= every and {(k, i) for k, i in every if k in wanted} <= got
    assert len(got) < len(wanted) + 0.2 * len(every) and len(found) == len(got)
    assert line_dedup._rows_of_keys(lines, spark.createDataFrame([], "key long")).count() == 0
