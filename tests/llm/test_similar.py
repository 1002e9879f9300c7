"""Near duplicates, components, embeddings and benchmark leaks."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotativa.llm import common, decontam, embed, graph, simhash
from rotativa.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


class Groups:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def test_components(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(200)] + [(5, 5)]
    edges += [(random.randrange(2000, 2300), random.randrange(2000, 2300)) for _ in range(180)]
    groups = Groups({n for e in edges for n in e})
    for a, b in edges:
        groups.join(a, b)
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: groups.find(n) for n in groups.parent if groups.find(n) != n}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("bits", "radius"), [(64, 3), (40, 2), (64, 1), (16, 2)])
def test_ball_links_connect_exactly_what_is_near(spark, bits, radius):
    random.seed(bits + radius)
    points = {0, (1 << bits) - 1, 1 << (bits - 1)}
    for _ in range(30):
        center = random.getrandbits(bits)
        for _ in range(12):
            flips = random.sample(range(bits), random.randrange(5))
            points.add(center ^ sum(1 << b for b in flips))
    points = sorted(simhash.signed(p) for p in points)
    groups = Groups(points)
    near = {(a, b) for i, a in enumerate(points) for b in points[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    for a, b in near:
        groups.join(a, b)
    pairs = simhash.links(spark.createDataFrame([(p,) for p in points], "fp long"), bits, radius).collect()
    linked = Groups(points)
    for r in pairs:
        assert (min(r.a, r.b), max(r.a, r.b)) in near
        linked.join(r.a, r.b)
    assert {p: linked.find(p) for p in points} == {p: groups.find(p) for p in points}


def brute_fingerprint(text, size=3):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    groups, ids = Groups(prints), sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                groups.join(a, b)
    rows = QUERIES["op8_simhash"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", groups.find(i)) for i in ids}


def test_simhash_edges(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (7, "One two x"), (8, "one  TWO x"), (None, "one two x"), (None, "quite another text here"), (4, "É é " * 9000), (4, "É é " * 9000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fingerprint int, component_id string")
    found = simhash.near_duplicates(df).collect()
    assert len(found) == len(rows)
    by_text = {}
    for r in found:
        by_text.setdefault(r.fingerprint, set()).add((r.doc_id, r.component_id))
    assert by_text[0] == {(5, 3), (3, 3), (9, 3)}
    assert {(7, 7), (8, 7), (None, 7)} in by_text.values()
    assert {(None, None)} in by_text.values() and {(4, 4)} in by_text.values()
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_deduplicated(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(3000)]
    base = [random.choices(words, k=300) for _ in range(40)]
    near = [[w if i not in (40, 200) else "changed" for i, w in enumerate(b)] for b in base]  # similarity about 0.93
    far = [[w if random.random() > 0.15 else random.choice(words) for w in b] for b in base]  # about 0.3
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(100 + i, " ".join(b)) for i, b in enumerate(near)]
    rows += [(200 + i, " ".join(b)) for i, b in enumerate(far)] + [(300 + i, " ".join(base[0]).upper()) for i in range(30)]
    rows += [(400, None), (401, ""), (402, "short one"), (403, "Short\nONE"), (404, "short two"), (0, " ".join(base[0])), (None, " ".join(base[1])), (None, "only here"), (None, "only here")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, key string, class_id int")
    out = simhash.deduplicated(df)
    assert out.columns == df.columns
    kept = sorted(r.doc_id if r.doc_id is not None else r.text for r in out.collect() if r.doc_id is not None)
    assert kept == [*range(40), *range(200, 240), 400, 402, 404]
    assert [r.text for r in out.where("doc_id is null").collect()] == ["only here"]
    assert simhash.deduplicated(df.limit(0)).count() == 0


def jaccard(a, b):
    a, b = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


def test_recall_of_block_edits(spark):
    """Copies that gained, lost or exchanged a block, at similarities of 0.80 to 0.85."""
    random.seed(6)
    words = [f"w{i}" for i in range(20_000)]
    rows = []
    for i in range(300):
        base = random.choices(words, k=300)
        new = random.choices(words, k=68)
        copy = [base + new, base[:248], base[:120] + new[:28] + base[148:]][i % 3]
        assert 0.8 <= jaccard(base, copy) <= 0.85
        rows += [(i, " ".join(base)), (1000 + i, " ".join(copy))]
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(300)) and len(kept) <= 303


@pytest.mark.parametrize("chunk", [500_000, 20_000])
def test_copies_of_a_text_that_is_no_hub(spark, monkeypatch, chunk):
    """Edited copies are near their original and often not near one another; whichever has the smallest class."""
    monkeypatch.setattr(simhash, "CHUNK_SHINGLES", chunk)
    random.seed(8)
    words = [f"w{i}" for i in range(20_000)]
    texts = []
    for _ in range(2):
        base = random.choices(words, k=400)
        texts.append(base)
        for n in random.choices(range(4, 10), k=150):
            at = set(random.sample(range(400), n))
            texts.append([random.choice(words) if i in at else w for i, w in enumerate(base)])
    groups = Groups(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if jaccard(a, texts[j]) >= 0.8:
                groups.join(i, j)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicated(df).collect()}
    assert kept == {groups.find(i) for i in range(len(texts))}


def test_all_pairs_of_a_chunk_are_joined():
    random.seed(9)
    sets = [np.unique(random.choices(range(12), k=9)) for _ in range(150)] + [np.empty(0, np.int64)]
    offsets = np.append(0, np.cumsum([len(s) for s in sets]))
    groups, found = Groups(range(len(sets))), Groups(range(len(sets)))
    near = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if len(a) and i != j and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))}
    for pair in near:
        groups.join(*pair)
    links = simhash.joined(np.arange(len(sets)), np.arange(len(sets)), offsets, np.concatenate(sets), 0.8)
    assert set(links) <= near and len(links) < len(sets)
    for pair in links:
        found.join(*pair)
    assert [found.find(i) for i in range(len(sets))] == [groups.find(i) for i in range(len(sets))]


# Embeddings

def brute_embeddings(rows, least=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    groups, links = Groups([k for k in range(len(good))]), Counter()
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    return good, groups, links


def test_embeddings_equal_brute_force(spark):
    random = np.random.default_rng(7)
    centers = random.standard_normal((40, 16))
    rows = [(i, (centers[i % 40] + 0.15 * random.standard_normal(16)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(20)] + [(2000, [2 * x for x in rows[5][1]])]
    config = embed.PStableConfig(chunk=16)  # buckets are cut into chunks
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, class_id string")
    found = {r.vec_id: r for r in embed.near_duplicates(df, config=config).collect()}
    good, groups, links = brute_embeddings(rows)
    whole = sum(found[i].n_links for i, _ in good) / sum(links.values())
    assert 0.97 <= whole <= 1
    assert all(found[i].n_links <= links[k] for k, (i, _) in enumerate(good))
    least = {}
    for k, (i, _) in enumerate(good):
        root = groups.find(k)
        least[root] = min(i, least.get(root, i))
    assert sum(found[i].component_id == least[groups.find(k)] for k, (i, _) in enumerate(good)) / len(good) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [1e300, 0.0]), (7, [1.0, 0.0]), (None, [0.0, 1.0]), (None, None), (10, [-1.0, -0.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed.near_duplicates(df).collect()), key=str)
    expected = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 8)] + [(7, 2, 7, True)] * 2 + [(9, 2, 7, False), (10, 1, 10, True), (11, 1, 10, False)] + [(None, 0, None, True)] * 2
    assert found == sorted(expected, key=str)
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold():
    """Vectors at a cosine of exactly 0.9: the share of pairs that meet in some bucket."""
    random, config = np.random.default_rng(5), embed.PStableConfig()
    x = embed.unit(random.standard_normal((4000, 64)))
    y = random.standard_normal((4000, 64))
    y = embed.unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    z = 0.9 * x + np.sqrt(1 - 0.81) * y
    assert (embed.buckets(x, config) == embed.buckets(z, config)).any(axis=1).mean() >= 0.93


# Benchmark leaks

def brute_leaks(docs, items, size=5, least=0.8):
    import regex

    def cut(t):
        return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())

    def grams(w):
        k = min(size, len(w))
        return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))

    found = {}
    for i, item in items.items():
        words = cut(item)
        own = grams(words)
        for d, text in docs.items():
            w = cut(text)
            if not words or not w:
                continue
            k = min(size, len(words))
            at = [w[s:s + len(words)] for s in range(max(1, len(w) - len(words) + 1))]
            values = []
            for window in at:
                c = Counter(tuple(window[j:j + k]) for j in range(len(window) - k + 1))
                values.append(sum((c & own).values()) / sum((c | own).values()))
            if max(values) >= least:
                found[d, i] = (pytest.approx(max(values)), sum(v >= least for v in values))
    return found


def test_leaks_equal_brute_force(spark):
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(500)]
    items = {i: " ".join(random.choices(vocabulary, k=n)) for i, n in enumerate([60, 40, 41, 20, 7, 3])}
    items |= {6: "one Two, THREE four five six seven eight nine ten eleven twelve", 7: None, 8: "...", 9: "a b c d e f " * 4}

    def text(*parts):
        return " ".join([" ".join(random.choices(vocabulary, k=30)), *parts, " ".join(random.choices(vocabulary, k=30))])

    def edited(item, at):
        w = item.split()
        for a in at:
            w[a] = "edit"
        return " ".join(w)

    docs = {
        0: text(items[0]), 1: text(edited(items[0], [30])), 2: text(edited(items[0], [10, 30, 50])), 3: text(items[1].upper().replace(" ", " - ")),
        4: text(" ".join(items[2].split()[:39]), "in", " ".join(items[2].split()[39:])), 5: text(items[3], items[3]), 6: items[4], 7: text(items[5]),
        8: "ONE two three—four five; six seven eight nine ten eleven Twelve!", 9: None, 10: "", 11: text(items[9]), 12: " ".join(items[0].split()[:58]),
        13: text(), 14: "a b c d e f a b c d e f", 15: text(items[0].replace("w", "v")),
    }
    rows = [(d, t, 1, "x") for d, t in docs.items()] + [(0, docs[0], 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int, words string")
    bench = spark.createDataFrame([(i, t, "y") for i, t in items.items()] + [(0, items[0], "y")], "item_id long, text string, w string")
    found = {(r.doc_id, r.item_id): (r.similarity, r.windows) for r in decontam.contaminated(df, bench).collect()}
    expected = brute_leaks(docs, items)
    assert found == expected
    assert {(0, 0), (1, 0), (3, 1), (4, 2), (5, 3), (6, 4), (7, 5), (8, 6), (11, 9), (12, 0)} <= set(found)
    assert not {d for d, _ in found} & {9, 10, 13, 15}
    assert decontam.contaminated(df.limit(0), bench).count() == 0
    assert decontam.contaminated(df, bench.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, items[1]), (None, "clean"), (None, f"x {items[1]}")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(nulls, bench).collect()] == [(None, 1)]
    assert decontam.contaminated_texts(nulls, bench).count() == 2


def test_leaks_without_broadcast(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    small = {tuple(r) for r in decontam.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontam, "BROADCAST_SHINGLES", 0)
    assert {tuple(r) for r in decontam.contaminated(docs, bench).collect()} == small
    assert small
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = {r.item_id: r.text for r in bench.collect()}
    assert {(r[0], r[1]) for r in small} == set(brute_leaks({d: texts[d] for d, *_ in small}, items))


def test_leaks_store_places_alone(spark, monkeypatch):
    """Neither texts nor shingles of documents are written, and pairs that share many blocks are met once."""
    kept, joined = {}, []
    stored, first = decontam.stored, decontam.first_block

    def watched(df, name):
        kept[name] = stored(df, name)
        return kept[name]

    monkeypatch.setattr(decontam, "stored", watched)
    monkeypatch.setattr(common, "stored", watched)
    monkeypatch.setattr(decontam, "first_block", lambda *names: joined.append(names) or first(*names))
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert decontam.contaminated(docs, bench).count() and joined
    assert not [n for n, df in kept.items() if not n.startswith("item") for _, kind in df.dtypes if kind.startswith("array") or kind == "string"]
    drawn = lambda: random.getrandbits(64) - 2**63
    pairs = [(drawn(), drawn() & drawn() & drawn()) for _ in range(200)]
    rows = spark.createDataFrame([(a, a ^ flips) for a, flips in [*pairs, (5, 0), (-1, 0)]], "a long, b long")
    met = rows.select("a", "b", F.posexplode(decontam.blocks("a", 19)).alias("i", "x")).select("a", "b", "x", F.get(decontam.blocks("b", 19), "i").alias("y"))
    equal = met.where("x = y").withColumn("first", first("a", "b", 19) == F.col("x.block")).groupBy("a", "b").agg(F.count_if("first").alias("n"))
    assert {r.n for r in equal.collect()} == {1}
    assert rows.where(first("a", "b", 19).isNull()).count() == rows.count() - equal.count()


def test_simhash_in_expressions(spark):
    hashes = [random.getrandbits(64) - 2**63 for _ in range(37)]
    expected = sum(1 << b for b in range(64) if sum((h & (2**64 - 1)) >> b & 1 for h in hashes) * 2 > len(hashes))
    row = spark.createDataFrame([(hashes,)], "h array<long>").select(decontam.simhash("h").alias("s"), decontam.blocks("h[0]", 19).alias("b")).first()
    assert row.s & (2**64 - 1) == expected
    assert simhash.fingerprint(np.array(hashes, np.int64).view(np.uint64)) == row.s
    assert len(row.b) == 20
    assert spark.range(1).select(F.size(decontam.words(F.lit(" ,. ")))).first()[0] == 0


def test_spanning_links_connect_the_same():
    random.seed(21)
    for _ in range(100):
        ids = np.array(sorted(random.sample(range(100), 20)))
        pairs = [random.sample(ids.tolist(), 2) for _ in range(random.randrange(60))]
        a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        tied = [x.tolist() for x in embed.spanning(ids, a, b)]
        assert len(tied[0]) < len(ids) and {frozenset(p) for p in zip(*tied)} <= {frozenset(p) for p in pairs}

        def roots(links):
            root = {i: i for i in ids.tolist()}
            for _ in ids:
                for x, y in links:
                    root[x] = root[y] = min(root[x], root[y])
            return root

        assert roots(list(zip(*tied))) == roots(pairs)


def test_output_is_linear_in_a_dense_group(spark):
    """500 vectors that are all linked: 124,750 pairs, but not so many rows."""
    random.seed(22)
    rows = [(i, [1.0 + random.random() * 1e-3 for _ in range(8)], 1 + i % 3) for i in range(500)]
    classes = spark.createDataFrame(rows, "class_id long, vector array<double>, weight long")
    config = embed.PStableConfig(chunk=100)
    found = embed.neighbours(classes, config).collect()
    chunk_pairs = 5 * 6 // 2
    assert len(found) <= 2 * 200 * chunk_pairs * config.tables and len([r for r in found if r.b is not None]) < 500 * chunk_pairs * 2
    others = Counter()
    for r in found:
        others[r.a] += r.others or 0
    total = sum(w for _, _, w in rows)
    assert all(others[i] == total - w for i, _, w in rows)


@pytest.mark.parametrize("share", [1, 1_000])
def test_hot_keys_by_both_ways(spark, share, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)] + [(None, 300)], "k long, v long")
    side = rows.groupBy("k").count().withColumn("x", F.col("k") * 2)
    found = common.join_spread(rows, side, "k", "count", 301).select("k", "v", "x").collect()
    assert sorted(found) == sorted((k, v, 2 * k) for k, v in ((i % 7 if i % 3 else 0, i) for i in range(300)))


def edited(words, similarity, rng):
    """A copy with scattered words replaced, added and left out, down to about the similarity of five-word shingles."""
    words = list(words)
    k = max(1, round(len(words) * (1 - similarity) / (1 + similarity) / 5))
    for _ in range(k):
        at = rng.randrange(len(words))
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def test_recall_of_edited_items(spark):
    """Items edited to a weighted similarity of 0.80 to 0.85, hidden in other text: at least 0.9 of them are found."""
    rng = random.Random(23)
    items, docs, want = [], [], set()
    for i in range(300):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 60, 90]))]
        items.append((i, " ".join(words)))
        for _ in range(40):
            copy = edited(words, 0.82, rng)
            if rng.random() < 0.5:
                cut = rng.randrange(3)
                copy = copy[cut:] + [f"x{rng.randrange(10**6)}" for _ in range(cut)]
            a, b = (Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4)) for w in (words, copy))
            if 0.80 <= sum((a & b).values()) / sum((a | b).values()) <= 0.85:
                around = [f"y{rng.randrange(10**6)}" for _ in range(30)]
                docs.append((i, " ".join([*around, *copy, *around])))
                want.add((i, i))
                break
    assert len(want) >= 150
    found = decontam.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    hit = {(r.doc_id, r.item_id) for r in found}
    assert len(hit & want) >= 0.9 * len(want) and hit <= want


def test_fingerprints_propose_pairs(spark):
    """Classes whose fingerprints the balls connect share a bucket, without any band."""
    rows = [(0, 0b1011, 40, []), (1, 0b0000, 40, []), (2, 0b0111 << 40, 40, []), (3, -1, 40, []), (4, -1, 40, []), (5, 0b111111 << 20, 40, [])]
    classes = spark.createDataFrame(rows, "class_id long, fp long, shingles int, bands array<bigint>")
    members, pairs = simhash.candidates(classes, 0.8)
    assert {tuple(r) for r in pairs.collect()} == {(0, 1), (0, 2), (3, 4)}
    assert sorted(r.class_id for r in members.collect()) == [0, 1, 2, 3, 4]
