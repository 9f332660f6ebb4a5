import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import trestle.llm.jaccard as J
from trestle.llm.jaccard import components, linked, part_keys, tile_links
from trestle.llm.queries import op7_fingerprints
from trestle.llm.simhash import block_plan, fingerprints, near_counts, next_ids

WS = " \t\n\x0b\x0c\r"


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in "".join(" " if c in WS else c for c in low).split(" ") if w]


def shingles(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [(r[0], shingles(r[1], n)) for r in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, (_, a)), (k, (_, b)) in itertools.combinations(enumerate(sets), 2):
        both = len(a & b)
        if a and b and 100 * both >= percent * (len(a) + len(b) - both):
            root[find(i)] = find(k)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_components_of_links(docs, rows, n, percent):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in linked(docs, words=n, percent=percent).collect())
    assert got == brute(rows, n, percent)


def test_wide_groups(spark, monkeypatch):
    """A family of many near copies and a chain, over several tiles."""
    monkeypatch.setattr(J, "LEAST_TILE", 300)
    monkeypatch.setattr(J, "LEAST_ROOM", 5)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 900, 90)]
    rows = []
    for i in range(70):
        w = base.copy()
        for k in rng.integers(0, 90, i % 4):
            w[k] = f"x{i}{k}"
        rows.append((i, " ".join(w)))
    chain = base[:60] + [f"c{i}" for i in range(60)]
    for i in range(12):
        rows.append((100 + i, " ".join(chain[i * 3 : i * 3 + 80])))
    got = linked(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85, tile=300)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 4, 85)


@pytest.mark.parametrize("n,room", [(300, 2_000), (60, 3)])
def test_chained_groups(spark, monkeypatch, n, room):
    """Texts that each share keys with their neighbours only, so that all are one group in which little is linked: rows that are compared grow with the texts, not with their square."""
    monkeypatch.setattr(J, "LEAST_TILE", 300)
    monkeypatch.setattr(J, "LEAST_ROOM", 5)
    monkeypatch.setattr(J, "ROOM", room, raising=False)
    given, plain = [], J.compared

    def compared(tiles, *rest):
        given.append(tiles.count())
        return plain(tiles, *rest)

    monkeypatch.setattr(J, "compared", compared)
    chain = [f"c{i}" for i in range(7 * n + 80)]
    rows = [(i, " ".join(chain[7 * i : 7 * i + 80])) for i in range(n)] + [(n + i, " ".join(chain[21 * i + 1 : 21 * i + 81])) for i in range(n // 5)]
    got = linked(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85, tile=300)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 4, 85)
    assert len(given) == 2 and (room == 3 or given[1] < 20 * len(rows)), given


def test_one_passage_in_very_many(spark):
    """50,000 texts share a passage; the links are those of the few pairs that share nearly all. Null ids link others, too."""
    rng = np.random.default_rng(8)
    w = rng.integers(0, 10**9, (50_000, 40))
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(map(str, x))) for i, x in enumerate(w.tolist())]
    for k in range(20):
        rows.append((60_000 + k, rows[k][1] + " more"))
    rows += [(None, rows[30][1] + " one"), (70_000, rows[30][1] + " one two three four five six seven")]
    got = {r.doc_id: r.component_id for r in linked(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85).collect()}
    assert {d: c for d, c in got.items() if d != c} == {60_000 + k: k for k in range(20)} | {None: 30, 70_000: 30}


def test_null_ids_link(spark):
    w = [f"w{i}" for i in range(100)]
    rows = [(5, " ".join(w)), (None, " ".join(w[8:] + ["a"] * 2)), (9, " ".join(w[14:] + ["a"] * 2 + [f"b{i}" for i in range(4)])), (None, "alone is this text"), (None, None), (8, None)]
    got = linked(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 4, 85)


def test_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, "w " * 500_000), (4, "x" * 2_000_000), (5, long[: len(long) // 2])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in linked(spark.createDataFrame(rows, "doc_id long, text string"), words=5, percent=80).collect()}
    assert {k: v[1] for k, v in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5} and got[3][0] == got[4][0] == 1 and got[2][0] == 299_997


def test_no_documents(none):
    assert linked(none).count() == 0
    assert fingerprints(none, lambda c: F.col(c) % 50 == 0).count() == 0


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_no_link_without_a_key(percent):
    """Every pair at the threshold shares as many keys as it should, and one of the first ones in any order of all keys."""
    rng = np.random.default_rng(percent)
    for size in [*range(1, 40), 55, 97, 150, 333, 600]:
        for _ in range(20):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            most = size - -(-percent * size // 100)
            swap = int(rng.integers(0, most + 1))
            b = a.copy()
            b[: swap // 2] = rng.integers(0, 2**63, swap // 2, dtype=np.uint64)
            b = b[: size - (swap - swap // 2)] if swap - swap // 2 < size else b
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if both * 100 >= percent * (len(a) + len(b) - both) and len(b):
                of_a, of_b = ({band: (set(k.tolist()), need) for band, k, need in part_keys(x, percent)} for x in (a, b))
                low = min(max(of_a), max(of_b))  # the band of the smaller one
                common = of_a[low][0] & of_b[low][0]
                assert len(a) == len(b) == both or len(common) >= max(of_a[low][1], of_b[low][1])
                # In any order of all keys, what is left without the last ones has one in common.
                first = [set(sorted(k, key=lambda v: v * 0x9E3779B97F4A7C15 % 2**64)[: len(k) - need + 1]) for k, need in (of_a[low], of_b[low])]
                assert len(a) == len(b) == both or first[0] & first[1]


def test_tiles_find_what_connects():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**62, 200, dtype=np.uint64))
    sets = [np.unique(np.r_[base[k:], rng.integers(0, 2**62, k, dtype=np.uint64)]) for k in (0, 3, 8, 20, 40, 100)]
    links = tile_links(sets, [], list(range(6)), 85)
    assert all(len(np.intersect1d(sets[i], sets[k])) * 100 >= 85 * len(np.union1d(sets[i], sets[k])) for i, k in links)
    assert tile_links(sets[:2], sets[2:3], [0, 0, 0], 85) == []


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 100)] + [(300, 301 + i) for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102, 200)} | {i: 300 for i in range(300, 331)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_next_ids(spark):
    ids = [5, 1, 9, 9, None, 700, -3]
    got = {r.id: r.next_id for r in next_ids(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert got == {-3: 1, 1: 5, 5: 9, 9: 700, 700: -3}
    assert [(r.id, r.next_id) for r in next_ids(spark.createDataFrame([(4,)], "id long")).collect()] == [(4, 4)]


def test_fingerprints(docs, rows):
    got = fingerprints(docs, lambda c: F.col(c) % 5 == 0, radius=3).collect()
    texts = {}
    for r in rows:
        if r[0] is not None:
            texts.setdefault(r[0], []).append(r[1] or "")
    order = sorted(texts)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    want = Counter()
    for r in rows:
        t, k = r[1] or "", len(r[1] or "") // 4
        begin = min(x[:k] for x in texts[after[r[0]]]) if r[0] is not None else ""
        edited = t[: len(t) - k] + begin
        want[r[0], len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    prints = [(r.doc_id, r.fingerprint) for r in got]
    by_text = {}
    for r in got:
        assert len(r.fingerprint) == 32
        near = 1 - bin(int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).count("1") / 128
        assert r.near_edited == pytest.approx(near)
        if r.doc_id is not None:
            t = (texts[r.doc_id][0], r.fingerprint)
            assert by_text.setdefault(t[0], t[1]) == t[1]
            follow = min(f for d, f in prints if d == after[r.doc_id])
            if len({f for d, f in prints if d == after[r.doc_id]}) == 1:
                assert r.near_next == pytest.approx(1 - bin(int(r.fingerprint, 16) ^ int(follow, 16)).count("1") / 128)
        else:
            assert r.near_next is None
        asked = r.doc_id is not None and r.doc_id % 5 == 0
        apart = [bin(int(r.fingerprint, 16) ^ int(f, 16)).count("1") for _, f in prints]
        assert r.n_near == (sum(a <= 3 for a in apart) - 1 if asked else None)
    long = [r for r in got if r.n_chars > 300 and r.doc_id is not None and r.near_edited < 1]
    assert np.mean([r.near_edited - r.near_next for r in long]) > 0.1


def votes(text):
    """A fingerprint by counting each bit's votes over the terms, with another implementation of the hash."""
    import struct

    import xxhash

    w = [x for x in "".join(" " if c in WS else c for c in text).split(" ") if x]
    up = [0] * 128
    for a, b in zip(w, [*w[1:], None], strict=False):
        h = xxhash.xxh64_intdigest(a.encode(), seed=42)
        h = xxhash.xxh64_intdigest(b.encode(), seed=h) if b is not None else h
        bits = h | xxhash.xxh64_intdigest(struct.pack("<i", 1), seed=h) << 64
        weight = min(16, len(a) + len(b or ""))
        for i in range(128):
            up[i] += weight if bits >> i & 1 else -weight
    halves = [sum((up[64 * k + i] > 0) << i for i in range(64)) for k in (0, 1)]
    return "".join(f"{x:016x}" for x in halves)


def test_votes(spark):
    texts = ["", "one", "one two", "the same word the same word", "é 日本語 " + "x" * 40 + " A a", " ".join(f"w{i * i % 97}" for i in range(500))]
    rows = list(enumerate(texts)) + [(3, texts[3])] * 5
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), lambda c: F.col(c) >= 0).collect()
    assert len(got) == 11 and {(r.doc_id, r.fingerprint) for r in got} == {(i, votes(t)) for i, t in enumerate(texts)}


def test_many_equal_rows_and_long_texts(spark):
    """Sums of one row are never added to another's; a text of millions of words doesn't run over."""
    long = "aaaaaaaa bbbbbbbb " * 500_000
    docs = spark.range(30_000).selectExpr("CAST(NULL AS bigint) AS doc_id", "'the same text' AS text").unionByName(spark.createDataFrame([(7, long)], "doc_id long, text string"))
    got = fingerprints(docs, lambda c: F.col(c) >= 0).groupBy("doc_id", "fingerprint").count().collect()
    assert {(r.doc_id, r.fingerprint, r["count"]) for r in got} == {(None, votes("the same text"), 30_000), (7, votes("aaaaaaaa bbbbbbbb " * 50), 1)}


def test_block_tables_find_all(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 60)]
    rows = []
    for i in range(300):
        f0, f1 = base[i % 60], base[(i + 7) % 60]
        for b in rng.integers(0, 63, i % 5).tolist():
            f0 ^= 1 << b
        rows.append((i, f0, f1, 1))
    path = str(tmp_path / "f")
    spark.createDataFrame(rows, "id long, f0 long, f1 long, n long").write.parquet(path)
    got = {(r.f0, r.f1): r.n_near for r in near_counts(spark.read.parquet(path), lambda c: F.col(c) >= 0).collect()}
    apart = lambda a, b: bin(a[1] ^ b[1]).count("1") + bin(a[2] ^ b[2]).count("1")
    assert got == {(a[1], a[2]): sum(apart(a, b) <= 3 for b in rows) - 1 for a in rows}


@pytest.mark.parametrize("radius", range(33))
def test_blocks_cover_the_radius(radius):
    plan = block_plan(radius)
    assert [at for at, _, _ in plan] == list(np.cumsum([0, *(w for _, w, _ in plan)]))[:-1] and sum(w for _, w, _ in plan) == 128
    assert sum(most + 1 for _, _, most in plan) > radius and all(most >= 0 for _, _, most in plan)


@pytest.mark.parametrize("radius", [1, 12, 16])
def test_wide_radii_find_all(spark, tmp_path, radius):
    """Against brute force, with bits changed anywhere or in one run, up to beyond the radius."""
    rng = np.random.default_rng(radius)
    rows = []
    for i in range(400):
        f = (i % 20 + 1) * 0x9E3779B97F4A7C15F39CC0605CEDC835 % 2**128
        k = int(rng.integers(0, 15))
        for b in rng.permutation(128)[:k] if i % 3 else (int(rng.integers(0, 128)) + np.arange(k)) % 128:
            f ^= 1 << int(b)
        rows.append((i, *(x - 2**64 if x >= 2**63 else x for x in (f % 2**64, f >> 64)), 1 + i % 2))
    path = str(tmp_path / "f")
    spark.createDataFrame(rows, "id long, f0 long, f1 long, n long").withColumn("_", F.explode(F.expr("sequence(1, n)"))).write.parquet(path)
    got = {(r.f0, r.f1): r.n_near for r in near_counts(spark.read.parquet(path), lambda c: F.col(c) % 3 == 0, radius).collect()}
    apart = lambda a, b: sum(((x ^ y) % 2**64).bit_count() for x, y in zip(a[1:3], b[1:3], strict=True))
    assert got == {(a[1], a[2]): sum(b[3] for b in rows if apart(a, b) <= radius) - 1 for a in rows if a[0] % 3 == 0}


def test_near_copies_are_near(spark, tmp_path):
    """The query counts nearly all planted copies of at least 0.8 of all shingles of five words, and no other texts."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for family in range(4):
        base = [f"word{k}" for k in rng.integers(0, 5000, 200)]
        copies = [base]
        for k in range(12):
            w = base.copy()
            for at in rng.permutation(200)[: k % 4 + 1]:
                w[at] = f"other{family}{k}"
            copies.append(w)
        assert all(len(shingles(" ".join(base), 5) & (s := shingles(" ".join(w), 5))) >= 0.8 * len(shingles(" ".join(base), 5) | s) for w in copies)
        rows += [(family * 50 + k, " ".join(w)) for k, w in enumerate(copies)]
        want[family * 50] = len(copies) - 1
    rows += [(1000 + 2 * i + 1, " ".join(f"word{k}" for k in rng.integers(0, 5000, 200))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_near for r in op7_fingerprints(spark, str(tmp_path)).where("n_near IS NOT NULL").collect()}
    assert got.keys() == want.keys() and all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.95 * sum(want.values())
