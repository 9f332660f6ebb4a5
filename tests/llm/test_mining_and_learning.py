import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trestle.llm import clusters, collocations, discriminant

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases_by_hand(rows, longest, least, inside, top):
    f, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    best = {}
    for (lang, p), a in candidates.items():
        within = (b for (la, q), b in candidates.items() if la == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if any(100 * b >= inside * a for b in within):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        best.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(la, i + 1, p.decode(), -a, left, right, total[la], -s) for la, found in best.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize(("longest", "least", "top"), [(3, 3, 2000), (4, 2, 50), (2, 2, 7)])
def test_phrases_by_hand(spark, docs, rows, longest, least, top):
    got = {tuple(r) for r in collocations.collocations(docs, longest=longest, least=least, top=top).collect()}
    assert got == phrases_by_hand([(r[1], r[2]) for r in rows], longest, least, 50, top) and got


def test_pieces_longer_than_a_block_lose_no_phrase(spark, monkeypatch):
    """Blocks of 64 bytes, in pieces without an end, with one, and of one long word."""
    texts = [("a b c " * 400, "x"), ("a b c, b c a. " * 60 + "a  \tb" * 50, "x"), ("q" * 3000 + " a b", "x"), (" \t ", "x"), (",.;", None), ("a b\na b\r\na b", None)]
    got = []
    for data, _ in texts:
        data = np.frombuffer(data.encode(), np.uint8)
        for most in (8, 64, 1 << 20):
            rows = [collocations.block(data[a:c], np.zeros(1, np.int64), own - a, ["x"], 0) for a, own, c in collocations.windows(data, 2, most)]
            got.append(Counter())
            for r in filter(None, rows):
                got[-1].update(dict(zip(r[2], r[3].tolist(), strict=True)))
        assert got[-1] == got[-2] == got[-3] == Counter(re.findall("[^ \t.,;:!?\n\x0b\x0c\r]+", data.tobytes().decode()))
    table = spark.createDataFrame(texts * 2, "text string, lang string")
    found = {tuple(r) for r in collocations.collocations(table, least=5).collect()}
    assert found == phrases_by_hand(texts * 2, 3, 5, 50, 2000)


def test_cut_pieces_keep_their_phrases(spark):
    """A text of one piece that is cut into blocks: phrases across the cuts count once."""
    text = " ".join(f"w{i % 7} v{i % 5}" for i in range(2000))
    data = np.frombuffer(text.encode(), np.uint8)
    f = Counter()
    for a, own, c in collocations.windows(data, 2, 256):
        r = collocations.block(data[a:c], np.zeros(1, np.int64), own - a, ["x"], 0)
        codes, n = np.frombuffer(r[4], np.int32), len(np.frombuffer(r[4], np.int32))
        f.update(tuple(r[2][codes[i + t]] for t in range(3)) for i in range(min(n - r[6], n - 2)))
    w = text.split()
    assert f == Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))


def test_a_salt_changes_each_words_hash(spark, docs):
    one = collocations.words_of(collocations.occurrences(docs, "text", "lang", 3, 0))
    assert one.groupBy("i0").count().where("count > 1").isEmpty()
    made = [collocations.block(np.frombuffer(b"a b cd d", np.uint8), np.zeros(1, np.int64), 8, ["x"], salt) for salt in (0, 1)]
    of = [dict(zip(r[2], r[0].tolist(), strict=True)) for r in made]
    assert all(of[0][w] != of[1][w] for w in ("a", "b", "cd", "d"))


def test_no_phrases(spark, none):
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(spark.createDataFrame([("a b c", "x"), (None, None), ("", "x")], "text string, lang string")).collect() == []


def clusters_by_hand(rows, size, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in drawn[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        new = []
        for j, m in enumerate(c):
            own = [v for (_, v), at in zip(kept, mine, strict=True) if at == j]
            new.append([sum(x) // len(own) for x in zip(*own, strict=True)] if own else m)
        c = new
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, j, d in out:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out)


def test_clusters_by_hand(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=4) + i % 3).astype(np.float32).astype(float).tolist()) for i in range(200)]
    rows += [rows[3]] * 60 + [(300, [0.5] * 3), (301, None), (302, [0.1, None, 0.2, 0.3]), (303, [float("nan")] * 4), (304, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.25, -0.25, 0.0, 1.0]), (305, []), (306, [-0.001] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "'x' AS cluster").repartition(5)
    for k, rounds in ((7, 5), (300, 2), (1, 1), (5, 0)):
        got = Counter(tuple(x) for x in clusters.clustered(table, size=4, k=k, rounds=rounds).collect())
        assert got == clusters_by_hand(rows, 4, k, rounds)
    far = spark.createDataFrame([(1, [1e30, -1e30]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert {x.distance for x in clusters.clustered(far, size=2, k=2, rounds=1).collect()} == {0}
    assert clusters.clustered(table.limit(0), size=4).collect() == []
    assert clusters.clustered(table.where("vec_id IS NULL"), size=4).collect() == []


def test_nearest_takes_the_smaller_number(spark):
    one = spark.createDataFrame([([0, 0],), ([4, 0],)], "v array<bigint>")
    assert [r[0] for r in one.select(clusters.nearest([[2, 0], [2, 0], [0, 0]])["cluster"]).collect()] == [2, 0]


def test_statistics_by_hand(spark, docs, rows):
    kept = {tuple(r) for r in discriminant.counts(docs, ["doc_id"], "text").select("doc_id", "n_words", "n_chars", "n_symbols", "n_capitals", "n_lines", "n_distinct", "n_repeats").collect()}
    want = set()
    for r in rows:
        t = r[1] or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        want.add((r[0], len(w), sum(map(len, w)), sum(t.count(c) for c in "#$%&*<>="), len(re.findall("[A-Z]", t)), 1 + t.count("\n"), len(set(w)), sum(x == y for x, y in zip(w, w[1:], strict=False))))
    assert kept == want


def test_scores_are_those_of_two_normal_densities(spark):
    r = np.random.default_rng(1)
    d = len(discriminant.STATISTICS)
    x = np.concatenate([r.normal(size=(300, d)), 1 + r.normal(size=(120, d)) * r.uniform(0.5, 2, d)])
    q = np.floor(x * discriminant.GRID).astype(int)
    good = [True] * 300 + [False] * 120
    rows = spark.createDataFrame([(*map(int, v), g) for v, g in zip(q, good, strict=True)], ", ".join(f"x{i} long" for i in range(d)) + ", good boolean")
    got = np.array([r[0] for r in rows.select(discriminant.score(discriminant.learned(rows, 0.3, 0.05))).collect()])
    x, good = q / discriminant.GRID, np.array(good)
    scatter = {c: np.cov(x[good == c].T) * (np.count_nonzero(good == c) - 1) for c in (True, False)}
    pooled = sum(scatter.values()) / (len(x) - 2)
    log = {}
    for c in (True, False):
        n = np.count_nonzero(good == c)
        cov = 0.95 * (0.7 * scatter[c] / (n - 1) + 0.3 * pooled) + 0.05 * np.diag(np.diag(pooled) + 1 / discriminant.GRID)
        off = x - x[good == c].mean(0)
        log[c] = math.log(n / len(x)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ni,ij,nj->n", off, np.linalg.inv(cov), off)
    assert np.abs(got - 1 / (1 + np.exp(np.clip(log[False] - log[True], -700, 700)))).max() < 1e-6


def test_scores_of_odd_rows(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60)] + [(1, 0, 0), (3, None, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = discriminant.classified(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    unlabelled = discriminant.classified(docs, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}
    assert discriminant.classified(none, labels).collect() == []


@needs_data
def test_held_out_documents_are_judged_right(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    seen = discriminant.classified(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert len(seen) > 50 and sum(r.predicted == r.quality for r in seen) >= 0.97 * len(seen)
