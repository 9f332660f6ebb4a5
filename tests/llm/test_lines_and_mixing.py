import hashlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from trestle.llm import mixing
from trestle.llm.linededup import LineRuns, drop_lines
from trestle.llm.mixing import mixed_documents, mixed_sizes, permuted, shard_draws, source_slots, source_targets, word_counts
from trestle.llm.shared import written

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def expected(rows, least, keep_first=False):
    held = defaultdict(list)
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")} - {""}:
            held[k].append(r[0])
    first = {k: min((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= least}
    out = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if key(x) not in first or (keep_first and r[0] is not None and first[key(x)] == r[0])]
        out[r[0], len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("broadcast,first", [(100, False), (0, False), (0, True), (100, True)])
def test_lines(docs, rows, broadcast, first):
    got = drop_lines(docs, carry=["doc_id", "row"], min_docs=4, broadcast_keys=broadcast, keep_first=first, batches=5)
    assert Counter((r.row.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.collect()) == expected(rows, 4, first)


def test_no_lines(none):
    assert drop_lines(none).count() == 0


def test_runs_compact_and_tell_what_is_new(spark):
    runs = LineRuns(spark)
    batch = lambda *ks: spark.createDataFrame([(k, -k, 1, k) for k in ks], runs.schema)
    assert runs.seen().count() == 0
    for ks in ((1, 2), (2, 3), (4,), (1, 5), (6,)):
        new = {r.h1 for r in runs.unseen(batch(*ks)).collect()}
        assert new == set(ks) - {r.h1 for r in runs.seen().collect()}
        runs.add(batch(*ks))
    assert [x is not None for x in runs.runs] == [True, False, True]
    # A key is in one run only; where it comes again it has a tally.
    held = [(r.h1, r.n) for run in runs.runs if run is not None for r in run.collect()]
    assert sorted(held) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1)]
    assert sorted((r.h1, r.n) for t in runs.tallies if t is not None for r in t.collect()) == [(1, 1), (2, 1)]
    assert {(r.h1, r.n) for r in runs.seen().collect()} == {(1, 2), (2, 2), (3, 1), (4, 1), (5, 1), (6, 1)}
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs_")]


def test_runs_are_never_shuffled(spark):
    runs = LineRuns(spark)
    batch = lambda a: spark.range(a, a + 500).selectExpr("id AS h1", "-id AS h2", "1L AS n", "id AS first")
    for a in (0, 400, 100):
        runs.add(batch(a))
    plan = runs.unseen(batch(900))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftAnti") == 2 and plan.count("Exchange") == 1  # the batch's own
    assert "Exchange" not in runs.seen()._jdf.queryExecution().executedPlan().toString()
    assert runs.seen().agg({"n": "sum"}).first()[0] == 1500
    runs.close()


def test_line_of_millions_and_many_lines(spark):
    long, many = "x" * 3_000_000, "\n".join(f"line {i % 1000}" for i in range(300_000))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([long, long + "\nown", many, many, "\n" * 1_000_000])], "doc_id long, text string")
    got = {r.row.doc_id: (r.n_lines, r.n_dropped, len(r.kept)) for r in drop_lines(docs, min_docs=2).collect()}
    assert got == {0: (1, 1, 0), 1: (2, 1, 3), 2: (300_000, 300_000, 0), 3: (300_000, 300_000, 0), 4: (1_000_001, 0, 1_000_000)}


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def words(t):
    return [w for w in "".join(c if c not in WS else " " for c in t or "").split(" ") if w]


def test_mix(docs, rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = targets(sizes)
    got = mixed_sizes(docs, block=8, shard=64).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for r in mixed_sizes(docs, id="node", block=8, shard=64).join(docs.select("node", "source").where("node IS NOT NULL").distinct(), "node").collect():
        taken[r.source] += r.taken
    for s, t in want.items():
        if s != "s1":  # whose rows without an id aren't joined here
            assert abs(taken[s] - t) <= 8 * 6 + 0.02 * t
    again = mixed_sizes(docs, block=8, shard=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed_sizes(docs, block=8, shard=64).collect()))


def test_mixed_texts_are_what_was_taken(docs):
    made, plain = mixed_documents(docs, block=8, shard=64).collect(), mixed_sizes(docs, block=8, shard=64).collect()
    n, m = Counter(), Counter()
    for r in made:
        n[r.doc_id] += len(words(r.text))
    for r in plain:
        m[r.doc_id] += r.taken
    assert n == Counter({k: v for k, v in m.items() if v})


def test_draws():
    """Whole shards, drawn: each is as full as it should be, together they are the quotas, alone they spread as draws do."""
    counts = np.array([30_000, 9_000, 1, 60_000])
    made = list(shard_draws(counts, 512, 7, 0, 10**9))
    assert [k for k, _, _ in made] == list(range(-(-int(counts.sum()) // 512)))
    assert all(n.sum() == 512 for _, _, n in made[:-1]) and (sum(n for _, _, n in made) == counts).all()
    before = np.zeros(4, np.int64)
    for _, first, n in made:
        assert (first == before).all()
        before = before + n
    # Any shard by itself is the same.
    for low, high in ((0, 1), (17, 18), (100, 140)):
        assert [(k, n.tolist()) for k, _, n in shard_draws(counts, 512, 7, low, high)] == [(k, n.tolist()) for k, _, n in made[low:high]]
    share = counts / counts.sum()
    spread = np.array([n for _, _, n in made[:-1]], float).std(0)
    assert spread[[0, 1, 3]] == pytest.approx(np.sqrt(512 * share * (1 - share))[[0, 1, 3]], rel=0.2)
    # More slots than numpy draws among.
    many = np.array([7 * 10**11, 3 * 10**11 + 5, 11])
    k, first, n = next(shard_draws(many, 8192, 7, 10**7, 10**7 + 1))
    assert n.sum() == 8192 and (first <= many).all() and abs(n[0] / 8192 - 0.7) < 0.05


@pytest.mark.parametrize("good, bad, most", [(30, 50, 20), (50, 30, 20), (6, 3, 8), (1, 40, 30), (5, 0, 3), (0, 5, 3), (5, 4, 9), (5, 4, 0)])
def test_draws_beyond_the_bound(monkeypatch, good, bad, most):
    """With the bound at nothing every draw is made the other way: it has the hypergeometric chances."""
    monkeypatch.setattr(mixing, "DRAW", -1)
    chance = np.random.default_rng(5)
    got = Counter(mixing.drawn(good, bad, most, chance) for _ in range(4000))
    for k in range(most + 1):
        want = comb(good, k) * comb(bad, most - k) / comb(good + bad, most)
        assert abs(got[k] / 4000 - want) < 5 * (want * (1 - want) / 4000) ** 0.5 + 1e-9
    counts = np.array([good, bad, 7])
    half = [mixing.halved(counts, most, chance) for _ in range(50)]
    assert all(h.sum() == most and (h >= 0).all() and (h <= counts).all() for h in half)


def test_large_draws_spread():
    """A fifth of 10**12 slots: the mean and the spread of draws without putting back, not a rounded proportion."""
    good, bad, most = 3 * 10**11, 7 * 10**11, 2 * 10**11
    n = np.array([mixing.drawn(good, bad, most, np.random.default_rng(i)) for i in range(2000)], float) - 0.3 * most
    deviation = (most * 0.3 * 0.7 * 0.8) ** 0.5
    assert abs(n.mean()) < 5 * deviation / 2000**0.5 and n.std() == pytest.approx(deviation, rel=0.1)


def test_taken_is_what_the_slots_hold(spark, docs, rows):
    """By brute force over the written slots: the blocks of each source are those of its stream of words, and each pass permutes them."""
    base = word_counts(docs, "text", [F.col("source").alias("_source")])
    got = Counter()
    for r in mixed_sizes(docs, id="source", block=8, shard=64).collect():
        got[r.source] += r.taken
    of = written(source_targets(base))
    slots = source_slots(of, 8, 64, 7).collect()
    held = Counter((r.s, r.epoch, r.b) for r in slots)
    assert max(held.values()) == 1  # a permutation never gives a block twice
    for r in of.collect():
        blocks = -(-r.source_size // 8)
        mine = [(e, b) for s, e, b in held if s == r.s]
        assert len(mine) == round(r.target * blocks / r.source_size) if r.source_size else not mine
        assert {e for e, _ in mine} <= {0, 1} and sum(e == 0 for e, _ in mine) == min(len(mine), blocks)
        taken = sum(min(8, r.source_size - 8 * b) for _, b in mine)
        assert got[r._source] == taken


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "a b " * 1_000_000, "x"), (2, "c", "y"), (3, None, None)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.size, r.taken) for r in mixed_sizes(docs).collect()}
    assert got[1][0] == 2_000_000 and got[2] == (1, 2) and got[3] == (0, 0)
    assert abs(got[1][1] - (1.5 * 2_000_001 - 2)) <= 64


def test_no_mix(none):
    assert mixed_sizes(none).count() == 0 and mixed_documents(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 1000])
def test_permutations(n):
    assert sorted(permuted(np.arange(n), n, 5).tolist()) == list(range(n))
