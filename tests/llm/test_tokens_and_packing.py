import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trestle.llm.packing import Ids, Sums, packed, packed_documents, plan
from trestle.llm.tokens import Merger, token_counts

PATH, TIKTOKEN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_are_the_librarys(docs, rows, library):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH, limit=100).collect())
    want = Counter()
    for r in rows:
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        want[r[0], len((r[1] or "").encode()), n, n > 100] += 1
    assert got == want


def test_merging_of_runs_and_long_words(library):
    texts = ["a" * 4001, "ab" * 900 + "!" * 77, "  \n\n x", "'s't're 1234567", "", None]
    assert Merger(PATH).text_counts(texts) == [len(library.encode(t or "").ids) for t in texts]


def test_cache_overflow_changes_nothing(library):
    m = Merger(PATH, kept=3)
    texts = ["one two three four", "five six seven", "one nine"]
    assert m.text_counts(texts[:1]) + m.text_counts(texts[1:]) == [len(library.encode(t).ids) for t in texts]


def test_no_rows(none):
    assert token_counts(none, PATH).count() == 0
    assert packed_documents(none, TIKTOKEN).count() == 0


def test_packing(docs, rows, library):
    got = packed_documents(docs, TIKTOKEN, capacity=64).collect()
    want = Counter()
    for r in rows:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        cut = [0, *range(len(ids) % 64 or 64, len(ids), 64), len(ids)]
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            want[r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.05 * -(-sum(r.length for r in got) // 64) + 1


def test_plan_places_every_piece():
    rng = np.random.default_rng(3)
    for capacity in (8, 33, 100):
        for size in (0, 1, 5, 300):
            counts = np.bincount(rng.integers(1, capacity + 1, size), minlength=capacity + 1)
            used = Counter()
            for lengths, times in plan(counts, capacity):
                assert sum(lengths) <= capacity and times > 0
                for x in lengths:
                    used[x] += times
            assert used == Counter({x: n for x, n in enumerate(counts.tolist()) if n})


def test_sums_are_exact():
    left = np.bincount([3, 3, 4, 2, 1, 1, 9], minlength=11)
    sums = Sums(left)
    assert sums.pair(9, 6) == (3, 3) and sums.pair(9, 7) == (4, 3) and sums.pair(9, 8) is None
    assert sums.triple(9, 8) == (3, 3, 2) and sums.triple(9, 10) == (4, 3, 3) and sums.triple(9, 20) is None
    left[3] = 1  # the available pieces only become fewer
    assert sums.pair(9, 6) == (4, 2) and sums.triple(9, 8) == (4, 3, 1)
    # each long piece with its kind of complement leaves no gap
    assert sorted(sum(p) for p, _ in plan(np.bincount([7, 3, 6, 2, 2, 5, 2, 2, 1], minlength=11), 10)) == [10, 10, 10]


def test_few_sequences_with_pairs_and_triples(library):
    """On the documents of a table: at most 2 sequences above what all tokens need, many of them filled exactly by two and three pieces beside the longest."""
    import pyarrow.parquet as pq

    ids = Ids(TIKTOKEN)
    counts = np.zeros(1025, np.int64)
    for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist():
        n = len(ids.of(t)) // 4 + 1
        counts[1024] += n // 1024
        counts[n % 1024] += n % 1024 > 0
    made = plan(counts, 1024)
    least = -(-int((counts * np.arange(1025)).sum()) // 1024)
    assert sum(n for _, n in made) <= least + 2
    filled = Counter()
    for p, n in made:
        filled[len(p)] += n * (sum(p) == 1024)
    assert filled[2] > 100 and filled[3] > 20 and filled[4] > 5
    # Larger tables have finer histograms: the same plan's share of waste doesn't grow.
    assert sum(n for _, n in plan(counts * 5000, 1024)) <= 5000 * sum(n for _, n in made)


def test_ids_are_the_librarys(library):
    import random

    r = random.Random(5)
    some = [" ", "  ", "\n", "a", "é", "1", "½", "Ⅷ", "'s", "'", ".", "<|endoftext|>", "\x1c", "\x85", "\u3000", "日", "🙂", "_", "\r\n", "\xa0", " " * 6000, "\n " * 3000, "aab", "aba"]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 20))) for _ in range(500)] + [None, ""]
    ids = Ids(TIKTOKEN)
    for t in texts:
        assert ids.of(t) == np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" + "\n " * 1_000_000 + "b", "x" * 1_000_000])
def test_very_long_runs(spark, library, text):
    n = len(library.encode(text, add_special_tokens=False).ids)
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = packed_documents(docs, TIKTOKEN, capacity=1024).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == {1: n + 1, 2: 2}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()} == {1: n, 2: 1}


def test_hot_length(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(5000).selectExpr("id", "IF(id % 3 = 0, 7L, id % 16 + 1) AS length").write.parquet(path)
    got = packed(spark.read.parquet(path), ["id"], 16).groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in got) <= 16 and sum(r[1] for r in got) == sum(7 if i % 3 == 0 else i % 16 + 1 for i in range(5000))
