from collections import Counter

import pytest

import corpus_pipeline as P
from trestle.llm.shared import written

from .conftest import sample
from .test_lines_and_mixing import expected, key, targets, words
from .test_pairs_and_prints import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = [r[:5] for r in sample(9)] + [(500 + i, t, "en", "s1", len(t)) for i, t in enumerate(["", "12 34", "\n\n"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_each_stage_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "mixing", "packing"]
    tables = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        tables.append(written(stage(spark, tables[-1], folder)))
        if k < 4:
            assert tables[-1].columns == docs.columns
    before, known, thin, single, mixed = ([tuple(r) for r in t.collect()] for t in tables[:5])
    # Documents without a letter go; here every other one is of a language that was learned.
    assert Counter(known) == Counter(r for r in before if any(c.isalpha() for c in r[1] or ""))
    # Frequent lines stay in their first document; what is left of nothing goes.
    want = Counter()
    frequent = {}
    for r in known:
        for x in {key(x) for x in r[1].split("\n")} - {""}:
            frequent.setdefault(x, []).append(r[0])
    first = {x: min((i for i in v if i is not None), default=None) for x, v in frequent.items() if len(v) >= 10}
    for r in known:
        stay = [x for x in r[1].split("\n") if key(x) not in first or first[key(x)] == r[0]]
        text = "\n".join(stay)
        if len(stay) == len(r[1].split("\n")) or text.strip(" "):
            want[(r[0], text, r[2], r[3], r[4] if text == r[1] else len(text))] += 1
    assert first and Counter(thin) == want and expected(thin, 10) is not None
    # Of each component the smallest id stays; rows without an id stay.
    component = {d: c for d, _, c in brute(thin, 5, 80)}
    assert Counter(single) == Counter(r for r in thin if r[0] is None or component[r[0]] == r[0])
    assert len(single) < len(thin)
    # No document more than twice, sources near their targets, only words of the documents.
    size, taken, of = Counter(), Counter(), {}
    for r in single:
        size[r[3]] += len(words(r[1]))
        of.setdefault(r[0], set()).update(words(r[1]))
    for r in mixed:
        taken[r[3]] += len(words(r[1]))
        assert set(words(r[1])) <= of[r[0]] and r[4] == len(r[1])
    twice = Counter(r[0] for r in single)
    assert all(n <= 2 * twice[d] for d, n in Counter(r[0] for r in mixed).items())
    for s, t in targets(size).items():
        assert abs(taken[s] - t) <= 64 * 3 + 0.05 * t
    # Every text's ids, in sequences without gaps.
    places = {}
    for r in tables[5].collect():
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and p[0][0] == 0 and sum(p[-1]) <= 1024
    assert Counter(r.piece == 0 for r in tables[5].collect())[True] == len(mixed)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
