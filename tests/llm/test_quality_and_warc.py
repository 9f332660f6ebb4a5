import base64
import gzip
import hashlib
import io
import zlib
from collections import Counter
from math import comb, lgamma

import numpy as np
import pytest
from pyspark.sql import functions as F

from trestle.llm.quality import at_most, cutoffs, features, judged
from trestle.llm.warc import BadRecord, digest, read_archives, record, records, round_trip, write_archives

WS = " \t\n\x0b\x0c\r"


def words(t):
    return [w for w in "".join(" " if c in WS else c for c in t or "").split(" ") if w]


def counts(t):
    t = t or ""
    w, lines = words(t), [x for x in t.split("\n") if words(x)]
    threes = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if threes[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_base_counts(docs, rows, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in judged(docs, labels).collect())
    want = Counter()
    for r in rows:
        c = counts(r[1])
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want[(r[0], *c, failed, not failed)] += 1  # without labels nothing but the base rejects
    assert got == want


def test_binomial_tail(spark):
    cases = [(0, 10, 0.01), (3, 500, 0.02), (40, 9000, 0.005), (0, 1, 0.3), (2500, 600000, 0.005), (7, 7, 0.4)]
    for k, n, p in cases:
        got = spark.range(1).select(F.lit(float(k)).alias("_k"), F.lit(float(n)).alias("_n")).select(at_most(F.col("_k"), F.col("_n"), p)).first()[0]
        if n <= 9000:
            exact = float(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) if k < n * p else 1.0
            assert got == pytest.approx(exact, rel=1e-8)
        assert 0 <= got <= 1


@pytest.mark.parametrize("k, n, p", [(2500, 600_000, 0.005), (799_000, 40_000_000, 0.02), (795_000, 40_000_000, 0.02), (19_999_999, 10**9, 0.02)])
def test_binomial_tail_of_large_strata(spark, k, n, p):
    """Against the sum of all terms: no number of them is a bound."""
    i = np.arange(k, dtype=float)
    terms = 1 + np.cumprod((k - i) * (1 - p) / ((n - k + i + 1) * p)).sum()
    exact = terms * np.exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * np.log(p) + (n - k) * np.log1p(-p))
    got = spark.range(1).select(F.lit(float(k)).alias("_k"), F.lit(float(n)).alias("_n")).select(at_most(F.col("_k"), F.col("_n"), p)).first()[0]
    assert got == pytest.approx(exact, rel=1e-4)


def test_very_long_text(spark):
    """A million words in one text are counted as a loop counts them."""
    text = "\n".join(" ".join(f"w{(i * 31 + j) % 5000}" for j in range(100)) for i in range(10_000))
    docs = spark.createDataFrame([(1, text, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    r = features(docs, "doc_id", "text", "lang").first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text)


def test_cutoffs_keep_their_promise(spark):
    text = lambda i, bad: " ".join(f"word{(i * 7 + k) % 97}x{k}" + ("|" if bad and k % 2 else "") for k in range(60))
    rows = [(i, text(i, i % 10 == 0), "en" if i % 2 else None) for i in range(4000)] + [(9000 + i, text(i, True), "few") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1) for i in range(0, 4000)] + [(9000, 0), (None, 1), (5, None)], "doc_id long, quality int")
    f = features(docs, "doc_id", "text", "lang").cache()
    cuts = {r.stratum: r for r in cutoffs(f, labels, "doc_id", "quality", 0.02, 0.05).collect()}
    assert cuts[None].cut and cuts[None].k == 0 and cuts[None].hits == 400 and cuts["few"].cut is None and cuts["few"].n == 0
    got = {r.doc_id: r.kept for r in judged(docs, labels).collect()}
    assert all(got[i] for i in range(4000) if i % 10)
    assert not any(got[i] for i in range(0, 4000, 20)) and all(got[9000 + i] for i in range(20))


def test_few_labels_suffice_and_ties_are_settled(spark):
    """Two hundred good documents are enough at alpha 0.02 where nothing good is rejected; of thresholds that reject alike the loosest is used."""
    rows = [(i, "a" if i < 250 else "b", 100, 40 if i % 25 == 0 else 0, 0, 0, 0, 10, 100, False) for i in range(300)]
    f = spark.createDataFrame(rows, "id long, stratum string, word_chars long, n_symbols long, n_capitals long, n_dup_lines long, n_repeat_words long, n_lines long, n_words long, base_failed boolean")
    labels = spark.createDataFrame([(i, 0 if i % 25 == 0 else 1) for i in range(300)], "doc_id long, quality int")
    got = {r.stratum: r for r in cutoffs(f, labels, "doc_id", "quality", 0.02, 0.05).collect()}
    assert (got["a"].n, got["a"].k, got["a"].hits) == (240, 0, 10) and got["b"].cut is None
    # 40 symbols of 100 characters are beyond all cutoffs but 40: level 11 of the first rule.
    assert got["a"].cut == 4 * 11 and got["a"].p == pytest.approx(0.98**240)


def test_simulated_risk(spark):
    """Where thresholds in truth reject more good documents than alpha, they are certified in at most the promised share of trials."""
    import numpy as np

    rng = np.random.default_rng(4)
    trials, n = 300, 400
    bad = rng.random((trials, n)) < 0.055  # alpha is 0.05
    rows = [(t * n + i, str(t), 100, 100 if b else 0, 0, 0, 0, 10, 100, False) for t in range(trials) for i, b in enumerate(bad[t].tolist())]
    rows += [(10**6 + t * 100 + i, str(t), 100, 100, 0, 0, 0, 10, 100, False) for t in range(trials) for i in range(60)]
    f = spark.createDataFrame(rows, "id long, stratum string, word_chars long, n_symbols long, n_capitals long, n_dup_lines long, n_repeat_words long, n_lines long, n_words long, base_failed boolean")
    labels = f.selectExpr("id AS doc_id", "IF(id < 1000000, 1, 0) AS quality")
    each = 0.1  # every trial's part of delta
    certified = cutoffs(f, labels, "doc_id", "quality", 0.05, each * trials).where("cut IS NOT NULL").count()
    assert certified <= each * trials


def test_no_documents(none, spark):
    assert judged(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


PAGES = "page_id long, url string, html string, `_text` int, digest string"


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    rows = [(i, f"http://h/{i}?a b\r\n", "<p>" + "é" * (i % 5) + "</p>", 1, "x") for i in range(40)]
    rows += [(50, None, "x" * 3_000_000, None, None), (51, "u", None, 1, None), (52, "u", "", 1, None), (53, "u", "\r\n\r\nWARC/1.1\r\n", 1, None), (None, None, "<p></p>", None, None), (53, "u", "other", 1, None), (39, "u", "<p>éééé</p>", 1, "x")]
    path = str(tmp_path_factory.mktemp("pages") / "t")
    spark.createDataFrame(rows, PAGES).write.parquet(path)
    return spark.read.parquet(path), rows


@pytest.mark.parametrize("least", [0, 8])
def test_round_trip(pages, least):
    table, rows = pages
    last = {}
    for r in rows:
        data = (r[2] or "").encode()
        if r[0] is not None and len(data) >= least:
            last[data] = max(r[0], last.get(data, r[0]))
    want = Counter()
    for r in rows:
        data = (r[2] or "").encode()
        again = r[0] is not None and last.get(data, r[0]) > r[0]
        want[r[0], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", last[data] if again else None] += 1
    assert Counter(tuple(r) for r in round_trip(table, least=least).collect()) == want


def test_archives_are_gzip_members(pages, tmp_path):
    table, rows = pages
    archives = write_archives(table, f"file://{tmp_path}/a").collect()
    assert sum(a.records for a in archives) == len(rows)
    for a in archives:
        with open(a.path.removeprefix("file://"), "rb") as f:
            raw = f.read()
        assert gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type: ") == a.records
        held = []
        assert len([*records(io.BytesIO(raw).read, held.append)]) == a.records
    spark = table.sparkSession
    assert read_archives(spark.createDataFrame([], "path string")).count() == 0


def test_no_pages(spark):
    assert round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_bad_archives():
    good = record("response", "n", "u", "d", b"payload", digest(b"payload"), {})
    assert [r["payload-bytes"] for r in records(io.BytesIO(good * 3).read)] == ["7"] * 3
    plain = gzip.decompress(good)
    for bad in (plain.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"), plain.replace(b"\r\n\r\npayload\r\n\r\n", b"\r\n\r\npay\r\n\r\n"), plain + b"x", plain[:9]):
        with pytest.raises(BadRecord):
            [*records(io.BytesIO(gzip.compress(bad)).read)]
    with pytest.raises(BadRecord):
        [*records(io.BytesIO(good[:-9]).read)]
    with pytest.raises(zlib.error):
        [*records(io.BytesIO(b"not gzip at all").read)]
