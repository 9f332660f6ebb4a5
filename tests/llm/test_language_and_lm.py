import fractions
import functools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from trestle.llm.langid import START, UNKNOWN, expected, held_out, learn, predict, rolling, text_words, vocabulary, word_scores
from trestle.llm.lm import scored

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def model():
    v = vocabulary(PATH)
    p = np.vstack([np.random.default_rng(1).dirichlet(np.ones(v.size), 2).T, np.zeros(2)])
    at = dict(zip((int(c) for c in v.codes), range(v.size), strict=True))
    code = lambda s: int(rolling(np.frombuffer(s.encode("utf-32-le"), "<u4")[None])[0, -1])
    return v, p, lambda s: at.get(code(s))


#: Short words; pieces of more than ten letters; sixty letters; runs of a script without spaces.
WORDS = ["the", "straße", "zq", "internationalization", "responsibilities", "the" * 20, "straßenbahn" * 6, "q" * 75, "日本語文字" * 20]


def chance(model, p, s, k):
    """By recursion over the first piece: all segmentations, unlimited pieces."""
    piece = model[2]

    @functools.lru_cache(None)
    def total(s):
        if not s:
            return fractions.Fraction(1)
        found = fractions.Fraction(0)
        for n in range(1, len(s) + 1):
            i = piece(s[:n])
            q = max(p[i, k] if i is not None else 0, UNKNOWN if n == 1 else 0)
            if q:
                found += fractions.Fraction(float(q)) * total(s[n:])
        return found

    found = total(START + s)
    return math.log(found.numerator) - math.log(found.denominator)


def test_forward_sums_all_segmentations(model):
    v, p, piece = model
    assert v.longest > 15 and piece(max(v.pieces, key=len)) is not None
    got = word_scores(v, p, WORDS)
    for w, row in zip(WORDS, got.tolist(), strict=True):
        assert row == pytest.approx([chance(model, p, w, k) for k in (0, 1)], rel=1e-9)
    assert word_scores(v, p, ["a" * 400_000]).shape == (1, 2)


@pytest.mark.parametrize("word", ["straße", "internationalization", "the" * 20])
def test_expectations(model, word):
    """The expected count of a piece is the derivative of the logarithm of the word's chance by the piece's, times the latter."""
    v, p, piece = model
    p = p[:, [0]].copy()
    got = expected(v, p, [word], np.array([2.0]))
    s = START + word
    for n in (1, 2, 3, 5):
        i = piece(s[1 : 1 + n])
        if i is not None:
            more = p.copy()
            more[i] *= 1.0001
            slope = (word_scores(v, more, [word]) - word_scores(v, p, [word]))[0, 0] / math.log(1.0001)
            assert got[i] == pytest.approx(2 * slope, rel=1e-3, abs=1e-7)
    # Every letter, and the mark, is in one piece of each segmentation, or unknown.
    names = dict((piece(x), x) for x in v.pieces)
    assert sum(got[i] * len(names[i]) for i in np.flatnonzero(got)) <= 2 * len(s) + 1e-6


def test_a_long_run_of_letters(spark):
    rows = [(i, "the road and the width of the lane " * 5, "en") for i in range(8)] + [(10 + i, "la route et la largeur de la voie " * 5, "fr") for i in range(8)]
    rows += [(30, "theroadandthewidthofthelane" * 20_000, None), (31, "larouteetlalargeurdelavoie" * 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.row.doc_id: r.lang_pred for r in predict(docs, learn(docs, PATH), ["doc_id"]).collect()}
    assert got[30] == "en" and got[31] == "fr"


def test_words():
    assert text_words("Éa b2c x²\n'd' 12") == ["éa", "b", "c", "x", "d"]
    assert text_words("12 ² --") == text_words(None) == text_words("") == []
    assert text_words("a" * 100) == ["a" * 100]


def test_predictions(spark, docs, rows):
    model = learn(docs, PATH, sample=1000)
    assert model.langs == ["en", "fr"]
    got = predict(docs, model, ["doc_id", "lang", "text"]).withColumn("h", held_out("row.doc_id")).collect()
    assert len(got) == len(rows)
    for r in got:
        if not any(c.isalpha() for c in r.row.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1
        assert r.h == (r.row.doc_id is not None and zlib.crc32(str(r.row.doc_id).encode()) % 4 == 2)
    sure = [r for r in got if r.h and r.row.lang and len(r.row.text or "") > 100 and r.row.text[0] not in "x日"]
    assert sum(r.lang_pred == r.row.lang for r in sure) >= 0.9 * len(sure)


def test_nothing_to_learn_from(none, docs):
    empty = learn(none, PATH)
    assert empty.langs == [] and {r.lang_pred for r in predict(docs, empty, ["doc_id"]).collect()} == {"und"}
    assert predict(none, empty, ["doc_id"]).count() == 0


@pytest.mark.parametrize("order,hot", [(1, 5), (2, 5), (2, 1 << 18), (3, 20), (4, 0)])
def test_backoff_scores(docs, rows, order, hot):
    lower = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
    split = lambda t: [lower(w) for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w]
    counts = defaultdict(int)
    for r in rows:
        w = split(r[1])
        for n in range(1, order + 1):
            for i in range(len(w) - n + 1):
                counts[tuple(w[i : i + n])] += 1
    total = sum(c for k, c in counts.items() if len(k) == 1)

    def score(g):
        if len(g) == 1:
            return counts[g] / total
        return counts[g] / counts[g[:-1]] if counts[g] >= 2 else 0.4 * score(g[1:])

    want = Counter()
    for r in rows:
        w = split(r[1])
        s = [math.log10(score(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w))]
        want[r[0], len(w), round(sum(s) / len(s), 6) if s else None] += 1
    got = Counter((r.doc_id, r.n_words, None if r.score is None else round(r.score, 6)) for r in scored(docs, order=order, hot=hot).collect())
    assert got == want


def test_hashes_are_sparks(spark):
    from trestle.llm.lm import joined_hash

    r = np.random.default_rng(2)
    a, b = (r.integers(-(2**63), 2**63 - 1, 200, np.int64) for _ in range(2))
    rows = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long").selectExpr("a", "b", "xxhash64(a, b) AS h").collect()
    want = {(x, y): h for x, y, h in zip(a.tolist(), b.tolist(), joined_hash(a.view(np.uint64), b.view(np.uint64)).view(np.int64).tolist())}
    assert {(r.a, r.b): r.h for r in rows} == want


def test_hot_and_long_texts(spark):
    """A third of all rows are one text, one text has a million words, one word is in nearly every text."""
    texts = ["the same text of the"] * 200 + [f"the w{i} the" for i in range(399)] + ["the long " * 500_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.score) for r in scored(docs, hot=10).collect()}
    assert len(got) == 600 and got[599][0] == 1_000_000 and len({got[i] for i in range(200)}) == 1
    assert -0.1 < got[599][1] < 0


def test_trigrams_are_registered(spark, tmp_path):
    """The query of order 3 tells apart what that of order 2 can't: words that follow two others."""
    from trestle.llm.queries import QUERIES

    texts = ["a b c", "a b c", "x b d", "x b d", "a b d"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    two, three = ({r.doc_id: r.score for r in QUERIES[q](spark, str(tmp_path)).collect()} for q in ("op5_lm_scores", "op5_trigram_scores"))
    one = math.log10(3 / 15)  # a
    assert two[4] == pytest.approx((one + 0 + math.log10(3 / 5)) / 3, abs=1e-6)
    assert three[4] == pytest.approx((one + 0 + math.log10(0.4 * 3 / 5)) / 3, abs=1e-6)
    assert three[0] == pytest.approx((one + 0 + math.log10(2 / 3)) / 3, abs=1e-6)


@pytest.mark.parametrize("least", [1, 3])
def test_full_bitmaps_and_rarer_words(spark, monkeypatch, least):
    """Bitmaps that let everything through change nothing; n-grams count from one time on, or from three."""
    from trestle.llm import lm

    texts = ["a b c a b c a b", "c a b c", "a d", "e f g", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = Counter(tuple(w[i : i + n]) for t in texts if (w := (t or "").split()) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(c for k, c in counts.items() if len(k) == 1)
    score = lambda g: counts[g] / total if len(g) == 1 else counts[g] / counts[g[:-1]] if counts[g] >= least else 0.4 * score(g[1:])
    want = {i: round(sum(math.log10(score(tuple(w[max(0, j - 2) : j + 1]))) for j in range(len(w))) / len(w), 6) for i, t in enumerate(texts) if (w := (t or "").split())}
    for full in (False, True):
        if full:
            monkeypatch.setattr(lm, "bitmap", lambda table: np.full(lm.BITS // 8, 255, np.uint8))
        got = {r.doc_id: round(r.score, 6) for r in scored(docs, least=least, hot=0).where("score IS NOT NULL").collect()}
        assert got == want


def test_no_scores(none):
    assert scored(none).count() == 0
