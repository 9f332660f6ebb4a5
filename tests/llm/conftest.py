import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, row string, node long, `_text` string, size int"


def sample(seed=1, n=60):
    """Documents with copies, near copies, shared lines, empty and null texts, a long text, odd characters, null ids and clashing columns."""
    r = random.Random(seed)
    words = {"en": "the and of road width lane is near with this".split(), "fr": "le la des étroit voie est près avec être où".split()}
    made = lambda lang, k: " ".join(r.choice(words[lang]) + r.choice(["", "a", "ing", "s."]) for _ in range(k))
    texts = []
    for i in range(n):
        lang = r.choice(["en", "fr"])
        texts.append((made(lang, r.randint(1, 120)), lang))
    base = made("en", 100)
    for k in range(6):
        w = base.split()
        w[10 * k + 3] = f"other{k}"
        texts.append((" ".join(w), "en"))
    texts += [(base, "en")] * 3 + [("All rights reserved.\n" + made("en", 20) + "\n  ALL RIGHTS RESERVED. ", "en") for _ in range(12)]
    texts += [(None, "en"), ("", None), (" \t\n \x0b", "fr"), ("aaaa " * 3000, "en"), ("x" * 5000, None), ("日本語 🙂 <|endoftext|> é b", "fr"), ("12 34 ---", "en"), ("Only Caps AND caps\x1cx", "en"), ("one\r\none\n\none", "en")]
    rows = [(i, t, k, f"s{i % 3}" if i % 7 else None, len(t or ""), "x", i, "clash", 3) for i, (t, k) in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, "en", "s1", 3, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return sample()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DDL)
