"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed_sizes

    return mixed_sizes(table(spark, sf_dir, "documents"), block=64, shard=8192)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, learn, predict

    docs = table(spark, sf_dir, "documents")
    model = learn(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return predict(docs, model, ["doc_id"]).select("row.doc_id", "lang_pred", "score").withColumn("held_out", held_out("doc_id"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import drop_lines

    found = drop_lines(table(spark, sf_dir, "documents"), carry=["doc_id"], min_docs=10)
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=1024)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import linked

    return linked(table(spark, sf_dir, "documents"), words=4, percent=85)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), alpha=0.02, delta=0.05)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import scored

    return scored(table(spark, sf_dir, "documents"), order=2).withColumn("score", F.round("score", 6))


def op5_trigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import scored

    return scored(table(spark, sf_dir, "documents"), order=3).withColumn("score", F.round("score", 6))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"), least=0)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"), lambda id: F.col(id) % 50 == 0, radius=16)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .discriminant import classified

    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cutoff=0.3).withColumn("score", F.round("score", 6))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), longest=3, least=10, inside=50, top=2000)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clusters import clustered

    return clustered(table(spark, sf_dir, "embeddings"), size=64, k=40, rounds=5, scale=256, seed=2)


QUERIES = {f.__name__: f for f in (op1_token_counts, op3_source_mix, op4_language_id, op8_line_dedup, op9_best_fit_packing, op10_ngram_jaccard, op2_quality_rules, op7_fingerprints, op6_warc_round_trip, op5_lm_scores, op5_trigram_scores, op11_quality_classifier, op12_collocations, op13_centroid_clusters)}


def _quality_sql() -> str:
    """The rules and the exact test in SQL: the same cutoffs, the binomial tail summed up term by term."""
    from .quality import RULES

    level = lambda r: " + ".join(f"(100 * {RULES[r][0]} > {c} * {RULES[r][1]})::INT" for c in RULES[r][2])
    rank = "greatest(" + ", ".join(f"CASE WHEN ({level(r)}) > 0 THEN {len(RULES)} * ({level(r)}) - {i} ELSE 0 END" for i, r in enumerate(RULES)) + ")"
    top = len(RULES) * max(len(c) for _, _, c in RULES.values())
    p = 0.02
    return rf"""
        WITH split AS (
            SELECT doc_id, lang AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents),
        windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS three FROM split, unnest(range(1, len(w) - 1)) AS r(i)),
        twice AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, three) AS n FROM windows) WHERE n > 1),
        repeats AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM twice GROUP BY doc_id),
        counts AS (
            SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
                   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(string_split(t, chr(10)))::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
            FROM split LEFT JOIN repeats USING (doc_id)),
        f AS (SELECT *, {rank} AS rank, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
        labelled AS (SELECT stratum, good, rank FROM f JOIN (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
        tested AS (
            SELECT s.stratum, c.cut, s.n, count(*) FILTER (WHERE good = 1 AND rank >= cut) AS k, count(*) FILTER (WHERE good <> 1 AND rank >= cut) AS hits
            FROM (SELECT stratum, count(*) FILTER (WHERE good = 1) AS n FROM labelled GROUP BY 1) s JOIN labelled l ON l.stratum IS NOT DISTINCT FROM s.stratum, unnest(range(1, {top + 1})) AS c(cut) GROUP BY ALL),
        chances AS (
            SELECT t.*, (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({p}) + (n - i) * ln(1 - {p}))) FROM unnest(range(0, least(k, (n * {p})::BIGINT + 1) + 1)) AS r(i)) AS p
            FROM tested t),
        cuts AS (
            SELECT stratum, cut FROM chances WHERE n > 0 AND k < n * {p} AND p <= 0.05 * n / (SELECT count(*) FROM labelled WHERE good = 1) AND hits > k
            QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY hits - k DESC, cut DESC) = 1)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT coalesce(rank >= (SELECT c.cut FROM cuts c WHERE c.stratum IS NOT DISTINCT FROM f.stratum), false) AS kept FROM f"""


def _discriminant_sql(shrink: float = 0.3, diagonal: float = 0.05) -> str:
    """The statistics, their covariances by class, Cholesky's factors column by column, and each row's forward substitution."""
    from .discriminant import CHARS, GRID, STATISTICS

    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    # DuckDB's CAST rounds to even as floor() doesn't; numbers end in D in Spark only.
    shown = [x.replace("0.01D", "0.01::DOUBLE").replace("1D", "1::DOUBLE") for x in STATISTICS.values()]
    made = ", ".join(f"floor({GRID} * {x} + 0.5)::BIGINT AS x{i}" for i, x in enumerate(shown))
    chars = ", ".join(f"length(regexp_replace(t, '[^{c}]', '', 'g'))::BIGINT AS n_{name}" for name, c in CHARS.items())
    sums = ", ".join([f"sum(x{i}) AS s{i}" for i in range(d)] + [f"sum(x{i} * x{j})::HUGEINT AS s{i}_{j}" for i, j in pairs])
    scatter = ", ".join(f"((s{i}_{j} * n - s{i}::HUGEINT * s{j})::DOUBLE / n / {GRID**2}) AS c{i}_{j}" for i, j in pairs)
    means = ", ".join(f"s{i}::DOUBLE / n / {GRID} AS m{i}" for i in range(d))
    pooled = ", ".join(f"sum(c{i}_{j}) / (sum(n) - 2) AS p{i}_{j}" for i, j in pairs)
    mix = lambda i, j: f"{1 - diagonal} * ({1 - shrink} * c{i}_{j} / (n - 1) + {shrink} * p{i}_{j})"
    covs = ", ".join(mix(i, j) + (f" + {diagonal} * (p{i}_{i} + {1 / GRID})" if i == j else "") + f" AS v{i}_{j}" for i, j in pairs)
    steps, last = [], "cov"
    for j in range(d):
        inner = lambda i, j=j: "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
        steps += [f"f{j} AS (SELECT *, sqrt(v{j}_{j}{inner(j)}) AS l{j}_{j} FROM {last})"]
        below = ", ".join(f"(v{i}_{j}{inner(i)}) / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, d))
        steps += [f"g{j} AS (SELECT *{', ' + below if below else ''} FROM f{j})"]
        last = f"g{j}"
    z, of = [], "pairs"
    for i in range(d):
        z += [f"z{i}_ AS (SELECT *, (x{i}::DOUBLE / {GRID} - m{i}{''.join(f' - l{i}_{k} * z{k}' for k in range(i))}) / l{i}_{i} AS z{i} FROM {of})"]
        of = f"z{i}_"
    log_det = " + ".join(f"ln(l{i}_{i})" for i in range(d))
    squares = " + ".join(f"z{i} * z{i}" for i in range(d))
    return rf"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        counts AS (
            SELECT r, doc_id, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS n_chars, {chars}, (1 + length(regexp_replace(t, '[^\n]', '', 'g')))::BIGINT AS n_lines,
                   len(w)::BIGINT AS n_words, len(list_distinct(w))::BIGINT AS n_distinct, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_repeats FROM t),
        rows AS MATERIALIZED (SELECT r, doc_id, {made} FROM counts),
        said AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
        held AS (SELECT doc_id, good FROM said WHERE {_crc32_sql("doc_id::VARCHAR")} % 5 <> 0),
        sums AS (SELECT good, count(*) AS n, {sums} FROM rows JOIN held USING (doc_id) GROUP BY 1),
        scatter AS (SELECT good, n, {means}, {scatter} FROM sums), pooled AS (SELECT {pooled}, sum(n) AS total FROM scatter),
        cov AS (SELECT good, n, total, {", ".join(f"m{i}" for i in range(d))}, {covs} FROM scatter, pooled),
        {", ".join(steps)},
        model AS MATERIALIZED (SELECT *, ln(n / total) - ({log_det}) AS c FROM {last}), pairs AS (SELECT * FROM rows, model),
        {", ".join(z)},
        densities AS (SELECT r, doc_id, max(c - 0.5 * ({squares})) FILTER (WHERE good) AS one, max(c - 0.5 * ({squares})) FILTER (WHERE NOT good) AS zero FROM {of} GROUP BY 1, 2),
        scored AS (SELECT doc_id, round(1 / (1 + exp(least(700, greatest(-700, zero - one)))), 6) AS score FROM densities)
        SELECT doc_id, {_crc32_sql("doc_id::VARCHAR")} % 5 = 0 AS held_out, score, (score >= 0.3)::INT AS predicted FROM scored"""


def _crc32_sql(x: str) -> str:
    """The CRC-32 of an ASCII text, bit by bit."""
    step = "CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({x}, ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b < 0 THEN {step} ELSE xor(a, b) END), 4294967295)"


def _centroids_sql(rounds: int = 5, k: int = 40, size: int = 64, scale: int = 256, seed: int = 2) -> str:
    from .clusters import MOST

    out = [rf"""
        v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: greatest(-{MOST}, least({MOST}, floor({scale} * x::DOUBLE)))::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v AS m FROM v WHERE vec_id IS NOT NULL
            QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) <= {k})"""]
    for i in range(rounds + 1):
        out.append(f"""
        a{i} AS MATERIALIZED (SELECT r, min({{'d': list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c}}) AS b FROM v, c{i} GROUP BY r)""")
        if i < rounds:
            out.append(f"""
        s{i} AS (SELECT b.c AS c, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{i} JOIN v USING (r), unnest(range(1, {size + 1})) AS u(j) GROUP BY 1, 2),
        n{i} AS (SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY j) AS m FROM s{i} GROUP BY 1),
        c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN n{i} USING (c))""")
    return "WITH" + ",".join(out) + f"""
        SELECT vec_id, b.c::INT AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c = b.c"""


SQL: dict[str, str] = {
    "op11_quality_classifier": _discriminant_sql(),
    "op13_centroid_clusters": _centroids_sql(),
    "op12_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        o AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM w, unnest(range(1, len(w) + 1)) AS r(i)),
        f1 AS (SELECT lang, a, count(*) AS n FROM o GROUP BY ALL), total AS (SELECT lang, sum(n)::BIGINT AS n FROM f1 GROUP BY 1),
        f2 AS (SELECT lang, a, b, count(*) AS n FROM o WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        f3 AS (SELECT lang, a, b, c, count(*) AS n FROM o WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        most AS (SELECT lang, a, b, max(n) AS n FROM (SELECT lang, a, b, n FROM f3 UNION ALL SELECT lang, b, c, n FROM f3) GROUP BY ALL),
        cuts AS (
            SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.n AS a, l.n AS l, r.n AS r, 1 AS k
            FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.a = f2.a JOIN f1 r ON r.lang = f2.lang AND r.a = f2.b LEFT JOIN most ON most.lang = f2.lang AND most.a = f2.a AND most.b = f2.b
            WHERE most.n IS NULL OR 100 * most.n < 50 * f2.n
            UNION ALL SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.n, l.n, r.n, 1
            FROM f3 JOIN f1 l ON l.lang = f3.lang AND l.a = f3.a JOIN f2 r ON r.lang = f3.lang AND r.a = f3.b AND r.b = f3.c
            UNION ALL SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.n, l.n, r.n, 2
            FROM f3 JOIN f2 l ON l.lang = f3.lang AND l.a = f3.a AND l.b = f3.b JOIN f1 r ON r.lang = f3.lang AND r.a = f3.c),
        scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
        best AS (SELECT *, encode(phrase) AS bytes FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, bytes) AS rank, phrase, a, l, r, total.n AS n, score
        FROM best JOIN total ON total.lang = best.lang QUALIFY row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, bytes) <= 2000""",
    "op5_lm_scores": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        t AS (SELECT doc_id, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a FROM w, unnest(range(1, len(w) + 1)) AS r(i)),
        one AS (SELECT b, count(*) AS n FROM t GROUP BY 1), two AS (SELECT a, b, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY 1, 2),
        s AS (SELECT t.doc_id, CASE WHEN two.n >= 2 THEN log10(two.n / c.n) ELSE log10(o.n / (SELECT count(*) FROM t)) + CASE WHEN t.a IS NULL THEN 0 ELSE log10(0.4) END END AS s
              FROM t JOIN one o ON t.b = o.b LEFT JOIN one c ON t.a = c.b LEFT JOIN two ON t.a = two.a AND t.b = two.b)
        SELECT w.doc_id, count(s) AS n_words, round(avg(s), 6) AS score FROM w LEFT JOIN s USING (doc_id) GROUP BY 1""".replace("\\\\", "\\"),
    "op5_trigram_scores": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        t AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM w, unnest(range(1, len(w) + 1)) AS r(i)),
        one AS (SELECT c, count(*) AS n FROM t GROUP BY 1), two AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY 1, 2),
        three AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY 1, 2, 3),
        s AS (SELECT t.doc_id, CASE WHEN three.n >= 2 THEN log10(three.n / ab.n)
                                    WHEN bc.n >= 2 THEN log10(bc.n / ob.n) + CASE WHEN t.a IS NULL THEN 0 ELSE log10(0.4) END
                                    ELSE log10(oc.n / (SELECT count(*) FROM t)) + CASE WHEN t.b IS NULL THEN 0 WHEN t.a IS NULL THEN log10(0.4) ELSE 2 * log10(0.4) END END AS s
              FROM t JOIN one oc ON t.c = oc.c LEFT JOIN one ob ON t.b = ob.c LEFT JOIN two bc ON t.b = bc.b AND t.c = bc.c
                   LEFT JOIN two ab ON t.a = ab.b AND t.b = ab.c LEFT JOIN three ON t.a = three.a AND t.b = three.b AND t.c = three.c)
        SELECT w.doc_id, count(s) AS n_words, round(avg(s), 6) AS score FROM w LEFT JOIN s USING (doc_id) GROUP BY 1""",
    "op6_warc_round_trip": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
        last AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
        b32 AS (
            SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4)))::INT % 32 + 1, 1), '' ORDER BY i) AS d
            FROM last, unnest(range(0, 32)) AS r(i) GROUP BY h)
        SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < last THEN last END AS refers_to
        FROM p JOIN last USING (h) JOIN b32 USING (h)""",
    "op2_quality_rules": _quality_sql(),
    "op8_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
            FROM documents),
        keyed AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines),
        often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.k IS NOT NULL) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN often o ON keyed.k = o.k GROUP BY doc_id""".replace("\\", "\\"),
}
