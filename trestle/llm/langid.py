"""Language identification by segmentation-marginalised unigrams.

A word is a run of letters, in lower case, behind a mark of its start. Each language gives each piece of a fixed
public vocabulary a probability, and a word the sum over all its segmentations of the products of its pieces'
probabilities: a forward pass over the word's positions. The pieces' probabilities are
learned by expectation maximisation, from forward and backward passes over words of known language.

All pieces and all words count, however long. Words of usual length are taken together by their length; longer ones in windows of
positions, with the sums of as many positions before as the longest piece has characters, scaled as they go.
"""

from __future__ import annotations

import base64
import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, mixed, slices, written

START = "▁"
#: Letters of the words that are taken together by length: with so many, sums need no scaling.
SHORT = 30
#: Piece numbers that a window of longer words holds at once.
WINDOW = 400_000
#: A model has a column for each language, and each task holds it: so many at most.
LANGUAGES = 1000
#: The probability that every language gives a character that is no piece.
UNKNOWN = 1e-8

_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = 0x9E3779B97F4A7C15


def text_words(text: str | None) -> list[str]:
    """The words of a text; with none, it has no letter."""
    found = []
    for w in _LETTERS.findall((text or "").lower()):
        if not w.isalpha():  # letters only: numerals count as word characters, too
            w = "".join(filter(str.isalpha, w))
        if w:
            found.append(w)
    return found


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base))
    out[0] = 1
    return np.cumprod(out)


def rolling(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of rows of character codes: each the one before times the base, and the character's own."""
    n = codes.shape[1]
    out = np.zeros((codes.shape[0], n + 1), np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * powers(n, pow(_BASE, -1, 1 << 64))[1:], axis=1, out=out[:, 1:])
    return out * powers(n)


class Vocabulary:
    """The pieces of letters, with or without the mark of a word's start, among a byte-level vocabulary's tokens (.tiktoken)."""

    def __init__(self, path: str):
        found = set()
        with open(path, "rb") as f:
            for token, _ in map(bytes.split, f):
                try:
                    t = base64.b64decode(token).decode().lower()
                except UnicodeDecodeError:
                    continue
                t = START + t[1:] if t[:1] == " " else t
                if t and (t == START or t.removeprefix(START).isalpha()):
                    found.add(t)
        self.pieces = sorted(found | {START})
        self.longest = max(map(len, self.pieces))
        self.power = powers(self.longest)
        codes = np.array([int(rolling(np.frombuffer(p.encode("utf-32-le"), "<u4")[None])[0, -1]) for p in self.pieces], np.uint64)
        order = np.argsort(codes)
        self.codes, self.size = codes[order], len(codes)

    def index(self, code: np.ndarray) -> np.ndarray:
        """A piece's number; of what is no piece, the number of pieces."""
        at = np.minimum(np.searchsorted(self.codes, code), self.size - 1)
        return np.where(self.codes[at] == code, at, self.size)


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers of the words of each length, and their character codes with the mark of the start."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.frombuffer("".join(START + words[i] for i in at).encode("utf-32-le"), "<u4").reshape(len(at), n + 1)


def lattice(v: Vocabulary, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """The piece numbers of all substrings, by their start and end."""
    h, n = rolling(codes), codes.shape[1]
    return {(a, b): v.index(h[:, b] - h[:, a] * v.power[b - a]) for b in range(1, n + 1) for a in range(max(0, b - v.longest), b)}


def forward(p: np.ndarray, at: dict[tuple[int, int], np.ndarray], rows: int, n: int, longest: int) -> list[np.ndarray]:
    """For each position, the sum over all segmentations of what comes before it. p: of pieces by language."""
    f = [np.ones((rows, p.shape[1]))]
    for b in range(1, n + 1):
        total = np.zeros_like(f[0])
        for a in range(max(0, b - longest), b):
            q = p[at[a, b]]
            if a == b - 1:
                q = np.maximum(q, UNKNOWN)
            total += f[a] * q
        f.append(total)
    return f


def ending(v: Vocabulary, h: np.ndarray, low: int, high: int) -> np.ndarray:
    """The numbers of the pieces that end at positions low + 1 to high of each row, by position and length. h: prefix hashes."""
    b = np.arange(low + 1, high + 1)[:, None]
    a = b - np.arange(1, v.longest + 1)
    codes = h[:, b] - h[:, np.maximum(a, 0)] * v.power[1:]
    return np.where(a >= 0, v.index(codes), v.size)


def long_scores(v: Vocabulary, p: np.ndarray, words: list[str]) -> np.ndarray:
    """word_scores() of words of any length."""
    out = np.zeros((len(words), p.shape[1]))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    order = np.argsort(lengths)
    for some in np.split(order, np.flatnonzero(np.diff(np.log2(lengths[order]).astype(int))) + 1):
        for rows in np.array_split(some, -(-int(lengths[some].sum()) // 2_000_000)) if len(some) > 1 else [some]:
            n = int(lengths[rows].max())
            codes = np.frombuffer("".join((START + words[i]).ljust(n, "\0") for i in rows).encode("utf-32-le"), "<u4").reshape(len(rows), n)
            h = rolling(codes)
            before = np.zeros((len(rows), v.longest, p.shape[1]))  # the sums at the positions before, the nearest first, scaled
            before[:, 0] = 1
            scale = np.zeros((len(rows), p.shape[1]))
            width = max(1, WINDOW // (len(rows) * v.longest))
            for low in range(0, n, width):
                pieces = ending(v, h, low, min(n, low + width))
                for k in range(pieces.shape[1]):
                    q = p[pieces[:, k]]
                    np.maximum(q[:, 0], UNKNOWN, out=q[:, 0])
                    new = np.einsum("rjl,rjl->rl", before, q)
                    before[:, 1:] = before[:, :-1].copy()
                    before[:, 0] = new
                    b = low + k + 1
                    if b % 8 == 0 or b == n or (lengths[rows] == b).any():
                        scale += np.log(new)
                        before /= new[:, None]
                        done = np.flatnonzero(lengths[rows] == b)
                        out[rows[done]] = scale[done]
    return out


def word_scores(v: Vocabulary, p: np.ndarray, words: list[str]) -> np.ndarray:
    """The logarithm of each word's probability in each language."""
    out = np.zeros((len(words), p.shape[1]))
    long = [i for i, w in enumerate(words) if len(w) > SHORT]
    if long:
        out[long] = long_scores(v, p, [words[i] for i in long])
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        out[short] = word_scores(v, p, [words[i] for i in short])
        return out
    for rows, codes in by_length(words):
        out[rows] = np.log(forward(p, lattice(v, codes), *codes.shape, v.longest)[-1])
    return out


def expected(v: Vocabulary, p: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, over all their segmentations. p: one language's column."""
    out = np.zeros(v.size + 1)
    long = [i for i, w in enumerate(words) if len(w) > SHORT]
    for i in long:
        out += counts[i] * long_expected(v, p[:, 0], words[i])
    if long:
        short = np.array([i for i, w in enumerate(words) if len(w) <= SHORT], np.int64)
        return out[:-1] + expected(v, p, [words[i] for i in short], counts[short])
    for rows, codes in by_length(words):
        n = codes.shape[1]
        at = lattice(v, codes)
        f = forward(p, at, *codes.shape, v.longest)
        back = [None] * n + [np.ones((len(rows), 1))]
        for a in range(n - 1, -1, -1):
            back[a] = np.zeros((len(rows), 1))
            for b in range(a + 1, min(n, a + v.longest) + 1):
                q = p[at[a, b]]
                q = np.maximum(q, UNKNOWN) if b == a + 1 else q
                np.add.at(out, at[a, b], (counts[rows, None] * f[a] * q * back[b] / f[n])[:, 0])
                back[a] += q * back[b]
    return out[:-1]


def long_expected(v: Vocabulary, p: np.ndarray, word: str) -> np.ndarray:
    """expected() of one word of any length: forward and backward sums as logarithms."""
    codes = np.frombuffer((START + word).encode("utf-32-le"), "<u4")[None]
    n, h, width = codes.shape[1], rolling(codes), max(1, WINDOW // v.longest)
    spans = [(low, min(n, low + width)) for low in range(0, n, width)]

    def chances(low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        pieces = ending(v, h, low, high)[0]
        q = p[pieces]
        q[:, 0] = np.maximum(q[:, 0], UNKNOWN)
        return pieces, q

    ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = back[n] = 0
    for low, high in spans:
        _, q = chances(low, high)
        for k in range(high - low):
            b = low + k + 1
            m = min(b, v.longest)
            terms = ahead[b - m : b][::-1]
            top = terms.max()
            ahead[b] = top + np.log(np.exp(terms - top) @ q[k, :m])
    for low, high in reversed(spans):
        _, q = chances(low, high)
        for k in range(high - low - 1, -1, -1):
            b = low + k + 1
            m = min(b, v.longest)
            with np.errstate(divide="ignore"):
                terms = back[b] + np.log(q[k, :m])
            back[b - m : b] = np.logaddexp(back[b - m : b], terms[::-1])
    out = np.zeros(v.size + 1)
    for low, high in spans:
        pieces, q = chances(low, high)
        b = np.arange(low + 1, high + 1)[:, None]
        a = b - np.arange(1, v.longest + 1)
        share = np.where(a >= 0, np.exp(ahead[np.maximum(a, 0)] + back[b] - ahead[n]), 0) * q
        np.add.at(out, pieces, share)
    return out


class Model:
    """langs, and p: the pieces' probabilities by language, with a row of zeros at the end."""

    def __init__(self, path: str, langs: list[str], p: np.ndarray):
        self.path, self.langs, self.p = path, langs, p


def held_out(id: str) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 600, rounds: int = 3) -> Model:
    """Learns from text and lang of the rows that are not held out and have id, text and lang.

    sample: the bound of the documents read of each language, chosen by a hash of the id (that many are expected, where there are as many).
    The model has a column a language and a row a piece: neither grows with the documents.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(id)).select(F.col(id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    there = {r["_lang"]: r["count"] for r in known.groupBy("_lang").count().collect()}
    langs = sorted(there)
    if len(langs) > LANGUAGES:
        raise ValueError(f"{len(langs)} languages; a model has at most {LANGUAGES}")
    v = vocabulary(path)
    if not langs:
        return Model(path, [], np.zeros((v.size + 1, 0)))
    u = F.xxhash64("_id") / F.lit(2.0**64) + 0.5
    share = F.element_at(F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, sample / there[k])))), F.col("_lang"))
    words = known.where(u < share).mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(words)
    p = np.full((v.size + 1, len(langs)), 1.0 / v.size)
    p[-1] = 0
    for _ in range(rounds):
        told = spark.sparkContext.broadcast(p)

        def expect(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                of = np.array(b.column("lang").to_pylist(), object)
                n = b.column("n").to_numpy()
                w = np.array(b.column("word").to_pylist(), object)
                for k, name in enumerate(langs):
                    if (mine := np.flatnonzero(of == name)).size:
                        e = expected(vocabulary(path), told.value[:, [k]], w[mine].tolist(), n[mine].astype(float))
                        some = np.flatnonzero(e > 1e-12)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(e[some])], ["k", "piece", "e"])

        sums = words.mapInArrow(expect, "k int, piece int, e double").groupBy("k", "piece").agg(F.sum("e").alias("e")).collect()
        count = np.full((v.size, len(langs)), 0.01)
        for k, piece, e in sums:
            count[piece, k] += e
        p = np.vstack([count / count.sum(0), np.zeros(len(langs))])
    return Model(path, langs, p)


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(parts, "_text"):
        by: dict[str, Counter] = {}
        for t, k in zip(b.column("_text").to_pylist(), b.column("_lang").to_pylist(), strict=True):
            by.setdefault(k, Counter()).update(text_words(t))
        rows = [(k, w, n) for k, c in by.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])


def predict(docs: DataFrame, model: Model, carry: list[str], text: str = "text", kept: int = 150_000) -> DataFrame:
    """row (a struct of the columns in carry), lang_pred and score of each row's whole text.

    score: the language's share of the likelihood, all languages being as likely before. A text that is null or has
    no letter, or a model without languages, gives `und` and the score 0. kept: words whose scores a task remembers.
    """
    rows = bounded(docs).select(F.struct(*(F.col(c) for c in carry)).alias("row"), *(F.col(c).alias("_text") for c in [text] if c not in carry))
    told = docs.sparkSession.sparkContext.broadcast(model)

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        v, known, scores = vocabulary(m.path), {}, np.zeros((0, len(m.langs)))
        # A text that is carried along comes once.
        whole = parts if text not in carry else (pa.RecordBatch.from_arrays([r, r.field(carry.index(text))], ["row", "_text"]) for b in parts for r in [b.column("row")])
        for b in slices(whole, "_text", 2 << 20):
            texts = [text_words(t) for t in b.column("_text").to_pylist()]
            new = list({w for ws in texts for w in ws} - known.keys())
            if len(known) + len(new) > kept:
                known, scores, new = {}, scores[:0], list({w for ws in texts for w in ws})
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            if new and m.langs:
                scores = np.vstack([scores, word_scores(v, m.p, new)])
            langs, best = [], []
            for ws in texts:
                if not ws or not m.langs:
                    langs.append("und")
                    best.append(0.0)
                    continue
                s = scores[np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))].sum(0)
                k = int(s.argmax())
                langs.append(m.langs[k])
                best.append(float(1 / np.exp(s - s[k]).sum()))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(langs, pa.string()), pa.array(best, pa.float64())], ["row", "lang_pred", "score"])

    return rows.mapInArrow(of, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")
