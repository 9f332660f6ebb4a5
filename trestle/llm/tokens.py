"""Token counts by rank-synchronous array merging.

A batch's pre-tokens lie in one flat array of symbols. In each round every pre-token's lowest-ranked
pair is merged in all its places at once; pre-tokens without a ranked pair leave. The symbols that
are left are the tokens. A merge yields only pairs of a higher rank than its own, so the rounds give what
merging one place at a time gives.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The splitting pattern of byte-level BPE as its library defines it, and the printable
# stand-ins of bytes in its vocabulary files (the rest follow from 256 on).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

NONE = np.int32(2**31 - 1)


class Merger:
    """The merge table of a byte-level BPE file (.json of the tokenizers library)."""

    def __init__(self, path: str, kept: int = 400_000):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab = told["model"]["vocab"]
        rest = [b for b in range(256) if b not in set(PRINTABLE)]
        char = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.of_byte = np.array([vocab[char[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = made  # by rank
        special = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(PATTERN)
        self.kept, self.known = kept, {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each non-empty pre-token."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), out)
        rank = np.full(len(sym), NONE, np.int32)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            live = np.repeat(least != NONE, sizes)
            if not live.all():
                sym, owner, rank = sym[live], owner[live], rank[live]
                sizes, least = sizes[least != NONE], least[least != NONE]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, sizes)
            # In a run of equal symbols hits touch each other: every other one counts, from the left.
            run = np.flatnonzero(hit)
            fresh = np.r_[True, np.diff(run) != 1]
            first = run[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            place = run[(run - first) % 2 == 0]
            sym[place] = self.made[rank[place]]
            np.subtract.at(out, owner[place], 1)
            keep = np.ones(len(sym), bool)
            keep[place + 1] = False
            rank[place] = rank[place + 1]  # whether the pair goes on is told below
            moved = np.zeros(len(sym), bool)
            moved[place] = True
            moved[place[place > 0] - 1] = True
            sym, owner, rank, moved = sym[keep], owner[keep], rank[keep], moved[keep]
            # The symbol before a merge may itself have been swallowed, so look once more to the left.
            anew = np.flatnonzero(moved | np.r_[moved[1:], False])
            anew = anew[anew + 1 < len(sym)]
            same = owner[anew] == owner[anew + 1]
            rank[anew[~same]] = NONE
            anew = anew[same]
            rank[anew] = self.ranks(sym[anew], sym[anew + 1])
            rank[-1] = NONE
        return out

    def text_counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; special strings inside texts count as one token each."""
        found = []
        extra = []
        for t in texts:
            t, n = t or "", 0
            if self.special and self.special.search(t):
                parts = self.special.split(t)
                found.append([w for p in parts for w in self.split.findall(p)])
                n = len(parts) - 1
            else:
                found.append(self.split.findall(t))
            extra.append(n)
        new = list({w for ws in found for w in ws} - self.known.keys())
        if len(self.known) + len(new) > self.kept:
            self.known = {}
            new = list({w for ws in found for w in ws})
        self.known.update(zip(new, self.counts(new).tolist(), strict=True) if new else ())
        of = self.known.__getitem__
        return [sum(map(of, ws)) + n for ws, n in zip(found, extra, strict=True)]


@functools.lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


def token_counts(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row's whole text.

    path: of a byte-level BPE file on every executor. A null text counts as empty: 0 bytes, 0 tokens.
    Rows are independent: repeated and null ids stay as they are, other columns are not read.
    """
    from .shared import bounded, slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for b in slices(batches, "_text"):
            n = m.text_counts(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    rows = bounded(docs).select(F.col(id).alias("_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    over: Column = (F.col("n_tokens") > limit).alias("over_limit")
    return rows.mapInArrow(count, f"_id {kind}, n_bytes long, n_tokens long").select(F.col("_id").alias(id), "n_bytes", "n_tokens", over)
