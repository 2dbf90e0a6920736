"""Same or near-same texts across splits: winnowing fingerprints, chained seeds, alignment, coverage.

Texts are first reduced to distinct ones. Rolling hashes of k characters are winnowed (the least of each window of w), so any common
run of w + k - 1 characters shares a fingerprint. Fingerprints are ordered by the number of texts that hold them, and join across
splits from the rare end: a text that has the given share of its fingerprints in another one has one of its rarest in it. The seeds of a
pair are chained so that both positions grow, and each is extended to the left and right as far as the characters agree.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.workspace import materialise, ship_package

BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every run of k codes, mixed so that the least of a window falls anywhere."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * BASE + codes[j : j + n].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def winnow(text: str, k: int, w: int) -> list[tuple[int, int]]:
    """(position, hash) of the least hash of each window of w, the last of equals; a text of under k characters has one, of all of it."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(codes) == 0:
        return []
    h = rolling_hashes(codes, min(k, len(codes)))
    if len(h) <= w:
        at = np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    else:
        windows = np.lib.stride_tricks.sliding_window_view(h, w)
        at = np.unique(np.arange(len(windows)) + w - 1 - np.argmin(windows[:, ::-1], axis=1))
    return [(int(p), int(h[p].astype(np.int64))) for p in at]


def fingerprints(texts: DataFrame, k: int, w: int) -> DataFrame:
    """(text_id, side, fp) of texts(text_id, side, text): the different fingerprints of each text."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [sorted({h for _, h in winnow(t, k, w)}) for t in b["text"]]
            n = [len(g) for g in got]
            yield pd.DataFrame({"text_id": np.repeat(b["text_id"].to_numpy(), n), "side": np.repeat(b["side"].to_numpy(), n), "fp": np.array([h for g in got for h in g], np.int64)})

    return texts.select("text_id", "side", "text").mapInPandas(run, "text_id string, side string, fp long")


def same_before(a: str, b: str, i: int, j: int, most: int) -> int:
    """Characters before a[i] and b[j] that agree, most at most."""
    n = 0
    step = 1
    while n < most:
        step = min(step, most - n)
        if a[i - n - step : i - n] == b[j - n - step : j - n]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
    return n


def same_after(a: str, b: str, i: int, j: int, most: int) -> int:
    """Characters from a[i] and b[j] on that agree, most at most."""
    n = 0
    step = 1
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
    return n


def chained(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of seeds (in order of the first position) whose second positions grow too."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, q) in enumerate(seeds):
        at = bisect_left(tails, q)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(q)
            ends.append(k)
        else:
            tails[at], ends[at] = q, k
    out = []
    k = ends[-1] if ends else -1
    while k >= 0:
        out.append(seeds[k])
        k = back[k]
    return out[::-1]


def aligned(a: str, b: str, k: int, w: int) -> int:
    """Characters of a that stand in collinear runs common with b.

    Fingerprints that occur once in each part are its seeds; a longest chain of them is extended to both sides, and what lies between two
    runs is taken in the same way. In a part without such seeds the first repeated fingerprint that both hold is the seed.
    """
    fa, fb = winnow(a, k, w), winnow(b, k, w)
    todo, got = [(0, len(a), 0, len(b))], 0
    pa, pb = [p for p, _ in fa], [p for p, _ in fb]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        n = same_after(a, b, alo, blo, min(ahi - alo, bhi - blo))
        if n >= min(k, len(a), len(b)) or alo > 0 or n == ahi - alo:
            got, alo, blo = got + n, alo + n, blo + n
        n = same_before(a, b, ahi, bhi, min(ahi - alo, bhi - blo))
        if n >= min(k, len(a), len(b)) or ahi < len(a):
            got, ahi, bhi = got + n, ahi - n, bhi - n
        if ahi - alo < k or bhi - blo < k:
            continue
        ma = fa[bisect_left(pa, alo) : bisect_left(pa, ahi - k + 1)]
        mb = fb[bisect_left(pb, blo) : bisect_left(pb, bhi - k + 1)]
        na, nb = Counter(h for _, h in ma), Counter(h for _, h in mb)
        where = {h: q for q, h in reversed(mb)}
        seeds = chained([(p, where[h]) for p, h in ma if na[h] == 1 == nb[h]]) or [(p, where[h]) for p, h in ma if h in nb][:1]
        seeds = [s for s in seeds if a[s[0] : s[0] + k] == b[s[1] : s[1] + k]]
        at, bt, runs = alo, blo, []
        for p, q in seeds:
            if p < at or q < bt:
                continue
            before, after = same_before(a, b, p, q, min(p - at, q - bt)), same_after(a, b, p, q, min(ahi - p, bhi - q))
            runs.append((p - before, p + after, q - before, q + after))
            at, bt = p + after, q + after
        got += sum(r[1] - r[0] for r in runs)
        if runs:
            edges = [(alo, blo), *[(r[1], r[3]) for r in runs]], [*[(r[0], r[2]) for r in runs], (ahi, bhi)]
            todo += [(x, y, u, v) for (x, u), (y, v) in zip(*edges, strict=True) if y - x and v - u]
    return got


def cross_split_matches(texts: DataFrame, k: int = 16, w: int = 17, least: float = 0.8, share: float | None = 0.8) -> DataFrame:
    """(id_a, id_b, common, coverage_a, coverage_b) of texts(text_id, side, text) with sides 'a' and 'b': the characters in runs common to
    both, and their shares of the texts.

    A pair is one that has at least the given share of one text's different fingerprints in the other, and at least the given coverage
    (least) of one of the texts; a share of None asks for any fingerprint in common. Give distinct texts: copies belong to one text_id.
    Null and empty texts match nothing.
    A pair is found from the text whose fingerprints the other one holds: among n of them, ceil(share n) in common leave
    n - ceil(share n) that the other may lack, so one of the n - ceil(share n) + 1 rarest is shared. No fingerprint is left out; one
    that very many texts hold is among the rarest of those only that have hardly any other.
    """
    texts = texts.where("text is not null and text <> ''").select("text_id", "side", "text")
    fp, _ = materialise(fingerprints(texts, k, w), "fingerprints")
    held = fp.groupBy("fp").agg(F.count(F.when(F.col("side") == "a", 1)).alias("na"), F.count(F.when(F.col("side") == "b", 1)).alias("nb")).where("na > 0 and nb > 0")
    n = fp.groupBy("text_id", "side").agg(F.count("*").alias("n"))
    of = lambda d, s, name: d.where(F.col("side") == s).select("fp", F.col("text_id").alias(name))
    all_ = fp.join(held.select("fp"), "fp", "left_semi")
    if share is None:
        pairs = of(all_, "a", "id_a").join(of(all_, "b", "id_b"), "fp").select("id_a", "id_b").distinct()
        return _verified(texts, pairs, k, w, least, 0.0)
    # fingerprints of one side only are the rarest of all: they take the first places of a text's order without being looked at again
    shared = fp.join(held, "fp").select("text_id", "side", F.struct((F.col("na") + F.col("nb")).alias("texts"), "fp").alias("f"))
    kept, _ = materialise(shared.join(n, ["text_id", "side"]).groupBy("text_id", "side", "n").agg(F.array_sort(F.collect_list("f")).alias("fs")).where(F.size("fs") >= F.ceil(share * F.col("n"))), "texts")
    prefix = F.slice("fs", 1, (F.size("fs") - F.ceil(share * F.col("n")) + 1).cast("int"))
    head = kept.select("text_id", "side", F.explode(prefix).alias("f")).select("text_id", "side", "f.fp")
    pairs = of(head, "a", "id_a").join(of(all_, "b", "id_b"), "fp").select("id_a", "id_b").unionByName(of(all_, "a", "id_a").join(of(head, "b", "id_b"), "fp").select("id_a", "id_b")).distinct()
    return _verified(texts, pairs, k, w, least, share)


def _verified(texts: DataFrame, pairs: DataFrame, k: int, w: int, least: float, share: float) -> DataFrame:
    """Pairs that hold by the definition, from their whole texts."""
    pairs, _ = materialise(pairs, "pairs")
    side = lambda s: texts.where(F.col("side") == s).select(F.col("text_id").alias(f"id_{s}"), F.col("text").alias(f"text_{s}"))
    full = pairs.join(side("a"), "id_a").join(side("b"), "id_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ia, ib, x, y in zip(b["id_a"], b["id_b"], b["text_a"], b["text_b"], strict=True):
                hx, hy = {h for _, h in winnow(x, k, w)}, {h for _, h in winnow(y, k, w)}
                both = len(hx & hy)
                if both >= share * len(hx) or both >= share * len(hy):
                    m = aligned(x, y, k, w)
                    out.append((ia, ib, m, m / len(x), m / len(y)))
            yield pd.DataFrame(out, columns=["id_a", "id_b", "common", "coverage_a", "coverage_b"])

    return full.mapInPandas(run, "id_a string, id_b string, common int, coverage_a double, coverage_b double").where(F.greatest("coverage_a", "coverage_b") >= least)
