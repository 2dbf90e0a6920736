"""Free-entered names mapped to a reference list, by BK-trees under an edit metric.

The metric is the unrestricted Damerau-Levenshtein distance, which obeys the triangle inequality, so a tree finds every
entry within a threshold. Reference lists are taken in shards; each shard's tree is broadcast and the winners are merged.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.text import PLACEHOLDERS
from assayflow.workspace import materialise, ship_package

SHARD = 20000  # reference entries in one tree
REMEMBERED = 100000  # searches a tree remembers before it forgets all
# Words before or after a name that belong to its long form, and short forms of words in names.
FORMS = ("republic of", "kingdom of", "state of", "commonwealth of", "federation of", "union of", "the")
SHORT = {"n": "north", "s": "south", "e": "east", "w": "west", "st": "saint", "rep": "republic", "is": "islands", "mt": "mount", "fed": "federated", "dem": "democratic", "unit": "united", "prov": "provinces"}
SPLIT = re.compile(r"\s*[,;/|]\s*|\s+[-–—]\s+|\s*[()\[\]]\s*")


def distance(a: str, b: str, most: int) -> int:
    """Unrestricted Damerau-Levenshtein distance; most + 1 where the lengths alone exceed most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return abs(len(a) - len(b))
    last: dict[str, int] = {}
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [far, i]
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            cost = 1
            if x == y:
                cost, match = 0, j
            row.append(min(rows[i][j] + cost, row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        rows.append(row)
        last[x] = i
    return rows[-1][-1]


class Tree:
    """BK-tree over folded names. Distances to entries are remembered, for the same words come again in many texts."""

    def __init__(self, names: list[str]) -> None:
        self.exact: dict[str, list[str]] = {}
        for n in names:
            self.exact.setdefault(fold(n), []).append(n)
        self.nodes: list[tuple[str, dict[int, int]]] = []
        self.found: dict[tuple[str, int], list[tuple[int, str]]] = {}
        for key in sorted(self.exact):
            if not self.nodes:
                self.nodes.append((key, {}))
                continue
            at = 0
            while True:
                word, children = self.nodes[at]
                d = distance(key, word, 1 << 30)
                if d in children:
                    at = children[d]
                else:
                    children[d] = len(self.nodes)
                    self.nodes.append((key, {}))
                    break
        self.aliases: dict[str, set[str]] = {}
        for n in names:
            for a in aliases(n):
                self.aliases.setdefault(a, set()).add(n)

    def within(self, key: str, most: int) -> list[tuple[int, str]]:
        """(distance, name) of every entry within most of the key: subtrees that the triangle inequality rules out are left out."""
        if (key, most) in self.found:
            return self.found[key, most]
        found, todo = [], [0] if self.nodes else []
        while todo:
            word, children = self.nodes[todo.pop()]
            d = distance(key, word, 1 << 30)
            if d <= most:
                found += [(d, n) for n in self.exact[word]]
            todo += [c for k, c in children.items() if d - most <= k <= d + most]
        if len(self.found) >= REMEMBERED:
            self.found.clear()
        self.found[key, most] = sorted(found)
        return self.found[key, most]


def repaired(text: str) -> str:
    """Text whose UTF-8 was once read in a one-byte encoding, read rightly."""
    if any(c in text for c in "ÃÂÅÄâÐÑ"):
        for encoding in ("cp1252", "latin-1"):
            try:
                return text.encode(encoding).decode("utf-8")
            except UnicodeError:
                continue
    return text


def fold(text: str) -> str:
    """Lower case, without accents, marks and punctuation."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return " ".join(re.sub(r"[^\w]+|_", " ", text).split())


def aliases(name: str) -> set[str]:
    """Short forms of a name of several words: initials with the beginning of the last word."""
    ws = fold(name).split()
    big = [w for w in ws if w not in ("of", "and", "the")]
    out = set()
    if len(big) > 1:
        letters = "".join(w[0] for w in big)
        out |= {f"{letters} {big[-1][:k]}" for k in range(2, 8)} | {letters}
    return out


def spelled_out(ws: list[str], dotted: set[str], names: dict[str, list[str]]) -> str | None:
    """The one name whose words begin with the given ones, where those with a full stop may be cut short."""
    hits = [n for key, n in names.items() if len(key.split()) == len(ws) and all(k == w or (w in dotted and k.startswith(w)) or SHORT.get(w) == k for w, k in zip(ws, key.split(), strict=True))]
    return hits[0][0] if len(hits) == 1 and len(hits[0]) == 1 else None


def variants(part: str) -> Iterator[str]:
    """A folded part, and without the words of a long form."""
    key = fold(part)
    yield key
    for form in FORMS:
        if key.startswith(form + " "):
            yield key[len(form) + 1 :]
        if key.endswith(" " + form):
            yield key[: -len(form) - 1]
    ws = key.split()
    if ws and ws[-1] == "of":  # "A, B of" is "B of A"
        head = re.split(r"[,;]", part, maxsplit=1)
        if len(head) == 2:
            yield fold(head[1] + " " + head[0])
    if ws and ws[-1] == "country":
        yield " ".join(ws[:-1])
    if ws[:1] == ["rep"] and ws[1:2] == ["of"]:
        yield " ".join(ws[2:])
    if any(w in SHORT for w in ws):
        yield " ".join(SHORT.get(w, w) for w in ws)


def threshold(key: str) -> int:
    return 0 if len(key) < 5 else 1 if len(key) < 7 else 2 if len(key) < 10 else 3


def best(tree: Tree, part: str, typos: bool) -> tuple[int, str] | None:
    """(distance, name) of a part of a text, null if none or several are closest."""
    for v in variants(part):
        if v in tree.exact and len(tree.exact[v]) == 1:
            return 0, tree.exact[v][0]
    key = fold(part)
    if len(hits := tree.aliases.get(key, set())) == 1:
        return 0, next(iter(hits))
    dotted = {fold(w) for w in re.findall(r"\w+(?=\.)", part)}
    if dotted and (name := spelled_out(key.split(), dotted, tree.exact)):
        return 0, name
    if not typos:
        return None
    found = sorted({(d, n) for v in set(variants(part)) for d, n in tree.within(v, threshold(v))})
    if not found or (len(found) > 1 and found[1][0] == found[0][0] and found[1][1] != found[0][1]):
        return None
    return found[0]


def candidates(text: str) -> list[list[str]]:
    """Parts of a text that may name an entry, in ranks: what stands before a colon outweighs the rest."""
    text = repaired(text).replace("_", " ").strip(" \t \"'`?!.:;,")
    head, colon, tail = text.partition(":")
    ranks = [[head], [p for p in SPLIT.split(head) if p]]
    if colon:
        ranks.append([tail])
    return [r for r in ranks if any(fold(p) and fold(p) not in PLACEHOLDERS for p in r)]


def meant(tree: Tree, text: str) -> tuple[int, int, str] | None:
    """(rank, distance, name) of the entry a text stands for."""
    for rank, parts in enumerate(candidates(text)):
        after_colon = rank == 2 or (rank == 1 and len(candidates(text)) == 2 and ":" in text and parts == [text.partition(":")[2]])
        for typos in (False, True):
            if typos and after_colon:
                continue
            hits = {h for p in parts if (h := best(tree, p, typos))}
            if hits:
                low = min(hits)
                if len({n for d, n in hits if d == low[0]}) == 1:
                    return rank, *low
                return None
    return None


def map_to_reference(df: DataFrame, text: str, reference: DataFrame, name: str, into: str = "name", reader: Callable = meant) -> DataFrame:
    """(text, into): each different text of df with the reference entry it stands for, null where it stands for none.

    Null texts have no row; blank texts and placeholders stand for none. An entry is found by its spelling without case,
    accents and punctuation, in long, short or turned form, alone or beside a place, and with typing errors up to a
    threshold that grows with its length. Of several entries equally close none is taken. Repeated and null reference
    entries don't matter; an empty list maps nothing.
    """
    spark = df.sparkSession
    ship_package(spark)
    # few bytes but much work each: spread them, or adaptive execution would join them into one task
    texts = df.select(F.col(f"`{text}`").alias("t")).where("t is not null").distinct().repartition(4 * spark.sparkContext.defaultParallelism, "t")
    found, shards = None, 0
    for names in _shards(reference.select(F.col(f"`{name}`").alias("n")).where("n is not null").distinct().orderBy("n")):
        kept = spark.sparkContext.broadcast(names)
        if shards == 1:  # a second shard reads the texts again: they are written once
            texts, _ = materialise(texts, "texts")
        shards += 1

        def run(batches: Iterator[pd.DataFrame], kept=kept) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            tree = _tree(kept.value)
            for b in batches:
                hits = [reader(tree, t) for t in b["t"]]
                yield pd.DataFrame({"t": b["t"], "rank": [h[0] if h else 9 for h in hits], "d": [h[1] if h else 99 for h in hits], "n": [h[2] if h else None for h in hits]})

        part = texts.mapInPandas(run, "t string, rank int, d int, n string")
        found = part if found is None else found.unionByName(part)
    if shards > 1:  # winners of the shards: the best rank, then the least distance, unless two names tie
        low = found.groupBy("t").agg(F.min(F.struct("rank", "d")).alias("low"))
        found = found.join(low, "t").where((F.col("rank") == F.col("low.rank")) & (F.col("d") == F.col("low.d"))).groupBy("t").agg(F.min("n").alias("a"), F.max("n").alias("b")).select("t", F.when(F.col("a") == F.col("b"), F.col("a")).alias("n"))
    return found.select(F.col("t").alias(text), F.col("n").alias(into))


def _shards(names: DataFrame) -> Iterator[tuple[str, ...]]:
    """The names in runs of SHARD, one at a time; an empty list is one empty run."""
    held: list[str] = []
    some = False
    for r in names.toLocalIterator():
        held.append(r[0])
        if len(held) == SHARD:
            some = True
            yield tuple(held)
            held = []
    if held or not some:
        yield tuple(held)


@functools.lru_cache(maxsize=4)
def _tree(names: tuple[str, ...]) -> Tree:
    """One tree for each Python worker and shard, built where it is used."""
    return Tree(list(names))
