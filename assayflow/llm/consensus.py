"""Best representative of a group of duplicate records, by token-level consensus.

The values of a group are aligned progressively to a profile, heaviest first; each column of the profile takes a weighted
vote over its tokens; the existing value closest to the consensus is emitted. Votes are counted by tier, and one vote of
a higher tier outweighs any number of lower ones: with tiers the consensus follows the best tier that has a usable value
at all, with a single tier the majority of each column decides.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.workspace import materialise, ship_package

Votes = dict[str, int]
Profile = list[dict[str, Votes]]


def heavier(a: Votes, b: Votes) -> bool:
    """Whether a outweighs b: the highest tier in which they differ decides."""
    for tier in sorted(a.keys() | b.keys(), reverse=True):
        if a.get(tier, 0) != b.get(tier, 0):
            return a.get(tier, 0) > b.get(tier, 0)
    return False


def add(into: dict[str, Votes], token: str, votes: Votes) -> None:
    have = into.setdefault(token, {})
    for tier, n in votes.items():
        have[tier] = have.get(tier, 0) + n


def merge(a: Profile, na: Votes, b: Profile, nb: Votes) -> Profile:
    """Global alignment of two profiles; columns of common tokens pair off, gaps count as the empty token."""
    score = [[-(i + j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    fit = [[2 if (x.keys() & y.keys()) - {""} else -1 for y in b] for x in a]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            score[i][j] = max(score[i - 1][j - 1] + fit[i - 1][j - 1], score[i - 1][j] - 1, score[i][j - 1] - 1)
    out: Profile = []
    i, j = len(a), len(b)
    while i or j:
        column: dict[str, Votes] = {}
        if i and j and score[i][j] == score[i - 1][j - 1] + fit[i - 1][j - 1]:
            i, j = i - 1, j - 1
            parts = [*a[i].items(), *b[j].items()]
        elif i and score[i][j] == score[i - 1][j] - 1:
            i -= 1
            parts = [*a[i].items(), ("", nb)]
        else:
            j -= 1
            parts = [*b[j].items(), ("", na)]
        for token, votes in parts:
            add(column, token, votes)
        out.append(column)
    return out[::-1]


class Alignment:
    """A profile that takes one text after the other, heaviest first."""

    def __init__(self) -> None:
        self.profile: Profile = []
        self.total: Votes = {}

    def take(self, text: str, votes: Votes) -> None:
        own: Profile = [{ch: dict(votes)} for ch in text]
        self.profile = merge(self.profile, self.total, own, votes) if self.total else own
        for tier, n in votes.items():
            self.total[tier] = self.total.get(tier, 0) + n


def profile_of(values: list[tuple[str, Votes]]) -> tuple[Profile, Votes]:
    """Progressive alignment of a list of texts, heaviest first, then in order of text."""
    order = sorted(values, key=lambda v: v[0])
    order.sort(key=lambda v: sorted(v[1].items(), reverse=True), reverse=True)
    held = Alignment()
    for text, votes in order:
        held.take(text, votes)
    return held.profile, held.total


def consensus(profile: Profile) -> str:
    """The heaviest token of each column; of equals the least."""
    out = []
    for column in profile:
        best = None
        for token in sorted(column):
            if best is None or heavier(column[token], column[best]):
                best = token
        out.append(best or "")
    return "".join(out)


def closest_to_consensus(votes: DataFrame, group: str, value: str, tier: str, n: str) -> DataFrame:
    """(group, value): of each group the reported value that is closest to the consensus of all its values.

    votes has a row for each group, value (text) and tier (texts, the greatest is best) with the number n of records. Values are aligned
    in the order of their votes (the highest tier in which two differ decides), then of their text. Ties in distance go to the value with
    more votes in the same sense, then to the lesser text. Rows with a null group, value or tier don't vote. Groups of one value are
    emitted as they are. The values of a group pass through one task one at a time, sorted before; only the profile is held.
    """
    spark = votes.sparkSession
    ship_package(spark)
    v = votes.select(F.col(f"`{group}`").alias("g"), F.col(f"`{value}`").alias("v"), F.col(f"`{tier}`").alias("t"), F.col(f"`{n}`").alias("n")).where("g is not null and v is not null and t is not null")
    # tiers are few, so the votes of a value stay small however many records report it; from the highest down, they compare as arrays do
    v = v.groupBy("g", "v", "t").agg(F.sum("n").alias("n")).groupBy("g", "v").agg(F.sort_array(F.collect_list(F.struct("t", "n")), asc=False).alias("votes"))
    v, _ = materialise(v, "votes")
    several = v.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").select("g")
    single = v.join(several, "g", "left_anti").select("g", "v")
    many = v.join(several, "g", "left_semi")

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, Alignment()
        for b in batches:
            done = []
            for g, text, votes in zip(b["g"], b["v"], b["votes"], strict=True):
                if g != at:
                    if at is not None:
                        done.append((at, consensus(held.profile)))
                    at, held = g, Alignment()
                held.take(text, {x["t"]: x["n"] for x in json.loads(votes)})
            yield pd.DataFrame(done, columns=["g", "agreed"])
        if at is not None:
            yield pd.DataFrame([(at, consensus(held.profile))], columns=["g", "agreed"])

    ordered = many.repartition("g").sortWithinPartitions("g", F.desc("votes"), "v").select("g", "v", F.to_json("votes").alias("votes"))
    agreed = ordered.mapInPandas(aligned, "g string, agreed string")
    near = many.join(agreed, "g").withColumn("distance", F.levenshtein("v", "agreed"))
    best = near.groupBy("g").agg(F.max(F.struct((-F.col("distance")).alias("d"), "votes")).alias("b"))
    chosen = near.join(best, "g").where((-F.col("distance") == F.col("b.d")) & (F.col("votes") == F.col("b.votes"))).groupBy("g").agg(F.min("v").alias("v"))
    return single.unionByName(chosen).select(F.col("g").alias(group), F.col("v").alias(value))
