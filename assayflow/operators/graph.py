"""Groups of linked identifiers: roots hooked to lesser roots, with pointer jumping, and what is built on it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayflow.workspace import discard, materialise


def linked_groups(pairs: DataFrame, a: str, b: str, members: DataFrame | None = None, member: str = "id") -> DataFrame:
    """(id, root, size): the least identifier that each one is linked to, directly or through others, and the number of its group.

    Every round hooks each root to the least root that a neighbour of its members has, and then jumps two steps up, so chains shorten
    fourfold. Members without a pair are groups of their own; pairs with a null end link nothing.
    """
    spark = pairs.sparkSession
    p = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both, bpath = materialise(p.unionByName(p.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct(), "edges")
    nodes = p.select(F.col("x").alias("id")).unionByName(p.select(F.col("y").alias("id")))
    if members is not None:
        nodes = nodes.unionByName(members.select(F.col(member).alias("id")).where("id is not null"))
    root, path = materialise(nodes.distinct().withColumn("root", F.col("id")), "roots")
    while True:
        of = lambda k, r: root.select(F.col("id").alias(k), F.col("root").alias(r))  # noqa: B023, E731
        hook = both.join(of("y", "ry"), "y").join(of("x", "rx"), "x").where("ry < rx").groupBy("rx").agg(F.min("ry").alias("p"))
        hook, hpath = materialise(hook, "hooks")
        if not hook.limit(1).count():
            discard(spark, hpath)
            break
        up = lambda h: h.join(h.select(F.col("rx").alias("p"), F.col("p").alias("pp")), "p", "left").select("rx", F.coalesce("pp", "p").alias("p"))
        moved = root.join(up(up(hook)).withColumnRenamed("rx", "root"), "root", "left").select("id", F.coalesce("p", "root").alias("root"))
        moved, new = materialise(moved, "roots")
        discard(spark, path, hpath)
        root, path = moved, new
    discard(spark, bpath)
    sizes = root.groupBy("root").agg(F.count("*").alias("size"))
    return root.join(sizes, "root").select("id", "root", "size")


def ranked(df: DataFrame, key: str) -> DataFrame:
    """(key, rank, of): the different keys of df, null aside, with their place in order from 0 and their number. Keys are ranked within
    ranges of their own and the ranges' sizes are added, so no task orders all of them."""
    keys = df.select(F.col(key).alias("r")).where("r is not null").distinct().repartitionByRange("r").withColumn("part", F.spark_partition_id())
    keys, _ = materialise(keys, "ranges")
    n = keys.groupBy("part").agg(F.count("*").alias("n"))
    ranges = Window.orderBy("part")  # one row for each range
    before = n.select("part", (F.sum("n").over(ranges) - F.col("n")).alias("before"), F.sum("n").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("of"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("r")) - 1 + F.col("before")
    return keys.join(F.broadcast(before), "part").select(F.col("r").alias(key), rank.alias("rank"), "of")


def dense_labels(df: DataFrame, root: str, pattern: str, into: str = "label") -> DataFrame:
    """df with consecutive labels by the order of its roots; null where the root is."""
    named = ranked(df, root).select(root, F.format_string(pattern, (F.col("rank") + 1).cast("int")).alias(into))
    return df.join(named, root, "left")


def star_links(df: DataFrame, record: str, groups: Mapping[str, Column]) -> DataFrame:
    """(a, b): each record tied to the least record of each of its groups; as many links as memberships, not pairs."""
    keys = F.explode(F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{k}:"), c)) for k, c in groups.items()])))
    rows = df.select(F.col(record).alias("b"), keys.alias("g")).where("b is not null").distinct()
    return rows.join(rows.groupBy("g").agg(F.min("b").alias("a")), "g").select("a", "b").distinct()


def leakage_units(df: DataFrame, record: str, groups: Mapping[str, Column], extra: Mapping[str, Column], folds: int) -> DataFrame:
    """(record, unit, size): components over all groups. Raises where the groups in extra chain a unit to more than its share
    of a fold although it was smaller without them."""
    first = linked_groups(star_links(df, record, groups), "a", "b", df, record)
    both = linked_groups(star_links(df, record, {**groups, **extra}), "a", "b", df, record)
    before = first.agg(F.max("size")).first()[0] or 0
    largest, n = both.agg(F.max("size"), F.count("*")).first()
    if largest and largest > before and largest > n / folds:
        raise ValueError(f"linking made a unit of {largest} of {n} records (it was {before})")
    return both.select(F.col("id").alias(record), F.col("root").alias("unit"), "size")


def profile_groups(profiles: DataFrame, key: str, links: DataFrame, weight: str) -> DataFrame:
    """(key, group_name): components over links (a, b), named by the member of most records, the lesser of equals."""
    g = linked_groups(links, "a", "b", profiles, key)
    named = g.join(profiles.select(F.col(key).alias("id"), F.col(weight).alias("w")), "id")
    best = named.groupBy("root").agg(F.min_by("id", F.struct((-F.col("w")).alias("w"), "id")).alias("group_name"))
    return g.join(best, "root").select(F.col("id").alias(key), "group_name")


def capped_merge(pairs: list[tuple[str, str, float]], lineage: dict[str, str], seeds: dict[str, str], most: int, stop_share: float = 0.01) -> tuple[dict[str, str], set[str], list[tuple[str, str, str]]]:
    """(root of each record, removed records, ledger): duplicate pairs merged in the order of similarity, as long as a unit stays within most.

    Pairs within a lineage need no action; pairs across are merged, or the member of the smaller lineage (of equals the greater
    identifier) is removed. Each step depends on the ones before, so this takes the few pairs across lineages, not a table. More than
    stop_share of pairs across is an error.
    """
    parent = dict(seeds)
    members: dict[str, int] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes: dict[str, int] = {}
    for r in lineage:
        members[find(r)] = members.get(find(r), 0) + 1
        sizes[lineage[r]] = sizes.get(lineage[r], 0) + 1
    best: dict[tuple[str, str], float] = {}
    for a, b, s in pairs:
        if a != b and a in lineage and b in lineage:
            k = (min(a, b), max(a, b))
            best[k] = max(s, best.get(k, s))
    removed: set[str] = set()
    ledger: list[tuple[str, str, str]] = []
    across = within = 0
    for (a, b), _ in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if a in removed or b in removed:
            ledger.append((a, b, "member_removed"))
        elif lineage[a] == lineage[b]:
            within += 1
            ledger.append((a, b, "within_lineage"))
        else:
            across += 1
            ra, rb = find(a), find(b)
            if ra == rb:
                ledger.append((a, b, "already_joined"))
            elif members.get(ra, 0) + members.get(rb, 0) <= most:
                lo, hi = min(ra, rb), max(ra, rb)
                parent[hi] = lo
                members[lo] = members.get(lo, 0) + members.pop(hi, 0)
                ledger.append((a, b, "merged"))
            else:
                drop = min((a, b), key=lambda r: (sizes[lineage[r]], [-ord(c) for c in r]))
                removed.add(drop)
                ledger.append((a, b, f"removed {drop}"))
    if across and across > stop_share * (across + within):
        raise ValueError(f"{across} of {across + within} duplicate pairs cross lineages")
    return {r: find(r) for r in lineage}, removed, ledger
