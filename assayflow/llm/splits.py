"""Splits that keep related records together.

A Boruvka forest: in every round each component picks its least outgoing link, the picked links are contracted, and they
are kept as the spanning forest. Roots are stratified by size band and dealt to the splits at even steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayflow.workspace import discard, materialise


def _roots(parent: DataFrame) -> tuple[DataFrame, str]:
    """Pointer jumping: (c, p) of a forest with p = c at roots, until every p is a root."""
    spark = parent.sparkSession
    parent, path = materialise(parent, "parents")
    while True:
        up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        jumped, new = materialise(parent.join(up, "p").select("c", F.col("pp").alias("p")), "parents")
        moved = jumped.join(parent.select("c", F.col("p").alias("q")), "c").where("p <> q").limit(1).count()
        discard(spark, path)
        parent, path = jumped, new
        if not moved:
            return parent, path


def spanning_forest(links: DataFrame, a: str, b: str, weight: str) -> tuple[DataFrame, DataFrame]:
    """((node, root), (a, b, weight)): the component of each linked node, and the links of the least spanning forest.

    Links are weighed by weight, then by their ends, so no two are equal. Null ends and links of a node with itself link
    nothing; repeated links count once. Both results are written tables; an empty table gives empty ones.
    """
    spark = links.sparkSession
    e = links.select(F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y"), F.col(f"`{weight}`").alias("w")).where("x is not null and y is not null and x <> y")
    e = e.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("w").alias("w"))
    e, epath = materialise(e.select("x", "y", F.struct("w", "x", "y").alias("k")), "links")
    nodes, npath = materialise(e.select(F.col("x").alias("node")).unionByName(e.select(F.col("y").alias("node"))).distinct().select("node", F.col("node").alias("root")), "nodes")
    forests: list[DataFrame] = []
    while e.limit(1).count():
        out = e.select(F.col("x").alias("c"), "k", F.col("y").alias("p")).unionByName(e.select(F.col("y").alias("c"), "k", F.col("x").alias("p")))
        best, bpath = materialise(out.groupBy("c").agg(F.min(F.struct("k", "p")).alias("b")).select("c", "b.k", "b.p"), "picked")
        forests.append(materialise(best.select("k").distinct().select(F.col("k.x").alias("a"), F.col("k.y").alias("b"), F.col("k.w").alias("weight")), "forest")[0])
        back = best.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        # the only circles are two components that picked the same link; the smaller becomes the root
        hooked = best.join(back, "p", "left").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        root, rpath = _roots(hooked)
        to = lambda k: root.select(F.col("c").alias(k), F.col("p").alias(f"r{k}"))  # noqa: B023, E731
        merged = e.join(to("x"), "x").join(to("y"), "y").where("rx <> ry")
        merged = merged.groupBy(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).agg(F.min("k").alias("k"))
        e2, epath2 = materialise(merged, "links")
        nodes2, npath2 = materialise(nodes.join(root.select(F.col("c").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "nodes")
        discard(spark, epath, npath, bpath, rpath)
        e, epath, nodes, npath = e2, epath2, nodes2, npath2
    forest = forests[0] if forests else e.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("k.w").alias("weight"))
    for f in forests[1:]:
        forest = forest.unionByName(f)
    return nodes, forest


def related_units(df: DataFrame, record: str, groups: dict[str, "F.Column"], keep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((record, unit), forest): records that share a group, directly or through others, on any of their rows.

    groups: the keys of df's groups by kind, null where a row names none. A unit's name is its least record. Records
    without a group are units of their own; rows with a null record belong to none. The links of the forest are those of
    records (R), through groups by kind; a link weighs the records of its group, so small groups tie first. keep: a path under which the
    forest is written as a table that outlasts the job (an existing one is refused).
    """
    row = df.select(F.col(f"`{record}`").alias("r"), *[k.alias(f"g{i}") for i, k in enumerate(groups.values())]).where("r is not null")
    keys = F.array_compact(F.array(*[F.when(F.col(f"g{i}").isNotNull(), F.concat(F.lit(f"{kind}:"), F.col(f"g{i}"))) for i, kind in enumerate(groups)]))
    row, _ = materialise(row.select("r", F.explode_outer(keys).alias("g")).distinct(), "members")
    size = row.where("g is not null").groupBy("g").agg(F.count("*").alias("w"))
    links = row.join(size, "g").where("w > 1").select(F.concat(F.lit("R:"), "r").alias("a"), F.col("g").alias("b"), "w")
    nodes, forest = spanning_forest(links, "a", "b", "w")
    if keep is not None:
        forest.write.parquet(keep)
        forest = forest.sparkSession.read.parquet(keep)
    of = nodes.where(F.col("node").startswith("R:")).select(F.substring("node", 3, 1 << 30).alias("r"), "root")
    name = of.groupBy("root").agg(F.min("r").alias("unit"))
    linked = of.join(name, "root").select("r", "unit")
    return row.select("r").distinct().join(linked, "r", "left").select(F.col("r").alias(record), F.coalesce("unit", "r").alias("unit")), forest


def quotas(bands: Sequence[tuple[int, int, int]], splits: Sequence[tuple[str, float]]) -> dict[int, list[int]]:
    """Units of each band for each split, of bands (band, units, records): the largest first, and what a split got too little or too much of
    the records so far is carried to the next band. Of parts of units the largest wants go first."""
    total = sum(p for _, p in splits)
    shares = [p / total for _, p in splits]
    held, seen, out = [0.0] * len(shares), 0, {}
    for band, n, records in sorted(bands, reverse=True):
        seen += records
        mean = records / n
        wants = [max(0.0, (p * seen - h) / mean) for p, h in zip(shares, held, strict=True)]
        scale = n / (sum(wants) or 1)
        wants = [x * scale for x in wants]
        given = [int(x) for x in wants]
        for k in sorted(range(len(wants)), key=lambda k: (given[k] - wants[k], k))[: n - sum(given)]:
            given[k] += 1
        held = [h + g * mean for h, g in zip(held, given, strict=True)]
        out[band] = given
    return out


def deal(units: DataFrame, unit: str, size: str, splits: Sequence[tuple[str, float]], seed: int = 1, buckets: int = 4096) -> DataFrame:
    """units with a column split: in each band of sizes (powers of two) the units are dealt in the order of a seeded hash, as many to each
    split as quotas() gives. Each split has its proportion of the records to within about the largest unit, however few units are large.

    A unit's place is its rank in a hash bucket plus the sizes of the buckets before it: no band is sorted in one task. The driver gets
    one row for each band, 64 at most. Equal units (repeats) get the same split; a column split is replaced; sizes under one or null count
    as one. An empty table gives an empty one.
    """
    weight = F.greatest(F.coalesce(F.col(f"`{size}`").cast("double"), F.lit(1.0)), F.lit(1.0))
    u = units.select(F.col(f"`{unit}`").alias("unit"), weight.alias("w")).groupBy("unit").agg(F.max("w").alias("w")).withColumn("band", F.floor(F.log2("w")).cast("int"))
    u = u.withColumn("h", F.xxhash64(F.lit(seed), "unit")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    counts = u.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.sum("w").alias("records"))
    given = quotas([tuple(r) for r in counts.groupBy("band").agg(F.sum("n"), F.sum("records")).collect()], splits)
    starts = counts.select("band", "bucket", (F.sum("n").over(Window.partitionBy("band").orderBy("bucket")) - F.col("n")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("band", "bucket").orderBy("h", "unit"))
    placed = u.withColumn("rank", rank).join(F.broadcast(starts), ["band", "bucket"])  # 64 bands of 4096 buckets at most
    at = F.col("start") + F.col("rank")
    edges = [(band, name, sum(g[: k + 1])) for band, g in sorted(given.items()) for k, (name, _) in enumerate(splits)]
    names = F.coalesce(*[F.when((F.col("band") == band) & (at <= edge), F.lit(name)) for band, name, edge in edges], F.lit(splits[-1][0]))
    dealt = placed.select(F.col("unit").alias("__unit"), names.alias("split"))
    return units.drop("split").join(dealt, F.col(f"`{unit}`").eqNullSafe(F.col("__unit"))).drop("__unit")
