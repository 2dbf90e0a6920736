"""Encoding of a corpus with a public byte-level BPE vocabulary.

Short texts are encoded as they are. Long ones are cut into overlapping chunks that are pre-tokenised apart; where the
pre-token boundaries of two neighbours meet again in their overlap they stay together (the pattern looks ahead only), so
the text is cut there and the pieces are encoded. A text with neighbours that never meet is encoded in one go.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.workspace import ship_package

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK, OVERLAP = 16384, 1024
_encoders: dict[int, object] = {}


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """(contents of the rank file, pre-token pattern); path defaults to the public file."""
    import public_tokenizers as public

    with open(path or public.path(VOCABULARY), "rb") as f:
        return f.read(), public.PATTERN


def encoder(ranks: bytes, pattern: str):  # noqa: ANN201
    """One encoder for each Python worker."""
    import tiktoken

    key = hash((ranks, pattern))
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def boundaries(text: str, pattern: str) -> list[int]:
    """Starts of the pre-tokens of text, and its end."""
    import regex

    return [m.start() for m in regex.finditer(pattern, text)] + [len(text)]


def _lists(ids: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_corpus(docs: DataFrame, key: str, text: str, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids array<int>) of every row of docs, without special tokens; their strings are ordinary text.

    Null and empty texts have an empty list. Rows with the same key each keep their row. Texts of any length are encoded
    as if in one go; those over chunk characters in pieces of about that length. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kept = spark.sparkContext.broadcast(vocabulary(path))  # some 800 kB
    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*kept.value)
        for b in batches:
            ids = [enc.encode_ordinary(t) for t in b.column("t").to_pylist()]
            rest = [n for n in b.schema.names if n != "t"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), _lists(ids)], names=[*rest, "ids"])

    short = d.where(F.length("t") <= chunk).mapInArrow(encode, f"k {kind}, ids array<int>")
    long = d.where(F.length("t") > chunk).groupBy("k", "t").agg(F.count("*").alias("copies")).withColumn("doc", F.sha2(F.concat_ws(":", F.col("k").cast("string"), F.sha2("t", 256)), 256))
    heads = long.select("doc", "k", "copies")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, t in zip(b["doc"], b["t"], strict=True):
                n = max(1, -(-(len(t) - overlap) // chunk))
                yield pd.DataFrame({"doc": doc, "i": range(n), "last": [i == n - 1 for i in range(n)], "t": [t[i * chunk : (i + 1) * chunk + overlap] for i in range(n)]})

    chunks = long.select("doc", "t").mapInPandas(cut, "doc string, i int, last boolean, t string").repartition("doc", "i")

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, pattern = kept.value
        for b in batches:
            marks = [boundaries(t, pattern) for t in b["t"]]
            yield pd.DataFrame({"doc": b["doc"], "i": b["i"], "head": [[p for p in m if p <= overlap] for m in marks], "tail": [[p - chunk for p in m if p >= chunk and p < len(t)] for m, t in zip(marks, b["t"], strict=True)]})

    marked = chunks.mapInPandas(ends, "doc string, i int, head array<int>, tail array<int>")
    after = marked.select("doc", (F.col("i") - 1).alias("i"), "head")
    cuts = marked.select("doc", "i", "tail").join(after, ["doc", "i"]).select("doc", "i", F.array_min(F.array_intersect("tail", "head")).alias("cut"))
    placed = chunks.join(cuts, ["doc", "i"], "left").join(cuts.select("doc", (F.col("i") + 1).alias("i"), F.col("cut").alias("start")), ["doc", "i"], "left")
    # where two neighbours never meet, later boundaries prove nothing: such a text is encoded in one go
    unmet = cuts.where("cut is null").select("doc").distinct()
    begin = F.coalesce("start", F.lit(0))
    upto = F.when(F.col("last"), F.length("t")).otherwise(F.col("cut") + chunk)
    pieces = placed.join(unmet, "doc", "left_anti").select("doc", "i", F.substring("t", begin + 1, upto - begin).alias("t"))
    in_one = long.join(unmet, "doc", "left_semi").select("doc", F.lit(0).alias("i"), "t")
    coded = pieces.unionByName(in_one).mapInArrow(encode, "doc string, i int, ids array<int>")
    whole = coded.groupBy("doc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda x: x.ids)).alias("ids"))
    joined = heads.join(whole, "doc").select("k", F.explode(F.array_repeat("ids", F.col("copies").cast("int"))).alias("ids"))
    return short.unionByName(joined).withColumnRenamed("k", key)


def decode_corpus(coded: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(key, text): the bytes of the ids, concatenated and read as UTF-8; null ids give null, unknown ids an error."""
    kept = coded.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = coded.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(*kept.value)
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "text": [None if x is None else enc.decode_bytes([int(i) for i in x]).decode("utf-8", "replace") for x in b["x"]]})

    return coded.select(F.col(f"`{key}`").alias("k"), F.col(f"`{ids}`").alias("x")).mapInPandas(decode, f"k {kind}, text string").withColumnRenamed("k", key)
