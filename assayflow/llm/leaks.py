"""Evaluation texts leaking into a corpus: a join of word shingles, verified by the longest common subsequence.

The items are a stated query set, taken in blocks; every document of the corpus meets every block, in two ways. Passages,
that is PASSAGE words in a row and more, count whatever their number: a document that holds the share `least` of an item's
words in them, in order, is found. And a first pass counts, over all documents and outside of such passages, in how many each
item shingle occurs. Shingles that are no common phrase are anchors; a document with enough of them is verified by the longest
common subsequence of the item and the parts of the document that lie around them. So common phrases are no leaks by
themselves, and a passage is one however often it leaked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.llm.words import words
from assayflow.workspace import materialise, ship_package

SHINGLE = 3  # words; with a word changed here and there, longer runs would be broken too often
AROUND = 12  # words on each side of an anchor that may count as matched
PASSAGE = 10  # words in a row that are no phrase but a passage
BLOCK_WORDS = 2_000_000  # words of items that are held at once


@dataclass
class ItemIndex:
    """Words and shingles of a block of items; shingles are triples of word numbers packed in 63 bits."""

    ids: list
    vocab: dict[str, int] = field(default_factory=dict)
    seqs: list[np.ndarray] = field(default_factory=list)
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    anchors: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    post_item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    post_at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    need: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # anchors of each item that a document must hold
    begins: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of the items' words, one item after the other
    runs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    run_starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    run_post: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # places among the items' words

    def number(self, ws: list[str]) -> np.ndarray:
        return np.array([self.vocab.get(w, 0) for w in ws], np.int32)


def shingles(seq: np.ndarray) -> np.ndarray:
    """Packed triples of word numbers; -1 where a word is in no item."""
    if len(seq) < SHINGLE:
        return np.zeros(0, np.int64)
    a, b, c = (x.astype(np.int64) for x in (seq[:-2], seq[1:-1], seq[2:]))
    return np.where((a > 0) & (b > 0) & (c > 0), (a << 42) | (b << 21) | c, -1)


def run_keys(sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the runs of PASSAGE words, of which each is in some item, from their shingles."""
    n = len(sh) - (PASSAGE - SHINGLE)
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = [sh[at : at + n] for at in (*range(0, PASSAGE - SHINGLE, SHINGLE), PASSAGE - SHINGLE)]
    whole = np.flatnonzero(np.logical_and.reduce([p >= 0 for p in parts]))
    h = np.zeros(len(whole), np.uint64)
    for p in parts:
        h = (h ^ p[whole].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return whole, h.view(np.int64)


def index_items(rows: list[tuple[object, str]]) -> ItemIndex:
    ix = ItemIndex([r[0] for r in rows])
    for _, text in rows:
        ws = words(text or "")
        for w in ws:
            ix.vocab.setdefault(w, len(ix.vocab) + 1)
        ix.seqs.append(ix.number(ws))
    assert len(ix.vocab) < 1 << 21, "a block of items has too many different words"
    ix.keys = np.unique(np.concatenate([shingles(s) for s in ix.seqs] or [np.zeros(0, np.int64)]))
    ix.begins = np.append(0, np.cumsum([len(s) for s in ix.seqs])).astype(np.int64)
    own = [run_keys(shingles(s)) for s in ix.seqs]
    run = np.concatenate([k for _, k in own] or [np.zeros(0, np.int64)])
    post = np.concatenate([b + at for b, (at, _) in zip(ix.begins, own, strict=False)] or [np.zeros(0, np.int64)])
    order = np.argsort(run, kind="stable")
    ix.runs, first = np.unique(run[order], return_index=True)
    ix.run_starts, ix.run_post = np.append(first, len(run)).astype(np.int64), post[order]
    return ix


def place(keys: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in found, positions in sorted keys) of the members of found that are keys."""
    if not len(keys) or not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == found)
    return hit, at[hit]


def choose_anchors(ix: ItemIndex, df: np.ndarray, n_docs: int, min_anchors: int) -> None:
    """The shingles of each item that are no phrases common to many texts. df counts the documents that hold a shingle outside of leaked
    passages. What is common is measured against the corpus and against the item's own rarest shingles."""
    triples = []
    ix.need = np.full(len(ix.seqs), min_anchors)
    for i, seq in enumerate(ix.seqs):
        sh = shingles(seq)
        if not len(sh):
            continue
        k = np.searchsorted(ix.keys, sh)
        count = df[k]
        own = np.sort(count)[len(count) // 6]
        telling = np.flatnonzero(count <= max(3, 0.005 * n_docs, 3 * own))
        ix.need[i] = min(min_anchors, max(1, len(telling) // 2))  # short items have few places
        triples += [(int(k[p]), i, int(p)) for p in telling]
    triples.sort()
    keys = np.array([t[0] for t in triples], np.int64)
    used, first = np.unique(keys, return_index=True)
    ix.anchors = ix.keys[used] if len(used) else np.zeros(0, np.int64)
    ix.starts = np.append(first, len(keys)).astype(np.int64)
    ix.post_item = np.array([t[1] for t in triples], np.int32)
    ix.post_at = np.array([t[2] for t in triples], np.int32)
    ix.keys = np.zeros(0, np.int64)


def common_words(item: np.ndarray, part: np.ndarray) -> int:
    """Length of the longest common subsequence, 64 and more cells at a time."""
    masks: dict[int, int] = {}
    for j, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | (1 << j)
    full = (1 << len(item)) - 1
    s = full
    for w in part.tolist():
        u = s & masks.get(w, 0)
        s = ((s + u) | (s - u)) & full
    return len(item) - s.bit_count()


def spread(starts: np.ndarray, hit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the document, places among the postings): each hit once for every posting of its key."""
    n = starts[at + 1] - starts[at]
    return np.repeat(hit, n), np.repeat(starts[at] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))


def covered(where: np.ndarray, before: int, after: int, size: int) -> np.ndarray:
    """Which of size words lie from before words before to after words after one of the places."""
    mark = np.zeros(size + 1, np.int64)
    np.add.at(mark, np.maximum(where - before, 0), 1)
    np.add.at(mark, np.minimum(where + after, size), -1)
    return np.cumsum(mark[:-1]) > 0


def passages(ix: ItemIndex, seq: np.ndarray, least: float) -> list[tuple[int, int, np.ndarray]]:
    """(item, words in order, which words of seq) of the items of which seq holds at least the share least in passages."""
    places, keys = run_keys(shingles(seq))
    hit, at = place(ix.runs, keys)
    if not len(hit):
        return []
    where, post = spread(ix.run_starts, places[hit], at)
    spots = ix.run_post[post]
    items = np.searchsorted(ix.begins, spots, side="right") - 1
    held, first = np.unique(spots, return_index=True)
    whose = items[first]
    width = np.minimum(np.append(np.where(whose[1:] == whose[:-1], np.diff(held), PASSAGE), PASSAGE), PASSAGE)
    share = np.bincount(whose, width, len(ix.seqs))
    out = []
    for i in np.flatnonzero((share > 0) & (share >= least * np.diff(ix.begins))):
        part = covered(where[items == i], 0, PASSAGE, len(seq))
        got = common_words(ix.seqs[i], seq[part])
        if got >= least * len(ix.seqs[i]):
            out.append((int(i), got, part))
    return out


def verify(ix: ItemIndex, seq: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """(item, words in order, anchors) of the items of which seq holds at least the share least."""
    hit, at = place(ix.anchors, shingles(seq))
    if not len(hit):
        return []
    where, post = spread(ix.starts, hit, at)
    items, spots = ix.post_item[post], ix.post_at[post]
    out = []
    held = np.bincount(items, minlength=len(ix.need))
    for i in np.flatnonzero(held >= ix.need):
        item, at, spot = ix.seqs[i], where[items == i], spots[items == i]
        piece = np.append(0, np.cumsum(np.diff(at) > SHINGLE + 2 * AROUND))
        anchors = np.bincount(np.unique(piece * len(item) + spot) // len(item))
        at = at[anchors[piece] >= ix.need[i]]  # scattered ones add up to no passage, however long the document
        if not len(at):
            continue
        part = seq[covered(at, AROUND, SHINGLE + AROUND, len(seq))]
        part = part[part > 0]
        if len(part) < least * len(item):
            continue
        got = common_words(item, part)
        if got >= least * len(item):
            out.append((int(i), got, len(at)))
    return out


def leaked_items(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, least: float = 0.5, min_anchors: int = 4) -> DataFrame:
    """(doc, item, n_words, n_item_words) of the documents that hold at least the share least of an item's words in order.

    Null and empty texts hold and lend nothing; items of fewer than three words are no passages. Repeated rows of either
    table count once. Whole texts are searched. Documents' other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    d = docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text")).where("text is not null and doc is not null")
    doc_type, item_type = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    rows = sorted({(r[0], r[1]) for r in items.select(item, item_text).where(F.col(item_text).isNotNull()).toLocalIterator()}, key=lambda r: str(r[0]))
    blocks: list[list[tuple[object, str]]] = [[]]
    size = 0
    for r in rows:
        if size > BLOCK_WORDS:
            blocks.append([])
            size = 0
        blocks[-1].append(r)
        size += len(r[1]) // 5
    found = None
    for block in blocks:
        ix = index_items(block)
        known = spark.sparkContext.broadcast(ix)

        def number(batches: Iterator[pa.RecordBatch], kept=known) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ix = kept.value
            get = ix.vocab.get
            for b in batches:
                seqs = [np.array([get(w, 0) for w in words(t)], np.int32) for t in b.column("text").to_pylist()]
                held = [i for i, s in enumerate(seqs) if np.count_nonzero(s) >= SHINGLE]
                found = [[(i, got) for i, got, _ in passages(ix, seqs[k], least)] for k in held]
                yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(held, pa.int64())), pa.array([seqs[i].tobytes() for i in held], pa.binary()), pa.array([np.array(f, np.int32).tobytes() for f in found], pa.binary())], names=["doc", "seq", "found"])

        numbered, _ = materialise(d.mapInArrow(number, f"doc {doc_type}, seq binary, found binary"), "words")

        def count(batches: Iterator[pd.DataFrame], kept=known) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            ix = kept.value
            keys = ix.keys
            total = np.zeros(len(keys), np.int64)
            for b in batches:
                for s, f in zip(b["seq"], b["found"], strict=True):
                    seq = np.frombuffer(s, np.int32)
                    sh = shingles(seq)
                    if f:  # what stands in a leaked passage is no phrase of other texts
                        inside = np.logical_or.reduce([part for _, _, part in passages(ix, seq, least)])
                        sh = sh[~(inside[:-2] & inside[1:-1] & inside[2:])]
                    _, at = place(keys, sh)
                    total[np.unique(at)] += 1
            held = np.flatnonzero(total)
            yield pd.DataFrame({"at": held, "n": total[held]})

        counts = numbered.select("seq", "found").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # one row for each shingle of the items
        df = np.zeros(len(ix.keys), np.int64)
        for at, n in counts:
            df[at] = n
        choose_anchors(ix, df, d.count(), min_anchors)
        searching = spark.sparkContext.broadcast(ix)

        def search(batches: Iterator[pd.DataFrame], kept=searching) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            ix = kept.value
            for b in batches:
                out = []
                for k, s, f in zip(b["doc"], b["seq"], b["found"], strict=True):
                    pairs = [(i, got) for i, got, _ in verify(ix, np.frombuffer(s, np.int32), least)] + np.frombuffer(f, np.int32).reshape(-1, 2).tolist()
                    out += [(k, ix.ids[i], got, len(ix.seqs[i])) for i, got in pairs]
                yield pd.DataFrame(out, columns=["doc", "item", "n_words", "n_item_words"])

        part = numbered.mapInPandas(search, f"doc {doc_type}, item {item_type}, n_words int, n_item_words int")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc", "item").agg(F.max("n_words").alias("n_words"), F.max("n_item_words").alias("n_item_words")).select(F.col("doc").alias(doc), F.col("item").alias(item), "n_words", "n_item_words")
