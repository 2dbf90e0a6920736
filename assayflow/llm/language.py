"""Languages of documents and of their sentences, by interpolated Kneser-Ney character models.

One model for each language is trained on all labelled rows: sentences, votes on labels and n-grams are counted in the tasks,
and the driver gets the counts of different triples and n-grams only. The n-grams of all models lie in one sorted array of packed keys, with a row of log probabilities, one for each language, so that a character is looked up once for
all. A sentence gets the language of least cross-entropy per character; sentences that no model explains are rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.workspace import discard, materialise, ship_package

ORDER = 4
BITS = 14  # of a character's number in a packed n-gram
DISCOUNT = 0.75
PARTS = 5  # of the labelled documents, of which four judge the fifth, and of the sentences, of which one is held out
SLICE = 512  # documents handled at once in a task
AT_ONCE = 512  # sentences scored at once, so that their arrays stay in the processor's cache
SEEN = 200_000  # sentences that a task remembers to have passed on
MIN_LETTERS = 12
MIN_LETTERS_CJK = 6

# Codes and names of the languages.
LABELS = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french francais", "es": "es spa spanish espanol castellano",
    "pt": "pt por portuguese portugues", "it": "it ita italian italiano", "nl": "nl nld dut dutch nederlands", "ru": "ru rus russian",
    "ja": "ja jpn japanese",
}
CODE_OF = {name: code for code, names in LABELS.items() for name in names.split()}

# Patterns that search whole texts begin with one class of characters, to which the engine skips.
LINE = re.compile("[\r\n\u2028\u2029][\r\n\u2028\u2029]*")
STOP = re.compile("[.!?\u2026\u3002\uff01\uff1f](?:(?<=[\u3002\uff01\uff1f])|[\"'\u201d\u00bb)\\]]*[\\s\u200b]+(?=[^\\W\\da-z\u00df-\u00f6\u00f8-\u00ff\u0430-\u044f]|[\\d\\[(\"'\u00ab\u201c]))")
END = 14  # characters from the last that ENDED may hold, one line end among them
ENDED = re.compile("[.!?\u2026\u3002\uff01\uff1f][^A-Za-z\u00c0-\u024f\u0400-\u04ff\u3040-\u30ff\u3400-\u9fff]{0,12}$")
# <word>, [words], (words), or a number with a code before and a unit after it.
CODES = re.compile(r"[<\[(A-Z\d](?:(?<=<)[^<>]{1,20}>|(?<=\[)[^\]]{0,60}\]|(?<=\()[^)]{0,60}\)|(?:(?<=[A-Z])[A-Z]-\d+|(?<=\d)\d*)(?:[.,/]\d+)*(?:\s?(?:mg/[lL]|мг/л))?)")
QUOTED = re.compile(r"«[^»]{1,200}»|“[^”]{1,200}”|„[^“”]{1,200}[“”]|\"[^\"]{1,200}\"")
LETTER = re.compile(r"[^\W\d_]")
ENOUGH = re.compile(r"(?:[\W\d_]*+[^\W\d_]){%d}" % MIN_LETTERS)
CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
ENOUGH_CJK = re.compile("(?:[^\u3040-\u30ff\u3400-\u9fff]*+[\u3040-\u30ff\u3400-\u9fff]){%d}" % MIN_LETTERS_CJK)
MIXED_WORD = re.compile("[a-zA-Z][\u0400-\u04ff]|[\u0400-\u04ff][a-zA-Z]")
# Cyrillic letters and the Latin ones that look the same.
SAME_LOOK = str.maketrans("аеорсухіјѕАВЕКМНОРСТУХІЈЅ", "aeopcyxijsABEKMHOPCTYXIJS")
SAME_LOOK_BACK = str.maketrans("aeopcyxABEKMHOPCTYX", "аеорсухАВЕКМНОРСТУХ")
CYRILLIC = re.compile("[\u0400-\u04ff]")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff][\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]*")


def label_code(c: F.Column) -> F.Column:
    """The two-letter code of a label in any spelling, with or without region; null where it is missing or undefined."""
    first = F.regexp_extract(F.lower(F.trim(F.translate(c, "çãêñ", "caen"))), r"^([a-z]+)", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CODE_OF.items() for x in kv]), first)


def prose_of(part: str) -> str | None:
    """The part without quoted words, codes, numbers and insertions in brackets; null unless it is a whole sentence."""
    if len(part) < MIN_LETTERS_CJK or not ENDED.search(part, max(0, len(part) - END)):
        return None
    if '"' in part or "\u00ab" in part or "\u201c" in part or "\u201e" in part:
        part = QUOTED.sub(" ", part)
    if not (ascii_only := part.isascii()):
        part = INVISIBLE.sub("", part)
    prose = CODES.sub("0", " ".join(part.split())).strip(" >-*•#")
    if not ascii_only and CJK.search(prose) and ENOUGH_CJK.match(prose):
        return prose
    if prose.count(" ") < 3 or not ENOUGH.match(prose):
        return None
    if (prose[0] if prose[0].isalpha() else prose[LETTER.search(prose).start()]).islower() and prose.lower() != prose:
        return None
    if not ascii_only and CYRILLIC.search(prose) and MIXED_WORD.search(prose):
        prose = prose.translate(SAME_LOOK if 2 * len(CYRILLIC.findall(prose)) < len(LETTER.findall(prose)) else SAME_LOOK_BACK)
    return prose


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, prose) of the whole sentences of a text: the parts between line and sentence ends that end as sentences do and don't
    begin in the middle of one. A line that goes on in lower case is no end."""
    cuts = [0]
    for m in LINE.finditer(text):
        e = m.end()
        while e < len(text) and text[e].isspace():
            e += 1
        if e < len(text) and text[e].islower() and not ENDED.search(text[max(cuts[-1], m.start() - 16) : m.start()]):
            continue
        cuts.append(m.end())
    cuts.append(len(text))
    out = []
    for line, stop in zip(cuts, cuts[1:], strict=False):
        start = line
        for m in STOP.finditer(text, line, stop):
            if prose := prose_of(text[start : m.end()]):
                out.append((start, m.end(), prose))
            start = m.end()
        if start < stop and (prose := prose_of(text[start:stop])):
            out.append((start, stop, prose))
    return out


@dataclass
class Models:
    languages: list[str]
    alphabet: dict[str, int]
    keys: np.ndarray  # packed n-grams of all orders, sorted
    contexts: np.ndarray  # packed contexts, sorted
    rows: np.ndarray  # of each language: log probabilities of the keys, log back-off weights of the contexts, and a zero
    scale: float = 1.0
    reject: float = -5.0


def pack(codes: np.ndarray, n: int) -> np.ndarray:
    """Packed n-grams that end at each position from n - 1 on; the order is part of the key."""
    k = np.full(len(codes) - n + 1, n, np.int64)
    for j in range(n):
        k = (k << BITS) | codes[j : len(codes) - n + 1 + j]
    return k


def fold(prose: str) -> str:
    return " ".join(prose.lower().split())


def numbers(alphabet: dict[str, int]) -> np.ndarray:
    """The number of each character, by its code point."""
    table = np.zeros(0x11000, np.int64)
    for ch, i in alphabet.items():
        table[ord(ch)] = i
    return table


def encode(folded: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the characters, ends of the texts); each text is led by ORDER - 1 blanks. table: of numbers()."""
    points = np.frombuffer(("   " + "   ".join(folded)).encode("utf-32-le", "replace"), np.uint32)
    return table[np.minimum(points, len(table) - 1)], np.cumsum([len(t) + 3 for t in folded])


def alphabet_of(chars: dict[str, int]) -> dict[str, int]:
    """Numbers of the characters that occur more than once, the most frequent first."""
    known = sorted((-n, ch) for ch, n in chars.items() if n > 1 and ord(ch) < 0x11000)[: (1 << BITS) - 2]
    return {ch: i + 1 for i, (_, ch) in enumerate(known)}


def count_grams(folded: list[str], alphabet: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-grams of the highest order, how often each occurs); every text ends in as many blanks as lead it."""
    codes, _ = encode(folded, numbers(alphabet))
    return np.unique(pack(np.append(codes, [alphabet.get(" ", 0)] * (ORDER - 1)), ORDER), return_counts=True)


def model_of(grams: dict[str, tuple[np.ndarray, np.ndarray]], alphabet: dict[str, int]) -> Models:
    """Models from the n-grams of the highest order of each language, sorted, with their counts."""
    strip = {n: (1 << (BITS * n)) - 1 for n in range(ORDER + 1)}
    suffix = lambda keys, n: ((n - 1) << (BITS * (n - 1))) | (keys & strip[n - 1])
    context = lambda keys, n: ((n - 1) << (BITS * (n - 1))) | ((keys & strip[n]) >> BITS)
    languages, size = sorted(grams), len(alphabet) + 1
    used = {}
    for lang in languages:
        used[lang, ORDER] = grams[lang]
        for n in range(ORDER - 1, 0, -1):  # lower orders count the different characters seen before
            used[lang, n] = np.unique(suffix(used[lang, n + 1][0], n + 1), return_counts=True)
    keys = {n: np.unique(np.concatenate([used[lang, n][0] for lang in languages])) for n in range(1, ORDER + 1)}
    contexts = {n: np.unique(context(keys[n], n)) for n in keys}
    logp = {n: np.full((len(languages), len(k)), np.nan, np.float32) for n, k in keys.items()}
    back = {n: np.zeros((len(languages), len(c)), np.float32) for n, c in contexts.items()}
    for li, lang in enumerate(languages):
        below = np.full(1, 1.0 / size)
        for n in range(1, ORDER + 1):
            k, c = used[lang, n]
            ctx, of, kinds = np.unique(context(k, n), return_inverse=True, return_counts=True)
            total = np.bincount(of, c)
            rest = DISCOUNT * kinds / total
            lower = below if n == 1 else below[np.searchsorted(used[lang, n - 1][0], suffix(k, n))]
            below = np.maximum(c - DISCOUNT, 0) / total[of] + rest[of] * lower
            logp[n][li, np.searchsorted(keys[n], k)] = np.log(below)
            back[n][li, np.searchsorted(contexts[n], ctx)] = np.log(rest if n > 1 else rest / size)
    # n-grams of other languages: what backing off gives
    for n in keys:
        lower = np.broadcast_to(back[1], logp[1].shape) if n == 1 else logp[n - 1][:, np.searchsorted(keys[n - 1], suffix(keys[n], n))] + back[n][:, np.searchsorted(contexts[n], context(keys[n], n))]
        np.copyto(logp[n], lower, where=np.isnan(logp[n]))
    rows = np.concatenate([*logp.values(), *back.values(), np.zeros((len(languages), 1), np.float32)], axis=1)
    return Models(languages, alphabet, np.concatenate([*keys.values()]), np.concatenate([*contexts.values()]), rows)


def train(samples: dict[str, list[str]]) -> Models:
    """Models of the languages from their different sentences."""
    samples = {lang: sorted(set(ps)) for lang, ps in samples.items()}
    alphabet = alphabet_of(Counter(ch for ps in samples.values() for p in ps for ch in p.lower()))
    return model_of({lang: count_grams([fold(p) for p in ps or [" "]], alphabet) for lang, ps in samples.items()}, alphabet)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in keys, whether it is there)."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Lookup:
    """find() in keys by a hash table; keys that lost their place in it to another are found by bisection."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, bits = keys, max(12, (16 * len(keys)).bit_length())
        self.shift, self.table = np.uint64(64 - bits), np.zeros(1 << bits, np.int32)
        self.table[self.place(keys)] = np.arange(len(keys))

    def place(self, wanted: np.ndarray) -> np.ndarray:
        hashed = wanted.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        hashed >>= self.shift
        return hashed.view(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.table[self.place(wanted)].astype(np.int64)
        hit = self.keys[at] == wanted
        rest = np.flatnonzero(~hit)
        at[rest], hit[rest] = find(self.keys, wanted[rest])
        return at, hit


def lookup(of: Models | Votes) -> Lookup:
    """Of the keys; made once in a process."""
    if "made" not in of.__dict__:
        of.made = Lookup(of.keys)
    return of.made


def score(m: Models, prose: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(mean log probability per character by language, characters) of each text."""
    return score_folded(m, [fold(p) for p in prose])


def score_folded(m: Models, folded: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """score() of texts as fold() gives them, AT_ONCE of them at a time."""
    if len(folded) > AT_ONCE:
        several = [score_folded(m, folded[at : at + AT_ONCE]) for at in range(0, len(folded), AT_ONCE)]
        return np.concatenate([s for s, _ in several]), np.concatenate([n for _, n in several])
    if not folded:
        return np.zeros((0, len(m.languages)), np.float32), np.zeros(0, np.int64)
    if "numbers" not in m.__dict__:
        m.numbers = numbers(m.alphabet)
    codes, ends = encode(folded, m.numbers)
    starts = np.append(0, ends[:-1])
    n = np.maximum(ends - starts - (ORDER - 1), 1)
    grams = pack(codes, ORDER)  # number i ends at character i + ORDER - 1, so a text's own begin at its start
    zero = m.rows.shape[1] - 1
    at, hit = lookup(m).find(grams)
    own = np.ones(len(grams), bool)
    for k in range(1, ORDER):  # the blanks that lead the next text aren't scored
        own[ends[:-1] - k] = False
    at = np.where(hit & own, at, zero)
    rest = np.flatnonzero(~hit & own)
    left, owner = grams[rest], np.searchsorted(ends, rest, side="right")
    more_rows, more_owner = [], []
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            p, hit = find(m.keys, (left & ((1 << (BITS * order)) - 1)) | (order << (BITS * order)))
            more_rows.append(p[hit])
            more_owner.append(owner[hit])
            left, owner = left[~hit], owner[~hit]
        context = ((left & ((1 << (BITS * order)) - 1)) >> BITS) | ((order - 1) << (BITS * (order - 1)))
        p, known = find(m.contexts, context)
        more_rows.append(len(m.keys) + p[known])
        more_owner.append(owner[known])
    extra, whose = np.concatenate(more_rows), np.concatenate(more_owner)
    total = np.stack([np.add.reduceat(row[at], starts) + np.bincount(whose, row[extra], len(folded)) for row in m.rows], axis=1)
    return total / n[:, None], n


def char_triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(packed triples of characters, the text of each); two blanks lead each text."""
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer(("  " + "  ".join(texts)).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    triples = points[:-2] << 21
    triples |= points[1:-1]
    triples <<= 21
    triples |= points[2:]
    own = np.ones(len(triples), bool)
    ends = np.cumsum(size + 2)[:-1]
    own[ends - 1] = own[ends - 2] = False  # triples that reach into the next text
    return triples[own], np.repeat(np.arange(len(texts)), size)


def agreeing(docs: list[tuple[str, list[str]]], parts: int = PARTS, part_of: list[int] | None = None) -> dict[str, list[str]]:
    """Folded sentences by language of labelled documents, without wrong labels: first whole documents go that mostly contradict their
    label, then single sentences.

    A sentence is judged by the parts of the documents that its own isn't in, by how often its character triples occur under each label.
    These are shares of all triples, not of their contexts: stray copies in another label's documents stay rare there, where a model of
    contexts would learn them by heart. A label without any agreeing sentence keeps all of its own. agreeing_sentences() does the same in
    the tasks. part_of: the part of each document, else dealt in turn.
    """
    part_of = [q for q, (_, ps) in zip(part_of, docs, strict=True) if any(p.split() for p in ps)] if part_of else None
    docs = [(lang, [s for p in ps if (s := " ".join(p.lower().split()))]) for lang, ps in docs]
    docs = [d for d in docs if d[1]]
    if not docs:
        return {}
    names = sorted({lang for lang, _ in docs})
    texts = [s for _, ss in docs for s in ss]
    doc = np.repeat(np.arange(len(docs)), [len(ss) for _, ss in docs])
    label = np.array([names.index(lang) for lang, _ in docs])[doc]
    size = np.array([len(t) for t in texts])
    triples, of = char_triples(texts)
    triples = np.unique(triples, return_inverse=True)[1]
    kinds = int(triples.max()) + 1
    part = np.array(part_of)[doc] if part_of else doc % parts

    def judged(keep: np.ndarray) -> np.ndarray:
        k = keep[of]
        place = (part[of[k]] * len(names) + label[of[k]]) * kinds + triples[k]
        counts = np.bincount(place, minlength=parts * len(names) * kinds).reshape(parts, len(names), kinds)
        whole, out = counts.sum(axis=0), np.zeros(len(texts), np.int64)
        for q in range(parts):
            c = whole - counts[q] + 0.1
            logs = np.log(c / c.sum(axis=1, keepdims=True))
            mine = part[of] == q
            s = np.stack([np.bincount(of[mine], row[triples[mine]], len(texts)) for row in logs])
            out[part == q] = s.argmax(axis=0)[part == q]
        return out

    right = judged(np.ones(len(texts), bool)) == label
    sound = 2 * np.bincount(doc, size * right) >= np.bincount(doc, size)
    keep = sound[doc]
    keep &= judged(keep) == label
    kept: dict[str, list[str]] = {lang: [] for lang in names}
    for text, k, who in zip(texts, keep, label, strict=True):
        if k:
            kept[names[who]].append(text)
    return {lang: ps or [s for other, ss in docs if other == lang for s in ss] for lang, ps in kept.items()}


def thresholds(model: Models, low: float, other: float, gap: float, wrong: int, held: int) -> None:
    """Rejection and confidence from what held-out sentences gave."""
    model.reject = low - max(0.0, low - other) / 2
    # a logistic scale for the gap per character: its typical size should be all but certain, unless sentences were mistaken
    error = (wrong + 1) / (held + 2)
    model.scale = float(np.log((1 - error) / error) / max(gap, 1e-3))


def held_out(m: Models, sentences: list[str], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score under the own language, best of the others, gap of the two best, whether mistaken) of each folded sentence."""
    s, _ = score_folded(m, sentences)
    k = np.array([m.languages.index(x) for x in langs], np.int64)
    own, rest, top = s[np.arange(len(s)), k], s.copy(), np.sort(s, axis=1)
    rest[np.arange(len(s)), k] = -np.inf
    return own, rest.max(axis=1), top[:, -1] - top[:, -2], s.argmax(axis=1) != k


def fit(samples: dict[str, list[str]], aside: Callable[[int, str], bool] = lambda i, _: i % PARTS == 0) -> Models:
    """Models of the languages, with rejection and confidence set on sentences that were held out.

    A text is rejected when its best model explains it worse than half way between the held-out sentences of the models' own languages
    (their 0.1 % quantile) and what the other models make of a language that is left out (their median)."""
    samples = {lang: sorted(set(ps)) for lang, ps in samples.items()}
    model = train(samples)
    held = [(lang, p) for lang, ps in samples.items() for i, p in enumerate(ps) if aside(i, p)]
    if held and len(model.languages) > 1:
        rest = train({lang: [p for i, p in enumerate(ps) if not aside(i, p)] or ps for lang, ps in samples.items()})
        own, other, gap, wrong = held_out(rest, [fold(p) for _, p in held], [lang for lang, _ in held])
        thresholds(model, float(np.quantile(own, 0.001)), float(np.median(other)), float(np.median(gap)), int(np.count_nonzero(wrong)), len(held))
    return model


def find_sentences(docs: DataFrame, key: str, text: str, label: str | None = None) -> DataFrame:
    """(k, part, l, start, end, s): of each text its whole sentences, folded, the code of its label and one of PARTS parts by its key."""
    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    code = label_code(F.col(f"`{label}`")) if label else F.lit(None).cast("string")
    d = docs.select(F.col(f"`{key}`").alias("k"), F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(PARTS)).cast("int").alias("part"), code.alias("l"), F.col(f"`{text}`").alias("t")).where("t is not null and t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                found = [sentences(t) for t in b.column("t").to_pylist()]
                offsets = pa.array(np.append(0, np.cumsum([len(f) for f in found])), pa.int32())
                flat = [x for f in found for x in f]
                values = (pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2].lower() for x in flat], pa.string()))  # prose has single blanks, so this is fold()
                columns = [pa.ListArray.from_arrays(offsets, v) for v in values]
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("part"), b.column("l"), *columns], names=["k", "part", "l", "start", "end", "s"])

    return d.mapInArrow(run, f"k {kind}, part int, l string, start array<int>, end array<int>, s array<string>")


def merged(totals: dict, key: object, keys: np.ndarray, counts: np.ndarray) -> None:
    """Add the counts of sorted keys to those that totals has under key."""
    if key in totals:
        both, of = np.unique(np.concatenate([totals[key][0], keys]), return_inverse=True)
        keys, counts = both, np.bincount(of, np.concatenate([totals[key][1], counts])).astype(np.int64)
    totals[key] = (keys, counts)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str], list[list[str]]]]:
    """(parts, labels, sentences) of some documents at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            b = whole.slice(at, SLICE)
            yield b.column("part").to_pylist(), b.column("l").to_pylist(), b.column("s").to_pylist()


TRIPLE_COUNTS = "part int, l string, triple long, n long"


def count_triples(totals: dict, parts: list[int], labels: list[str], texts: list[list[str]]) -> None:
    groups: dict[tuple[int, str], list[str]] = {}
    for q, lang, ss in zip(parts, labels, texts, strict=True):
        groups.setdefault((q, lang), []).extend(ss)
    for group, ss in groups.items():
        if ss:
            merged(totals, group, *np.unique(char_triples(ss)[0], return_counts=True))


def counted(totals: dict) -> Iterator[pa.RecordBatch]:
    for (q, lang), (keys, n) in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([q] * len(keys), pa.int32()), pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n, pa.int64())], names=["part", "l", "triple", "n"])


def sound_rows(parts: list[int], labels: list[str], texts: list | None, triples: list | None, times: list | None) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "l": pa.string(), "s": pa.list_(pa.string()), "triples": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}
    columns = [pa.nulls(len(parts), kind) if x is None else pa.array(x, kind) for x, kind in zip((parts, labels, texts, triples, times), kinds.values(), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[*kinds])


@dataclass
class Votes:
    """How well the triples of each label's documents fit, those of one part left out."""

    names: list[str]
    keys: np.ndarray
    logs: np.ndarray  # of each label: the parts, one after the other, with a value for each key

    def of(self, texts: list[str], part: np.ndarray) -> np.ndarray:
        if len(texts) > AT_ONCE:
            return np.concatenate([self.of(texts[at : at + AT_ONCE], part[at : at + AT_ONCE]) for at in range(0, len(texts), AT_ONCE)])
        triples, of = char_triples(texts)
        at = lookup(self).find(triples)[0] + part[of] * len(self.keys)
        starts = np.append(0, np.cumsum([len(t) for t in texts])[:-1])  # no text is empty
        return np.stack([np.add.reduceat(row[at], starts) for row in self.logs]).argmax(axis=0)


def by_part(counts: DataFrame, keys: np.ndarray | None = None, names: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(how often each triple occurs by part and label, triples, labels). counts: TRIPLE_COUNTS. keys and names: what a first count had."""
    t = counts.groupBy("part", "l", "triple").agg(F.sum("n").alias("n")).toArrow()
    triple, n = t.column("triple").to_numpy(), t.column("n").to_numpy()
    keys, names = np.unique(triple) if keys is None else keys, sorted(set(t.column("l").unique().to_pylist())) if names is None else names
    label = np.array([names.index(x) for x in t.column("l").unique().to_pylist()], np.int64)[t.column("l").combine_chunks().dictionary_encode().indices.to_numpy()] if len(t) else np.zeros(0, np.int64)
    c = np.zeros((PARTS, len(names), len(keys)))
    c[t.column("part").to_numpy(), label, np.searchsorted(keys, triple)] = n
    return c, keys, names


def votes_of(c: np.ndarray, keys: np.ndarray, names: list[str]) -> Votes:
    """From what by_part() gave."""
    whole = c.sum(axis=0)
    logs = np.empty((len(names), PARTS, len(keys)), np.float32)
    for q in range(PARTS):
        rest = whole - c[q] + 0.1
        logs[:, q] = np.log(rest / rest.sum(axis=1, keepdims=True))
    return Votes(names, keys, logs.reshape(len(names), PARTS * len(keys)))


def agreeing_sentences(found: DataFrame) -> tuple[DataFrame, str] | None:
    """Table of the different (l, s) of labelled documents without wrong labels, as agreeing() chooses them; None if there are none."""
    spark = found.sparkSession
    labelled = found.where("l is not null and size(s) > 0").select("part", "l", "s")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for x in slices(batches):
            count_triples(totals, *x)
        yield from counted(totals)

    counts, keys, names = by_part(labelled.mapInArrow(count, TRIPLE_COUNTS))
    if not len(keys):
        return None
    voting = spark.sparkContext.broadcast(votes_of(counts, keys, names))

    def sound(batches: Iterator[pa.RecordBatch], kept=voting) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        v, gone = kept.value, {}
        for parts, labels, texts in slices(batches):
            n = [len(ss) for ss in texts]
            flat, doc = [x for ss in texts for x in ss], np.repeat(np.arange(len(texts)), n)
            label = np.array([v.names.index(x) for x in labels])[doc]
            right, size = v.of(flat, np.array(parts)[doc]) == label, np.array([len(x) for x in flat])
            good = 2 * np.bincount(doc, size * right, len(texts)) >= np.bincount(doc, size, len(texts))
            stay, go = np.flatnonzero(good), np.flatnonzero(~good)
            count_triples(gone, *([x[i] for i in go] for x in (parts, labels, texts)))
            yield sound_rows([parts[i] for i in stay], [labels[i] for i in stay], [texts[i] for i in stay], None, None)
        for (q, lang), (triples, times) in gone.items():
            yield sound_rows([q], [lang], None, [triples], [times])

    # the documents that stay, and beside them how often triples occur in those that go, which are far fewer
    judged, judged_path = materialise(labelled.mapInArrow(sound, "part int, l string, s array<string>, triples array<long>, times array<long>"), "sound")
    gone = judged.where("triples is not null").select("part", "l", F.explode(F.arrays_zip("triples", "times")).alias("x")).select("part", "l", F.col("x.triples").alias("triple"), F.col("x.times").alias("n"))
    counts -= by_part(gone, keys, names)[0]
    second = spark.sparkContext.broadcast(votes_of(counts, keys, names))

    def agree(batches: Iterator[pa.RecordBatch], kept=second) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        v, seen = kept.value, set()
        for parts, labels, texts in slices(batches):
            if len(seen) > SEEN:
                seen.clear()
            rows = {(q, lang, x) for q, lang, ss in zip(parts, labels, texts, strict=True) for x in ss if (lang, x) not in seen}
            if rows:
                right = v.of([x for _, _, x in rows], np.array([q for q, _, _ in rows]))
                held = {(lang, x) for (_, lang, x), w in zip(rows, right, strict=True) if v.names[w] == lang}
                seen |= held
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.string()), pa.array([x for _, x in held], pa.string())], names=["l", "s"])

    out, path = materialise(judged.where("s is not null").select("part", "l", "s").mapInArrow(agree, "l string, s string").distinct(), "agreeing")
    discard(spark, judged_path)
    lone = sorted(set(names) - {r.l for r in out.select("l").distinct().collect()})
    if lone:
        out, more = materialise(out.unionByName(labelled.where(F.col("l").isin(lone)).select("l", F.explode("s").alias("s")).distinct()), "agreeing")
        discard(spark, path)
        path = more
    return out, path


def fit_on(docs: DataFrame, key: str, text: str, label: str) -> Models:
    """Models from all labelled documents and their whole texts; labels that are wrong don't count."""
    found, path = materialise(find_sentences(docs, key, text, label), "sentences")
    models = fit_found(found)
    discard(docs.sparkSession, path)
    return models


def fit_found(found: DataFrame) -> Models:
    """fit_on() of what find_sentences() gave, which is read several times.

    The same as fit(agreeing()) of all documents, by their parts, with the sentences held out whose CRC32 is a multiple of PARTS."""
    spark = found.sparkSession
    chosen = agreeing_sentences(found)
    if chosen is None:
        return fit({"en": ["the"]})
    table, path = chosen
    held = F.pmod(F.crc32(F.col("s").cast("binary")), F.lit(PARTS)) == 0
    sizes = table.groupBy("l").agg(F.count("*").alias("n"), F.count_if(held).alias("held")).collect()
    all_held = [r.l for r in sizes if r.n == r.held]  # they teach all the same
    table = table.select("l", "s", held.alias("held"), (~held | F.col("l").isin(all_held)).alias("rest"))

    def chars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rest, mine in b.groupby("rest")["s"]:
                points, n = np.unique(np.frombuffer("".join(mine).encode("utf-32-le", "replace"), np.uint32), return_counts=True)
                yield pd.DataFrame({"rest": rest, "ch": points.astype(np.int64), "n": n})

    totals: list[Counter] = [Counter(), Counter()]
    for r in table.select("rest", "s").mapInPandas(chars, "rest boolean, ch long, n long").groupBy("rest", "ch").agg(F.sum("n").alias("n")).collect():
        totals[0][chr(r.ch)] += r.n
        if r.rest:
            totals[1][chr(r.ch)] += r.n
    alphabets = [alphabet_of(t) for t in totals]
    known = spark.sparkContext.broadcast(alphabets)

    def grams(batches: Iterator[pd.DataFrame], kept=known) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        totals: dict = {}
        for b in batches:
            for which, alphabet in enumerate(kept.value):
                for lang, mine in (b[b["rest"]] if which else b).groupby("l")["s"]:
                    merged(totals, (which, lang), *count_grams(list(mine), alphabet))
        for (which, lang), (keys, n) in totals.items():
            yield pd.DataFrame({"which": which, "l": lang, "gram": keys, "n": n})

    counts = table.select("rest", "l", "s").mapInPandas(grams, "which int, l string, gram long, n long").groupBy("which", "l", "gram").agg(F.sum("n").alias("n"))
    counts, counts_path = materialise(counts, "grams")

    def model(which: int) -> Models:
        of = {}
        for r in sizes:
            t = counts.where((F.col("which") == which) & (F.col("l") == r.l)).select("gram", "n").toArrow()
            order = np.argsort(keys := t.column("gram").to_numpy())
            of[r.l] = (keys[order], t.column("n").to_numpy()[order])
        return model_of(of, alphabets[which])

    models = model(0)
    if len(models.languages) > 1 and any(r.held for r in sizes):
        rest = spark.sparkContext.broadcast(model(1))

        def judge(batches: Iterator[pd.DataFrame], kept=rest) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            for b in batches:
                for at in range(0, len(b), 4096):
                    x = b.iloc[at : at + 4096]
                    yield pd.DataFrame(dict(zip(("own", "other", "gap", "wrong"), held_out(kept.value, x["s"].tolist(), x["l"].tolist()), strict=True)))

        # quantiles of values to five places, so that the numbers of different ones that they are taken from are bounded
        five = lambda c, q: F.percentile(F.round(c, 5), q).alias(c)
        r = table.where("held").select("l", "s").mapInPandas(judge, "own double, other double, gap double, wrong boolean").agg(five("own", 0.001), five("other", 0.5), five("gap", 0.5), F.count_if("wrong").alias("wrong"), F.count("*").alias("n")).first()
        thresholds(models, r.own, r.other, r.gap, r.wrong, r.n)
        rest.unpersist()
    discard(spark, path, counts_path)
    return models


def segment_languages(docs: DataFrame, key: str, text: str, models: Models) -> DataFrame:
    """(key, start, end, lang, confidence, n_chars): the language of each whole sentence, neighbours of one language as one segment.

    start and end count characters. lang is null where the rejection found no language; texts without prose have no rows.
    Repeated rows are each read. Null and empty texts have no rows.
    """
    return segments_of(find_sentences(docs, key, text), key, models)


def segments_of(found: DataFrame, key: str, models: Models) -> DataFrame:
    """segment_languages() of what find_sentences() gave."""
    kept = found.sparkSession.sparkContext.broadcast(models)
    kind = found.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                start, end = (b.column(c).flatten().to_numpy() for c in ("start", "end"))
                if not len(start):
                    continue
                owner = np.repeat(np.arange(b.num_rows), b.column("s").value_lengths().to_numpy())
                s, n = score_folded(m, b.column("s").flatten().to_pylist())
                top = np.sort(s, axis=1)
                gap = top[:, -1] - top[:, -2] if s.shape[1] > 1 else np.ones(len(s))
                sure = 1 / (1 + np.exp(-m.scale * gap))
                best = np.where(top[:, -1] >= m.reject, s.argmax(axis=1), len(m.languages))
                first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (best[1:] != best[:-1])))
                chars = np.add.reduceat(n, first)
                columns = [b.column("k").take(pa.array(owner[first])), pa.array(start[first], pa.int32()), pa.array(end[np.append(first[1:], len(end)) - 1], pa.int32()), pa.array([*m.languages, None], pa.string()).take(pa.array(best[first])), pa.array(np.add.reduceat(sure * n, first) / chars), pa.array(chars, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "start", "end", "lang", "confidence", "n_chars"])

    return found.select("k", "start", "end", "s").mapInArrow(run, f"k {kind}, start int, end int, lang string, confidence double, n_chars int").withColumnRenamed("k", key)
