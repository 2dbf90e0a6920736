import random

from pyspark.sql import functions as F

from assayflow.llm import language as lang
from assayflow.llm.leaks import common_words, leaked_items
from assayflow.llm.reference import Tree, distance, map_to_reference
from assayflow.llm.words import words


def test_words_are_the_same_in_any_dress():
    plain = "Größere Änderung: naïve file 12"
    for dressed in ("GRÖSSERE   änderung\nnaïve FILE 12", "Größere Än­derung naïve​ file 12", "Größere Änderung; nаïve filе 12", "Größere Änderung naïve ﬁle １２"):
        assert words(dressed) == words(plain)
    assert words("") == [] and words("日本") == ["日", "本"]


def test_common_words_against_dynamic_programming():
    import numpy as np

    r = random.Random(1)
    for _ in range(30):
        a, b = [r.randrange(1, 8) for _ in range(r.randrange(1, 90))], [r.randrange(1, 8) for _ in range(r.randrange(0, 90))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert common_words(np.array(a), np.array(b, dtype=int)) == t[-1][-1]


def leak_rows():
    r = random.Random(11)
    common = "the strain was read again before the plates were moved".split()
    code = lambda: f"{r.choice('ABCDEFGH')}{r.choice('JKLMNP')}-{r.randrange(10**5)}"
    sentence = lambda: " ".join(w for c in common for w in ([c, code()] if r.random() < 0.35 else [c])) + "."
    items = [(i, " ".join(sentence() for _ in range(6))) for i in range(12)]
    noise = lambda: " ".join(sentence() for _ in range(10))
    docs, want = [], set()
    for i, text in items:
        ws = text.split()
        changed = [("other" if k % 9 == 4 else w) for k, w in enumerate(ws)]
        half = len(ws) // 2
        forms = [text, text.upper(), "  ".join(ws), " ".join(changed), " ".join(ws[: int(len(ws) * 0.6)]), " ".join(ws[:half]) + ". " + noise() + " " + " ".join(ws[half:])]
        for f in forms:
            docs.append((len(docs), noise() + "\n" + f + "\n" + noise(), "z"))
            want.add((docs[-1][0], i))
        docs.append((len(docs), noise() + " " + " ".join(ws[5:17]) + " " + noise(), "z"))  # a short quotation
    docs += [(1000 + k, noise(), "z") for k in range(40)] + [(2000, None, "z"), (2001, "", "z"), (2002, "x" * 50000, "z"), (0, docs[0][1], "z")]
    return docs, items, want


def test_leaks(spark):
    docs, items, want = leak_rows()
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame([*items, (99, None), (98, "two words")], "item long, body string")
    got = {(x.doc_id, x.item) for x in leaked_items(d, "doc_id", "text", i, "item", "body").collect()}
    assert got == want
    assert leaked_items(d.limit(0), "doc_id", "text", i, "item", "body").count() == 0
    assert leaked_items(d, "doc_id", "text", i.limit(0), "item", "body").count() == 0


def test_short_items_leak_too(spark):
    """Items of a few words, against a search of the words themselves, in a corpus of few documents."""
    items = [(1, "zorvic pelmon trask"), (2, "quill harbax venno dril"), (3, "mossel tarn quib loden frask wend"), (4, "two words")]
    noise = "the strain was read again before the plates were moved "
    docs = [(k, noise + t.upper() + ", " + noise) for k, (_, t) in enumerate(items)] + [(10, noise * 5), (11, "zorvic then pelmon then trask " + noise)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item long, body string")
    assert {(x.doc_id, x.item) for x in leaked_items(d, "doc_id", "text", i, "item", "body").collect()} == {(0, 1), (1, 2), (2, 3)}


def test_passages_leak_however_common_they_are(spark):
    """A half of an item in a third of all documents, and an item of phrases that stand in many documents, against runs compared word by word."""
    r = random.Random(23)
    vocab = ["".join(r.choice("abdegklmnorstu") for _ in range(6)) for _ in range(4000)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    phrases = [text(12) for _ in range(6)]
    items = [(1, text(100)), (2, " ".join(f"{p} {text(1)}" for p in phrases)), (3, text(80))]
    half, third = " ".join(items[0][1].split()[:58]), " ".join(items[0][1].split()[:33])
    joined = " ".join(items[1][1].split()[:44])
    docs = [(k, f"{text(40)} {half if k < 40 else ' '} {text(40)}") for k in range(60)]
    docs += [(100 + k, f"{text(30)} {phrases[k % 6]} {text(30)} {phrases[(k + 2) % 6]} {text(9)}") for k in range(60)]
    docs += [(200, f"{text(20)} {joined} {text(20)}"), (201, f"{text(20)} {third} {text(20)}"), (202, items[1][1]), (203, f"{text(50)} {items[2][1]}")]

    def holds(item: str, doc: str) -> bool:
        a, b = words(item), words(doc)
        runs = {tuple(b[j : j + 10]) for j in range(len(b) - 9)}
        return 2 * len({p + k for p in range(len(a) - 9) if tuple(a[p : p + 10]) in runs for k in range(10)}) >= len(a)

    want = {(k, i) for k, d in docs for i, t in items if holds(t, d)}
    assert {(k, 1) for k in range(40)} | {(200, 2), (202, 2), (203, 3)} == want
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item long, body string")
    assert {(x.doc_id, x.item) for x in leaked_items(d, "doc_id", "text", i, "item", "body").collect()} == want


def test_distance_is_a_metric():
    r = random.Random(4)
    ws = ["".join(r.choice("abc") for _ in range(r.randrange(7))) for _ in range(25)]
    d = {(a, b): distance(a, b, 99) for a in ws for b in ws}
    assert all(d[a, b] == d[b, a] and (d[a, b] == 0) == (a == b) for a in ws for b in ws)
    assert all(d[a, c] <= d[a, b] + d[b, c] for a in ws for b in ws for c in ws)
    assert distance("ca", "abc", 9) == 2 and distance("abcd", "abdc", 9) == 1


def test_tree_against_brute_force():
    r = random.Random(6)
    names = sorted({"".join(r.choice("abcde") for _ in range(r.randrange(3, 9))) for _ in range(120)})
    tree = Tree(names)
    for _ in range(60):
        q = "".join(r.choice("abcde") for _ in range(r.randrange(3, 9)))
        assert tree.within(q, 2) == sorted((distance(q, n, 99), n) for n in names if distance(q, n, 99) <= 2)


def test_places(spark):
    names = ["Berlestán", "Lunbasaland", "Lunbasaland-Vinleu", "North Ullanlis", "South Ullanlis", "United Provinces of Lunleledor", "Tammubique", "Karledor Islands"]
    want = {
        "berlestan": "Berlestán", "BERLESTÁN: Kuopa": "Berlestán", "Lunbasaland: Berlestán Street clinic": "Lunbasaland", "Lunbasaland-Vinleu": "Lunbasaland-Vinleu", "N. Ullanlis": "North Ullanlis", "Republic of Tammubique": "Tammubique",
        "Tammubique, Republic of": "Tammubique", "Unit. Prov. of Lunleledor": "United Provinces of Lunleledor", "Lunleledor, United Provinces of:Kuopa": "United Provinces of Lunleledor", "UPL (Lunl.)": "United Provinces of Lunleledor", "Kuopa (Tammubique)": "Tammubique",
        "Kuopa, tammubique": "Tammubique", "Tamubbique?": "Tammubique", "BerlestÃ¡n": "Berlestán", "North_Ullanlis": "North Ullanlis", "Karledor Is.": "Karledor Islands", "Ullanlis": None, "research vessel": None, "Kjepuxx: 9": None, "": None, " ": None, "x" * 3000: None,
    }
    df = spark.createDataFrame([(t, "q") for t in [*want, None, "berlestan"]], "place string, name string")
    ref = spark.createDataFrame([(n,) for n in [*names, None, "Tammubique"]], "name string")
    got = {x.place: x.name for x in map_to_reference(df, "place", ref, "name").collect()}
    assert {k: v for k, v in got.items() if want[k] != v} == {} and got.keys() == want.keys()
    assert map_to_reference(df, "place", ref.limit(0), "name").where("name is not null").count() == 0


def test_places_in_several_shards(spark, monkeypatch):
    """A list in shards gives what it gives in one tree: winners merge, and ties between shards stay unmatched."""
    from assayflow.llm import reference

    r = random.Random(9)
    names = sorted({"".join(r.choice("abcdelnorst") for _ in range(r.randrange(8, 13))).title() for _ in range(90)} | {"Tarsolen", "Tarsolan"})
    texts = [n.lower() for n in names[::3]] + [n[:-1] + "x" for n in names[1::3]] + ["Tarsolin", "Tarsolen: Kuopa", "nothing of it", "", None]
    df, ref = spark.createDataFrame([(t,) for t in texts], "place string"), spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    one = {x.place: x.name for x in map_to_reference(df, "place", ref, "name").collect()}
    monkeypatch.setattr(reference, "SHARD", 20)
    assert {x.place: x.name for x in map_to_reference(df, "place", ref, "name").collect()} == one
    assert one["Tarsolin"] is None and sum(v is not None for v in one.values()) > 50


def test_sentences_cost_what_they_are_long():
    """A part with too few letters is left as soon as it is read, however its letters are spread, and texts take far less time than plain patterns do."""
    import re
    import time

    def seconds(f) -> float:  # noqa: ANN001
        took = []
        for _ in range(5):
            t = time.thread_time()
            f()
            took.append(time.thread_time() - t)
        return min(took)

    few = "a b c d e f g h i j k" + " -" * 4000 + " ."
    assert lang.prose_of(few) is None and seconds(lambda: lang.prose_of(few)) < 50 * seconds(lambda: lang.LETTER.findall(few))

    stop = re.compile(r"[.!?\u2026][\"'\u201d\u00bb)\]]*[\s\u200b]+(?=[^\W\da-z\u00df-\u00f6\u00f8-\u00ff\u0430-\u044f]|[\d\[(\"'\u00ab\u201c])|[\u3002\uff01\uff1f]")
    codes = re.compile(r"<[^<>]{1,20}>|\[[^\]]{0,60}\]|\([^)]{0,60}\)|(?:[A-Z]{2}-)?\d+(?:[.,/]\d+)*(?:\s?(?:mg/[lL]|мг/л))?")
    r = random.Random(2)
    pieces = ["The plate AB-12 was read", " (see 3)", " [x]", " <b>", ". ", ".\n", "。", "！？", " 4,5 mg/L", " ½ мг/л", "Größe", " Żaden", " X1-A-3 CD", "…\") ", "  ", "'", "漢字", "²3", "\u200b"]
    texts = ["".join(r.choice(pieces) for _ in range(40)) for _ in range(300)]
    for new, plain, text in ((lang.STOP, stop, texts), (lang.CODES, codes, texts)):
        assert all([m.span() for m in new.finditer(t)] == [m.span() for m in plain.finditer(t)] for t in text)
    prose = ["The plate was read twice because the sign was missing from the form that nobody had kept. " * 20] * 50
    for new, plain in ((lang.STOP, stop), (lang.CODES, codes)):
        assert seconds(lambda p=new: [p.sub("0", t) for t in prose]) < 0.8 * seconds(lambda p=plain: [p.sub("0", t) for t in prose])
    for t in texts:
        for p in (t, t.rstrip(), t + "." + "-" * 12, t + "." + "-" * 12 + "\n", t + "." + "-" * 13):
            assert bool(lang.ENDED.search(p)) == bool(lang.ENDED.search(p, max(0, len(p) - 14)))


SAMPLES = {
    "en": ["The plate was read twice because the sign was missing.", "Nobody in the laboratory noticed the warning until last year.", "We kept both values for the sample and reopened the entry.", "The incubator was replaced before the trays were moved."],
    "de": ["Die Platte wurde zweimal gelesen, weil das Vorzeichen fehlte.", "Niemand im Labor bemerkte die Warnung bis zum letzten Jahr.", "Wir behielten beide Werte der Probe und öffneten den Eintrag wieder.", "Der Brutschrank wurde ersetzt, bevor die Schalen weggebracht wurden."],
    "fr": ["La plaque a été lue deux fois parce que le signe manquait.", "Personne au laboratoire n'a remarqué l'avertissement avant l'année dernière.", "Nous avons gardé les deux valeurs et rouvert le dossier.", "L'incubateur a été remplacé avant le transfert des boîtes."],
}


def test_languages_of_sentences(spark):
    m = lang.fit({k: v * 3 for k, v in SAMPLES.items()})
    texts = [
        (1, "The value was missing because nobody read the plate.\nDie Probe wurde im Labor nicht gelesen und fehlte."), (2, None), (3, ""), (4, "TOB\t<=1\tR\nAMP\t2\tS"), (5, ">1\nACGTACGTACGTACGT"),
        (6, "Le signe de la plaque manquait avant le transfert."), (7, "The word \"Vorzeichen des Eintrags der Probe\" was kept by the laboratory."), (8, "x" * 40000), (6, "Le signe de la plaque manquait avant le transfert."),
    ]
    got = lang.segment_languages(spark.createDataFrame([(a, b, "q") for a, b in texts], "doc_id long, text string, lang string"), "doc_id", "text", m).collect()
    langs = {k: {x.lang for x in got if x.doc_id == k} for k, _ in texts}
    assert langs == {1: {"en", "de"}, 2: set(), 3: set(), 4: set(), 5: set(), 6: {"fr"}, 7: {"en"}, 8: set()}
    assert sum(x.doc_id == 6 for x in got) == 2 and all(0.5 <= x.confidence <= 1 for x in got)
    assert lang.segment_languages(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", m).count() == 0


def test_model_is_a_distribution():
    """Over all characters that may follow a context, the probabilities add up to about one."""
    import numpy as np

    m = lang.train(SAMPLES)
    for ctx in ("the", "ate", "qzx"):
        chars = [*m.alphabet, "☃"]
        total = np.zeros(len(m.languages))
        for ch in chars:
            codes = np.array([m.alphabet.get(c, 0) for c in ctx + ch])
            keys = lang.pack(codes, lang.ORDER)
            s = np.zeros(len(m.languages))
            left = keys
            for n in range(lang.ORDER, 0, -1):
                k = left if n == lang.ORDER else (left & ((1 << (lang.BITS * n)) - 1)) | (n << (lang.BITS * n))
                at, hit = lang.find(m.keys, k)
                if hit[0]:
                    s += m.rows[:, at[0]]
                    break
                c = ((left & ((1 << (lang.BITS * n)) - 1)) >> lang.BITS) | ((n - 1) << (lang.BITS * (n - 1)))
                at, known = lang.find(m.contexts, c)
                if known[0]:
                    s += m.rows[:, len(m.keys) + at[0]]
            total += np.exp(s)
        assert np.all(np.abs(total - 1) < 0.15)


def test_held_out_accuracy():
    m = lang.fit({k: v * 3 for k, v in SAMPLES.items()})
    unseen = {"en": "This report was written by the second reader of the entry.", "de": "Dieser Bericht wurde von der zweiten Person im Labor geschrieben.", "fr": "Ce rapport a été écrit par la seconde personne du laboratoire."}
    s, _ = lang.score(m, list(unseen.values()))
    assert [m.languages[i] for i in s.argmax(axis=1)] == list(unseen)


def test_labels(spark):
    want = {"en_US": "en", "English": "en", "DE": "de", "es-419": "es", "fre": "fr", "und": None, "xx": None, "": None, None: None, "ja-JP": "ja", "português": "pt"}
    rows = spark.createDataFrame([(k,) for k in want], "l string").select("l", lang.label_code(F.col("l")).alias("c")).collect()
    assert {x.l: x.c for x in rows} == want


def test_wrong_labels_do_not_teach():
    """15 % of the documents have another language's label, with a stock sentence that many documents hold, once in capitals."""
    stock = {"en": "Values outside the tested range are shown with a sign.", "de": "Werte außerhalb des Bereichs tragen ein Vorzeichen.", "fr": "Les valeurs hors de la gamme portent un signe."}
    r = random.Random(3)
    docs, names = [], list(SAMPLES)
    for i in range(240):
        true = names[i % 3]
        label = names[(i + 1) % 3] if r.random() < 0.15 else true
        own = [" ".join(r.choice(SAMPLES[true]).rstrip(".").split()[: r.randrange(4, 12)]) + f" {r.choice(SAMPLES[true])}" for _ in range(4)]
        text = stock[true].upper() if i % 11 == 0 else stock[true]
        docs.append((label, [*own, text] if i % 3 != 1 or i % 2 else own))
    kept = lang.agreeing(docs)
    m = lang.fit(kept)
    for true, text in stock.items():
        assert text.lower() in kept[true] and all(text.lower() not in ps for other, ps in kept.items() if other != true)
        for t in (text, text.upper()):
            s, _ = lang.score(m, [t])
            assert m.languages[int(s.argmax())] == true and s.max() >= m.reject
    for true, texts in SAMPLES.items():
        assert {m.languages[i] for i in lang.score(m, texts)[0].argmax(axis=1)} == {true}


def test_models_know_all_labelled_documents(spark):
    """The models are those of every labelled document, to its end, made in one process; 300 documents of a language, some over 20,000 characters."""
    import zlib

    import numpy as np

    r, names = random.Random(5), list(SAMPLES)
    rare = {"en": "Quixotic zebrafish jumped over.", "de": "Jähzornige Äffchen quälten Büffel.", "fr": "Voyez çà, œuvres kiwi où."}
    docs = []
    for i in range(900):
        true = names[i % 3]
        label = names[(i + 1) % 3] if r.random() < 0.1 else true
        own = " ".join(" ".join(r.sample(x := r.choice(SAMPLES[true]).rstrip(".").split(), len(x))).capitalize() + "." for _ in range(4))
        if i >= 891:
            own, label = "TOB <=1 R\n" * 2200 + own + " " + rare[true], true
        docs.append((i, own, label))
    d = spark.createDataFrame([*docs, (2000, docs[0][1], None), (2001, None, "en"), (2002, "", "de")], "k long, t string, l string").repartition(3)
    m = lang.fit_on(d, "k", "t", "l")
    parts = {x.k: x.p for x in d.select("k", F.pmod(F.xxhash64("k"), F.lit(5)).alias("p")).collect()}
    kept = lang.agreeing([(lb, [p for _, _, p in lang.sentences(t)]) for _, t, lb in docs], part_of=[parts[k] for k, _, _ in docs])
    whole = lang.fit(kept, lambda _, p: zlib.crc32(p.encode()) % 5 == 0)
    assert m.languages == whole.languages == sorted(names) and m.alphabet == whole.alphabet
    assert (m.keys == whole.keys).all() and (m.contexts == whole.contexts).all()
    assert abs(m.reject - whole.reject) < 1e-4 and abs(m.scale / whole.scale - 1) < 1e-3
    texts = [*rare.values(), *(t for ts in SAMPLES.values() for t in ts)]
    assert np.allclose(lang.score(m, texts)[0], lang.score(whole, texts)[0], atol=2e-3)
    assert sum(p.lower() in kept[k] for k, p in rare.items()) >= 2  # they stand after character 20,000 of the last documents
    none = lang.fit_on(d.where("l is null"), "k", "t", "l")
    assert none.languages == ["en"] and lang.fit_on(d.where("k < 0"), "k", "t", "l").languages == ["en"]


def test_agreeing_edges():
    assert lang.agreeing([]) == {} and lang.agreeing([("en", []), ("de", [" "])]) == {}
    assert lang.agreeing([("en", ["One sentence alone."])]) == {"en": ["one sentence alone."]}


def test_rejection_of_an_unknown_language():
    """Sentences of a language that no model was fitted on score below the rejection, those of the models' own languages above."""
    r = random.Random(8)
    shuffled = {k: [" ".join(r.sample(x := s.rstrip(".").split(), len(x))) + "." for s in v for _ in range(12)] for k, v in SAMPLES.items()}
    m = lang.fit(shuffled)
    foreign = ["Żaden z pracowników nie zauważył ostrzeżenia wydrukowanego na formularzu.", "Gyűjtőedényből származó izolátumok újraszekvenálása megtörtént."]
    assert (lang.score(m, foreign)[0].max(axis=1) < m.reject).all()
    assert (lang.score(m, [s for v in SAMPLES.values() for s in v])[0].max(axis=1) >= m.reject).all()
