import random

import numpy as np
from pyspark.sql import functions as F

from stratigraph.llm import language as L

TEXTS = {
    "en": ["The build step reads the last file.", "Every worker keeps the names of the packages.", "Could you add a test for this?", "The queue is empty after the refresh."],
    "de": ["Der Bauschritt liest die letzte Datei.", "Jeder Arbeiter behält die Namen der Pakete.", "Könntest du dafür bitte einen Test schreiben?", "Die Warteschlange ist nach dem Lauf leer."],
    "ru": ["Шаг сборки читает последний файл.", "Каждый процесс хранит имена пакетов.", "Можно добавить для этого тест?", "Очередь пуста после обновления."],
}


def docs(spark, n=240):
    r = random.Random(4)
    rows = []
    for i in range(n):
        c = r.choice(list(TEXTS))
        rows.append((i, " ".join(r.choices(TEXTS[c], k=4)), {"en": "English", "de": "de_DE", "ru": " rus"}[c] if i % 20 else "en", c))
    mixed = " ".join(TEXTS["en"][:2] + TEXTS["de"][:2])
    rows += [(1000, None, "en", None), (1001, " \n", None, None), (1002, "for (let i = 0; i < n; i++) {\n  log(i);\n}", None, None), (1003, mixed, "en", None)]
    rows += [(1004, TEXTS["de"][2].encode().decode("latin-1") + " " + TEXTS["de"][1].encode().decode("latin-1"), "xx", "de"), (1005, TEXTS["en"][0] + " " + TEXTS["de"][0] + " " + TEXTS["en"][1], "en", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string"), rows


def test_labels_mixed_and_odd_texts(spark):
    df, rows = docs(spark)
    names = spark.createDataFrame([("en", "English", "eng"), ("de", "German", "deu"), ("ru", "Russian", "rus")], "code string, name string, iso3 string")
    m = L.train_on(df, names)
    assert m.accuracy > 0.95
    segs = L.segments(df, m, label=L.label_code(F.col("lang"), names))
    got = {(r.doc_id, r.lang): r for r in L.document_languages(segs).collect()}
    for i, t, _, c in rows[:240]:
        assert (i, c) in got and got[i, c].n_langs == 1
    assert not any(k[0] in (1000, 1001, 1002) for k in got)
    assert {k for k in got if k[0] == 1003} == {(1003, "en"), (1003, "de")}
    assert (1004, "de") in got and {k for k in got if k[0] == 1005} == {(1005, "en")}
    found = {(r.doc_id, r.lang) for r in L.wrong_labels(L.document_languages(segs)).collect()}
    assert found == {(i, c) for i, _, lab, c in rows[:240] if lab == "en" and c != "en"} | {(1003, "en"), (1003, "de"), (1004, "de")}
    text = rows[-3][1]
    spans = sorted((r.seg_start, r.seg_end, r.lang) for r in segs.where("doc_id = 1003").collect())
    assert rows[243][0] == 1003 and [x[2] for x in spans] == ["en", "de"]
    assert rows[243][1][spans[1][0] : spans[1][1]].startswith("Der Bauschritt") and text is not None


def test_empty(spark):
    df, _ = docs(spark, 5)
    names = spark.createDataFrame([("en", "English", "eng"), ("de", "German", "deu")], "code string, name string, iso3 string")
    m = L.train_on(df.limit(0), names)
    assert L.segments(df.limit(0), m).count() == 0


def test_features_count_every_ngram():
    idx, counts = L.features(["ab", "", "abc"])
    # " ab " has 4+3+2+1 n-grams and 2 letters; "  " has 2+1; " abc " has 5+4+3+2 and 3
    assert counts.tolist() == [12, 3, 17] and len(idx) == 32 and (idx >= 0).all() and (idx < L.BUCKETS).all()
    v = L.weights_of(idx, counts, np.ones(L.BUCKETS))
    assert np.isclose(v[:12].sum(), L.SCALE)


def test_sentences_skip_code_and_names():
    s = [x[2] for x in L.sentences("> link(rows, limit)\n\nThe parser reads `a_b` twice.\nlet x = 1;\n```\nrun --all\n```\npath: a/b.ts:12")]
    assert s == ["the parser reads twice"]
