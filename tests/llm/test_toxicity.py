import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from drayage.llm import queries, toxicity
from tests.conftest import DATA

LARGER = DATA.replace("0.001", "0.1")


def test_windows_and_doubling():
    assert toxicity.windows(b"...word!") == [b"word"]
    long = bytes(range(97, 123)) * 4
    cut = toxicity.windows(long)
    assert all(len(w) <= toxicity.WINDOW for w in cut) and cut[0] + b"".join(w[20:] for w in cut[1:]) == long
    assert toxicity.twice(b"ab") == bytes((97, 97 ^ 0x5A, 98, 98 ^ 0x5A))


def test_held_out_accuracy(spark):
    scored = queries.op8_toxicity(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id")
    rows = scored.filter("held_out").select("toxic", "predicted", "score").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    right = sum(r.toxic == r.predicted for r in rows) / len(rows)
    clean = sum(r.predicted for r in rows if r.toxic == 0) / sum(r.toxic == 0 for r in rows)
    caught = sum(r.predicted for r in rows if r.toxic == 1) / sum(r.toxic == 1 for r in rows)
    assert right > 0.97 and clean < 0.01 and caught > 0.8


def test_held_out_rows_are_never_trained_on(spark):
    ids = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", queries.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in ids)


def test_a_single_toxic_word_convicts():
    draw = random.Random(4)
    syllables = "an be co du el fi go hu in jo ka lo me no or pa".split()

    def text():
        return " ".join("".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(60))

    ordinary = [text() for _ in range(400)]
    toxic = [f"{text()} {draw.choice(('rotten', 'vilest', 'wretch'))} {text()}" for _ in range(150)]
    judge = toxicity.Judge(toxicity.fit(toxic, ordinary))
    held = [text() for _ in range(100)]
    assert sum(judge.score(t) >= 0.5 for t in held) <= 2
    assert sum(judge.score(f"{t} rotten! {text()}") >= 0.5 for t in held) >= 95


def test_odd_rows(spark, odd_documents, no_documents):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    model = queries.toxicity_model(spark, docs, LARGER)
    rows = toxicity.score(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.id in (4, 5, None)} | {toxicity.Judge(model).score("")}) <= 2
    kept = toxicity.accepted(odd_documents.withColumn("row", F.lit(1)), model)
    assert kept.count() == sum(r.score < 0.5 for r in rows) and kept.columns[-1] == "row"
    assert toxicity.score(no_documents, model).isEmpty() and toxicity.accepted(no_documents, model).isEmpty()


def test_without_labels_nothing_is_rejected(spark, odd_documents):
    labels = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int")
    assert toxicity.train(odd_documents, labels) is None
    assert toxicity.accepted(odd_documents, None).count() == odd_documents.count()


SYLLABLES = "an be co du el fi go hu in jo ka lo me no or pa".split()


def _filler(draw, words):
    return " ".join("".join(draw.choices(SYLLABLES, k=draw.randint(1, 3))) for _ in range(words))


def test_words_of_few_texts_are_learnt():
    draw = random.Random(11)
    rare = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(210)]
    toxic = [f"{_filler(draw, 30)} {rare[i % 210]} {_filler(draw, 30)}" for i in range(1470)]
    judge = toxicity.Judge(toxicity.fit(toxic, [_filler(draw, 60) for _ in range(4000)]))
    assert sum(judge.score(f"{_filler(draw, 30)} {w}, {_filler(draw, 30)}") >= 0.5 for w in rare) >= 189
    assert sum(judge.score(_filler(draw, 60)) >= 0.5 for _ in range(500)) <= 5


def test_ordinary_words_can_be_toxic_in_a_row():
    draw = random.Random(12)
    words = ["hupa", "elgo", "comein"]
    toxic = [f"{_filler(draw, 40)} {' '.join(words)} {_filler(draw, 40)}" for _ in range(400)]
    ordinary = [f"{_filler(draw, 40)} {' '.join(draw.sample(words, 2))} {_filler(draw, 40)}" for _ in range(1500)]
    judge = toxicity.Judge(toxicity.fit(toxic, ordinary))
    assert sum(judge.score(f"{_filler(draw, 40)} Hupa elgo comein! {_filler(draw, 40)}") >= 0.5 for _ in range(200)) >= 160
    for clean in ("hupa elgo", "comein elgo hupa", "elgo comein", "hupa an elgo be comein"):
        assert sum(judge.score(f"{_filler(draw, 40)} {clean} {_filler(draw, 40)}") >= 0.5 for _ in range(100)) <= 1


def test_long_labelled_texts_are_learnt_from(spark):
    draw = random.Random(13)
    filler = [_filler(draw, 400) for _ in range(60)]
    rows = [(i, " ".join(draw.sample(filler, 14)).replace(" be ", " vilest ")) for i in range(40)]
    assert all(len(t) > toxicity.TRAIN_CHARS for _, t in rows)
    rows += [(100 + i, draw.choice(filler)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judge = toxicity.Judge(toxicity.train(docs, docs.selectExpr("doc_id", "int(doc_id < 100) AS toxic")))
    assert judge.score(f"{_filler(draw, 30)} vilest {_filler(draw, 30)}") > judge.score(_filler(draw, 60))
    assert judge.score(rows[0][1]) >= 0.5 > judge.score(rows[-1][1])


def test_finds_are_significant():
    toxic = [np.array([1, 2] if i < 3 else [2, 9], np.uint64) for i in range(100)]
    ordinary = [np.array([2, 7], np.uint64)] * 900
    assert toxicity._telling(toxic, ordinary, 900, toxicity.CHANCE).tolist() == [1, 9]
    assert toxicity._telling(toxic, [np.array([1], np.uint64)] * 900, 900, toxicity.CHANCE).tolist() == [2, 9]
    assert toxicity._telling(toxic[:2], ordinary, 900, toxicity.CHANCE).tolist() == []
