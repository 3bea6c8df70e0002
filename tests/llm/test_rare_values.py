"""Rare languages and suffixes, plain-word secrets, and batches of very many rows without text."""

import pyarrow as pa
from pyspark.sql import functions as F

from maskmix.llm import common
from maskmix.llm.common import regroup
from maskmix.llm.language import identify_documents, identify_pages
from maskmix.llm.secrets import find_secrets, redact

EN, DE, EL = "the house and the garden of the king ", "das haus und der garten des koenigs ist ", "το σπίτι και ο κήπος του βασιλιά "


def test_a_language_of_four_texts_stays(spark):
    rows = [(i, (EN if i % 2 else DE) * 3, "en" if i % 2 else "de", "h") for i in range(60)]
    rows += [(100 + i, EL * 3, "el", "h") for i in range(4)] + [(200, "123", "el", "h"), (201, None, "el", "h")]
    found = identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = {r[0]: r[-1] for r in found.collect()}
    assert all((got[100 + i].language, got[100 + i].accepted) == ("el", True) for i in range(4))
    assert [got[i].accepted for i in (200, 201)] == [False] * 2
    assert all(got[i].language == ("en" if i % 2 else "de") for i in range(60))


def test_only_rare_languages(spark):
    rows = [(0, "abc def", "xx", "h"), (1, "12", "xx", "h"), (2, None, None, None)]
    found = identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = {r[0]: r[-1] for r in found.collect()}
    assert (got[0].language, got[0].accepted) == ("xx", True) and not got[1].accepted and got[2].language == "und"


def test_every_one_of_a_thousand_suffixes_counts(spark):
    def page(i, suffix, text, lang):
        return (i, f"<html lang='{lang}'><p>{text}</p>" if lang else f"<p>{text}</p>", f"http://w{i}.x{i}.s{suffix}/a")

    rows = [page(i, chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676), (EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(1000)]
    rows += [page(5000 + k, "rare", EN, "en") for k in range(6)] + [page(6000, "rare", "a", None)]
    found = identify_pages(spark.createDataFrame(rows, "page_id long, html string, url string"))
    got = {r[0]: r[-1] for r in found.collect()}
    assert len(got) == 1007 and got[6000].language == "en"  # by its suffix, which is among a thousand others


def test_plain_words_behind_a_label(spark):
    texts = [
        ("a", "password=hunter22 here", "password=[SECRET] here"),
        ("a", "password=correcthorse", "[SECRET]"),
        ("a", "password=changeme", None), ("a", "x password=changeme", None), ("a", "y password=changeme", None),
        ("a", "secret=letmein", None), ("b", "secret=letmein", None),
    ]
    df = spark.createDataFrame([(i, t, s) for i, (s, t, _) in enumerate(texts)], "doc_id long, text string, source string")
    found = find_secrets(df)
    clean = {r[0]: r[1] for r in found.select("doc_id", redact(F.col("text"), F.col(found.columns[-1]))).collect()}
    assert clean[0] == "[SECRET] here" and clean[1] == "[SECRET]"
    assert [clean[i] for i in range(2, 7)] == [texts[i][1] for i in range(2, 7)]


def test_batches_bound_their_rows():
    texts = pa.array([None] * 300_000 + ["x" * 3_000_000, "", "y"])
    batch = pa.RecordBatch.from_arrays([texts, pa.array(range(len(texts)))], names=["t", "n"])
    made = list(regroup([batch.slice(0, 1), batch.slice(1)], "t"))
    assert max(b.num_rows for b in made) <= common.BATCH_ROWS
    assert [n for b in made for n in b.column(1).to_pylist()] == list(range(len(texts)))
