"""The whole pipeline on a small corpus, against a brute-force version of its stages."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_operators import PASSAGE, brute_components, brute_fingerprint

EN, DE = "the house and the garden of the king near a river ", "das haus und der garten des königs ist schön "


def corpus():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = []
    for i in range(40):
        base = EN if i % 2 else DE
        rows.append((i, base + " ".join(word() for _ in range(30)) + " " + base, "en" if i % 2 else "de", f"s{i % 3}", 0))
    rows += [(100 + k, rows[6][1], "de", "s9", 0) for k in range(3)]  # copies
    rows.append((110, EN * 2 + PASSAGE, "en", "s1", 0))  # a benchmark passage
    rows.append((111, EN * 3 + " ".join(word() for _ in range(20)) + " password=abc123XYZ789q end " + EN, "en", "s1", 0))
    rows += [(112, None, "en", "s1", 0), (113, "", None, None, 0), (114, "12 34 %%", "de", "s1", 0)]
    rows += [(None, EN + "no id " + DE, "en", None, None), rows[3]]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows]


def test_stages_and_rows(spark, tmp_path):
    rows = corpus()
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, kinds).withColumn("accepted", F.lit("mine")).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    without_language = {112, 113, 114}
    left = [r for r in rows if r[0] not in without_language]
    names = brute_components([brute_fingerprint(r[1]) for r in left], [r[0] for r in left])
    first = {}
    for r, name in zip(left, names):
        if r[0] == name and name not in first:
            first[name] = r
    left = [r for r in first.values() if PASSAGE not in r[1]]
    want = {r[0]: r[1].replace("password=abc123XYZ789q", "[SECRET]") for r in left}
    assert {6, 111, None} <= set(want) and not {100, 101, 102, 110} & set(want)

    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
    assert {r.doc_id: r.text for r in kept.collect()} == want and kept.count() == len(want)
    assert [(r.doc_id, r.n_chars, len(r.text)) for r in kept.collect() if r.n_chars != len(r.text) or r.accepted != "mine"] == []

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4") for i, t in want.items()}
    assert {(r.doc_id, r.length, r.ids_crc32) for r in got} == {(i, len(x), zlib.crc32(x.tobytes())) for i, x in ids.items()}
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for a, b in zip(places, places[1:]):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)


def test_empty_tables(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
