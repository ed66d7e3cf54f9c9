import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimloom.llm.language_id import FILTERS, WIDTHS, WINDOW, drawn_windows, fit, held_out, identify, keep_identified, predict, train, windows
from claimloom.llm.textbuf import Block

EN = "the cat and the dog went with their friends to another house where nothing was wrong "
DE = "der hund und die katze gingen mit ihren freunden zu einem anderen haus wo nichts war "


def corpus(spark):
    rows = [(i, (EN if i % 2 else DE)[i % 7 :] * (1 + i % 5), "en" if i % 2 else "de") for i in range(200)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "123 !? 。", None), (503, "é" * 3, None), (504, EN * 3000, None), (505, EN, None), (505, EN, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))


def test_held_out_accuracy_and_defined_cases(spark):
    got = identify(corpus(spark)).collect()
    assert len(got) == 207
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.doc_id < 500:
            assert r.lang_pred == ("en" if r.doc_id % 2 else "de")
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (500, 501, 502)) and by[503].lang_pred != "und"
    nameless = identify(corpus(spark).unionByName(spark.createDataFrame([(None, EN, "en", "x")], "doc_id long, text string, lang string, score string"))).where("doc_id is null").first()
    assert nameless.lang_pred == "en" and nameless.held_out is False
    assert by[504].lang_pred == by[505].lang_pred == "en"


def test_no_labels_and_empty(spark):
    docs = corpus(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify(docs).collect()} == {"und"}
    assert identify(docs.limit(0)).count() == 0


def test_filter_keeps_columns_and_clean_rows(spark):
    docs = corpus(spark)
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {500, 501, 502}


def test_pooling_equals_plain_convolution():
    x, doc = windows(Block(pa.array([EN * 5, "Äb c" * 9, ""])))
    net = train(x, doc, ["a", "b"], epochs=1)
    got = net.pooled(x[:2], net.tables())[0]
    for r in range(2):
        e, out = net.embed[x[r]], []
        for w, bias, width in zip(net.filters, net.bias, WIDTHS, strict=True):
            conv = np.array([np.einsum("oe,oef->f", e[p : p + width], w) for p in range(WINDOW)])
            out.append(conv.max(0) + bias)
        assert np.allclose(got[r], np.concatenate(out), atol=1e-3) and got.shape[1] == FILTERS * len(WIDTHS)


def test_training_uses_no_held_out_row(spark):
    docs = corpus(spark)
    swapped = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    net = fit(swapped, ~held_out(F.col("doc_id")))
    assert net.languages == ["de", "en"]
    assert sorted(predict(docs, net).collect()) == sorted(r[:1] + r[2:] for r in map(tuple, identify(docs).collect()))


def test_predictions_against_plain_convolution(spark):
    """Label and score of whole texts, window by window and filter by filter, for the query's own network."""
    docs = corpus(spark)
    net = fit(docs, ~held_out(F.col("doc_id")))
    got = {r.doc_id: r for r in identify(docs).where("doc_id < 12").collect()}
    for r in docs.where("doc_id < 12").collect():
        raw = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in (r.text or "").encode())
        total, mass = 0, 0
        for at in range(0, len(raw), WINDOW):
            w = np.frombuffer(raw[at : at + WINDOW].ljust(WINDOW + max(WIDTHS) - 1), np.uint8)
            if (w == 32).all():
                continue
            e = net.embed[w]
            top = [np.max([np.einsum("oe,oef->f", e[p : p + k], f) for p in range(WINDOW)], 0) + b for k, f, b in zip(WIDTHS, net.filters, net.bias, strict=True)]
            z = np.maximum(np.concatenate(top), 0) @ net.out + net.out_bias
            z = np.exp(z - z.max())
            n = int((w[:WINDOW] != 32).sum())
            total, mass = total + n * z / z.sum(), mass + n
        assert got[r.doc_id].lang_pred == net.languages[int(np.argmax(total))] and abs(got[r.doc_id].score - (total / mass).max()) < 1e-4


def test_windows_are_drawn_from_whole_texts(spark):
    rows = [(1, "ä" * 128 + "b" * 300, "x"), (1, "ä" * 128 + "b" * 300, "x"), (2, "c" * 256 * 4000, "y"), (3, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = drawn_windows(docs, 1500).collect()
    assert sorted((r.i, bytes(r.bytes)) for r in got if r.lang == "x") == [(0, "ä".encode() * 128), (1, b"b" * 256), (2, b"b" * 44)]
    places = [r.i for r in got if r.lang == "y"]
    assert 1300 < len(places) < 1700 and min(places) < 50 and max(places) > 3950 and len(set(places)) == len(places)
