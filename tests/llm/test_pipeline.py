import re

import corpus_pipeline
import pytest

from claimloom.llm.packing import CAPACITY
from claimloom.llm.queries import QUERIES

from .test_jaccard_join import brute as near
from .test_packing import checked
from .test_secret_scan import plain
from .test_suffix_dedup import brute as repeats

P = " ".join(f"shared{i} words" for i in range(40))
A, B = (" ".join(f"the{x}a and" for x in range(60)), " ".join(f"of{x}b to" for x in range(60)))
FILLER = "the quick brown fox and the lazy dog went over to that other side of town where it was"


def planted(spark, folder):
    rows = [(i, " ".join(f"{w}{i}" if k % 3 == 0 else w for k, w in enumerate(FILLER.split() * 4)), "en", "s", 0) for i in range(40)]
    base = rows[0][1].split()
    rows += [(100, rows[0][1], "en", "s", 0), (101, " ".join([*base[:-1], "changed"]), "en", "s", 0), (102, None, None, "s", 0), (103, "", "en", "s", 0), (104, "12 34 !!", "en", "s", 0)]
    rows += [(200, f"{A} {P} end of one", "en", "s", 0), (201, f"{B}  {P} fin", "en", "s", 0), (202, 'and a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" in here', "en", "s", 0)]
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return rows


def test_stages_against_plain_python(spark, tmp_path):
    rows = planted(spark, f"file://{tmp_path}")
    docs, seen = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, f"file://{tmp_path}")
        if n < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"file://{tmp_path}/{n}")
            docs = spark.read.parquet(f"file://{tmp_path}/{n}")
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
        else:
            final = out.collect()
    texts = {r[0]: r[1] for r in rows}
    one = seen["language ID"]
    assert set(texts) - set(one) == {102, 103, 104} and all(one[i] == texts[i] for i in one)
    two = seen["n-gram Jaccard join"]
    assert set(two) == {g for _, g in near(list(one.items())).values()} and not {100, 101} & set(two)
    three = seen["suffix-array dedup"]
    assert set(three) == set(two) and P in three[200] and P not in three[201] and three[201].split() == f"{B} fin".split()
    assert not repeats(list(three.items()), 50)[1] and all(three[i] == two[i] for i in two if i != 201)
    four = seen["secret scans"]
    assert set(four) == set(three) and four[202] == 'and a token = "[SECRET]" in here' and all(not plain(t) for t in four.values())
    checked(final, list(four.items()), CAPACITY)


def test_registered(spark):
    import __spark_entry__ as e

    names = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
    assert set(QUERIES) <= set(e.queries()) and [n for n, _ in corpus_pipeline.STAGES][0] == "language ID"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs_on_the_smallest_tables(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, seq string, pos int, context string, piece int"


def odd_rows():
    long = " ".join(f"{w}{i}" if i % 5 else w for i, w in enumerate(FILLER.split() * 3000))
    rows = [(None, A), (None, A), (None, None), (1, f"{A} {P}"), (1, f"{A} {P}"), (1, f"{B} and quite other words"), (2, None), (3, ""), (4, f"  {B} {P}\n"), (5, long), (6, f"the pwd: x7#Kq9!vTz2mm is in the {FILLER}"), (7, " \t\n")]
    return [(i, t, None, None, None, "s", 1, "c", 2) for i, t in rows]


@pytest.mark.parametrize("empty", [False, True])
def test_every_stage_on_odd_rows(spark, tmp_path, empty):
    """Null and repeated ids, null, empty and long texts, null columns, clashing names; and the empty table."""
    docs = spark.createDataFrame([] if empty else odd_rows(), ODD)
    spark.createDataFrame([(i, FILLER + f" {i}", "en", "s", 9) for i in range(0 if empty else 60, 0 if empty else 120)], "doc_id long, text string, lang string, source string, n_chars long").unionByName(docs, allowMissingColumns=True).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, f"file://{tmp_path}")
        assert n == 4 or out.columns == docs.columns, name
        out.write.parquet(f"file://{tmp_path}/{n}")
        docs = spark.read.parquet(f"file://{tmp_path}/{n}")
        rows = docs.collect()
        if empty:
            assert not rows, name
            continue
        texts = [(r.doc_id, r.text) for r in rows] if n < 4 else []
        if n == 0:  # rows without a letter go, whatever their id
            assert sorted(i for i, _ in texts if i is not None and i < 60) == [1, 1, 1, 4, 5, 6] and [t for i, t in texts if i is None] == [A, A]
        if n == 1:  # rows without an id stay; of equal rows one; the other text of id 1 stays
            assert len([t for i, t in texts if i is None]) == 2 and sorted(t[:3] for i, t in texts if i == 1) == sorted([A[:3], B[:3]])
            assert len([1 for i, _ in texts if i is not None and i >= 60]) < 60
        if n == 3:
            assert [t for i, t in texts if i == 6] == [f"the pwd: [SECRET] is in the {FILLER}"] and len([t for i, t in texts if i == 5][0].split()) > 40_000
        if n == 4:
            assert {r.doc_id for r in rows if r.doc_id is None or r.doc_id < 60} == {None, 1, 4, 5, 6}


def test_unlabelled_corpora_and_clashing_columns_pass_the_stages(spark, tmp_path):
    """Without a lang nothing can be foreign; columns with names that stages use themselves keep their values."""
    rows = [(i, " ".join(f"{w}{i}" if k % 3 == 0 else w for k, w in enumerate(FILLER.split() * 4)), None, i + 5, i + 7, i + 9, "x") for i in range(30)] + [(90, None, None, 1, 2, 3, "y"), (91, "12 34", None, 1, 2, 3, "y")]
    rows += [(50, rows[0][1], None, 1, 2, 3, "z"), (51, f"{A} {P} end", None, 1, 2, 3, "z"), (52, f"{B} {P} fin", None, 4, 5, 6, "z")]
    names = "doc_id long, text string, lang string, __at long, __word long, __bits long, __claimloom_at string"
    docs = spark.createDataFrame(rows, names)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"file://{tmp_path}/{n}")
        docs = spark.read.parquet(f"file://{tmp_path}/{n}")
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {*range(30), 51, 52} and all(tuple(got[i])[3:] == rows[i][3:] for i in range(30)) and tuple(got[52])[3:] == (4, 5, 6, "z")
    assert P in got[51].text and P not in got[52].text
