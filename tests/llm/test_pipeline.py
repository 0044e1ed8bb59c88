import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm.entries import QUERIES, SQL
from tests.llm.test_jaccard import brute

CLASHES = ("score", "lang_pred", "Stays", "cluster", "bucket", "key", "grp", "node", "group", "size", "tie", "kept", "bin", "component_id", "shard", "copy", "row", "x0", "n", "rank", "a.b", "text_id", "stays_text", "lang_", "least")
ODD = [
    (5, "one two three four five six seven eight nine ten eleven twelve " * 3, "en", "a", 10),
    (3, "one two three four five six seven eight nine ten eleven twelve " * 3, "en", "a", 10),
    (3, "one two three four five six seven eight nine ten eleven twelve " * 3, "en", "a", 10),
    (9, "", "en", "b", 0),
    (4, None, None, None, None),
    (7, "  \n ", "fr", "b", 4),
    (8, "12 34 ½ !!", "de", "b", 10),
    (6, "very long text with words " * 20000, "en", None, 500000),
    (None, "no identifier but words", "en", "a", 20),
    (11, "kurzer text aus worten", "de", "c", 20),
    (13, "un texte de quelques mots", "fr", "c", 20),
]


def test_entries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)
    import __spark_entry__ as entry  # an import that fails there only warns, so look that nothing is missing

    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        kept.append(docs.count())
        if name == "simhash_near_dedup":  # five words, similarity 0.8
            groups = {c for _, c in brute([(r.doc_id, r.text) for r in before.collect()])}
            assert {r.doc_id for r in docs.collect()} == groups
        if name == "suffix_array_dedup":
            text = {r.doc_id: r.text for r in before.collect()}
            assert all(len(r.text) <= len(text[r.doc_id]) and r.n_chars == len(r.text) for r in docs.collect())
            seen = {}
            for r in docs.orderBy("doc_id").collect():
                if r.text == text[r.doc_id]:
                    seen.setdefault(hashlib.sha256(r.text.encode()).hexdigest(), []).append(r.doc_id)
            assert all(len(v) == 1 for v in seen.values() if len(v[0:1]) and len(text[v[0]]) >= 50)
    assert kept[0] > 0.9 * spark.read.parquet(f"{sf_dir}/documents.parquet").count() and kept[1] < kept[0]
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == columns and mixed.count() > 0
    packed = corpus_pipeline.pack(spark, mixed, sf_dir).toPandas()
    assert (packed.groupby("bin_id")["size"].sum() <= 2048).all()
    assert len(packed.drop_duplicates(["doc_id", "copy"])) == mixed.count()


@pytest.mark.parametrize("kind", ["string", "int"])
def test_stages_on_odd_rows_and_clashing_columns(spark, kind):
    plain = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = plain.select("*", *[F.lit(c if kind == "string" else 1).alias(c) for c in CLASHES])
    want = {
        "language_id": {(5, 108), (3, 108), (6, 500000), (None, 23), (11, 22), (13, 25)},  # und goes: null, empty, blank, no letter
        "simhash_near_dedup": {None, 3, 6, 7, 8, 11, 13},  # null, empty and blank are one group, that of 4; one row of 3
        "suffix_array_dedup": {None, 3, 6, 8, 11, 13},
    }
    for name, stage in corpus_pipeline.STAGES:
        out, same = stage(spark, docs, ""), stage(spark, plain, "")
        assert stage(spark, docs.limit(0), "").count() == 0, name
        if name == "best_fit_packing":
            assert sorted(map(str, out.collect())) == sorted(map(str, same.collect()))  # extra columns change nothing
            assert out.agg(F.sum("size")).first()[0] == sum(len((r[1] or "").split()) for r in ODD)
            continue
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r["score"] == ("score" if kind == "string" else 1) for r in rows)
        assert sorted(str(r[:5]) for r in rows) == sorted(str(tuple(r)) for r in same.collect()), name
        if name == "language_id":
            lens = {len(r[1]) for r in ODD if r[1]}
            assert {r.doc_id for r in rows} == {d for d, _ in want[name]} and {len(r.text) for r in rows} <= lens
        elif name == "simhash_near_dedup":
            assert {r.doc_id for r in rows} == {c for _, c in brute([(-1 if r[0] is None else r[0], r[1]) for r in ODD])} - {-1} | {None}
            assert len(rows) == len({r.doc_id for r in rows})
        elif name == "suffix_array_dedup":
            assert {r.doc_id for r in rows} == want[name] and {r.doc_id: r.text for r in rows}[3] == ODD[1][1]
        else:
            taken = {}
            for r in rows:
                taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
            assert max(n for d, n in taken.items() if d != 3) <= 2 and taken.get(3, 0) <= 4


def test_near_dedup_goes_by_row_and_nulls_come_first(spark):
    x, y = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    for rows, want in (
        ([(1, y), (5, x), (5, y)], [(1, y), (5, x)]),
        ([(None, y), (1, y)], [(None, y)]),
        ([(None, y), (None, x), (2, x), (2, x), (2, y), (3, None), (3, "")], [(None, x), (None, y), (3, None)]),
        ([(2**60 + 1, x), (2**60, x), (None, y)], [(2**60, x), (None, y)]),
    ):
        docs = spark.createDataFrame([(*r, None, None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
        got = corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
