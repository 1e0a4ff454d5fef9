"""The pipeline against the stages' own operators, one after the other."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark):
    from stratagraph.llm import langid, mixing, neardup, quality

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    ids = set(rows)
    some = lambda keep: docs.filter(docs.doc_id.isin(list(keep)))
    ids = {r.doc_id for r in langid.identify(docs).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANGUAGE_SHARE}
    sites = quality.page_sites(spark.read.parquet(f"{DATA}/pages.parquet"))
    ids = {r.doc_id for r in quality.classify(some(ids), spark.read.parquet(f"{DATA}/labels.parquet"), sites).collect() if r.kept}
    ids = {r.doc_id for r in neardup.classes(some(ids)).collect() if r.doc_id == r.class_id}
    copies = {r.doc_id: r.taken // r.size for r in mixing.mix(some(ids)).collect() if r.taken}
    got = [r for r in corpus_pipeline.run(spark, DATA).collect()]
    assert sorted(r.doc_id for r in got) == sorted(i for i, n in copies.items() for _ in range(n))
    assert all(r.lossless and r.n_chars == len(rows[r.doc_id].text) for r in got)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (2, None, None, None, None), (None, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (True, 0)] and kept.columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_clashing_columns_and_empty_tables(spark):
    """Columns named like the stages' own, in every stage, with null, empty, repeated and long rows."""
    names = ["copies", "__row", "row", "n", "m", "id", "key", "host", "section", "class_id", "score", "lang_pred", "kept", "size", "bucket", "ids", "f", "y"]
    schema = COLUMNS + "".join(f", `{c}` string" for c in names)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("lang = 'en'").orderBy("doc_id").limit(40).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs]
    rows += [rows[0], (None, rows[1][1], None, None, None), (rows[2][0], "12 !! 34", "en", "s", 1), (None, None, None, None, None), (7, "", "en", "s", 0), (8, " ".join(r[1] for r in rows[:20]), "en", "s", 1)]
    for given in (spark.createDataFrame([(*r, *names) for r in rows], schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, given, DATA)
            assert got.columns == given.columns, name
            assert all(list(r)[5:] == names for r in got.collect())
        got = corpus_pipeline.STAGES[-1][1](spark, given, DATA).collect()
        assert len(got) == given.count() and all(r.lossless and r.n_pieces == len(r.ids) for r in got)


def prose(k, n=60):
    return " ".join(f"word{k}x{i}" for i in range(n))


def test_one_row_of_each_class_stays_whatever_the_ids(spark):
    texts = [(None, prose(0)), (None, prose(1)), (None, prose(1) + " more"), (7, prose(2)), (7, prose(3)), (7, prose(3)), (8, prose(4)), (None, prose(4)), (9, prose(3)), (None, None), (None, "")]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], COLUMNS), DATA).collect()
    got = sorted((r.doc_id or 0, r.text or "") for r in kept)
    one = [x for x in ((0, prose(1)), (0, prose(1) + " more")) if x in got]
    assert len(one) == 1  # either of the near copies
    assert got == sorted([(0, ""), (0, ""), (0, prose(0)), *one, (7, prose(2)), (7, prose(3)), (8, prose(4))])
    alone = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(8, prose(4), "en", "s", 1), (None, prose(4), "en", "s", 1), (None, prose(5), "en", "s", 1)], COLUMNS), DATA).collect()
    assert sorted((r.doc_id or 0, r.text) for r in alone) == [(0, prose(5)), (8, prose(4))]


def test_mix_takes_rows_and_not_ids(spark):
    from stratagraph.llm import mixing

    docs = spark.createDataFrame([(None if k % 2 else 5, prose(k, 5 + k) + " 1" * (k % 7), "en", "ab"[k % 3 == 0], 1) for k in range(60)], COLUMNS)
    mixed = mixing.mix(docs).collect()
    rows = [len(r.text.split()) for r in corpus_pipeline.mix_sources(spark, docs, DATA).collect()]
    assert sum(rows) == sum(r.taken for r in mixed) and len({r.taken // r.size for r in mixed}) > 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_language_and_quality_judge_rows_and_not_ids(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = docs.filter("lang = 'en' and n_chars > 500").orderBy("doc_id").first()
    odd = spark.createDataFrame([(None, good.text, "en", good.source, 1), (None, "12 34 56", "en", good.source, 1), (good.doc_id, "78 90", "en", good.source, 1)], COLUMNS)
    docs = docs.select(odd.columns).unionByName(odd.select([odd[f.name].cast(f.dataType) for f in docs.select(odd.columns).schema]))
    found = [(r.doc_id, r.text) for r in corpus_pipeline.language_id(spark, docs, DATA).collect()]
    assert (None, good.text) in found and (None, "12 34 56") not in found and (good.doc_id, "78 90") not in found
    from stratagraph.llm import quality

    labels, sites = spark.read.parquet(f"{DATA}/labels.parquet"), quality.page_sites(spark.read.parquet(f"{DATA}/pages.parquet"))
    assert corpus_pipeline.quality_classifier(spark, docs, DATA).count() == quality.classify(docs, labels, sites).filter("kept").count()


@pytest.mark.skipif(not os.path.isdir("/proc/self"), reason="no /proc")
def test_written_tables_give_freed_memory_of_the_driver_back(spark):
    """Pieces freed outside the JVM's heap, below one that is still in use, which the allocator keeps by itself."""
    import gc
    import time

    from stratagraph.llm.runtime import cut

    jvm = spark._jvm
    used = lambda: int(open(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
    rows = lambda: sorted(r.id for r in cut(spark.range(3)).collect())
    assert rows() == rows() == [0, 1, 2]  # so that classes are loaded
    held = [jvm.java.nio.ByteBuffer.allocateDirect(64 << 10) for _ in range(1500)]
    last = jvm.java.nio.ByteBuffer.allocateDirect(64 << 10)
    del held
    for _ in range(3):
        gc.collect()
        jvm.System.gc()
        time.sleep(0.5)
    before = used()
    assert rows() == [0, 1, 2]
    assert used() < before - 50 and last.capacity() == 64 << 10
