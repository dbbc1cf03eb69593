import corpus_pipeline
from quire.llm.common import written
from quire.llm.toxicity import fit_toxicity, score_toxicity
from pyspark.sql import functions as F

from tests.llm.test_packing import check, reference
from tests.llm.test_partenum import brute as near_brute
from tests.llm.test_rindex import brute as repeats_brute


def test_stages_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, state = docs.columns, docs
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, state, sf), "test")
        if name == "best_fit_packing":
            check(out.collect(), dict(zip(rows, reference(r.text for r in rows.values()), strict=True)), 2048)
            break
        assert out.columns == columns
        got = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            model = fit_toxicity(state, spark.read.parquet(f"{sf}/labels.parquet"), lambda k: F.crc32(k.cast("string")) % 3 == 1)
            want = {r.doc_id for r in score_toxicity(state, model).filter("score < 0.7").collect()}
            assert set(got) == want and len(want) < len(rows)
        elif name == "exact_dedup":
            last = {}
            for r in sorted(rows.values(), key=lambda r: r.doc_id):
                last[r.text] = r.doc_id
            assert set(got) == set(last.values())
        elif name == "near_dedup":
            assert set(got) == {c for _, _, c in near_brute([(r.doc_id, r.text) for r in rows.values()])}
        else:
            order = list(rows.values())
            for r, (_, runs, kept) in zip(order, repeats_brute([r.text for r in order], 200), strict=True):
                assert got[r.doc_id].text == (kept.decode("utf-8", "ignore") if runs else r.text)
                assert got[r.doc_id].n_chars == (len(got[r.doc_id].text) if runs else r.n_chars)
        if name != "repeated_passages":
            assert all(got[d] == rows[d] for d in got)
        rows, state = got, out


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, component_id int"
    odd = spark.createDataFrame([(1, None, None, None, None, 1.0, "k", 3), (2, "", "en", "s", 0, 1.0, "k", 3), (3, "a " * 50_000, "en", "s", 100_000, 1.0, "k", 3), (4, "a " * 50_000, "en", "s", 100_000, 1.0, "k", 3)], schema)
    for docs in (odd, odd.limit(0)):
        state = docs
        for _, stage in corpus_pipeline.STAGES:
            state = written(stage(spark, state, "/root/testdata/sf0.001"), "odd")
        assert (state.count() > 0) == (docs is odd)


def test_repeated_and_null_ids(spark):
    words = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    near, passage = words("near"), words("passage")
    rows = [(1, words("same")), (1, words("same")), (2, words("same")), (7, words("other")), (7, words("another")), (8, words("other")), (None, words("nil")), (None, words("nil")), (None, words("same"))]
    rows += [(3, near), (4, near + " tail"), (4, words("own")), (None, near + " end"), (None, "x " + passage), (9, words("z", 200) + " " + passage)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    order = lambda found: sorted((r.doc_id or 0, r.text) for r in found)

    exact = written(corpus_pipeline.drop_copies(spark, docs, ""), "ids")
    gone = [(1, words("same")), (1, words("same")), (7, words("other")), (None, words("nil")), (None, words("same"))]
    left = list(rows)
    for r in gone:
        left.remove(r)
    assert exact.columns == docs.columns and order(exact.collect()) == sorted((d or 0, t) for d, t in left)

    close = written(corpus_pipeline.drop_near_copies(spark, exact, ""), "ids")
    left = [r for r in left if r not in ((4, near + " tail"), (None, near + " end"))]
    assert close.columns == docs.columns and order(close.collect()) == sorted((d or 0, t) for d, t in left)

    cut = corpus_pipeline.strip_passages(spark, close, "").collect()
    want = [(d or 0, t.replace(" " + passage, "") if passage in t else t) for d, t in left]
    assert order(cut) == sorted(want)
