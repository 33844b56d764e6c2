import corpus_pipeline
from lodestitch.llm import neardup_text
from lodestitch.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_act(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == docs.columns, name
        assert after.count() <= before.count()
        before = after
    assert before.count() > 0.8 * docs.count()
    assert corpus_pipeline.run(spark, DATA).select("doc_id").distinct().count() == before.count()


def test_near_copies_from_80_percent_go(spark):
    say = lambda k, n: [f"{k}{i}" for i in range(n)]
    base = say("w", 200)
    texts = [base, base[:180] + say("v", 20), base[:170] + say("u", 30)]  # 176 of 216 shingles shared: 0.81; 166 of 226: 0.73
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, DATA)
    assert {r["doc_id"] for r in kept.collect()} == {0, 2}
    at_85 = neardup_text.near_duplicates(docs)  # op6's threshold
    assert all(r["kept"] for r in at_85.collect())


def test_every_operator_is_registered():
    assert {int(x[2:].split("_")[0]) for x in QUERIES} == set(range(1, 11))
