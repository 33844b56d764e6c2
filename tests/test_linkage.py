import pytest
from pyspark.sql import functions as F

from lodestitch.functions import address as A
from lodestitch.operators import blocking, context, diagnostics, errors, features, metrics, models, splits
from lodestitch.plans import catalogue, pipeline
from lodestitch.sources import tables
from lodestitch.streaming import link

ENTITY = "id long, country string, norm_name string, norm_address string"
US1 = [(11, "acme traders", "12 main street springfield il"), (12, "blue tech", "40 oak road portland or"), (13, "zenith labs", ""), (14, "", "7 elm street springfield il"), (15, "orphan co", "999 nowhere lane springfield il")]
FR1 = [(21, "mas pharmacie", "25 mail pablo picasso nantes pays de la loire"), (22, "pg finance", "75 rue brunet pessac nouvelle aquitaine"), (23, "tourcoing maternelle", "40 rue bonne nouvelle tourcoing hauts de france")]
US2 = [(1, "acme traders", "12 main st springfield illinois"), (2, "blue tech", "40 oak rd portland oregon"), (3, "zenith labs", "5 pine st springfield il"), (4, "someone else", "7 elm street springfield il"), (5, "acme", "13 main street springfield il"), (6, "", "")]
FR2 = [(11, "mas pharmacie", "25 mail pablo picasso nantes"), (12, "pg finance sas", "75 rue brunet pessac"), (13, "maternelle de tourcoing", "40 rue bonne nouvelle tourcoing"), (14, "boulangerie", "3 rue de lille roubaix")]


@pytest.fixture(scope="module")
def tiny(spark):
    s1 = spark.createDataFrame([(i, c, n, a) for c, rows in (("us", US1), ("france", FR1)) for i, n, a in rows], ENTITY).withColumn("source", F.lit(1))
    t = spark.createDataFrame([(o * 1000 - 1000 + i, c, n, a, o) for o in (2, 3) for c, rows in (("us", US2), ("france", FR2)) for i, n, a in rows], ENTITY + ", source int")
    lexicon = spark.createDataFrame([("us", "springfield"), ("us", "portland")], "country string, token string")
    a, b = pipeline.prepare(s1, t, lexicon=lexicon)
    return s1, t, a.cache(), b.cache(), lexicon


def test_candidates_of_the_tiny_data(tiny):
    _, _, a, b, _ = tiny
    got = blocking.candidates(a, b).cache()
    assert got.groupBy(*blocking.PAIR).count().where("count > 1").count() == 0
    by = {(r["s1_id"], r["target_id"]): r for r in got.collect()}
    assert by[11, 1001]["exact_name_rank"] == 0 and by[11, 1001]["house_city_hit"] and by[14, 1004]["house_city_hit"]
    assert not any(r["house_city_hit"] for r in by.values() if r["country"] == "france")
    assert by[21, 2011]["mask"] & 1 and by[23, 1013]["mask"] & 2 and (15, 1006) not in by
    assert all(r["n_bad"] == 0 for r in diagnostics.validate(got, a, b).collect()), diagnostics.validate(got, a, b).collect()


def test_features_of_the_tiny_data(tiny):
    _, _, a, b, _ = tiny
    rows = pipeline.pair_features(pipeline.candidate_pairs(a, b), a, b)
    assert rows.columns[4:] == features.FEATURES and len(features.FEATURES) == 47 and len(features.MODEL_INPUTS) == 42
    by = {(r["s1_id"], r["target_id"]): r for r in rows.collect()}
    r = by[11, 1001]
    assert r["name_exact"] == 1 and r["house_number_match"] == 1 and r["city_match"] == 1 and r["best_name_rank"] == 0 and r["country_match"] == 1
    assert all(x["city_match"] is None and x["house_city_match"] is None for x in by.values() if x["country"] == "france")
    assert by[13, 1003]["address_ratio"] is None and by[13, 1003]["s1_address_missing"] == 1
    counts = {}
    for (s, t) in by:
        counts[s, t // 1000] = counts.get((s, t // 1000), 0) + 1
    assert all(x["s1_candidate_count"] == counts[s, t // 1000] for (s, t), x in by.items())


def test_pipeline_end_to_end_resumes_and_refuses_another_config(spark, tiny, tmp_path):
    s1, t, a, b, lexicon = tiny
    config = pipeline.Config(channels=("exact_name", "house_city", "name_token_sort"))
    rows = pipeline.pair_features(pipeline.candidate_pairs(a, b, config), a, b, config)
    truth = blocking.exact_name(a, b)
    labelled = features.with_labels(rows, truth).cache()
    matcher = models.fit_trees(labelled, ["name_ratio", "address_ratio", "name_token_jaccard"], models.TreeParams(rounds=3, depth=2, min_rows=1))
    out = f"file://{tmp_path}/run"
    got = pipeline.run(spark, s1, t, out, matcher, config=config, lexicon=lexicon)
    lists = {r["source1_entity_id"]: r["matched_entity_ids"] for r in got["lists"].collect()}
    assert set(lists) == {f"S1-{i}" for i, *_ in US1 + FR1}
    again = pipeline.run(spark, s1, t, out, matcher, config=config, lexicon=lexicon)
    assert tables.tables_equal(got["decisions"], again["decisions"])
    assert tables.tables_equal(got["decisions"].select("s1_id", "target_source", "target_id"), got["features"].select("s1_id", "target_source", "target_id"))
    with pytest.raises(ValueError, match="another configuration"):
        pipeline.run(spark, s1, t, out, matcher, config=pipeline.Config(name_k=7), lexicon=lexicon)
    lines = (tmp_path / "run/matching_results.tsv").read_text().splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and [x.split("\t")[0] for x in lines[1:]] == [f"S1-{i}" for i, *_ in FR1 + US1]
    assert dict(x.split("\t") for x in lines[1:]) == lists
    assert tables.exists(spark, f"{out}/candidate_pairs.tsv") and not tables.exists(spark, f"{out}/matching_results.tsv.parts")
    matcher.save(f"{out}/model", spark)
    back = models.Matcher.load(f"{out}/model", spark)
    assert back.columns == matcher.columns and tables.tables_equal(back.score(labelled).select("s1_id", "score"), matcher.score(labelled).select("s1_id", "score"))
    with pytest.raises(ValueError, match="missing features"):
        matcher.score(labelled.drop("name_ratio"))


def test_tfidf_against_brute_force(spark):
    import math

    names = ["acme traders", "acme trading", "blue tech", "a", "", "tech blue labs", "acme"]
    q = spark.createDataFrame([(i, "us", n) for i, n in enumerate(["acme trade", "blue teck", "zzz", ""])], "id long, country string, norm_name string")
    t = spark.createDataFrame([(i, "us", n, 2) for i, n in enumerate(names)], "id long, country string, norm_name string, source int")
    grams = lambda x: {f" {w} "[i : i + 3] for w in x.split() for i in range(len(w))}
    df = {}
    for n in names:
        for g in grams(n):
            df[g] = df.get(g, 0) + 1
    idf = lambda g: math.log((1 + len(names)) / (1 + df.get(g, 0))) + 1
    vec = lambda x: {g: idf(g) / math.sqrt(sum(idf(y) ** 2 for y in grams(x))) for g in grams(x)}
    want = {}
    for i, x in enumerate(["acme trade", "blue teck", "zzz", ""]):
        v = vec(x)
        scored = sorted(((-round(sum(v[g] * w for g, w in vec(n).items() if g in v), 9), j) for j, n in enumerate(names)))
        for rank, (s, j) in enumerate([y for y in scored if y[0] < 0][:3]):
            want[i, rank] = (j, -s)
    got = {(r["s1_id"], r["rank"]): (r["target_id"], r["score"]) for r in blocking.tfidf_topk(q, t, "norm_name", 3, 10, None).collect()}
    assert {k: (j, round(s, 7)) for k, (j, s) in got.items()} == {k: (j, round(s, 7)) for k, (j, s) in want.items()}
    with pytest.raises(ValueError):
        blocking.tfidf_topk(q, t, k=10, pool=5)


def test_name_frequency(spark):
    rows = [(1, 2, "us", ""), (2, 2, "us", "acme"), (3, 2, "us", None), (4, 2, "us", "acme"), (5, 2, "india", "acme"), (6, 3, "us", "acme")]
    df = spark.createDataFrame(rows, "id long, source int, country string, norm_name string")
    assert {r["id"]: r["name_frequency"] for r in features.name_frequency(df).collect()} == {1: None, 2: 2, 3: None, 4: 2, 5: 1, 6: 1}


CONTEXT = [
    (1, 10, 2, 0.995, 0.9, 0.8, 1.0, 0.9, 1, 1, 0), (1, 11, 3, 0.999, 1.0, 1.0, 1.0, 1.0, 3, 1, 0),
    (1, 12, 3, 0.50, 0.4, 0.3, None, 0.2, 50, 0, 0), (2, 20, 2, 0.992, 0.8, 0.9, 0.5, 0.9, 1, 0, 0),
]
CONTEXT_KIND = "s1_id long, target_id long, target_source int, score double, address_token_set_ratio double, name_ratio double, address_number_set_jaccard double, translit_skeleton_ratio double, target_name_frequency long, house_number_match int, target_address_missing int"


def test_context(spark):
    got = {r["target_id"]: r for r in context.context_features(spark.createDataFrame(CONTEXT, CONTEXT_KIND)).collect()}
    r = got[10]
    assert (r["s1_candidate_count"], r["s1_count_ge_0.99"], r["candidate_score_rank"], r["s1_second_score"], r["s1_high_s2_count"], r["s1_high_s3_count"]) == (3, 2, 2, 0.995, 1, 1)
    assert (r["other_source_high_count"], r["top_is_s3"]) == (1, 1) and abs(r["diff_top_address_token_set_ratio"] + 0.1) < 1e-9
    assert got[11]["candidate_score_rank"] == 1 and got[11]["is_top"] == 1 and abs(got[11]["s1_score_margin"] - 0.004) < 1e-9 and got[11]["diff_top_name_ratio"] == 0
    assert abs(got[12]["candidate_score_minus_top"] + 0.499) < 1e-9 and got[12]["diff_top_address_number_set_jaccard"] is None
    assert (got[20]["s1_candidate_count"], got[20]["s1_second_score"], got[20]["other_candidates_high_count"]) == (1, 0, 0)
    _, names = context.design(context.context_features(spark.createDataFrame(CONTEXT, CONTEXT_KIND)))
    assert len(names) == 22


def test_decision_rules(spark):
    df = spark.createDataFrame(CONTEXT, CONTEXT_KIND)
    of = lambda c: [r["x"] for r in df.select("target_id", c.alias("x")).orderBy("target_id").collect()]
    assert of(context.decide_single_stricter(0.99, 0.99)) == [True, True, False, True]
    assert of(context.decide_single_stricter(0.99, 0.999)) == [True, True, False, False]
    calm = df.withColumn("house_number_match", F.lit(1)).withColumn("address_number_set_jaccard", F.lit(1.0))
    assert [r["x"] for r in calm.select("target_id", context.decide_single_stricter(0.99, 0.999, True).alias("x")).orderBy("target_id").collect()] == [True, True, False, True]


def test_auc_and_summary(spark):
    auc = lambda p, n: metrics.rank_auc(spark.createDataFrame([(float(x), 1) for x in p] + [(float(x), 0) for x in n], "score double, label int")).first()["auc"]
    assert auc([3, 4], [1, 2]) == 1 and auc([1, 2], [3, 4]) == 0 and auc([1, 1], [1, 1]) == 0.5 and auc([], [1]) is None
    rows = spark.createDataFrame([(1, 2, 1, 0.2, 0), (1, 2, 2, 0.995, 1), (1, 3, 3, 0.9, 0), (7, 2, 4, 0.8, 0)], "s1_id long, target_source int, target_id long, score double, predicted int")
    got = {r["s1_id"]: tuple(r)[1:] for r in metrics.score_summary(rows).collect()}
    assert got[1][:3] == (3, 0.995, 0.9) and abs(got[1][3] - 0.095) < 1e-9 and got[1][4] == 1 and got[7][2] == 0 and got[7][3] == 0.8


def test_false_positive_ladder(spark):
    base = dict(cross_script=False, name_ratio=0.3, translit_name_ratio=0.3, translit_skeleton_ratio=0.3, address_token_set_ratio=0.5, address_number_set_jaccard=None, target_name_frequency=1, house_city_match=0)
    cases = [
        ({"cross_script": True, "name_ratio": 0.05, "translit_skeleton_ratio": 0.7}, "transliteration collision (cross-script)"),
        ({"translit_skeleton_ratio": 0.8, "name_ratio": 0.5, "translit_name_ratio": 0.69}, "skeleton collision (Latin, spelling differs)"),
        ({"name_ratio": 1.0, "address_token_set_ratio": 0.95, "address_number_set_jaccard": 1.0}, "near-duplicate record: name & address ≥0.9, numbers agree"),
        ({"name_ratio": 0.2, "translit_name_ratio": 0.9, "address_token_set_ratio": 0.9}, "near-duplicate record: name & address ≥0.9, numbers agree"),
        ({"address_token_set_ratio": 0.95, "address_number_set_jaccard": 0.5}, "address near-duplicate, numbers conflict"),
        ({"name_ratio": 1.0, "address_token_set_ratio": 0.74, "target_name_frequency": 40}, "same/near name, weak or missing address — common name (freq > 5)"),
        ({"name_ratio": 1.0, "address_token_set_ratio": None}, "same/near name, weak or missing address — rare name (freq ≤ 5)"),
        ({"address_token_set_ratio": 0.95}, "same/near address, different name"), ({"house_city_match": 1}, "house+city collision, weak name & address"),
        ({"name_ratio": 0.75, "address_token_set_ratio": 0.8}, "partial evidence on both name and address"), ({}, "other"),
    ]
    kind = "cross_script boolean, name_ratio double, translit_name_ratio double, translit_skeleton_ratio double, address_token_set_ratio double, address_number_set_jaccard double, target_name_frequency long, house_city_match int, i int"
    df = spark.createDataFrame([tuple((base | c).values()) + (i,) for i, (c, _) in enumerate(cases)], kind)
    assert [r["x"] for r in df.orderBy("i").select(metrics.ladder(errors.false_positive_rules()).alias("x")).collect()] == [w for _, w in cases]


def test_alignment_and_thresholds(spark):
    assert len(metrics.THRESHOLDS) == 39 and sorted(metrics.THRESHOLDS) == metrics.THRESHOLDS and metrics.THRESHOLDS[-1] == 0.99999
    a = spark.createDataFrame([(1, 2, 3, 0.5), (1, 2, 4, 0.6)], "s1_id long, target_source int, target_id long, score double")
    b = spark.createDataFrame([(1, 2, 3, 0.1), (1, 2, 4, 0.2)], "s1_id long, target_source int, target_id long, f double")
    assert sorted((r["score"], r["f"]) for r in errors.aligned(a, b).collect()) == [(0.5, 0.1), (0.6, 0.2)]
    for x, y, why in ((a, b.limit(1), "not aligned"), (a.limit(1), b, "not aligned"), (a.union(a), b, "one to one")):
        with pytest.raises(Exception, match=why):
            errors.aligned(x, y).collect()


def test_f_beta_cases(spark):
    df = spark.createDataFrame([(0, 0, 0), (2, 0, 0), (0, 3, 0), (2, 3, 0), (2, 4, 2)], "p long, t long, h long")
    got = [r[0] for r in df.select(metrics.f_beta("p", "t", "h")).collect()]
    assert got[:4] == [1, 0, 0, 0] and abs(got[4] - 1.25 * 0.5 / (0.25 + 0.5)) < 1e-12


def test_lists_and_truth(spark):
    s1 = spark.createDataFrame([(5,), (6,), (7,)], "s1_id long")
    pairs = spark.createDataFrame([(5, 30, 3), (5, 10, 3), (5, 20, 2), (7, 1, 2)], "s1_id long, target_id long, target_source int")
    lists = tables.id_lists(s1, pairs)
    assert {r["source1_entity_id"]: r["matched_entity_ids"] for r in lists.collect()} == {"S1-5": "S2-20,S3-10,S3-30", "S1-6": "", "S1-7": "S2-1"}
    assert {r["matched_entity_ids"] for r in tables.id_lists(s1, pairs.limit(0)).collect()} == {""}
    assert tables.tables_equal(tables.explode_truth(lists), pairs.select("s1_id", "target_source", "target_id"))
    with pytest.raises(Exception, match="unknown source"):
        tables.explode_truth(spark.createDataFrame([("S1-1", "S9-4")], "source1_entity_id string, matched_entity_ids string")).collect()


def test_groups(spark):
    kind = "target_source int, country string, part int, s1_id_min long, s1_id_max long, s1_rows long"
    good = [(s, c, p, lo, hi, 2) for s in (2, 3) for c, p, lo, hi in (("us", 0, 1, 5), ("us", 1, 6, 9), ("france", 0, 2, 3))]
    of = lambda rows: [tuple(r)[:2] for r in diagnostics.decision_groups(spark.createDataFrame(rows, kind)).collect()]
    assert of(good) == [("france", 0), ("us", 0), ("us", 1)]
    for bad, why in ((good[:-1], "lacks"), ([*good[:-1], (3, "france", 0, 2, 4, 2)], "differ"), (good + [(s, "us", 2, 8, 12, 2) for s in (2, 3)], "overlap")):
        with pytest.raises(Exception, match=why):
            of(bad)
    s1 = spark.createDataFrame([(i,) for i in (1, 3, 5, 7, 9)], "id long")
    assert sorted(r["id"] for r in diagnostics.group_ids(s1, 3, 7, 3).collect()) == [3, 5, 7]
    with pytest.raises(ValueError):
        diagnostics.group_ids(s1, 3, 7, 4)


def test_splits(spark):
    ids = spark.range(1000).withColumnRenamed("id", "s1_id")
    s = splits.split(ids, 0.2)
    assert s.where("split = 1").count() == 200 and s.count() == 1000
    assert {r["fold"]: r["count"] for r in splits.folds(ids, 5).groupBy("fold").count().collect()} == dict.fromkeys(range(5), 200)
    assert splits.sample(ids, 10).join(s.where("split = 1"), "s1_id").count() == 10
    for bad in (0, 1, 2):
        with pytest.raises(ValueError):
            splits.split(ids, bad)
    with pytest.raises(ValueError):
        splits.split(ids.limit(0))


def test_tsv(spark, tmp_path, monkeypatch):
    path = tmp_path / "s1.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Acme ""A"" Ltd"\t\tUS\nS1-2\tBlue\t5 st\tIndia\n')
    at = f"file://{path}"
    rows = tables.load_entities(spark, at)
    assert [tuple(r) for r in rows.orderBy("entity_id").collect()][0] == ("S1-1", 'Acme "A" Ltd', "", "US")
    assert {r["column"]: r["n_blank"] for r in tables.summarize_entities(rows).collect()}["business_address"] == 1
    assert tables.load_entities(spark, at, ["country"], 1).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.load_entities(spark, at + "x")
    with pytest.raises(ValueError):
        tables.load_entities(spark, at, nrows=0)
    with pytest.raises(ValueError):
        tables.load_truth(spark, at)
    assert tables.convert(spark, at, f"file://{tmp_path}/pq") and not tables.convert(spark, at, f"file://{tmp_path}/pq")
    norm = tables.normalise(rows, 1)
    tables.write_partitioned(norm, f"file://{tmp_path}/cache", ["source", "country"])
    got = tables.load_partition(spark, f"file://{tmp_path}/cache", 1, "us", ["id", "norm_name"])
    assert [tuple(r) for r in got.collect()] == [(1, "acme a")] and [r[0] for r in tables.countries(norm).collect()] == ["india", "us"]
    monkeypatch.setenv(tables.ENV, "")
    assert tables.dataset_dir("d") == "d"
    monkeypatch.setenv(tables.ENV, "/x")
    assert tables.dataset_dir("d") == "/x"
    with pytest.raises(Exception, match="no entity"):
        tables.require_all(spark.createDataFrame([(9,)], "id long"), norm).collect()


def test_streaming_links_equal_batch_links(spark, tiny, tmp_path):
    s1, t, *_ = tiny
    src = f"file://{tmp_path}/in"
    s1.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(s1.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = f"file://{tmp_path}/out"
    q = link.link_batches(stream, t, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), f"file://{tmp_path}/check")
    q.awaitTermination(120)
    want = blocking.candidates(s1, t, ("exact_name", "name_token_sort"))
    assert tables.tables_equal(spark.read.parquet(out).select(*blocking.PAIR, "mask"), want.select(*blocking.PAIR, "mask"))
    q = link.exact_links(stream, t).writeStream.format("memory").queryName("links").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("links").count() == blocking.exact_name(s1, t).count()


def test_models_and_second_stage(spark):
    rows = spark.range(600).select((F.col("id") % 60).alias("s1_id"), (F.col("id") % 2 + 2).cast("int").alias("target_source"), F.col("id").alias("target_id"), (F.col("id") % 7 / 7).alias("name_ratio"), F.when(F.col("id") % 5 > 0, F.col("id") % 3 / 3).alias("address_token_set_ratio"),
        F.lit(1.0).alias("address_number_set_jaccard"), F.lit(0.5).alias("translit_skeleton_ratio"), F.lit(2).cast("long").alias("target_name_frequency"), F.lit(1).alias("house_number_match"), F.lit(0).alias("target_address_missing"), (F.col("id") % 7 >= 4).cast("int").alias("label"))
    p = models.TreeParams(rounds=5, depth=3)
    scored = models.out_of_fold(rows, ["name_ratio", "address_token_set_ratio"], 3, p).cache()
    assert scored.count() == 600 and metrics.rank_auc(scored).first()["auc"] > 0.95
    for kind in ("tree", "logistic"):
        out = models.apply_second_stage(models.second_stage(scored, kind, 0.1, p), scored, 0.1, 0.5)
        assert out.count() == 600 and out.where("predicted = label").count() > 540
    n = rows.groupBy("s1_id").agg(F.sum("label").alias("n_true"))
    t, best = models.choose(scored, n)
    assert 0 < t < 1 and best > 0.9
    flat = models.counterfactual(models.fit_trees(rows, ["name_ratio", "address_token_set_ratio"], p), rows, "name_ratio", "translit_skeleton_ratio")
    assert flat.where("counterfactual is not null").count() == 600
    audit = diagnostics.feature_audit(rows, ["name_ratio", "house_number_match"])
    assert [r["feature"] for r in audit["constant"].collect()] == ["house_number_match"]


def test_whole_queries_keep_large_blocks_and_all_channels(spark, tmp_path):
    spark.createDataFrame([(700 * k + 12, "BUILDING", 0) for k in range(150)], "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, 0)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    rows = catalogue._keyed(spark, str(tmp_path)).collect()
    s1, targets = [r for r in rows if r["source"] == 1], [r for r in rows if r["source"] > 1]
    of = lambda key: {(a["id"], t["source"], t["id"]) for a in s1 for t in targets if key(a) and key(a) == key(t)}
    got = lambda name: {(r["s1_id"], r["target_source"], r["target_id"]) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    for name, key in (("join_house_city", "house_city"), ("join_postal", "postal")):
        want = of(lambda r, key=key: r[key])
        assert len(want) > 500 and got(f"{name}_whole") == want and len(got(name)) < len(want), name
    names = of(lambda r: " ".join(sorted(r["norm_name"].split())))
    assert got("join_token_sort_whole") == names
    mask = {(r["s1_id"], r["target_source"], r["target_id"]): r["mask"] for r in catalogue.QUERIES["merge_candidates_mask_whole"](spark, str(tmp_path)).collect()}
    bit = lambda b: {k for k, m in mask.items() if m & b}
    assert bit(blocking.BITS["house_city"]) == of(lambda r: r["house_city"]) and bit(blocking.BITS["exact_name"]) == of(lambda r: r["norm_name"])
    assert bit(blocking.BITS["name_char"]) == of(lambda r: r["norm_name"] != "")  # fewer targets than k: all that share an n-gram
    assert bit(blocking.BITS["address_char"])
    scored = got("pair_scores")
    assert scored == set(mask)


def _customers(spark, at, n=360):
    """A customer and a nation table in which copies share names and addresses; what `views.ENTITIES` makes of them."""
    kinds = ["BUILDING", "MACHINERY", "FURNITURE"]
    spark.createDataFrame([(40 * 700 * (k % 4) + k // 4, kinds[k // 4 % 3], k // 4 % 2) for k in range(n)], "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(0, 0), (1, 4)], "n_nationkey int, n_regionkey int").write.parquet(f"{at}/nation.parquet")
    return [r.asDict() for r in catalogue.views.entities(spark, str(at)).collect()]


def _best(rows, column, k, pool, max_df, sizes=(3, 3), binary=True, min_df=0):
    """All queries against all targets, row by row: the oracle of blocking.tfidf_topk."""
    import math
    from collections import Counter

    def grams(x):
        words = [f" {w} " for w in x.split()]
        every = Counter(w[i : i + n] for n in range(sizes[0], sizes[1] + 1) for w in words for i in range(max(len(w) - n + 1, 1)))
        return {g: 1 for g in every} if binary else every

    out = {}
    for source, country in {(r["source"], r["country"]) for r in rows if r["source"] > 1}:
        targets = [(r["id"], grams(r[column])) for r in rows if (r["source"], r["country"]) == (source, country)]
        df = Counter(g for _, x in targets for g in x)

        def unit(x, df=df, n=len(targets)):
            w = {g: (math.log((1 + n) / (1 + df[g])) + 1) * (1 + math.log(c)) for g, c in x.items() if df[g] >= min_df}
            size = math.sqrt(sum(v * v for v in w.values()))
            return {g: v / size for g, v in w.items()}

        targets = [(i, unit(x)) for i, x in targets]
        for r in (r for r in rows if r["source"] == 1 and r["country"] == country):
            v = unit(grams(r[column]))
            dot = lambda w, cap, v=v, df=df: round(sum(x * w[g] for g, x in v.items() if g in w and (not cap or df[g] <= cap)), 9)
            found = sorted((-p, i, w) for i, w in targets if (p := dot(w, max_df)) > 0)[: pool or k]
            scored = sorted((-(dot(w, None) if pool else -p), p, i) for p, i, w in found)[:k]
            out |= {(r["id"], source, i): round(-s, 6) for s, p, i in scored}
    return out


SEARCHES = {
    "char_2_5_gram_knn": ("norm_name", 20, None, None, (2, 5), False, 2),
    "tfidf_topk_address": ("norm_address", 5, 40, 300),
    "tfidf_topk_address_whole": ("norm_address", 25, 1000, 30_000),
    "tfidf_topk_name": ("norm_name", 5, 20, None),
    "tfidf_topk_name_whole": ("norm_name", 100, 1000, 30_000),
}


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_go_over_different_texts_and_give_all_copies(spark, tmp_path, monkeypatch, name):
    rows = _customers(spark, tmp_path)
    asked, search = [], blocking.topk.search
    monkeypatch.setattr(blocking.topk, "search", lambda *a, **k: asked.append(search(*a, **k)) or asked[-1])
    found = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    got = {(r["s1_id"], r["target_source"], r["target_id"]): r["score"] for r in found}
    want = _best(rows, *SEARCHES[name])
    assert len(found) == len(got) and set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    column = SEARCHES[name][0]
    texts = {(r["country"], r[column]) for r in rows if r["source"] == 1 and r[column]}
    assert asked[0].count() == 2 * len(texts) < sum(r["source"] == 1 for r in rows)  # each text is searched once in each source


def test_search_of_addresses_drops_no_ngram_and_no_target(spark, tmp_path):
    kinds = ["MACHINERY", "FURNITURE", "BUILDING", "BUILDING", "BUILDING"]
    keys = [(k, i) for i in range(2100) if (k := 700 * i + 10 + i % 7 // 5) % 3 or i % 8 == 0]  # one country, nearly 700 targets a source, of few texts
    spark.createDataFrame([(k, kinds[i % 5], i // 5 % 4 // 3) for k, i in keys], "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, 0), (1, 0)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    rows = [r.asDict() for r in catalogue.views.entities(spark, str(tmp_path)).collect()]
    want, cut = _best(rows, "norm_address", 5, None, None), _best(rows, "norm_address", 5, 40, 300)
    assert len(set(want) - set(cut)) > 10  # what n-grams in over 300 targets, and targets after the first 40, would lose
    found = catalogue.QUERIES["tfidf_topk_address"](spark, str(tmp_path)).collect()
    got = {(r["s1_id"], r["target_source"], r["target_id"]): r["score"] for r in found}
    assert len(found) == len(got) and set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


@pytest.mark.parametrize("name", [n for n in SEARCHES if n.startswith("tfidf")])
def test_searches_read_stored_texts_and_derive_nothing_else(spark, tmp_path, monkeypatch, name):
    rows = _customers(spark, tmp_path)
    column, kept, found = SEARCHES[name][0], [], []
    stored, search = tables.stored, blocking.topk.search
    monkeypatch.setattr(catalogue.tables, "stored", lambda x, what: pytest.fail("entities are derived for a search"))
    monkeypatch.setattr(blocking.topk, "stored", lambda x, what: kept.append((what, stored(x, what))) or kept[-1][1], raising=False)
    monkeypatch.setattr(blocking.topk, "search", lambda *a, **k: found.append(search(*a, **k)) or found[-1])
    catalogue.QUERIES[name](spark, str(tmp_path))
    plan = found[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" not in plan and "transform(" not in plan  # n-grams are made for the different texts, once
    texts = lambda *by: len({tuple(r[c] for c in by) for r in rows if (r["source"] > 1) == ("source" in by)})
    assert {what: x.count() for what, x in kept} == {"targets": texts("source", "country", column), "queries": texts("country", column)}


def test_a_blocks_best_are_the_same_from_one_chunk_or_many():
    import numpy as np

    rng = np.random.default_rng(3)
    texts = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    many = rng.integers(1, 6, 60)
    ids = np.concatenate([np.sort(x) for x in np.split(rng.permutation(many.sum()), np.cumsum(many)[:-1])])
    weights = blocking.topk._Weights(np.arange(30), np.bincount(np.concatenate([np.repeat(t, m) for t, m in zip(texts, many, strict=True)]), minlength=30), int(many.sum()), 1, 60)
    lists = lambda x: (np.concatenate(x), None, np.array([len(y) for y in x]))
    results = []
    for step in (60, 7):
        block = blocking.topk._Block(weights, *lists(texts[:20]), 25, True, False)
        for i in range(0, 60, step):
            first = many[:i].sum()
            block.read(ids[first : first + many[i : i + step].sum()], many[i : i + step], *lists(texts[i : i + step]))
        results.append(block.result(10).to_pylist())
    assert results[0] == results[1] and {len(x) for x in results[0]} == {10}


@pytest.mark.parametrize("rescore", [False, True])
def test_a_blocks_best_are_the_same_whichever_ngrams_are_summed_as_matrices(monkeypatch, rescore):
    import numpy as np

    rng = np.random.default_rng(5)
    often = rng.dirichlet(np.full(40, 0.4))
    texts = [np.unique(rng.choice(40, 9, p=often)) for _ in range(300)]
    many = rng.integers(1, 4, 300)
    ids = np.concatenate([np.sort(x) for x in np.split(rng.permutation(many.sum()), np.cumsum(many)[:-1])])
    weights = blocking.topk._Weights(np.arange(40), np.bincount(np.concatenate([np.repeat(t, m) for t, m in zip(texts, many, strict=True)]), minlength=40), int(many.sum()), 1, 200 if rescore else None)
    lists = lambda x: (np.concatenate(x), None, np.array([len(y) for y in x]))
    results = []
    for times in (0, 6, 10_000):  # none, some, all
        monkeypatch.setattr(blocking.topk, "OFTEN", times)
        block = blocking.topk._Block(weights, *lists(texts[:100]), 7, rescore, False)
        for i in range(0, 300, 150):
            first = many[:i].sum()
            block.read(ids[first : first + many[i : i + 150].sum()], many[i : i + 150], *lists(texts[i : i + 150]))
        results.append(block.result(5).to_pylist())
    assert results[0] == results[1] == results[2] and max(len(x) for x in results[0]) == 5


def test_rare_tokens_are_told_apart_by_text_and_give_all_copies(spark, tmp_path, monkeypatch):
    rows = _customers(spark, tmp_path)
    monkeypatch.setattr(blocking, "PART", 7)  # so that common texts come in parts
    found = catalogue.QUERIES["token_index_rare_whole"](spark, str(tmp_path))
    from collections import Counter

    want = set()
    for source, country in {(r["source"], r["country"]) for r in rows if r["source"] > 1}:
        targets = [(r["id"], set(r["norm_name"].split())) for r in rows if (r["source"], r["country"]) == (source, country)]
        n = Counter(w for _, x in targets for w in x)
        for r in (r for r in rows if r["source"] == 1 and r["country"] == country):
            rarest = set(sorted((w for w in set(r["norm_name"].split()) if n[w]), key=lambda w, n=n: (n[w], w))[:3])
            want |= {(r["id"], source, i) for i, x in targets if x & rarest}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    last = plan[: plan.index("Aggregate [")]  # what comes after pairs are told apart
    assert last.count("Generate explode") == 2  # ids are given out last, no pair of them is shuffled


def _copied(spark, at):
    """Customers of whom every three differ in nothing but their ids."""
    spark.createDataFrame([(600600 * i + j, "BUILDING", j % 2) for i in range(3) for j in range(60)], "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(0, 0), (1, 4)], "n_nationkey int, n_regionkey int").write.parquet(f"{at}/nation.parquet")


def test_candidates_are_merged_once_for_equal_s1_and_given_out_to_all(spark, tmp_path, monkeypatch):
    _copied(spark, tmp_path)
    want = blocking.merge(blocking.channels(*catalogue._whole(spark, str(tmp_path)))).select(*blocking.PAIR, "mask").collect()
    merged, merge = [], blocking.merge
    monkeypatch.setattr(blocking, "merge", lambda x: merged.append(merge(x)) or merged[-1])
    got = catalogue.QUERIES["merge_candidates_mask_whole"](spark, str(tmp_path)).select(*blocking.PAIR, "mask").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 1000
    assert 3 * merged[0].count() == len(got)


def test_copies_hold_every_id_and_tell_null_from_empty(spark, monkeypatch):
    monkeypatch.setattr(blocking, "PART", 2)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, None), (4, "a"), (5, "a"), (6, "a"), (7, "a"), (8, "a")], "id long, norm_name string")
    one, lists = blocking.copies(rows)
    assert sorted(tuple(r) for r in one.collect()) == [(1, None), (2, ""), (4, "a")]
    out = blocking.given_out(spark.createDataFrame([(1, 9), (2, 8), (4, 7)], "s1_id long, target_id long"), lists)
    assert sorted(map(tuple, out.collect())) == [(1, 9), (2, 8), (3, 9), (4, 7), (5, 7), (6, 7), (7, 7), (8, 7)]


def test_pairs_are_scored_once_for_equal_s1_with_the_texts_of_each_target(spark, tmp_path, monkeypatch):
    _copied(spark, tmp_path)
    made, make = [], features.pair_table
    monkeypatch.setattr(features, "pair_table", lambda *a, **k: made.append(make(*a, **k)) or made[-1])
    got = catalogue.QUERIES["pair_scores"](spark, str(tmp_path)).select(*blocking.PAIR, "ratio").collect()
    rows = {(r["s1_id"], r["target_source"], r["target_id"]): (r["a_norm_name"], r["b_norm_name"], r["b_norm_address"]) for r in made[0].collect()}
    given = {r["id"]: (r["norm_name"], r["norm_address"]) for r in catalogue.views.entities(spark, str(tmp_path)).collect()}
    assert len(got) == len({tuple(r)[:3] for r in got}) == 3 * len(rows) > 1000
    assert all(x == (given[s][0], *given[t]) for (s, _, t), x in rows.items())


def _by_content(spark, monkeypatch, cap):
    """Small tables with copies, unlike names and empty texts, `cap` targets a block; all pairs kept and their features, pair by pair of ids."""
    from lodestitch.operators import contents

    names = [(c, n, a) for c, rows in (("us", US1), ("us", US2), ("france", FR1), ("france", FR2)) for _, n, a in rows] + [("us", "qqq", "12 main street springfield il"), ("us", "", ""), ("france", "zz", "75 rue brunet pessac")]
    rows = [(1000 * o + 100 * copy + i, o, *x) for o in (1, 2, 3) for i, x in enumerate(names) for copy in range(1 + (i + o) % 3)]
    every = spark.createDataFrame(rows, "id long, source int, country string, norm_name string, norm_address string").withColumn("truth_key", F.col("id"))
    monkeypatch.setattr(catalogue.views, "sides", lambda *_: (every.where("source = 1"), every.where("source > 1")))
    monkeypatch.setattr(catalogue.A, "learn_city_lexicon", lambda *_: spark.createDataFrame([("us", "springfield"), ("us", "portland")], "country string, token string"))
    for m in (blocking, contents):
        monkeypatch.setattr(m, "PART", 2)  # so that copies come in parts
    monkeypatch.setitem(blocking.DEFAULTS, "max_block", cap)
    a, t = catalogue._whole(spark, "")
    kept = features.prefilter(features.pair_table(blocking.candidates(a, t), a, t))
    return contents, [tuple(r) for r in features.features(kept).collect()]


def _same_rows(got, want):
    key = lambda r: r[:3]
    assert len(got) == len(want) > 100
    for x, y in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert all(p == q or (isinstance(p, float) and abs(p - q) < 1e-9) for p, q in zip(x, y, strict=True)), (x, y)


def test_features_compare_different_texts_once_and_are_given_out_last(spark, monkeypatch):
    contents, want = _by_content(spark, monkeypatch, 3)
    kept, stored = {}, contents.stored
    monkeypatch.setattr(contents, "stored", lambda x, what: kept.update({what: stored(x, what)}) or kept[what])
    got = catalogue.QUERIES["pair_features"](spark, "")
    assert got.columns[4:] == features.FEATURES
    _same_rows([tuple(r) for r in got.select("s1_id", "target_source", "target_id", "country", *features.FEATURES).collect()], want)
    for what, text in (("names", "name"), ("addresses", "address")):
        pairs = [tuple(r) for r in kept[what].select(f"a_{text}", f"b_{text}").collect()]
        assert len(pairs) == len(set(pairs)) < len(want) / 4, what  # classes of equal texts, each pair of them once


def test_prefilter_looks_at_addresses_only_where_names_and_keys_do_not_decide(spark, monkeypatch):
    contents, want = _by_content(spark, monkeypatch, 1000)
    asked, scores = [], contents.S.pair_scores
    monkeypatch.setattr(contents.S, "pair_scores", lambda a, b, names: asked.append((a, b)) or scores(a, b, names))
    seen, strings = [], contents.Compared._strings
    monkeypatch.setattr(contents.Compared, "_strings", lambda *x: seen.append((x[1], strings(*x))) or seen[-1][1])
    got = [tuple(r) for r in catalogue.QUERIES["prefilter_keep"](spark, "").collect()]
    _same_rows(got, [r[:3] for r in want])
    assert [x for x, _ in seen] == ["name", "address"] and asked[-1][1] == "b_norm_address"
    pairs = {(r["a_norm_address"], r["b_norm_address"]) for r in seen[1][1].collect()}
    given = {r["id"]: (r["norm_name"], r["norm_address"]) for r in catalogue.views.sides()[0].unionByName(catalogue.views.sides()[1]).collect()}
    alike = {(given[s][1], given[t][1]) for s, _, t in got if given[s][0] and given[s][0] == given[t][0]}
    assert pairs and alike - pairs  # pairs of equal names alone aren't among those whose addresses are looked at


@pytest.mark.parametrize("name", ["tfidf_topk_name", "tfidf_topk_name_whole"])
def test_searches_of_names_are_dealt_before_texts_are_made_and_count_once(spark, tmp_path, monkeypatch, name):
    rows = _customers(spark, tmp_path)
    plan = catalogue.views.sides(spark, str(tmp_path))[1]._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.find("concat(") < plan.find("RepartitionByExpression [c_custkey")
    monkeypatch.setattr(type(spark.range(1)), "count", lambda x: pytest.fail("sizes are counted by a job of their own"))
    got = {(r["s1_id"], r["target_source"], r["target_id"]): r["score"] for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    want = _best(rows, *SEARCHES[name])
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_prefilter_compares_nothing_of_pairs_that_keys_keep(spark, monkeypatch):
    contents, want = _by_content(spark, monkeypatch, 3)
    kept, stored = {}, contents.stored
    monkeypatch.setattr(contents, "stored", lambda x, what: kept.update({what: stored(x, what)}) or kept[what])
    _same_rows([tuple(r) for r in catalogue.QUERIES["prefilter_keep"](spark, "").collect()], [r[:3] for r in want])
    assert kept["names"].count() and not kept["names"].where("name_exact = 1").count()
