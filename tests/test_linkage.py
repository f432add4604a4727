"""Blocking, features, matching and diagnosis on a small set of records with known answers."""

import pytest
from pyspark.sql import functions as F

from kindred.functions import hashing, similarity
from kindred.functions import keys as K
from kindred.functions.text import normalize_records
from kindred.operators import blocking, diagnose, features, matching, profiles, sampling
from kindred.plans.linkage import Linkage
from kindred.sources import sinks, tables

RAW = [
    ("S1", "S1-1", 1, "Blue Sky Restaurant", "12 MG Road, Bengaluru", "India"),
    ("S1", "S1-2", 2, "Café & Co.", "N.A.", "France"),
    ("S1", "S1-3", 3, "Private Ltd", None, ""),
    ("S2", "S2-1", 4, "Restaurant Sky Blue", "12 M.G. Road Bengaluru", "India"),
    ("S2", "S2-2", 5, "Cafe and Company", "7 rue de la Paix", "France"),
    ("S2", "S2-3", 6, "Blue Skyline Resto", "99 Park Street", "India"),
    ("S3", "S3-1", 7, "ब्लू स्काई", "12 MG Road Bengaluru", "India"),
    ("S3", "S3-2", 8, "Blue", "", "India"),
]
SCHEMA = "source string, entity_id string, ord long, business_name string, business_address string, country string"
TRUTH = [("S1-1", ["S2-1", "S3-1"]), ("S1-2", ["S2-2"]), ("S1-3", [])]
VECTORS = {
    ("S1-1", "S2-1"): [0, 0.526316, 0.8, 1, 1, 1, 3, 1, 1, 0, 0.97561, 0.857143, 0.5, 1, 2, 0.8, 1, 0, 1, 1, 1, 1, 1, 1],
    ("S1-1", "S2-3"): [0, 0.702703, 0.478261, 0.947368, 0, 0.2, 1, 1, 1, 0, 0.235294, 0, 0, 0, 0, 0.75, 0, 1, 1, 1, 1, 1, 1, 1],
    ("S1-1", "S3-1"): [0, 0.068966, 0, 0.526316, 0, 0, 0, 0.666667, 0, 1, 1, 1, 1, 1, 2, 1, 1, 0, 1, 1, 1, 1, 1, 1],
    ("S1-2", "S2-2"): [0, 0.814815, 0.714286, 0.6875, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 0, 1, 1],
}


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(RAW, SCHEMA)


@pytest.fixture(scope="module")
def records(raw):
    return normalize_records(raw).cache()


@pytest.fixture(scope="module")
def edges(spark):
    return matching.truth_edges(spark.createDataFrame(TRUTH, "source1_entity_id string, matched_ids array<string>")).cache()


def test_keys(records):
    got = {}
    for r in blocking.keyed(records).collect():
        got.setdefault(r.entity_id, set()).add(tuple(r.key.split(K.SEPARATOR)))
    assert got["S1-1"] == {("name_2tok", "india", "blue", "rest"), ("addr_ht0", "india", "12", "ben"), ("addr_ht1", "india", "12", "roa")} == got["S2-1"]
    assert got["S1-2"] == {("name_2tok", "france", "cafe")} and "S1-3" not in got
    assert got["S2-2"] == {("name_2tok", "france", "cafe"), ("addr_ht0", "france", "7", "pai"), ("addr_ht1", "france", "7", "rue")}
    assert got["S2-3"] == {("name_2tok", "india", "blue", "rest"), ("addr_ht0", "india", "99", "str"), ("addr_ht1", "india", "99", "par")}
    assert got["S3-2"] == {("name_2tok", "india", "blue")}
    a2 = {r.entity_id: tuple(r.k.split(K.SEPARATOR)[1:]) for r in records.select("entity_id", K.a2_key().alias("k")).where("k is not null").collect()}
    assert a2["S1-1"] == ("india", "blue", "sky") and a2["S2-1"] == ("india", "rest", "sky") and a2["S2-3"] == ("india", "blue", "skyl") and "S3-2" not in a2


def test_config():
    for bad in ({"name_tokens": 0}, {"name_prefix": 0}, {"address_prefix": 0}, {"max_group_size": 0}, {"address_words": -1}):
        with pytest.raises(ValueError):
            K.BlockingConfig(**bad)
    assert K.BlockingConfig(address_words=0).address_words == 0


def test_candidates_and_recall(records, edges):
    pairs = blocking.candidates(records)
    assert {(r.ref_id, r.cand_id) for r in pairs.collect()} == set(VECTORS)
    r = profiles.recall(pairs, edges).first()
    assert (r.true_pairs, r.found_pairs, r.recall) == (3, 3, 1.0)
    arms = blocking.two_arms(records)
    assert arms.where("not is_prod").count() == 0
    assert tuple(blocking.pair_faults(arms).first()) == (0, 0, 0)


def test_cap(spark):
    rows = [("S2", f"S2-{i}", i, "same", None, "x") for i in (5, 3, 1, 4, 2)]
    df = normalize_records(spark.createDataFrame(rows, SCHEMA))
    config = K.BlockingConfig(max_group_size=3)
    assert sorted(r.entity_id for r in blocking.build_index(df, config).collect()) == ["S2-1", "S2-2", "S2-3"]
    s = blocking.index_stats(df, config).first()
    assert (s.indexed_records, s.keyless_records, s.distinct_keys, s.largest_group, s.capped_groups, s.stored_references) == (5, 0, 1, 3, 1, 3)
    s = blocking.index_stats(df.where("ord <= 3"), config).first()
    assert s.capped_groups == 0 and blocking.index_stats(df.limit(0), config).first().distinct_keys == 0


def test_order_of_sources_and_partitions(spark, records):
    many = records.unionByName(records.withColumn("source", F.lit("S9")))
    config = K.BlockingConfig(max_group_size=2)
    want = None
    for n in (1, 3, 7):
        got = sorted(map(tuple, blocking.build_index(many.repartition(n), config).collect()))
        want = want or got
        assert got == want


def test_cap_over_the_group_limit(records, monkeypatch):
    many = records.unionByName(records.withColumn("source", F.lit("S9")))
    config = K.BlockingConfig(max_group_size=2)
    index = lambda **how: sorted(map(tuple, blocking.build_index(many, config, **how).collect()))
    want = index(), index(per_source=True)
    monkeypatch.setattr(blocking, "GROUP_LIMIT", 1)
    monkeypatch.setattr(blocking, "PARTS", 3)
    assert (index(), index(per_source=True)) == want


def test_self_pairs(records):
    index = blocking.build_index(records)
    pairs = blocking.generate_candidates(records, index)
    assert pairs.where("ref_source = cand_source and ref_id = cand_id").count() == 0
    twin = records.withColumn("source", F.concat("source", F.lit("x")))
    assert blocking.generate_candidates(records.where("entity_id = 'S3-2'"), blocking.build_index(twin)).count() == 1


def test_features(records):
    pairs = blocking.candidates(records)
    rows = features.featurize(pairs, records)
    for r in rows.collect():
        assert [round(r[n], 6) for n in features.FEATURE_NAMES] == VECTORS[r.ref_id, r.cand_id]
    assert tuple(features.health(rows).first()) == (4, 0, 0)
    assert len(rows.select(features.vector().alias("v")).first().v) == 24
    assert [r.entity_id for r in features.unknown_records(pairs, records.where("entity_id <> 'S2-3'")).collect()] == ["S2-3"]


def test_ratio_is_oriented():
    assert similarity.matched_ratio("tide", "diet") == 0.25 and similarity.matched_ratio("diet", "tide") == 0.5
    assert round(similarity.matched_ratio("restaurant", "restaurante"), 6) == 0.952381


def test_strict_bigrams(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("ab", "ab"), ("", ""), ("abc", "abd")], "a string, b string")
    assert [r[0] for r in df.select(similarity.strict_bigram_jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0, 1.0, 1 / 3]


def test_hashes(spark):
    assert [hashing.bucket_of(i, "v1") for i in ("S1-1", "S1-2", "S1-100", "S1-681193310")] == [3824, 3348, 8384, 4274]
    assert [hashing.bucket_of(i, "exp20k-split-v1") for i in ("S1-1", "S1-2", "S1-100", "S1-681193310")] == [3830, 558, 9080, 1213]
    assert [hashing.keyed_hash(i, "exp20k-s1") % 110 for i in ("S1-1", "S1-2", "S1-100", "S1-681193310")] == [67, 26, 90, 63]
    df = spark.createDataFrame([("S1-1",), ("S1-2",)], "ref_id string")
    sides = {r.ref_id: r.is_validation for r in matching.split_by_reference(df, salt="exp20k-split-v1").collect()}
    assert sides == {"S1-1": False, "S1-2": True}
    for f in (0, 1, -0.5):
        with pytest.raises(ValueError):
            matching.split_by_reference(df, fraction=f)


def test_metrics(spark):
    rows = [(1, 0.9), (1, 0.6), (0, 0.6), (0, 0.1), (1, 0.05)]
    df = spark.createDataFrame(rows, "label int, score double")
    r = {x.threshold: x for x in matching.evaluate_thresholds(df).collect()}
    assert (r[0.6].true_positives, r[0.6].false_positives, r[0.6].false_negatives) == (2, 1, 1)
    assert r[0.9].precision == 1.0 and round(r[0.9].recall, 6) == 0.333333
    assert matching.best_threshold(matching.evaluate_thresholds(df)).first().threshold == 0.9
    one = spark.createDataFrame([(9, 1, 6)], "true_positives int, false_positives int, false_negatives int")
    assert round(matching._metrics(one, 0.5).first().f_beta, 6) == 0.818182
    nothing = df.withColumn("prediction", F.lit(0))
    assert matching.precision_recall_fbeta(nothing).first().f_beta == 0.0
    ties = df.select("label", F.lit(0.95).alias("score"))
    assert matching.best_threshold(matching.evaluate_thresholds(ties)).first().threshold == 0.9


def test_macro(spark):
    pairs = spark.createDataFrame([("a", 1, 1), ("b", 1, 0), ("c", 0, 1)], "ref_id string, label int, prediction int")
    refs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "ref_id string")
    r = matching.macro_fbeta(pairs, refs).first()
    assert (r.n_references, r.macro_f_beta) == (4, 0.5)


def test_matcher(spark):
    import random

    rng = random.Random(1)
    rows = [(x, y, int(2 * x - y + rng.gauss(0, 0.5) > 0)) for x, y in ((rng.random(), rng.random()) for _ in range(300))]
    df = spark.createDataFrame(rows, "x double, y double, label int")
    m = matching.LogisticMatcher(features=("x", "y")).fit(df)
    w, b = [0.0, 0.0], 0.0
    import numpy as np

    a = np.array([[x, y, 1] for x, y, _ in rows])
    t = np.array([label for *_, label in rows])
    v = np.zeros(3)
    for _ in range(50):  # Newton steps on half the squared weights plus C times the log losses
        p = 1 / (1 + np.exp(-a @ v))
        g = a.T @ (p - t) + np.array([v[0], v[1], 0])
        v -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag([1, 1, 0]), g)
    assert np.allclose([m.coefficients()["x"], m.coefficients()["y"], m.model.intercept], v, atol=1e-3)
    assert m.summary.converged and m.summary.n_features == 2 and m.summary.n_positive == int(t.sum())
    assert m.predict(df, 0.5).where("prediction = label").count() > 200
    balanced = matching.LogisticMatcher(class_weight="balanced", features=("x", "y")).fit(df)
    assert balanced.coefficients() != m.coefficients()
    with pytest.raises(ValueError):
        m.fit(df.where("label = 1"))
    with pytest.raises(RuntimeError):
        matching.LogisticMatcher(features=("x",)).predict_proba(df)
    assert w == [0.0, 0.0] and b == 0.0


def test_diagnosis(spark, records):
    edges = spark.createDataFrame([("S1-1", "S3-2"), ("S1-3", "S3-2"), ("S1-1", "S2-1"), ("S1-2", "S9-9")], "ref_id string, cand_id string")
    missed = diagnose.missed_pairs(edges, blocking.candidates(records))
    rows = {(r.ref_id, r.cand_id): r for r in diagnose.flagged(missed, records).collect()}
    assert set(rows) == {("S1-1", "S3-2"), ("S1-3", "S3-2"), ("S1-2", "S9-9")}
    one = rows["S1-1", "S3-2"]
    assert one.name_1tok_vs_multi and one.addr_no_key_either and not one.addr_key_differs and one.category == "1-token vs multi-token name (no padding)"
    assert rows["S1-3", "S3-2"].category == "no usable key on either side" and rows["S1-2", "S9-9"].category == "record unavailable"
    counts = {r.flag: r.n for r in diagnose.flag_counts(diagnose.flagged(missed, records)).collect()}
    assert len(counts) == 19 and counts["name_1tok_vs_multi"] == 1
    hits = {r.family: r.n for r in diagnose.recovery_counts(diagnose.recovery(missed, records)).collect()}
    assert hits == {"name_1tok": 1, "any": 1}


def test_capped_pair_is_diagnosed(spark):
    rows = [("S1", "S1-1", 0, "same", None, "x")] + [("S2", f"S2-{i}", i, "same", None, "x") for i in range(1, 5)]
    r = normalize_records(spark.createDataFrame(rows, SCHEMA))
    config = K.BlockingConfig(max_group_size=3)
    edges = spark.createDataFrame([("S1-1", "S2-4")], "ref_id string, cand_id string")
    row = diagnose.flagged(diagnose.missed_pairs(edges, blocking.candidates(r, config)), r, config).first()
    assert row.shared_key_was_capped and row.category == "shared key truncated by cap=3"


def test_sampling(spark, raw):
    pool = raw.where("source <> 'S1'")
    matched = spark.createDataFrame([("S2", "S2-3")], "source string, entity_id string")
    got = sampling.restrict_pool(pool, matched, F.lit(True), 1)
    assert sorted(r.entity_id for r in got.collect()) == ["S2-1", "S2-3", "S3-1"]
    assert sampling.first_sampled(raw, 2, modulus=1).count() == 2


def test_profiles(spark, raw, records, edges):
    p = {r.source: r for r in profiles.source_profile(raw).collect()}
    assert (p["S1"].n_rows, p["S1"].empty_addresses, p["S3"].empty_addresses) == (3, 1, 1)
    truth = spark.createDataFrame(TRUTH, "source1_entity_id string, matched_ids array<string>")
    t = profiles.truth_profile(truth).first()
    assert (t.n_rows, t.singletons, t.total_pairs, t.s2_pairs, t.s3_pairs, t.mean_matches) == (3, 1, 3, 2, 1, 1.0)
    v = profiles.volume(records.where("source = 'S1'").select(F.col("entity_id").alias("ref_id")), blocking.candidates(records)).first()
    assert (v.total, v.largest, v.without, v.upper_median) == (4, 3, 1, 1)
    routes = {r.route: r.n for r in profiles.resolution(blocking.two_arms(records), edges).collect()}
    assert routes == {"production": 3}


def test_result_files(spark, tmp_path, records, edges):
    pairs = blocking.candidates(records)
    matches = matching.label_candidates(pairs, edges).where("label = 1").drop("label")
    refs = records.where("source = 'S1'").select(F.col("entity_id").alias("ref_id"))
    sinks.write_matching_results(refs, matches, str(tmp_path / "matching_results.tsv"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "matching_results.tsv")).collect())
    assert lines == ["S1-1\tS2-1,S3-1", "S1-2\tS2-2", "S1-3\t"]
    sinks.write_candidate_pairs(pairs, matches, str(tmp_path / "pairs"))
    assert spark.read.csv(str(tmp_path / "pairs"), sep="\t", header=True).count() == 4
    with pytest.raises(ValueError):
        sinks.write_candidate_pairs(pairs.where("cand_id <> 'S2-1'"), matches, str(tmp_path / "bad"))
    sinks.write_candidates(pairs, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).where("cand_source = 'S2'").count() == 3


def test_stages(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for config in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert sinks.Stages(spark, str(tmp_path), config).run("x", make).count() == 3
    assert len(calls) == 2
    sinks.Stages(spark, str(tmp_path), {"a": 2}, force=True).run("x", make)
    assert len(calls) == 3


def test_other_input_is_worked_on_anew(spark, tmp_path, raw):
    truth = spark.createDataFrame(TRUTH, "source1_entity_id string, matched_ids array<string>")
    first = Linkage(spark, str(tmp_path)).run(raw, truth, until="dataset")["dataset"].count()
    fewer = raw.where("entity_id <> 'S2-1'")
    again = Linkage(spark, str(tmp_path)).run(fewer, truth, until="dataset")["dataset"]
    assert again.count() == first - 1 and again.where("entity_id = 'S2-1'").count() == 0
    shuffled = fewer.repartition(3, "business_name")
    assert sinks.table_digest(shuffled) == sinks.table_digest(fewer) != sinks.table_digest(raw)
    assert sinks.table_digest(raw.limit(0))["rows"] == "0"


def test_text_replaces_text(spark, tmp_path):
    for text in ("one", "two"):
        sinks.write_text(spark, str(tmp_path / "t.txt"), text)
        assert sinks.read_text(spark, str(tmp_path / "t.txt")) == text
    assert not (tmp_path / "t.txt.tmp").exists()


def test_pair_of_an_unknown_record_fails(spark, records):
    pairs = blocking.candidates(records).select(*blocking.PAIR)
    known = features.featurize(pairs, records).count()
    fewer = records.where("entity_id <> 'S3-1'")
    assert [r.entity_id for r in features.unknown_records(pairs, fewer).collect()] == ["S3-1"]
    with pytest.raises(Exception, match="not there: S3-1"):
        features.featurize(pairs, fewer).collect()
    assert known == len(VECTORS)


def test_tsv_without_line_breaks(spark, tmp_path):
    lines = "".join(f"S2-{i}\tname {i}\t{i} road\tIN\n" for i in range(20_000))
    (tmp_path / "s.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + lines)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "100000")
        got = tables.read_source_tsv(spark, str(tmp_path / "s.tsv"), "S2", line_breaks=False)
        assert got.rdd.getNumPartitions() > 1
        assert [r.entity_id for r in got.orderBy("ord").collect()] == [f"S2-{i}" for i in range(20_000)]
    finally:
        spark.conf.set(name, before)


def test_run_until_features(spark, tmp_path, raw):
    truth = spark.createDataFrame(TRUTH, "source1_entity_id string, matched_ids array<string>")
    out = Linkage(spark, str(tmp_path)).run(raw, truth, until="features")
    assert out["features"].count() == 4 and out["features"].agg(F.sum("label")).first()[0] == 3
    with pytest.raises(ValueError):
        Linkage(spark, str(tmp_path)).run(raw, truth, until="nothing")


def test_stream(spark, tmp_path, raw, records):
    from kindred.streaming.linkage import link_stream

    index = blocking.build_index(records.where("source <> 'S1'"))
    raw.where("source = 'S1'").write.parquet(str(tmp_path / "in"))
    arrivals = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    query = link_stream(arrivals, index, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert {(r.ref_id, r.cand_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == set(VECTORS)


def test_tsv(spark, tmp_path):
    data = b'entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\t"a ""q"" b"\t1 x\tUS\nS2-2\tab "c"\n\nS2-3\tx\tna\t\n  \tq\tr\tUS\nS2-4\t"multi\nline"\tz\tIN\r\nS2-5\tbad\xff\tz\tIN\nS2-6\t a lead\tz \tIN\n'
    (tmp_path / "s.tsv").write_bytes(data)
    got = {r.entity_id: r for r in tables.read_source_tsv(spark, str(tmp_path / "s.tsv"), "S2").collect()}
    assert set(got) == {f"S2-{i}" for i in range(1, 7)}
    assert got["S2-1"].business_name == 'a "q" b' and got["S2-2"].business_address == "" and got["S2-4"].business_name == "multi\nline" and got["S2-4"].country == "IN"
    assert got["S2-5"].business_name == "bad�" and got["S2-6"].business_name == " a lead"
    (tmp_path / "e.tsv").write_bytes(b"")
    assert tables.read_source_tsv(spark, str(tmp_path / "e.tsv"), "S2").count() == 0
    (tmp_path / "m.tsv").write_bytes(b"country\textra\tentity_id\n")
    with pytest.raises(ValueError):
        tables.read_source_tsv(spark, str(tmp_path / "m.tsv"), "S2")
    (tmp_path / "o.tsv").write_bytes(b"country\textra\tbusiness_address\tentity_id\tbusiness_name\nX\t?\tA\tS2-9\tN\n")
    r = tables.read_source_tsv(spark, str(tmp_path / "o.tsv"), "S2").first()
    assert (r.country, r.business_address, r.business_name) == ("X", "A", "N")


def test_truth(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("matched_entity_ids\tsource1_entity_id\nS2-1, S3-1,,S2-1\tS1-1\n\tS1-2\nS2-9\tS1-1\nS2-7\t \n")
    got = {r.source1_entity_id: r.matched_ids for r in tables.read_truth_tsv(spark, str(tmp_path / "t.tsv")).collect()}
    assert got == {"S1-1": ["S2-9"], "S1-2": []}
    wanted = spark.createDataFrame([("S1-2",)], "source1_entity_id string")
    assert tables.read_truth_tsv(spark, str(tmp_path / "t.tsv"), wanted).count() == 1


def test_paths(tmp_path):
    import zipfile

    for name in tables.FILES:
        (tmp_path / "d").mkdir(exist_ok=True)
        (tmp_path / "d" / name).write_text("")
    assert tables.find_train_dir(str(tmp_path)) == str(tmp_path / "d")
    assert tables.train_path(str(tmp_path / "d"), tables.FILES[0]).endswith(tables.FILES[0])
    for bad in ("test_source1.tsv", "../x.tsv", "/etc/passwd"):
        with pytest.raises(ValueError):
            tables.train_path(str(tmp_path / "d"), bad)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ok.txt", "1")
    assert tables.find_dataset_zip([str(tmp_path)], "NO_SUCH_VARIABLE").endswith("a.zip")
    assert tables.safe_extract(str(tmp_path / "a.zip"), str(tmp_path / "x")) == ["ok.txt"]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil.txt", "1")
    with pytest.raises(ValueError):
        tables.safe_extract(str(tmp_path / "b.zip"), str(tmp_path / "x"))


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("a.total", 1234567.0), ("b", None)], "measure string, value double")
    text = sinks.write_report(spark, df, str(tmp_path / "report"))
    assert "1.23457e+06" in text and (tmp_path / "report.txt").read_text() == text
    assert '"a.total": 1234567.0' in (tmp_path / "report.json").read_text()
