"""Rules, edge cases and statistical properties of the operators."""

import statistics

import pytest
from pyspark.sql import functions as F

from tessera.functions import rng, scalar
from tessera.operators import aggregate, dp, encode, joins, keys, policy, profile, relational, report, spn
from tessera.operators.arf import ARF, ARFParams
from tessera.plans import pipeline
from tessera.sources import tables as io
from tessera.types import ForeignKey, TableSpec


def test_uniforms_are_uniform_and_do_not_depend_on_partitions(spark):
    df = spark.range(20000)
    u = rng.uniform(1, "a", F.col("id"))
    a = {r[0]: r[1] for r in df.select("id", u).collect()}
    b = {r[0]: r[1] for r in df.repartition(7).select("id", u).collect()}
    assert a == b
    assert abs(statistics.mean(a.values()) - 0.5) < 0.01 and abs(statistics.pvariance(a.values()) * 12 - 1) < 0.03


def test_normal_distribution(spark):
    xs = [0.001, 0.01, 0.3, 0.5, 0.77, 0.99, 0.9999]
    d = spark.createDataFrame([(x,) for x in xs], "p double")
    for r in d.select("p", scalar.normal_quantile(F.col("p")).alias("q"), scalar.normal_cdf(scalar.normal_quantile(F.col("p"))).alias("back")).collect():
        assert abs(r["q"] - statistics.NormalDist().inv_cdf(r["p"])) < 1e-6 and abs(r["back"] - r["p"]) < 1e-7


def test_masks_and_placeholders(spark):
    d = spark.createDataFrame([(1, "AB-12 c"), (2, None)], "id long, v string")
    assert [r[0] for r in d.orderBy("id").select(scalar.mask_of(F.col("v"))).collect()] == ["AA-DD a", None]
    got = d.select(*[scalar.placeholder(s, "1", "c", F.col("id")).alias(s) for s in ("name", "email", "phone", "national_id", "address", "token")]).collect()
    assert got[0]["email"] != got[1]["email"] and got[0]["email"].endswith("@example.invalid") and len(got[0]["phone"]) == 12
    assert scalar.placeholder_style("home_email") == "email" and scalar.placeholder_style("qty") == "token"


def test_dates_do_not_throw(spark):
    d = spark.createDataFrame([("2020-02-30",), ("2020-02-28",), ("+60123456789",), ("",), (None,)], "v string")
    assert [r[0] is not None for r in d.select(scalar.parse_date(F.col("v"))).collect()] == [False, True, False, False, False]


def test_kinds(spark):
    rows = [(i, i % 3, float(i) * 1.5, f"x{i}", f"2020-01-{1 + i % 28:02d}", None, i % 2 == 0) for i in range(200)]
    d = spark.createDataFrame(rows, "id long, few int, num double, ref string, day string, none string, flag boolean")
    assert profile.infer_kinds(d) == {"id": "numerical", "few": "categorical", "num": "numerical", "ref": "non_std", "day": "datetime", "none": "categorical", "flag": "categorical"}
    with pytest.raises(TypeError):
        profile.infer_kinds(spark.createDataFrame([([1],)], "a array<int>"))


def test_empty_table_profiles(spark):
    d = spark.createDataFrame([], "a long, b string")
    assert {r["n_rows"] for r in profile.null_and_distinct(d).collect()} == {0}
    assert profile.infer_kinds(d) == {"a": "categorical", "b": "categorical"}
    assert keys.containment(d, ["a"], d, ["a"]).first()["containment"] == 1.0
    assert not keys.uniqueness(d, ["a"]).first()["is_unique"]


def test_key_rules():
    assert keys.looks_like_key("user_id") and keys.looks_like_key("GUID") and not keys.looks_like_key("c_custkey")
    assert [keys.singular(x) for x in ("cities", "classes", "orders", "nation")] == ["city", "class", "order", "nation"]
    assert keys.topological_order({"c": ["b"], "b": ["a"], "a": ["a"], "x": ["y"], "y": ["x"]}) == ["a", "b", "c", "x", "y"]
    fks = [ForeignKey("c", ["k"], "b", ["k"]), ForeignKey("b", ["k"], "a", ["k"])]
    assert keys.depths(fks, ["a", "b", "c"]) == {"a": 0, "b": 1, "c": 2}


def test_orphans_below_and_above_the_limit(spark):
    parent = spark.createDataFrame([(i,) for i in range(90)], "parent_id long")
    child = spark.createDataFrame([(i, i) for i in range(100)], "child_id long, parent_id long")
    assert keys.infer_schema({"parent": parent, "child": child}).foreign_keys[0].containment == 0.9
    assert not keys.infer_schema({"parent": parent.filter("parent_id < 80"), "child": child}).foreign_keys


def test_validation_messages(spark):
    d = spark.createDataFrame([(1, 2)], "a_id long, b_id long")
    specs = {"a": TableSpec("a", "nothing"), "b": TableSpec("b", "b_id", [ForeignKey("b", [], "a", [])]), "c": TableSpec("c", "b_id", [ForeignKey("c", ["a_id"], "zzz", ["x"])])}
    codes = {r["code"] for r in keys.validate_schema(spark, {"a": d, "b": d, "c": d}, specs).collect()}
    assert {"key_missing", "incomplete", "parent_missing", "key_shared"} <= codes


def test_policy_precedence(spark):
    cols = "table_name string, column_name string, tags array<string>, is_key boolean, inferred_tag string, sensitive_table boolean"
    rows = [("t", "k", ["PCI"], True, None, True), ("t", "p", ["PCI", "PII"], False, None, True), ("t", "q", ["DOB", "FINANCIAL"], False, None, True), ("t", "u", [], False, None, True), ("t", "g", [], False, "INFERRED:EMAIL", True), ("t", "n", None, False, None, False)]
    d = spark.createDataFrame(rows, cols)
    got = lambda mode: {r["column_name"]: r["strategy"] for r in policy.decide(d, mode).collect()}
    assert got("balanced") == {"k": "PSEUDONYM", "p": "SUPPRESS", "q": "GENERALISE", "u": "MODEL", "g": "PSEUDONYM", "n": "MODEL"}
    assert got("strict")["u"] == "PSEUDONYM" and got("permissive")["g"] == "MODEL"
    assert policy.name_tag("full_name") == "INFERRED:NAME" and policy.name_tag("Phone No") == "INFERRED:PHONE" and policy.name_tag("amount") is None


@pytest.mark.parametrize(
    "tag, names",
    [
        ("NAME", "name names first_name surname sur_name given_names Middle-Name"), ("EMAIL", "email e_mail home_email mail_address"), ("PHONE", "phone mobile_1 telephone tel msisdn contact_no"),
        ("NATIONAL_ID", "national_id nric fin_no ic_no passport_no ssn social_security tax_id uen"), ("ADDRESS", "street address_line1 home_address mailing_address addr"), ("USERNAME", "username login"),
        ("BANK_ACCOUNT", "iban swift bank_account_no account_number acct_no primary_account_number"), ("CARD_NUMBER", "card_number card_no cardno"), ("CARD_SECURITY_CODE", "cvv cvc csc security_code"),
    ],
)
def test_names_that_give_a_column_away(tag, names):
    assert {policy.name_tag(n) for n in names.split()} == {f"INFERRED:{tag}"}


def test_names_that_do_not():
    assert not any(map(policy.name_tag, ["amount", "renames", "balance", "segment", "created_at", "o_orderkey", "date_of_birth", "income"]))
    styles = {n: scalar.placeholder_style(n) for n in ("contact", "contact_name", "work_mail", "national_ref", "addr2", "passport", "qty")}
    assert styles == {"contact": "phone", "contact_name": "phone", "work_mail": "email", "national_ref": "national_id", "addr2": "address", "passport": "national_id", "qty": "token"}


def test_generalise(spark):
    d = spark.createDataFrame([(float(i), f"2020-01-{1 + i:02d}", "x") for i in range(20)] + [(None, None, None)], "n double, d string, c string")
    got = policy.generalise(d, ["n", "d", "c"]).collect()
    assert {r["d"] for r in got} == {"2020", None} and len({r["n"] for r in got}) == 11 and {r["c"] for r in got} == {"x", None}


def test_aggregate_cap_and_config(spark):
    c = aggregate.AggregationConfig.from_config({"agg_include_mean": "tue", "agg_quantiles": "0.1, 0.9"}, {"include_std": False, "agg_k_first": 2, "agg_check_increasing": True})
    assert c.mean and not c.std and c.quantiles == (0.1, 0.9) and c.k_first == 2 and c.is_increasing
    d = spark.createDataFrame([(1, 1.0, "a"), (1, None, None), (2, 3.0, "b"), (None, 5.0, "b")], "k long, x double, s string")
    out = aggregate.aggregate(d, ["k"], ["x", "s"], aggregate.AggregationConfig(most_columns=4))
    assert out.columns == ["k", "count", "x__mean", "s__na_ratio", "x__std"]
    assert aggregate.aggregate(d.limit(0), ["k"], ["x"]).count() == 0


def test_series_with_nulls(spark):
    d = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (1, 3, 7.0), (1, 4, 6.0), (2, 1, None)], "k long, t long, x double")
    c = aggregate.AggregationConfig(decrease_ratio=True, first_max_pos=True, k_first=2, most_columns=100)
    r = {x["k"]: x for x in aggregate.aggregate(d, ["k"], ["x"], c, ["t"]).collect()}
    assert (r[1]["x__end_start_diff"], r[1]["x__increase_ratio"], r[1]["x__decrease_ratio"], r[1]["x__first_max_pos"], r[1]["x__first2"], r[1]["x__last1"]) == (1.0, 0.5, 0.5, 0.5, 7.0, 6.0)
    assert r[2]["x__end_start_diff"] is None and r[2]["x__first1"] is None and r[2]["count"] == 1


def test_expand_and_pin(spark):
    p = spark.createDataFrame([("a", 3), ("b", 0), ("c", None), ("d", 1)], "_rid string, d long")
    assert joins.expand(p, "d").count() == 4
    pinned = relational.pin_degrees(p.na.fill(0), "d", 10, "_rid", 1)
    assert pinned.agg(F.sum("d")).first()[0] == 10 and pinned.filter("_rid = 'b'").first()["d"] == 0


def test_copies_match_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    b = spark.createDataFrame([(1, None), (3, "x"), (1, None)], "a long, b string")
    assert joins.row_copies(a, b, ["a", "b"]).first()["n_copied"] == 2
    assert report.tvd(a, a, "b").first()["tvd"] == 0


def test_round_trip(spark):
    d = spark.createDataFrame([(i, i % 4, f"c{i % 3}", round(i * 0.25, 2), None if i % 5 == 0 else i) for i in range(100)], "id long, f int, c string, x double, n long")
    specs = [s for s in encode.fit(d) if s.name != "id"]
    back = encode.inverse_transform(encode.transform(d, specs, keep=["id"]), specs, "id", 1)
    assert sorted(map(tuple, back.select(*d.columns).collect()), key=str) == sorted(map(tuple, d.collect()), key=str)
    assert encode.domain_summary(specs)["declared"] == []


def test_mirror_columns_stay_alike(spark):
    d = spark.createDataFrame([(i, f"v{i % 7}", f"v{i % 7}") for i in range(50)], "id long, a string, b string")
    specs = encode.fit(d.drop("id"))
    assert specs[1].mirror_of == "a"
    out = encode.inverse_transform(encode.transform(d, specs, keep=["id"]), specs, "id", 1).collect()
    assert all(r["a"] == r["b"] for r in out)


def test_minted_keys(spark):
    d = spark.range(500).withColumnRenamed("id", "rid")
    k = [r[0] for r in encode.mint_keys(d, "rid", "card_txn", "n", "key", "CT").select("key").collect()]
    assert len(set(k)) == 500 and all(x.startswith("CT") and len(x) == 11 for x in k)


def test_chi_square():
    assert abs(spn.chi_square_p(3.841458820694124, 1) - 0.05) < 1e-9 and abs(spn.chi_square_p(18.307038053275146, 10) - 0.05) < 1e-9
    cells = {(0.0, 0.0): 10.0, (0.0, 1.0): 20.0, (1.0, 0.0): 30.0, (1.0, 1.0): 40.0}
    stat, df = spn.chi_square(cells)
    assert df == 1 and abs(stat - 0.4464285714) < 1e-6  # with the correction for two by two
    assert spn.dependent({(0.0, 0.0): 5.0}) and not spn.dependent({(0.0, 0.0): 50.0, (0.0, 1.0): 50.0})


def test_network_keeps_dependence(spark):
    d = spark.range(3000).select((F.col("id") % 2).cast("int").alias("a"), (100 * (F.col("id") % 2) + (F.col("id") % 61) / 10).cast("double").alias("x"), (F.col("id") % 3).cast("int").alias("z"))
    specs = encode.fit(d)
    m = spn.SPN(spn.SPNParams(beta=200, max_depth=3), specs).fit(encode.transform(d, specs))
    again = spn.SPN.from_json(m.to_json())
    rows = again.sample(spark.range(3000).withColumnRenamed("id", "rid"), "rid", 1, "t")
    out = encode.inverse_transform(rows, specs, "rid", 1).persist()
    means = {r["a"]: r["m"] for r in out.groupBy("a").agg(F.avg("x").alias("m")).collect()}
    assert means[1] - means[0] > 80 and out.agg(F.max("x")).first()[0] <= 106
    given = m.sample(spark.range(500).withColumnRenamed("id", "rid"), "rid", 2, "t", {"a": F.lit(float(specs[0].categories.index("1")))})
    assert given.agg(F.avg("x")).first()[0] > 80


def test_private_network(spark):
    d = spark.range(2000).select((F.col("id") % 2).cast("int").alias("a"), (F.col("id") % 50).cast("double").alias("x"))
    specs = encode.fit(d, domain={"x": {"min_val": 0, "max_val": 50}})
    m = spn.SPN(spn.SPNParams(beta=500, private=True, epsilon=2.0), specs).fit(encode.transform(d, specs))
    assert 0 < m.ledger.report()["spent"] <= 2.0 + 1e-9
    assert m.sample(spark.range(100).withColumnRenamed("id", "rid"), "rid", 1, "t").filter("x < 0 or x > 51").count() == 0


def test_ledger():
    led = dp.PrivacyLedger(2.0, 4, seed=1)
    assert abs(led.per_level - 0.175) < 1e-12 and abs(led.per_column - 0.26) < 1e-12  # of four columns and the weights of sums
    assert abs(4 * led.per_level + 4 * led.per_column + 4 * led.per_weights - 2.0) < 1e-12
    assert led.counts([0.0, 0.0], 1e9, "s") == [1.0, 1.0] or all(v >= 0 for v in led.counts([0.0, 0.0], 1e9, "s"))
    led.counts([5.0], 0.1, "s")
    assert led.report()["entries"][0]["epsilon"] == 1e9
    h = dp.degree_histogram({0: 1}, 1e-6, 10, dp.PrivacyLedger(1.0, 1, seed=3))
    assert abs(sum(h.values()) - 1) < 1e-9


def test_forest(spark):
    d = spark.range(600).select("id", (F.col("id") % 3).cast("int").alias("a"), (10 * (F.col("id") % 3) + (F.col("id") % 100) / 100).cast("double").alias("x"))
    specs = encode.fit(d.drop("id"))
    m = ARF(ARFParams(trees=5, max_depth=5, rounds=1), specs).fit(encode.transform(d, specs, keep=["id"]), "id")
    out = m.sample(spark.range(600).withColumnRenamed("id", "rid"), "rid", 1, "t")
    assert out.filter("x < 0 or x > 21").count() == 0 and m.diagnostics()["leaves"] > 3
    given = m.sample(spark.range(50).withColumnRenamed("id", "rid"), "rid", 1, "t", {"a": F.lit(float(specs[0].categories.index("2")))})
    assert given.count() == 50 and given.agg(F.avg("x")).first()[0] > 12


def test_engines():
    assert pipeline.engine("spn")[0] is spn.SPN
    with pytest.raises(ValueError):
        pipeline.engine("ARF", private=True)
    with pytest.raises(ValueError):
        pipeline.engine("XYZ")


def test_related_tables_end_to_end(spark, tmp_path):
    parent = spark.range(120).select(F.format_string("C%05d", "id").alias("client_id"), F.when(F.col("id") % 3 == 0, "GOLD").otherwise("BASE").alias("tier"), F.concat(F.lit("client "), F.col("id")).alias("full_name"))
    child = parent.withColumn("n", F.when(F.col("tier") == "GOLD", 6).otherwise(1)).select("client_id", "tier", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    child = child.select(F.xxhash64("client_id", "i").alias("txn_id"), "client_id", F.when(F.col("tier") == "GOLD", 1000 + F.col("i")).otherwise(10 + F.col("i")).cast("double").alias("amount"))
    tables = {"client": parent, "txn": child}
    specs = {"client": TableSpec("client", "client_id", kinds={"full_name": "non_std"}), "txn": TableSpec("txn", "txn_id", [ForeignKey("txn", ["client_id"], "client", ["client_id"])])}
    t = pipeline.train(spark, tables, specs, params=spn.SPNParams(beta=20, max_depth=3))
    t.model.save(spark, f"file://{tmp_path}/m")
    model = relational.RelationalModel.load(spark, f"file://{tmp_path}/m")
    synth = model.sample(spark, {"client": 150, "txn": 400}, seed=3)
    assert synth["txn"].count() == 400 and synth["client"].count() == 150
    checks = {(r["check_name"], r["table_name"]): r["status"] for r in report.check_integrity(spark, tables, synth, specs).collect()}
    assert checks["pk_unique", "client"] == checks["pk_unique", "txn"] == checks["fk_resolves", "txn"] == "PASS"
    both = synth["txn"].join(synth["client"], "client_id").groupBy("tier").agg(F.avg("amount").alias("m")).collect()
    means = {r["tier"]: r["m"] for r in both}
    assert means["GOLD"] > means["BASE"]
    assert not {r[0] for r in parent.select("full_name").collect()} & {r[0] for r in synth["client"].select("full_name").collect()}


def test_tables_in_and_out(spark, tmp_path):
    d = spark.createDataFrame([(1, "a;b"), (2, None)], "id long, v string")
    m = io.write_tables({"t": d}, f"file://{tmp_path}")
    assert m[0]["rows"] == 2 and io.load_tables(spark, f"file://{tmp_path}", ["t"])["t"].count() == 2
    io.write_tables({"u": d}, f"file://{tmp_path}", "csv")
    assert io.load_tables(spark, f"file://{tmp_path}", ["u"])["u"].count() == 2
    with pytest.raises(FileNotFoundError):
        io.load_tables(spark, f"file://{tmp_path}", ["nothing"])
    assert io.preview(d, 1, "id").first()["total_rows"] == 2
    assert [r[0] for r in d.orderBy("id").select(io.split_tags(F.col("v"))).collect()] == [["A", "B"], None]
    c = io.catalog_from_json(spark, '{"tables": {"t": {"columns": {"a": {"classifications": ["pii"]}}}}}')
    assert c.first()["tags"] == ["PII"]
