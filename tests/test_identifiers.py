"""Identifiers: a bijection from rows to a format's values, all different, none that the data hold, for any number of formats."""

from pyspark.sql import functions as F

from tessera.operators import encode, evaluate, identifiers
from tessera.functions import rng
from tessera.sources import tables as io


def made(spark, df, column, rows, seed="s"):
    fs, known = identifiers.learn(df, column, "salt")
    kind = df.schema[column].dataType.simpleString()
    return identifiers.generate(spark.range(rows), "id", {column: (fs, known, "salt", kind)}, seed)


def test_permutation_is_one(spark):
    for a, b in ((1, 1), (1, 7), (3, 4), (30, 33)):
        d = spark.range(a * b).select(identifiers.permute(F.col("id"), F.lit(a), F.lit(b), F.lit(2), "k", "c").alias("v"))
        got = sorted(r["v"] for r in d.collect())
        assert got == list(range(a * b))
    x = spark.range(200).select(*[identifiers.permute(F.col("id"), F.lit(10), F.lit(20), F.lit(k), "k", "c").alias(f"v{k}") for k in (0, 1)]).collect()
    assert sum(r["v0"] == r["v1"] for r in x) < 20 and sum(r["v0"] == i for i, r in enumerate(x)) < 20


def test_reals_never_come_back_and_none_repeats(spark):
    d = spark.range(700).select(F.format_string("AC-%03d", F.col("id")).alias("ref"))
    got = made(spark, d, "ref", 300)  # a thousand values at most, 700 of them real: the prefix is given up
    r = got.agg(F.count("ref"), F.count_distinct("ref"), F.count_if(~F.col("ref").rlike("^[A-Z]{2}-[0-9]{3}$"))).first()
    assert tuple(r) == (300, 300, 0) and got.join(d, "ref", "left_semi").isEmpty()
    again = made(spark, d.repartition(7), "ref", 300)
    assert got.exceptAll(again).isEmpty()
    other = made(spark, d, "ref", 300, "t")
    assert other.join(got, ["id", "ref"]).count() < 30


def test_all_formats_are_used_beyond_the_listed_ones(spark, monkeypatch):
    d = spark.range(3000).select(F.concat(F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")), F.lit("#"), F.lpad((F.col("id") * 7).cast("string"), 6, "0")).alias("ref"))
    want = {"x" * k + "#" for k in range(40)}
    for most in (identifiers.LISTED, 5):
        monkeypatch.setattr(identifiers, "LISTED", most)
        got = made(spark, d, "ref", 1000)
        masks = {r["m"].replace("a", "x").replace("D", "") for r in got.select(identifiers.mask_of(F.col("ref")).alias("m")).distinct().collect()}
        assert masks == want and got.select("ref").distinct().count() == 1000 and got.join(d, "ref", "left_semi").isEmpty()


def test_formats_that_run_out_grow(spark):
    d = spark.createDataFrame([(f"{i}-z",) for i in range(9)] + [(None,), ("",)], "v string")
    got = [r["v"] for r in made(spark, d, "v", 400).collect()]
    assert len(got) == len(set(got)) == 400 and not {f"{i}-z" for i in range(9)} & set(got)
    n = spark.range(1, 121).select(F.col("id").cast("int").alias("n"))  # 9, 90 and 21 numbers of 1, 2 and 3 digits
    back = [r["n"] for r in made(spark, n, "n", 2000).collect()]
    assert len(set(back)) == 2000 and not set(range(1, 121)) & set(back) and None not in back
    top = spark.range(2_147_483_000, 2_147_483_600).select(F.col("id").cast("int").alias("n"))
    assert all(999_999_999 < r["n"] < 2**31 for r in made(spark, top, "n", 500).collect())
    assert [r["v"] for r in made(spark, d.limit(0), "v", 3).collect()] == [None] * 3


def test_long_formats(spark):
    d = spark.range(60).select(F.sha2(F.col("id").cast("string"), 512).alias("v"))
    got = made(spark, d, "v", 500)
    assert got.select("v").distinct().count() == 500 and got.filter(F.length("v") != 128).isEmpty()


def test_decoded_tables_have_new_identifiers(spark):
    d = spark.range(300).select("id", F.format_string("REF%06d", F.col("id") * 37 + 100000).alias("ref"), (F.col("id") * 3 + 5000).alias("num"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("some"))
    specs = encode.fit(d.drop("id"), {"num": "non_std", "some": "non_std"})
    out = encode.inverse_transform(encode.transform(d, specs, keep=["id"]), specs, "id", 1)
    r = out.agg(*[f(c) for c in ("ref", "num") for f in (F.count, F.count_distinct)]).first()
    assert tuple(r) == (300,) * 4 and out.filter(~F.col("ref").rlike("^REF[0-9]{6}$")).isEmpty() and out.filter("num < 1000 or num > 9999").isEmpty()
    assert out.join(d.select("ref"), "ref", "left_semi").isEmpty() and out.join(d.select("num"), "num", "left_semi").isEmpty()
    assert 50 < out.filter("some is not null").count() < 150


def test_models_work_after_tables_were_written(spark, tmp_path):
    d = spark.range(400).select("id", (F.col("id") % 13).cast("double").alias("a"), rng.uniform(1, "u", F.col("id")).alias("b"))
    assert io.write_tables({"t": d}, f"file://{tmp_path}/out")[0]["rows"] == 400
    (m,) = io.write_tables({"t": d.select(F.lit('a "quoted"\ntext').alias("x"))}, f"file://{tmp_path}/csv", "csv")
    assert m["rows"] == 400
    a, _, _ = evaluate.detection(d.filter("id % 2 = 0"), d.filter("id % 2 = 1"), ["a", "b"], trees=3)
    assert 0 <= a <= 1


def test_generated_identifiers_where_codes_have_two_lengths(spark, tmp_path):
    import duckdb

    from tessera.plans import catalog

    c = spark.range(60).select((F.col("id") * 811).alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.5).alias("c_acctbal"), F.lit("m").alias("c_mktsegment"))
    c.coalesce(1).write.parquet(f"file://{tmp_path}/customer.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = sorted(duck.sql(catalog.oracles()["generated_identifiers"]).fetchall())
    got = catalog.queries()["generated_identifiers"](spark, f"file://{tmp_path}")
    assert sorted((r["customer_id"], r["contact"], r["code"]) for r in got.collect()) == want
    assert len({v for _, _, v in want}) == 60 and {len(str(811 * 37 * i + 100000)) for i in range(60)} == {6, 7}


def test_fixed_width_by_sign(spark):
    d = spark.createDataFrame([(7,), (123,), (-4,), (-55,)], "n long")
    fs, _ = identifiers.learn(d, "n", "salt", fixed=True)
    assert {r["mask"]: (r["n"], r["m"]) for r in fs.collect()} == {"DDD": (2, 2), "-DD": (2, 2)}
