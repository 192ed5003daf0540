from pyspark.sql import functions as F

from assayspark.operators import filters, fingerprints, ranking


def test_row_wise_operators_take_a_stream(spark, tmp_path):
    rows = [(1, "CCN.Cl", 500.0, "a"), (2, "CCO", 2000.0, None), (3, "CC.Na", None, "b")]
    schema = "id long, code string, v double, g string"
    batch = spark.createDataFrame(rows, schema)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    salts = spark.createDataFrame([("Cl",), ("Na",)], "part string")

    def steps(df):
        df = filters.drop_groups(df, "g", ["b"])
        df = filters.strip_parts(filters.label_activity(df, "v", 1000), "code", salts)
        df = fingerprints.fingerprint(df, "code", 2, 128, "char")
        return ranking.hash_split(df, "id").select("id", "code", "contains_salt", "label", F.size("bits").alias("n"), "split")

    query = steps(stream).writeStream.format("memory").queryName("out").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("out").collect()) == sorted(steps(batch).collect())
    assert spark.table("out").count() == 2
