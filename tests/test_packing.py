from pyspark.sql import functions as F

from linkloom.functions.packing import between_marks, bi_encoder_pack, concat_packed, cross_encoder_pack, entity_window, masked_mean


def test_packing(spark):
    df = spark.createDataFrame([([5, 6], [7], ["a", "[", "b", "c", "]", "d"], [[1.0, 2.0], [9.0, 9.0], [3.0, 4.0]], [1, 0, 1])], "a array<int>, b array<int>, t array<string>, v array<array<double>>, m array<int>")
    a, b = bi_encoder_pack(F.col("a"), F.lit(False), 6), bi_encoder_pack(F.col("b"), F.lit(True), 6)
    cross = cross_encoder_pack(F.col("a"), F.col("b"), F.lit(False), F.lit(True), 8)
    r = df.select(
        a.alias("a"), cross.alias("x"), concat_packed(a, b, 8).alias("y"), bi_encoder_pack(F.col("a"), F.lit(True), 3).alias("none"), entity_window(F.col("t"), 4, "<", ">").alias("e"),
        between_marks(F.col("t"), F.lit("["), F.lit("]")).alias("h"), between_marks(F.col("t"), F.lit("]"), F.lit("[")).alias("no"), masked_mean(F.col("v"), F.col("m")).alias("mean"),
        masked_mean(F.col("v"), F.array(F.lit(0))).alias("nothing"),
    ).first()
    assert tuple(r["a"]) == ([101, 5, 6, 102, 0, 0], [1, 1, 1, 1, 0, 0], [0] * 6)
    assert tuple(r["x"]) == tuple(r["y"]) == ([101, 5, 6, 102, 7, 102, 0, 0], [1] * 6 + [0, 0], [0, 0, 0, 0, 1, 1, 0, 0])
    assert (r["none"], r["e"], r["h"], r["no"], r["mean"], r["nothing"]) == (None, ["<", "a", "[", ">"], ["b", "c"], [], [2.0, 3.0], None)
