import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import codec

GOLDEN = {
    1.1: (1.0625, 0x3FF1, 1.0999994277954102, 0x3FF19999, 1.0999999999912689, 0x3FF199999999),
    1 / 3: (0.328125, 0x3FD5, 0.33333325386047363, 0x3FD55555, 0.3333333333321207, 0x3FD555555555),
    -2.7: (-2.625, 0xC005, -2.6999988555908203, 0xC0059999, -2.6999999999825377, 0xC00599999999),
    0.2: (0.1953125, 0x3FC9, 0.19999992847442627, 0x3FC99999, 0.1999999999989086, 0x3FC999999999),
    1e-310: (0.0, 0x0000, 9.9988441670284e-311, 0x00001268, 9.999999970888e-311, 0x000012688B70),
}


def test_golden(spark):
    rows = spark.createDataFrame([(x,) for x in GOLDEN], "x double")
    for k, width in enumerate((2, 4, 6)):
        got = rows.select("x", codec.trunc(F.col("x"), width).alias("t"), codec.encode(F.col("x"), width).alias("c")).collect()
        for r in got:
            assert (r["t"], r["c"]) == GOLDEN[r["x"]][2 * k : 2 * k + 2]


@pytest.mark.parametrize("width", codec.WIDTHS)
def test_every_pattern_is_cut_like_its_bits(spark, width):
    rng = np.random.default_rng(width)
    x = np.frombuffer(rng.bytes(8 * 3000), np.float64)
    powers = 2.0 ** np.arange(-1074, 1024)
    x = np.concatenate([x, powers, -powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), [0.0, -0.0, np.inf, -np.inf]])
    x = x[~np.isnan(x)]
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    cut = rows.select("i", codec.trunc(F.col("x"), width).alias("t"), codec.encode(F.col("x"), width).alias("c")).toPandas().sort_values("i")
    back = spark.createDataFrame(cut[["i", "c"]]).select("i", codec.decode(F.col("c"), width).alias("d")).toPandas().sort_values("i")
    bits = x.view(np.uint64)
    kept = bits & np.uint64((2 ** (8 * width) - 1) << (64 - 8 * width))
    assert (cut["t"].to_numpy().view(np.uint64) == kept).all()
    stepwise = codec.cut(rows, "t", F.col("x"), width).toPandas().sort_values("i")
    assert (stepwise["t"].to_numpy().view(np.uint64) == kept).all()
    assert (cut["c"].to_numpy() == (bits >> np.uint64(64 - 8 * width)).astype(np.int64)).all()
    assert (back["d"].to_numpy().view(np.uint64) == kept).all()


def test_nulls_nan_and_words(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    got = rows.select(codec.trunc(F.col("x"), 4).alias("t"), codec.decode(codec.encode(F.col("x"), 4), 4).alias("d")).collect()
    assert got[0]["t"] is None and got[0]["d"] is None
    assert np.isnan(got[1]["t"]) and np.isnan(got[1]["d"])
    code = spark.createDataFrame([(0xC00599999999,)], "c long")
    words = code.select(codec.code_words(F.col("c")).alias("w"))
    assert words.first()["w"] == [0x9999, 0x9999, 0xC005]
    assert words.select(codec.words_code(F.col("w")).alias("c")).first()["c"] == 0xC00599999999


def test_tolerances():
    assert [codec.adjusted_epsilon(w, 10 * 2.0**-52) for w in codec.WIDTHS] == [0.625, 9.5367431640625e-06, 1.4551915228366852e-10, 2.220446049250313e-15]
    assert codec.default_epsilon(2) == 15.0
    with pytest.raises(ValueError):
        codec.mantissa_bits(3)
