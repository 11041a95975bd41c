
from strata.operators.features import EqualWidthBins
from strata.streaming.scoring import read_parquet_stream, score_stream
from tests.conftest import SF


def test_fitted_bins_score_a_stream(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice")
    bins = EqualWidthBins("o_totalprice", 5).fit(orders)
    src = str(tmp_path)
    orders.write.mode("overwrite").parquet(src + "/data")
    stream = read_parquet_stream(spark, src + "/data", "o_orderkey long, o_totalprice double")
    scored = score_stream(stream, [lambda d: bins.transform(d, "price_bin")])
    q = scored.writeStream.format("memory").queryName("scored_orders").outputMode("append") \
        .option("checkpointLocation", src + "/checkpoint").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from scored_orders")
    exp = bins.transform(orders, "price_bin")
    assert got.count() == orders.count()
    assert got.exceptAll(exp).count() == 0
