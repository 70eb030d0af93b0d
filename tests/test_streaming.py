from graphs import mapping

from arcweave.streaming.components import follow_components, labels


def test_components_follow_a_stream(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "src long, dst long"
    assert labels(spark, out) is None
    expected = [{1: 1, 2: 1, 5: 5, 6: 5}, {1: 1, 2: 1, 5: 5, 6: 5, 7: 5}, {1: 1, 2: 1, 5: 1, 6: 1, 7: 1, 9: 9}]
    for rows, after in zip([[(1, 2), (5, 6)], [(7, 6)], [(2, 7), (9, 9)]], expected, strict=True):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        follow_components(spark.readStream.schema(schema).parquet(source), out, state).awaitTermination()
        assert mapping(labels(spark, out)) == after
