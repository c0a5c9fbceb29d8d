"""Streams and sinks."""

from sequora.sources import sinks, tables
from sequora.streaming import batches


def test_stream_equals_batch(spark, tmp_path):
    ref = spark.createDataFrame([(i, [1 + i % 2] * 8, i % 2) for i in range(6)], "seq bigint, codes array<int>, taxon bigint")
    q = spark.createDataFrame([(10, [1] * 8), (11, [2] * 7 + [0])], "seq bigint, codes array<int>")
    want = sorted(map(tuple, batches.classify(q, ref, 8, 1).collect()))
    assert [w[:2] for w in want] == [(10, 0), (11, 1)]
    q.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    batches.classify_stream(stream, ref, 8, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "cp"), 1).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).select("q", "pred", "support").collect())) == want


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT"), ("b", "GG")], "acc string, seq string")
    sinks.write_fasta(df, str(tmp_path / "f"))
    assert sorted(map(tuple, tables.fasta(spark, str(tmp_path / "f")).collect())) == [("a", "ACGT"), ("b", "GG")]
    sinks.write_report(df, str(tmp_path / "r"), "\t")
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "r"), sep="\t", header=True).collect())) == [("a", "ACGT"), ("b", "GG")]
