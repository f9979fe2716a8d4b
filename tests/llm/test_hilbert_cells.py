"""Cells of dimensions with very many values."""

from pyspark.sql import functions as F

from lexiloom.llm import hilbert_shards


def test_all_of_many_values_have_cells_in_their_order(spark, monkeypatch):
    """Nine thousand sources, one of them with a third of all rows, joined by broadcast and by shuffle."""
    rows = spark.range(13_500).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.col("id").alias("size"),
        F.expr("if(id >= 9000, 'hot', if(id % 500 = 0, null, concat('s', lpad(id, 5, '0'))))").alias("source"),
    )
    counts = {}
    for r in rows.collect():
        counts[r["source"]] = counts.get(r["source"], 0) + 1
    total, before, expected = sum(n for k, n in counts.items() if k is not None), 0, {None: 0}
    for k in sorted(k for k in counts if k is not None):
        expected[k] = int((before + counts[k] / 2) / total * 256)
        before += counts[k]
    for most in (16 << 20, 10):
        monkeypatch.setattr(hilbert_shards, "SHARED_BYTES", most)
        got = hilbert_shards.quantised(rows).select("source", "source_cell", "lang_cell").collect()
        assert len(got) == 13_500 and all(r["source_cell"] == expected[r["source"]] and r["lang_cell"] == 128 for r in got)
