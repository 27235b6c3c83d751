"""Recursive chunks as rows, a few texts at a time."""

from tessera.operators import text


def test_chunks_leave_a_task_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(text, "CHUNK_BATCH", 50)
    texts = [(1, "a", "one two three " * 40), (2, None, None), (3, "c", ""), (None, "d", "x" * 205), (3, "e", "p\n\nq r\n" * 30), (4, "f", " \n ")]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    out = text.chunk_recursive(docs, size=100, overlap=20, keys=("doc_id", "lang"))
    want = [(i, x, p, c, len(c)) for i, x, t in texts for p, c in enumerate(text.split_recursive(t, 100, 20))]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))
    assert out.columns == ["doc_id", "lang", "chunk_pos", "chunk_text", "chunk_len"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan     # no column that holds the chunks of all texts of a batch
