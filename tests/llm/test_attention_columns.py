"""Scoring ignores other columns, whatever their names, and scores repeated rows each time."""

from pyspark.sql import functions as F

from marketlens.llm import attention_lm


def test_attention_lm_ignores_other_columns(spark):
    docs = [(i, "the red cat saw the old barn" if i % 2 else None) for i in range(20)] + [(3, "the red cat saw the old barn"), (None, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    names = ["h", "n", "c", "w", "word", "ids", "held_out", "n_tokens", "base_score", "score", "shard", "round", "_row", "_rid"]
    plain = attention_lm.score_documents(df)
    clashing = attention_lm.score_documents(df.withColumns({c: F.lit(f"own {c}") for c in names}))
    assert clashing.columns == plain.columns
    one, other = (sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in x.collect())) for x in (plain, clashing))
    assert one == other and len(one) == len(docs)
    assert [r[2] for r in one if r[1] == 3] == [8, 8] and one[-1][2] == 1
