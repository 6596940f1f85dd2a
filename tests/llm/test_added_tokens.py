"""Packing's ids against the tokenizer file as it is loaded."""

from test_text import SF, check_packing

from quirework.llm import packing, queries


def test_added_tokens(spark, monkeypatch):
    from tokenizers import Tokenizer

    import corpus_pipeline

    t = Tokenizer.from_file(queries.tokenizer_path())
    end = "<|endoftext|>"
    texts = [f"x {end} y", end, f"{end}{end}", f"  {end}\n {end[:-1]}{end} é", f"a{end.upper()}b", "don't 12  \n", f"{'word ' * 2000}{end}", None, ""]
    df = spark.createDataFrame(list(enumerate(texts, 10_000)), "doc_id long, text string")
    df = df.unionByName(spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text"))
    tokens = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in df.collect()}
    assert len(tokens[10_000]) == 5 and 50256 in tokens[10_000]
    monkeypatch.setattr(queries, "table", lambda s, d, n: df)
    check_packing(queries.op8_packing(spark, "").collect(), tokens)
    check_packing(corpus_pipeline.pack_sequences(spark, df, "").collect(), tokens)
