import re

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_from_the_first_to_the_last(spark):
    """Each stage on what its predecessor kept: columns stay, decisions take effect, rows without text or id pass, and the
    pieces of the last cover the texts of the one before."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    import corpus_pipeline
    from termloom.llm.common import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")})
    odd = odd.unionByName(docs.limit(2)).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(10**9), "text": F.lit("the key token=abcdef1 and zQ8rT2vX9pL4mN7bK1wY6cD3 end")}))
    docs = docs.unionByName(odd).withColumns({"kept": F.lit("clash"), "_spans": F.lit(7), "number": F.lit(None).cast("int")})
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = materialise(out, name)
        seen[name] = docs.toPandas()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in seen["exact_dedup"].text]
    assert len(bare) == len(set(bare)) < len(seen["toxicity"])
    assert len(seen["near_dedup"]) <= len(seen["exact_dedup"]) and set(seen["near_dedup"].text) <= set(seen["exact_dedup"].text)
    clean = seen["secret_scan"]
    assert len(clean) == len(seen["near_dedup"]) and clean[clean.doc_id == 10**9].text.tolist() == ["the key [secret] and [secret] end"]
    assert all(n == len(t) for n, t in zip(clean.n_chars, clean.text, strict=True) if t is not None)
    pieces = corpus_pipeline.packing(spark, docs, SF).toPandas()
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in zip(clean.doc_id, clean.text, strict=True) if i == i}
    assert pieces.dropna(subset="doc_id").groupby("doc_id").length.sum().to_dict() == want


def test_every_stage_takes_an_empty_table(spark):
    import corpus_pipeline

    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
