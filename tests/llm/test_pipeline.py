import corpus_pipeline as P
from alertflow.llm import exact_dedup, minhash_forest, mixing, toxicity
from sentencepiece import SentencePieceProcessor

from alertflow.llm import sentencepiece_scan as S

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    flagged = {r.doc_id for r in toxicity.op7_toxicity(spark, SF).collect() if r.predicted}
    want = {r.doc_id: r for r in docs.collect() if r.doc_id not in flagged}
    now = docs
    for name, stage in P.STAGES:
        before, now = now, stage(spark, now, SF)
        rows = now.collect()
        now = spark.createDataFrame(rows, now.schema)
        if name != "sentencepiece":
            assert now.columns == names
        if name == "toxicity":
            assert {r.doc_id for r in rows} == set(want) and len(rows) == len(want)
        elif name == "exact_dedup":
            kept = {r.doc_id for r in exact_dedup.exact_groups(before).collect() if r.kept}
            assert sorted(r.doc_id for r in rows) == sorted(kept)
        elif name == "near_dedup":
            kept = {r.doc_id for r in minhash_forest.near_duplicates(before).collect() if r.kept}
            assert sorted(r.doc_id for r in rows) == sorted(kept)
        elif name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
            assert sorted(r.doc_id for r in rows) == sorted(d for d, n in copies.items() for _ in range(n))
        else:
            library = SentencePieceProcessor(model_file=S.MODEL_PATH)
            assert all(r.token_ids == library.encode(r.text) for r in rows)
    assert now.columns == [*names, "token_ids"]
    assert sorted(r.doc_id for r in P.run(spark, SF).select("doc_id").collect()) == sorted(r.doc_id for r in rows)


def test_null_repeated_and_empty_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (2, "", None, "s", 0),
           (3, "w " * 40_000, "en", None, 80_000)]
    for rows in (odd, []):
        now = spark.createDataFrame(rows, schema)
        for _, stage in P.STAGES:
            now = spark.createDataFrame((out := stage(spark, now, SF)).collect(), out.schema)
        assert now.columns[-1] == "token_ids" and (now.count() > 0) == bool(rows)
