import corpus_pipeline
from helpers import awkward, documents, sentence
from revspark.llm import near_dup, packing, secrets


def test_stages_on_awkward_rows(spark, tmp_path):
    import random
    rng = random.Random(3)
    rows = awkward()
    for i in range(300):
        words = sentence(rng, 40).split()
        if i % 6 == 0:
            words[rng.randrange(40)] = "grumblor"
        rows.append((3000 + i, " ".join(words), f"s{i % 3}"))
    rows += [(7000, "secret password=b7db7aa4a5fcc78305 kept here", "s1"), (7001, rows[70][1], "s1")]
    df = documents(spark, rows)
    spark.createDataFrame([(3000 + i, int(i % 6 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = df, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == df.columns
        seen[name] = docs.collect()
    toxic = {3000 + i for i in range(300) if i % 6 == 0}
    assert not toxic & {r["doc_id"] for r in seen["toxicity"]}
    assert len(seen["toxicity"]) == len(rows) - len(toxic) - (rows[70][0] in toxic)
    assert 7001 not in {r["doc_id"] for r in seen["near_duplicates"]}
    assert {r["doc_id"] for r in seen["secrets"]} == {r["doc_id"] for r in seen["near_duplicates"]}
    assert "[assign]" in next(r["text"] for r in seen["secrets"] if r["doc_id"] == 7000)
    assert {r["doc_id"] for r in seen["packing"]} == {r["doc_id"] for r in seen["mixing"]}


def test_run_equals_the_stages_and_reads_the_tables(spark):
    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d).collect()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, d)
    kept = kept.collect()
    encode = packing.WordIds(corpus_pipeline.tokenizer_path())
    assert sum(r["length"] for r in out) == sum(len(encode(r["text"] or "")) // 4 + 1 for r in kept)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    assert near_dup.THRESHOLD == 0.8 and secrets.MIN_ASSIGNED == 12


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
