from tokenizers import Tokenizer

import corpus_pipeline
from skylattice.llm import contamination, tokens, toxicity
from tests.llm.test_neardup import shingles, similar
from tests.oracle import SF_DIR


def test_stages_one_by_one(spark):
    """Each stage against its own operator over what the stage before it kept."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    (_, toxic), (_, dedup), (_, clean), (_, mix), (_, encode) = corpus_pipeline.STAGES

    index = toxicity.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    kept = toxic(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    scores = {r.doc_id: r.toxic_score for r in toxicity.score_toxicity(docs, index).collect()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids == {i for i, s in scores.items() if s < toxicity.THRESHOLD} and len(ids) < docs.count()

    single = dedup(spark, kept, SF_DIR)
    rows = kept.select("doc_id", "text").collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    left, groups = sorted(sets), []
    while left:
        group, todo = set(), [left[0]]
        while todo:
            i = todo.pop()
            if i not in group:
                group.add(i)
                todo += [j for j in left if j not in group and similar(sets[i], sets[j])]
        groups.append(min(group))
        left = [i for i in left if i not in group]
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.select("doc_id").collect()) == sorted(groups)

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    free = clean(spark, single, SF_DIR)
    table = contamination.SeedTable([i for i, _ in bench], [contamination.np.array(contamination.word_hashes(t), "u8") for _, t in bench])
    hit = {r.doc_id for r in single.collect() if table.search([r.text], contamination.WINDOW, contamination.SIMILARITY)[0]}
    assert free.columns == docs.columns and {r.doc_id for r in free.collect()} == set(groups) - hit

    mixed = mix(spark, free, SF_DIR)
    assert mixed.columns == docs.columns
    out = encode(spark, mixed, SF_DIR).orderBy("start").collect()
    library = Tokenizer.from_file(tokens.tokenizer_path())
    want = sorted((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in mixed.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in out) == want  # their order: test_training_order


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    drop = lambda df: sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect())
    assert drop(got) == drop(docs)
