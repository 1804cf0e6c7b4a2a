import corpus_pipeline
from skylattice.llm import mixing
from skylattice.storage import materialise


def test_token_files_follow_the_curriculum(spark):
    """Positions of the mix, of all passes, against the order of the pipeline's rows and token files."""
    words = {"a": 40, "b": 40, "c": 10}
    rows = [(1000 * k + i, s, " ".join(f"{s}{i}w{j}" for j in range(n))) for k, (s, n) in enumerate(words.items()) for i in range(30)]
    docs = materialise(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3), "test-docs")
    placed = [(p, g.doc_id) for g in mixing.mix(docs).collect() for p in g.positions]
    at = {}
    for p, i in sorted(placed):
        at.setdefault(i, []).append(p)
    mixed = mixing.mixed_rows(docs)
    seen, last, order = {}, 0.0, [r.doc_id for r in mixed.collect()]
    for i in order:
        p = at[i][seen.get(i, 0)]
        assert p >= last - 1e-9
        seen[i], last = seen.get(i, 0) + 1, p
    assert order != sorted(order) and max(seen.values()) > 1
    out = corpus_pipeline.encode_tokens(spark, mixed, "").orderBy("start").collect()
    assert [r.doc_id for r in out] == order
    stored = corpus_pipeline.encode_tokens(spark, materialise(mixed, "test-mixed"), "").orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in stored] == [(r.doc_id, r.start) for r in out]
