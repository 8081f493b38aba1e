import random

import corpus_pipeline
from siftlake.llm import registry
from siftlake.session import table


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 7)))
    text = lambda n=60: " ".join(word() for _ in range(n))
    item = text(30)
    clean = {k: text() for k in range(200)}
    rows = [(k, t) for k, t in clean.items()]
    rows += [(300 + k, " ".join(w + "%%" for w in text().split())) for k in range(60)]  # junk
    rows += [(400, clean[5]), (401, clean[6] + " tail"), (402, text(20) + " " + item + " " + text(20)), (403, text() + " password=abcdefabcdef12 " + text()), (404, "short"), (405, None), (None, text())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(150)] + [(300 + k, 0) for k in range(50)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    seen, at = [], table(spark, str(tmp_path), "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id for r in at.collect()})
        assert k == 4 or at.columns == docs.columns
    assert seen[0] == {*range(200), 400, 401, 402, 403, None}
    assert seen[1] == seen[0] - {400, 401}
    assert seen[2] == seen[1] - {402} == seen[3] == seen[4]
    masked = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert "[SECRET]" in masked[403].text and masked[403].n_chars == len(masked[403].text)
    assert all(masked[k].text == clean[k] for k in clean)
    last = {r.doc_id: r.decoded for r in at.collect()}
    assert last == {i: r.text for i, r in masked.items()}
    ran = {(r.doc_id, r.n_tokens, r.decoded) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ran == {(r.doc_id, r.n_tokens, r.decoded) for r in at.collect()}
    assert set(registry.oracle_sql()) <= set(registry.queries())
