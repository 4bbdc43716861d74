"""The pipeline's stages against brute force, each on what the one before kept."""

import numpy as np
from pyspark.sql import functions as F
from test_operators import ODD, brute_base, brute_lines, docs_of  # noqa: I001

import corpus_pipeline
from textloom.llm import byte_bpe, common, line_crf, minhash, mixing, queries


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    cols, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialise(stage(spark, seen[-1], sf))
        if name != "encode":
            assert out.columns == cols
        seen.append(out)
    raw, rules, lines, near, mixed, ids = (d.toPandas() for d in seen)
    text = dict(zip(raw["doc_id"], raw["text"], strict=True))
    model = line_crf.train(docs, common.table(spark, sf, "labels"))
    assert set(rules["doc_id"]) == {i for i, t in text.items() if not brute_base(t)[-1] and line_crf.judge(t, model, 0.5)[1]}
    gone = brute_lines(list(zip(rules["doc_id"], rules["text"], strict=True)))
    assert set(lines["doc_id"]) == {i for r, i in enumerate(rules["doc_id"]) if len(gone[r]) < sum(bool(l.strip()) for l in text[i].split("\n"))}
    words = minhash.Words(5)
    sets = {i: words.of(" ".join(t.lower().split())) for i, t in zip(lines["doc_id"], lines["text"], strict=True)}
    kept = set(near["doc_id"])
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    for i in set(sets) - kept:
        assert any(alike(sets[i], sets[j]) for j in sets if j != i)
    for i in kept:
        assert not any(alike(sets[i], sets[j]) for j in kept if j < i)
    copies = mixed["doc_id"].value_counts().to_dict()
    assert set(copies) <= kept and max(copies.values()) <= 3
    took = {r["doc_id"]: r["copies"] for r in mixing.mix(seen[3]).collect()}
    assert {i: n for i, n in took.items() if n} == copies
    own = byte_bpe.ByteBPE(queries.tokenizer("byte_bpe_50k.json"))
    now = dict(zip(near["doc_id"], near["text"], strict=True))
    assert len(ids) == len(mixed)
    for i, x in zip(ids["doc_id"], ids["ids"], strict=True):
        assert own.decode(np.array(x, "<u4").tobytes()) == now[i]


def test_stages_on_odd_rows(spark, sf):
    for rows in (ODD, []):
        docs = docs_of(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "encode":
                assert out.columns == docs.columns
            out.write.mode("overwrite").format("noop").save()
    nulls = docs_of(spark, [(1, None, None), (2, None, None)]).withColumn("n_chars", F.lit(None).cast("long"))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, nulls, sf).write.mode("overwrite").format("noop").save()


def test_whole_run_equals_its_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, sf))
    rows = lambda df: sorted((r["doc_id"], r["source"], r["n_tokens"], tuple(r["ids"])) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, sf)) == rows(docs) and len(rows(docs)) > 100


def test_stages_keep_rows_without_ids_of_their_own(spark, sf):
    """Unique texts survive whatever their ids; clashing columns come through."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    text = lambda k: " ".join(words[(i * k + i * i) % 24] + str(i * k % 7) for i in range(30)) + "."
    rows = [(None, text(1), "a"), (None, text(2), "a"), (5, text(3), "b"), (5, text(4), "b"), (1, text(3), "b")]
    docs = docs_of(spark, rows).withColumn("n_lines", F.lit(7)).withColumn("row", F.lit("r")).withColumn("ids", F.lit(3))
    lines = corpus_pipeline.dedup_lines(spark, docs, sf)
    assert lines.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["row"], r["ids"]) for r in lines.collect()) == sorted((str(i), t, 7, "r", 3) for i, t, _ in (rows[0], rows[1], rows[3], rows[4]))
    near = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert near.columns == docs.columns and sorted((str(r["doc_id"]), r["text"]) for r in near.collect()) == sorted((str(i), t) for i, t, _ in (rows[0], rows[1], rows[3], rows[4]))
    assert corpus_pipeline.encode(spark, docs, sf).count() == 5
