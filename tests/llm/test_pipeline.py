from __future__ import annotations

import corpus_pipeline
from lodestream.llm import suffixes
from odd import PASSAGE, documents, nothing, stored

from test_suffixes import brute
from test_tokens_packing import ids_of


def stages(spark, docs, sf_dir, root):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, out[-1], sf_dir)
        df.write.parquet(f"{root}/{name}")
        out.append(spark.read.schema(df.schema).parquet(f"{root}/{name}"))
    return out


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"  # with fewer labels no term is learned
    docs = stored(spark, sf_dir)
    raw, mild, single, cut, mixed, packed = stages(spark, docs, sf_dir, tmp_path)
    assert [s[0] for s in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "packing"]
    for df in (mild, single, cut, mixed):
        assert df.columns == docs.columns
    labels = stored(spark, sf_dir, "labels")
    bad = {r.doc_id for r in labels.where("toxic = 1").collect()}
    fine = {r.doc_id for r in labels.where("toxic = 0").collect()}
    kept = {r.doc_id for r in mild.collect()}
    assert len(kept & fine) >= 0.98 * len(fine & {r.doc_id for r in raw.collect()}) and len(kept & bad) <= 0.5 * len(bad)
    assert single.count() < mild.count()
    assert suffixes.repeated_passages(single).count() == len(brute(single, 50))
    assert cut.count() == single.count() and suffixes.repeated_passages(cut).count() <= suffixes.repeated_passages(single).count()
    tokens = sum(len(ids_of(r.text)) + 1 for r in mixed.collect())
    assert sum(r.length for r in packed.collect()) == tokens


def test_odd_rows_pass_every_stage(spark, sf_dir, tmp_path):
    for i, docs in enumerate((documents(spark), nothing(spark), documents(spark, [(1, None, None)] * 3))):
        for df in stages(spark, docs, sf_dir, tmp_path / str(i))[1:-1]:
            assert df.columns == docs.columns
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf_dir).count() >= 0


def test_repeats_of_long_passages_go(spark, sf_dir):
    docs = documents(spark, [(1, "first " + PASSAGE, "a"), (2, PASSAGE + " second one", "a")])
    assert {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, sf_dir).collect()} == {1: "first " + PASSAGE, 2: "second one"}


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0
