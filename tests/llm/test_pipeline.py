import corpus_pipeline
from lodestone.llm import jaccard, packing, quality, secrets, toxicity
from lodestone.runtime import materialise


def test_stages_against_one_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns, kept = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept
        kept = materialise(stage(spark, before, sf), "stage")
        if k < 4:
            assert kept.columns == columns
        old, new = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}, None
        if k < 4:
            new = {r.doc_id: r.text for r in kept.collect()}
        if k == 0:
            flags = {r.doc_id: r.toxic for r in toxicity.score(before, toxicity.train(before, labels)).collect()}
            assert set(new) == {i for i in old if not flags[i]} and len(new) < len(old)
        elif k == 1:
            flags = {r.doc_id: r.keep for r in quality.assess(before, labels).collect()}
            assert set(new) == {i for i in old if flags[i]} and len(new) < len(old)
        elif k == 2:
            group = {i: i for i in old}
            for r in jaccard.similar_pairs(before).collect():
                a, b = group[r.doc_id_a], group[r.doc_id_b]
                group = {i: min(a, b) if g in (a, b) else g for i, g in group.items()}
            assert set(new) == set(group.values()) and len(new) < len(old)
        elif k == 3:
            hit = {r.doc_id for r in secrets.scan(before)[0].collect()}
            assert set(new) == set(old) and {i for i in old if new[i] != old[i]} == hit
            assert secrets.scan(kept)[0].count() == 0
        else:
            packed = kept.toPandas().groupby("doc_id")["n_tokens"].sum().to_dict()
            assert packed == {r.doc_id: r.n for r in before.select("doc_id", packing.token_count(before.text).alias("n")).collect() if r.n}


def test_empty_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_redaction_goes_through_the_ledger(spark, sf, monkeypatch):
    docs, saved, ledgers = spark.read.parquet(f"{sf}/documents.parquet"), [], []
    save, scan = secrets.save, secrets.scan_places
    monkeypatch.setattr(secrets, "save", lambda folder, run, added, found: (saved.append(added.count()), save(folder, run, added, found)))
    monkeypatch.setattr(secrets, "scan_places", lambda d, ledger=None, **k: (ledgers.append(ledger), scan(d, ledger, **k))[1])
    out = dict(corpus_pipeline.STAGES)["secrets"](spark, docs, sf)
    assert saved[0] > 0 and ledgers[0] is None and ledgers[1].count() == saved[0]
    assert sorted(map(str, out.collect())) == sorted(map(str, secrets.redact(docs).collect()))


def test_secrets_stage_writes_its_documents_once(spark, sf, monkeypatch):
    docs, written = spark.read.parquet(f"{sf}/documents.parquet").repartition(8), []
    monkeypatch.setattr(secrets, "materialise", lambda df, name: (written.append(name), materialise(df, name))[1])
    out = dict(corpus_pipeline.STAGES)["secrets"](spark, docs, sf)
    assert written == ["unseen", "findings"] * 2  # no table of each run's paths, which nothing reads twice
    assert sorted(map(str, out.collect())) == sorted(map(str, secrets.redact(docs).collect()))


def test_near_copies_do_not_depend_on_the_bins(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near copies"](spark, docs, sf).select("doc_id").collect()}
    small = {r.doc_id for r in jaccard.deduplicate(docs, bin_tokens=5_000).select("doc_id").collect()}
    assert kept == small and 0 < len(kept) < docs.count()
