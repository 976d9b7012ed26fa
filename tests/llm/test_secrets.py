from dataclasses import replace

from pyspark.sql import functions as F

from lodestone.llm import secrets

SCHEMA = "doc_id long, source string, text string, blob string, rule string, n_chars long"
KEY = "AKIA" + "ABCDEFGH12345678"


def rows(spark, *xs):
    return spark.createDataFrame([(i, s, t, "b", "r", len(t or "")) for i, s, t in xs], SCHEMA)


def test_findings_reach_every_path_and_scans_are_incremental(spark):
    docs = rows(spark, (1, "a", f"x {KEY} y {KEY}"), (2, "b", f"x {KEY} y {KEY}"), (3, "a", "clean"), (4, None, "password = hunter2hunter"), (None, "a", None), (5, "a", ""))
    found, seen = secrets.scan(docs)
    got = sorted((r.doc_id, r.rule, r.ordinal) for r in found.collect())
    assert got == [(1, "aws_access_key", 1), (1, "aws_access_key", 2), (2, "aws_access_key", 1), (2, "aws_access_key", 2), (4, "password", 1)]
    assert seen.count() == 4 * len(secrets.RULES)
    seen = seen.persist()
    more = docs.unionByName(rows(spark, (9, "c", f"new {KEY}")))
    again, added = secrets.scan(more, seen)
    assert [(r.doc_id, r.rule) for r in again.collect()] == [(9, "aws_access_key")]
    assert added.count() == len(secrets.RULES)
    newer = tuple(replace(r, version=2) if r.name == "password" else r for r in secrets.RULES)
    again, added = secrets.scan(docs, seen, newer)
    assert [(r.doc_id, r.rule, r.rule_version) for r in again.collect()] == [(4, "password", 2)]
    assert {(r.rule, r.rule_version) for r in added.collect()} == {("password", 2)}


def test_redact_keeps_rows_columns_and_clean_texts(spark):
    docs = rows(spark, (1, "a", f"x {KEY} y"), (2, "b", "clean"), (None, "a", f"{KEY}"), (3, "c", None))
    out = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert secrets.redact(docs).columns == docs.columns and len(out) == 4
    assert (out[1].text, out[1].n_chars, out[2].text, out[None].text, out[3].text) == ("x [SECRET] y", 12, "clean", "[SECRET]", None)


def test_empty(spark):
    found, seen = secrets.scan(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and seen.count() == 0


def test_a_new_path_with_a_known_blob_is_reported(spark):
    docs = rows(spark, (1, "a", f"x {KEY}"), (2, "a", "password = hunter2hunter"))
    found, seen = (x.persist() for x in secrets.scan(docs))
    more = docs.unionByName(rows(spark, (9, "c", f"x {KEY}"), (10, "c", f"new {KEY}")))
    again, added = secrets.scan(more, seen, reported=found)
    assert sorted((r.doc_id, r.rule) for r in again.collect()) == [(1, "aws_access_key"), (2, "password"), (9, "aws_access_key"), (10, "aws_access_key")]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, secrets.scan(more)[0].collect()))
    assert added.count() == len(secrets.RULES)
    newer = tuple(replace(r, version=9) if r.name == "password" else r for r in secrets.RULES)
    again, _ = secrets.scan(more, seen.unionByName(added), newer, again)
    assert {(r.rule, r.rule_version) for r in again.collect() if r.doc_id == 2} == {("password", 9)} and again.count() == 4


def test_secrets_are_taken_whole(spark):
    pem = "-----BEGIN RSA PRIVATE KEY-----\nMIIEow{}\nAAAA\n-----END RSA PRIVATE KEY-----"
    long = "Zq9" * 100
    texts = {
        1: (f"é x {pem.format(1)} y {pem.format(2)} z", "é x [SECRET] y [SECRET] z"),
        2: (f"cut {pem.format(1)[:45]}\n", "cut [SECRET]"),
        3: (f"secret = {long}1;", "[SECRET];"),
        4: (f"secret = {long}2;", "[SECRET];"),
        5: (f"xoxb-{long} ghp_{long} password={long}", "[SECRET] [SECRET] [SECRET]"),
        6: (f"to https://{long}:{long}@host.org/x", "to [SECRET]/x"),
        7: (f"\U0001f511 api_key={KEY}tail00 {KEY}{KEY} $", "\U0001f511 [SECRET] [SECRET][SECRET] $"),
    }
    docs = rows(spark, *[(i, "a", before) for i, (before, _) in texts.items()])
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == {i: after for i, (_, after) in texts.items()}
    found = [r for r in secrets.scan(docs)[0].collect() if r.rule in ("private_key", "assigned_token")]
    hashes = [r.secret_sha256 for r in found if r.doc_id in (1, 3, 4)]
    assert len(hashes) == len(set(hashes)) == 4


def test_ledger_is_saved_and_loaded(spark, tmp_path):
    first = rows(spark, (1, "a", f"x {KEY}"), (2, "a", "password = hunter2hunter"), (3, "a", "clean"))
    found, added = secrets.scan(first)
    for _ in range(2):  # a run that is saved again counts once
        secrets.save(str(tmp_path), 1, added, found)
    more = first.unionByName(rows(spark, (9, "c", f"x {KEY}"), (10, "c", f"new {KEY}")))
    ledger, reported = secrets.load(spark, str(tmp_path))
    assert ledger.count() == 3 * len(secrets.RULES)
    again, new = secrets.scan(more, ledger, reported=reported)
    assert new.count() == len(secrets.RULES)  # the blob of path 10 alone was scanned
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, secrets.scan(more)[0].collect()))
    secrets.save(str(tmp_path), 2, new, again)
    assert secrets.scan(more, *secrets.load(spark, str(tmp_path))[:1], reported=secrets.load(spark, str(tmp_path))[1])[1].count() == 0


def test_redaction_is_one_pass_whatever_the_names(spark):
    docs = spark.createDataFrame([(1, f"x {KEY}", 1, 2, 22), (1, f"x {KEY}", 1, 2, 22), (None, "", 1, 2, 0), (2, "y " * 100_000 + KEY, 1, 2, 0)], "doc_id long, text string, _redacted int, _flagged int, n_chars int")
    out = secrets.redact(docs)
    assert "Exchange" not in out._jdf.queryExecution().toString() and out.columns == docs.columns
    assert [(r.doc_id, r.text, r.n_chars) for r in out.collect()] == [(1, "x [SECRET]", 10)] * 2 + [(None, "", 0), (2, "y " * 100_000 + "[SECRET]", 200_008)]
    assert secrets.redact(docs.limit(0)).count() == 0


def test_a_text_without_hints_holds_no_secret(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    for r in secrets.RULES:
        assert docs.where(F.regexp_like("text", F.lit(r.pattern)) & ~secrets._any_hit((r,), F.lower("text"))).count() == 0


def test_redaction_by_the_ledger_scans_unseen_blobs_alone(spark, tmp_path):
    pem = "-----BEGIN PRIVATE KEY-----\nAAAA\n-----END PRIVATE KEY-----"
    first = rows(spark, (1, "a", f"\U0001f511 {KEY} {pem} {KEY}"), (2, "a", "password = hunter2hunter"), (3, "a", "token of esteem"), (4, "a", None))
    found, added = secrets.scan_places(first)
    secrets.save(str(tmp_path), 1, added, found)
    ledger, reported = secrets.load(spark, str(tmp_path))
    more = first.unionByName(rows(spark, (9, "c", "password = hunter2hunter"), (9, "c", f"api_key={KEY}tail00 {KEY}"), (None, "c", ""), (1, "a", f"\U0001f511 {KEY} {pem} {KEY}")))
    found, new = secrets.scan_places(more, ledger, reported=reported)
    assert new.count() == 2 * len(secrets.RULES)  # an empty text and the one of path 9
    out = secrets.redact_found(more, found)
    key = lambda r: str(tuple(r))
    assert out.columns == more.columns and sorted(out.collect(), key=key) == sorted(secrets.redact(more).collect(), key=key)
    # what the ledger knows isn't looked for again: without its findings the known blobs stay as they are
    blind = secrets.redact_found(more, secrets.scan_places(more, ledger)[0])
    assert {r.doc_id for r in blind.where("text like '%[SECRET]%'").collect()} == {9}
