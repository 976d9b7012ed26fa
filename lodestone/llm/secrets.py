"""Secret scanning over a content-addressed ledger of blobs.

Every historical version of a path is addressed by the SHA-256 of its content.
A ledger holds the (blob, rule, rule version) triples that were ever scanned.
A run scans one copy of each blob, and only with the rule versions that the
ledger lacks for it, then joins these findings and those of earlier runs back
to every path that holds the blob. A changed rule gets a new version and is
rescanned alone. Only texts that hold a hint of some rule travel to the scan: the
others can hold no secret, and their blobs enter the ledger as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.runtime import free_name, materialise


@dataclass(frozen=True)
class Rule:
    """A pattern in the syntax that Java and RE2 share. A text without any of the
    lower-case `hints` can't match it, which spares most texts the pattern."""

    name: str
    version: int
    pattern: str
    hints: tuple[str, ...]


# patterns take a secret to its end, whatever its length; a key without an END line goes to the end of the text
RULES = (
    Rule("aws_access_key", 1, r"(?:AKIA|ASIA)[0-9A-Z]{16}", ("akia", "asia")),
    Rule("github_token", 2, r"gh[pousr]_[0-9A-Za-z]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack_token", 2, r"xox[abprs]-[0-9A-Za-z-]{10,}", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("google_api_key", 1, r"AIza[0-9A-Za-z_-]{35}", ("aiza",)),
    Rule("json_web_token", 1, r"eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}", ("eyj",)),
    Rule("private_key", 2, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[\s\S]*?(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----|\z)", ("private key-----",)),
    Rule("password", 3, r"(?i)pass(?:word|wd)[ ]?[:=][ ]?[\"']?[0-9A-Za-z_!@#$%^&*+/.-]{8,}", ("password", "passwd")),
    Rule("assigned_token", 2, r"(?i)(?:token|secret|api[_-]?key)[ ]?[:=][ ]?[\"']?[0-9A-Za-z_+/=.-]{16,}", ("token", "secret", "api")),
    Rule("url_credentials", 2, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]+@[0-9A-Za-z.-]+", ("://",)),
)


def _hit(rule: Rule, lowered):
    test = F.lit(False)
    for h in rule.hints:
        test = test | F.contains(lowered, F.lit(h))
    return test


def _any_hit(rules: tuple[Rule, ...], lowered):
    test = F.lit(False)
    for r in rules:
        test = test | _hit(r, lowered)
    return test


def blob_id(content):
    """Content address; null content has none."""
    return F.sha2(content, 256)


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """blobs(blob, ...) with `todo`, the names of the rules whose version the ledger lacks; blobs with none are dropped."""
    every = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", every)
    now = F.array(*[F.concat_ws("@", F.lit(r.name), F.lit(str(r.version))) for r in rules])
    done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", F.col("rule_version").cast("string"))).alias("_done"))
    left = F.transform(F.array_except(now, F.coalesce(F.col("_done"), F.array().cast("array<string>"))), lambda x: F.substring_index(x, "@", 1))
    return blobs.join(done, "blob", "left").withColumn("todo", left).drop("_done").where(F.size("todo") > 0)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, places: bool = False) -> DataFrame:
    """Findings (blob, rule, rule_version, ordinal, secret_sha256, secret_chars) in blobs(blob, content, todo); with `places` also start, from 1."""
    lowered = F.lower(F.col("content"))

    def placed(r: Rule):
        def row(x, i):
            m = F.substring(F.col("content"), x["start"], x["end"] - x["start"])
            return F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), (i + 1).alias("ordinal"), F.sha2(m, 256).alias("secret_sha256"), F.char_length(m).alias("secret_chars"), x["start"].alias("start"))

        return F.when(F.array_contains("todo", r.name), F.transform(_spans(r, F.col("content"), F.col("_low")), row))

    def found(r: Rule):
        if places:
            return placed(r)

        def row(m, i):
            return F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), (i + 1).alias("ordinal"), F.sha2(m, 256).alias("secret_sha256"), F.char_length(m).alias("secret_chars"))

        hits = F.regexp_extract_all(F.col("content"), F.lit(r.pattern), F.lit(0))
        return F.when(F.array_contains("todo", r.name) & _hit(r, F.col("_low")), F.transform(hits, row))

    empty = F.array().cast("array<struct<rule:string,rule_version:int,ordinal:int,secret_sha256:string,secret_chars:int" + ",start:int" * places + ">>")
    every = F.concat(*[F.coalesce(found(r), empty) for r in rules])
    return blobs.withColumn("_low", lowered).select("blob", F.inline(every))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, reported: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan versions(doc_id, source, text, ...) and return (findings by path, additions to the ledger).

    `reported` holds the findings of the runs that filled the ledger, as scan()
    returned them; keep them with it. They are joined to the paths of this run
    together with the new ones, so that a new path with a known blob is reported
    too. Of a rule whose version changed, the new version's findings alone count.

    Findings: doc_id, source, blob, rule, rule_version, ordinal (1, 2, ... within
    blob and rule), secret_sha256, secret_chars; secrets themselves never leave
    the scan. Additions: blob, rule, rule_version, one row per scanned pair.
    A path is (source, doc_id); each of its rows is one version.

    Null texts have no blob and no finding; an empty text is a blob without
    findings, texts of any length are read whole. Null ids and sources stay null
    in the findings. Repeated rows repeat their findings. With a ledger but without `reported`, only findings of
    pairs that this run scanned are returned. An empty table gives two empty
    results. Other columns are not read.
    """
    index, found, additions = _scanned(versions, ledger, rules, reported)
    return index.join(found, "blob").select("doc_id", "source", "blob", "rule", "rule_version", "ordinal", "secret_sha256", "secret_chars"), additions


def _scanned(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], reported: DataFrame | None, places: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index(doc_id, source, blob), findings by blob, additions to the ledger) of scan().

    With `places` the index is read once alone, and so it isn't written: of the
    documents a ledger of blobs is all that scan_places() writes.
    """
    paths = versions.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.col("text").alias("content"))
    paths = paths.withColumn("blob", blob_id(F.col("content")))
    index = paths.select("doc_id", "source", "blob")
    if not places:
        index = materialise(index, "blob-index")
    first = index.groupBy("blob").agg(F.min(F.struct("doc_id", "source")).alias("_at"))
    todo = materialise(unseen(first, ledger, rules).select("blob", F.col("_at.doc_id").alias("_doc"), F.col("_at.source").alias("_source"), "todo"), "unseen")
    # one row of each unseen blob meets its text; the texts are hashed to partitions once, unsorted
    texts = paths.where(_any_hit(rules, F.lower("content"))).join(
        todo.hint("shuffle_hash").select(F.col("blob").alias("_blob"), "_doc", "_source", "todo"),
        F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("blob") == F.col("_blob")),
    )
    found = materialise(scan_blobs(texts.select("blob", "content", "todo"), rules, places).distinct(), "findings")
    if reported is not None:
        current = F.lit(False)
        for r in rules:
            current = current | ((F.col("rule") == r.name) & (F.col("rule_version") == r.version))
        found = found.unionByName(reported.where(current).select(found.columns)).distinct()
    additions = todo.select("blob", F.explode("todo").alias("rule"))
    versions_of = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.version)])
    return index, found, additions.withColumn("rule_version", versions_of[F.col("rule")])


def _spans(rule: Rule, text, lowered):
    """array<struct<start, end>> of what the rule finds in text, from 1, end exclusive, in order.

    A match is the first occurrence of its text behind the match before it, as
    no pattern looks at what precedes it.
    """
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(spans, m):
        behind = F.when(F.size(spans) > 0, F.element_at(spans, -1)["end"]).otherwise(F.lit(1))
        start = F.call_function("locate", m, text, behind)
        return F.concat(spans, F.array(F.struct(start.alias("start"), (start + F.char_length(m)).alias("end"))))

    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return F.when(_hit(rule, lowered), F.aggregate(hits, empty, add)).otherwise(empty)


def _redacted(text, rules: tuple[Rule, ...], mark: str):
    """text with the union of the spans of all rules replaced; spans that overlap become one mark."""
    lowered = F.lower(text)
    return _cut(text, F.array_sort(F.concat(*[_spans(r, text, lowered) for r in rules])), mark)


def _cut(text, spans, mark: str):
    """text with the union of spans, in order of their start, replaced."""
    begin = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def add(s, x):
        apart = F.concat(s["out"], F.substring(text, s["at"], x["start"] - s["at"]), F.lit(mark))
        return F.struct(F.when(x["start"] >= s["at"], apart).otherwise(s["out"]).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    return F.aggregate(spans, begin, add, lambda s: F.concat(s["out"], F.substring(text, s["at"], F.char_length(text))))


def save(folder: str, run: int, additions: DataFrame, findings: DataFrame) -> None:
    """Keep what a scan of a run added under `folder`, which all executors share; saving a run again replaces it."""
    columns = ["blob", "rule", "rule_version", "ordinal", "secret_sha256", "secret_chars"]
    columns += [c for c in ("start",) if c in findings.columns]
    additions.write.mode("overwrite").parquet(f"{folder}/ledger/run={run}")
    findings.select(columns).distinct().write.mode("overwrite").parquet(f"{folder}/findings/run={run}")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(ledger, reported) of all runs saved under `folder`, as scan() takes them."""
    ledger, reported = (spark.read.parquet(f"{folder}/{x}").drop("run") for x in ("ledger", "findings"))
    return ledger, reported.distinct()


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret that scan() finds replaced by `mark` and n_chars, where there is such a column, set to the new length.

    One pass over each row, nothing is shuffled. The rules all read the original
    text; findings that overlap are replaced by one mark. All rows and columns
    stay, repeated rows too. Texts without a finding are returned as they are, of
    whatever length; null texts stay null. An empty table gives an empty result.
    """
    text, name = F.col("text"), free_name(docs, "redacted")
    return _with_text(docs, docs.withColumn(name, F.when(_any_hit(rules, F.lower(text)), _redacted(text, rules, mark)).otherwise(text)), name)


def _with_text(docs: DataFrame, changed: DataFrame, name: str) -> DataFrame:
    """The columns of docs, text taken from the column `name` of changed and n_chars set to its length."""
    text, new, out = F.col("text"), F.col(name), []
    for c in docs.columns:
        if c == "text":
            out.append(new.alias("text"))
        elif c == "n_chars":
            kind = docs.schema["n_chars"].dataType
            out.append(F.when(new.eqNullSafe(text), F.col("n_chars")).otherwise(F.char_length(new)).cast(kind).alias("n_chars"))
        else:
            out.append(F.col(f"`{c}`"))
    return changed.select(*out)


def scan_places(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, reported: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings by blob, additions to the ledger) of scan(), for save() and redact_found().

    Findings: blob, rule, rule_version, ordinal, secret_sha256, secret_chars,
    start (the character where the secret begins, from 1). `reported` must hold
    start too, as what scan_places() found and save() kept does. Nulls, repeated
    rows, long texts, an empty table and other columns are treated as in scan().
    """
    if reported is not None and "start" not in reported.columns:
        raise ValueError("the findings reported so far have no start: scan their blobs again without the ledger")
    _, found, additions = _scanned(versions, ledger, rules, reported, places=True)
    return found, additions


def redact_found(docs: DataFrame, found: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with the findings of scan_places() replaced by `mark`, as redact() does, but no text is scanned again.

    Only rows that hold a hint of some rule meet the findings of their blob; the
    others pass. All rows and columns stay, repeated rows too; null texts stay
    null, texts of any length are handled, an empty table gives an empty result.
    """
    text, name = F.col("text"), free_name(docs, "redacted")
    blob, spans = free_name(docs, "blob"), free_name(docs, "spans")
    span = F.struct(F.col("start").alias("start"), (F.col("start") + F.col("secret_chars")).alias("end"))
    of = found.groupBy("blob").agg(F.array_sort(F.collect_list(span))).toDF(blob, spans)
    hinted = F.coalesce(_any_hit(rules, F.lower(text)), F.lit(False))
    asked = docs.where(hinted).join(of.hint("shuffle_hash"), blob_id(text) == F.col(blob), "left")
    changed = asked.withColumn(name, F.when(F.col(spans).isNotNull(), _cut(text, F.col(spans), mark)).otherwise(text))
    return _with_text(docs, changed, name).unionByName(docs.where(~hinted))
