"""One query per operator, over the test tables or tables derived from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vettica.functions import languages, text
from vettica.functions.secret_rules import SECRET_RULES
from vettica.functions.sink_rules import (
    ALLOCATION,
    ANY_COMMAND,
    BUFFER,
    FORMAT,
    MEMORY,
    SINK_RULES,
    component,
)
from vettica.operators import evaluate, findings, sarif, secrets, sinks, verify
from vettica.operators.tokens import code_tokens
from vettica.plans import cascade as scan
from vettica.plans import derived
from vettica.session import checkpoint_root
from vettica.sources import corpus as corpora
from vettica.streaming.scan import read_corpus_stream, start_scan

Query = Callable[[SparkSession, str], DataFrame]


# --- inputs --------------------------------------------------------------


def raw_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, length, text) before any selection."""
    return derived.code_corpus(spark, folder).withColumn("content", F.col("text").cast("binary"))


def scannable(spark: SparkSession, folder: str) -> DataFrame:
    return corpora.decode_text(corpora.select_scannable(raw_corpus(spark, folder)))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.sink_candidates(derived.code_corpus(spark, folder))


def routed(spark: SparkSession, folder: str) -> DataFrame:
    rows = derived.scored_candidates(spark, folder)
    listed = F.when(F.col("cwe_list") == "", F.array().cast("array<string>")).otherwise(
        F.split("cwe_list", ", ")
    )
    return rows.withColumns(
        {"lang": languages.normalize_language(F.col("spelled")), "cwe": listed}
    )


def verified(spark: SparkSession, folder: str) -> DataFrame:
    return verify.classify(routed(spark, folder))


def secret_hits(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(derived.text_corpus(spark, folder))


def reported(spark: SparkSession, folder: str) -> DataFrame:
    return findings.all_findings(secret_hits(spark, folder), verified(spark, folder))


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The reported findings, a run for each first part of a path, in report order."""
    run = F.substring_index("path", "/", 1)
    return sarif.store_findings(sarif.with_run(reported(spark, folder), run), _scratch(spark, "findings"))


def with_stand_in_scores(rows: DataFrame) -> DataFrame:
    """Scores that depend on the candidate, in place of a model."""
    mixed = F.length("snippet") * 37 + F.col("line") * 11 + F.col("column")
    return rows.withColumn("score", F.pmod(mixed, F.lit(1001)).cast("double") / F.lit(1000.0))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    rows = derived.labelled(spark, folder).filter(verify.is_supported(F.col("lang")))
    judged = verify.classify(rows.withColumnRenamed("label", "y"))
    return judged.select("lang", "y", F.col("label").alias("pred"), "status")


def balanced(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.balance_per_language(derived.labelled(spark, folder), ["doc_id"])


# --- queries -------------------------------------------------------------


def _secret_query(*rule_ids: str) -> Query:
    chosen = tuple(r for r in SECRET_RULES if not rule_ids or r.rule_id in rule_ids)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        hits = secrets.scan_secrets(derived.text_corpus(spark, folder), chosen)
        return secrets.redacted(hits).drop("rule_order")

    return run


def _flat_cwe(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cwe", F.array_join("cwe", ","))


CANDIDATE_COLUMNS = ("path", "lang", "line", "column", "sink_name", "rule_no", "cwe")
FINDING_COLUMNS = (
    "layer", "path", "start_line", "start_column", "rule_order", "rule_id", "message",
    "severity", "confidence",
)


def _sink_query(lang: str) -> Query:
    rules = tuple(rule for rule in SINK_RULES if rule.lang == lang)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = sinks.sink_candidates(derived.code_corpus(spark, folder), rules)
        return _flat_cwe(rows).select(*CANDIDATE_COLUMNS)

    return run


def _decode_text(spark: SparkSession, folder: str) -> DataFrame:
    valid = F.col("text").cast("binary")
    rows = derived.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("path"),
        F.concat(valid, F.unhex(F.lit("FF")), valid, F.unhex(F.lit("E282C328"))).alias("content"),
    )
    return corpora.decode_text(rows)


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return corpora.changed_files(*derived.snapshots(spark, folder))


def _names(spark: SparkSession, folder: str) -> DataFrame:
    groups = {
        "buffer": BUFFER, "memory": MEMORY, "format": FORMAT, "command": ANY_COMMAND,
        "allocation": ALLOCATION,
    }
    return derived.names(spark, folder).withColumns(
        {label: F.col("name").rlike(component(words)) for label, words in groups.items()}
    )


def _score_batches(spark: SparkSession, folder: str) -> DataFrame:
    # defined here so that it travels to the workers by value
    def load_scorer() -> verify.Scorer:
        """Stands in for loading a model."""
        return lambda snippets, langs: [len(snippet) % 997 / 997 for snippet in snippets]

    return verify.score_batches(candidates(spark, folder), load_scorer)


def _softmax(spark: SparkSession, folder: str) -> DataFrame:
    first, second = (F.col("embedding")[i].cast("double") for i in (0, 1))
    return derived.table(spark, folder, "embeddings").select(
        "vec_id", F.round(verify.softmax_prob(first, second), 9).alias("probability")
    )


def _verify(spark: SparkSession, folder: str) -> DataFrame:
    rows = routed(spark, folder)
    return verify.verify_candidates(rows.drop("score"), rows.select("candidate_id", "score")).select(
        "candidate_id", "ml_verified", "confidence", "label", "status"
    )


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    decided = findings.decide_findings(verified(spark, folder))
    return decided.select("candidate_id", findings.finding_message().alias("message"))


def _cascade(corpus: DataFrame) -> DataFrame:
    return scan.cascade(corpus, with_stand_in_scores)


def cascade(spark: SparkSession, folder: str) -> DataFrame:
    return _cascade(scannable(spark, folder)).select(*FINDING_COLUMNS)


def _sarif_write(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the files written."""
    target = _scratch(spark, "report")
    sarif.write_report(stored(spark, folder), target)
    return spark.read.text(target).withColumnRenamed("value", "line")


def _streaming_scan(spark: SparkSession, folder: str) -> DataFrame:
    base = _scratch(spark, "scan")
    scannable(spark, folder).write.parquet(f"{base}/corpus")
    arriving = read_corpus_stream(spark, f"{base}/corpus")
    query = start_scan(_cascade, arriving, f"{base}/findings", "findings", f"{base}/log")
    query.awaitTermination()
    return spark.read.parquet(f"{base}/findings").select(*FINDING_COLUMNS)


def _incremental(spark: SparkSession, folder: str) -> DataFrame:
    return scan.incremental_scan(
        raw_corpus(spark, folder), _changes(spark, folder), with_stand_in_scores, _scratch(spark, "changed")
    ).select(*FINDING_COLUMNS)


def _rounded(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns(
        {c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")}
    )


def _project(source: Query, *columns: str | Column) -> Query:
    return lambda spark, folder: source(spark, folder).select(*columns)


def _path_columns(spark: SparkSession, folder: str, **columns: Column) -> DataFrame:
    return derived.code_corpus(spark, folder).select(
        "path", *[column.alias(name) for name, column in columns.items()]
    )


def queries() -> dict[str, Query]:
    path = "path"
    return {
        # sources and selection
        "corpus_load": lambda s, d: corpora.select_scannable(raw_corpus(s, d)).select(
            "path", "length", F.md5("content").alias("hash")
        ),
        "prune_dirs": lambda s, d: corpora.prune_dirs(raw_corpus(s, d)).select("path"),
        "filter_size": lambda s, d: corpora.filter_size(raw_corpus(s, d)).select("path", "length"),
        "filter_binary": lambda s, d: corpora.filter_binary(raw_corpus(s, d)).select("path"),
        "decode_text": _decode_text,
        "skip_report": lambda s, d: corpora.skip_report(raw_corpus(s, d)),
        "changed_files": _changes,
        "split_lines": lambda s, d: secrets.split_lines(derived.text_corpus(s, d)),
        # lookups
        "language_of_path": lambda s, d: _path_columns(
            s,
            d,
            lang=languages.rule_language(F.col(path)),
            model_lang=languages.model_language(F.col(path)),
        ),
        "normalize_language": _project(routed, "candidate_id", "lang"),
        "display_language": lambda s, d: _path_columns(
            s, d, language=languages.display_language(F.col(path))
        ),
        # secrets
        "secrets_aws": _secret_query("aws-access-key-id"),
        "secrets_api_key": _secret_query("generic-api-key"),
        "secrets_private_key": _secret_query("private-key-header"),
        "secrets_slack": _secret_query("slack-token"),
        "secrets_assignment": _secret_query("generic-secret-assignment"),
        "secret_scan": _secret_query(),
        "redact_secret": lambda s, d: derived.table(s, d, "part").select(
            "p_partkey",
            text.redact(F.col("p_name")).alias("four"),
            text.redact(F.col("p_name"), 2).alias("two"),
            text.redact(F.col("p_brand"), 12).alias("twelve"),
        ),
        "secret_findings": lambda s, d: secrets.secret_findings(secret_hits(s, d)).withColumn(
            "layer", F.lit(1)
        ),
        # sink candidates
        "code_tokens": lambda s, d: code_tokens(derived.code_corpus(s, d)),
        "call_sites": lambda s, d: sinks.call_sites(derived.code_corpus(s, d)).drop("target"),
        "match_sink_name": _names,
        "sinks_c": _sink_query("c"),
        "sinks_cpp": _sink_query("cpp"),
        "sinks_java": _sink_query("java"),
        "sinks_python": _sink_query("python"),
        "cwe_tags": lambda s, d: sinks.weakness_counts(candidates(s, d)),
        "function_spans": lambda s, d: sinks.function_spans(derived.code_corpus(s, d)),
        "enclosing_function": _project(
            candidates, "path", "line", "column", "sink_name", "rule_no", "function_line",
            "function_end_line", "snippet",
        ),
        "sink_candidates": lambda s, d: _flat_cwe(candidates(s, d)).select(
            *CANDIDATE_COLUMNS, "snippet"
        ),
        "candidates_by_rule": lambda s, d: sinks.candidates_by_rule(candidates(s, d)),
        # verification
        "route_ml": lambda s, d: verify.route_ml(routed(s, d)).select(
            "candidate_id", "lang", "supported", "route"
        ),
        "score_batches": _score_batches,
        "softmax_prob": _softmax,
        "classify": _project(
            verified, "candidate_id", "lang", "ml_verified", "confidence", "label", "status"
        ),
        "verify_candidates": _verify,
        # triage and reports
        "decide_findings": lambda s, d: findings.decide_findings(verified(s, d)).select(
            "candidate_id", "severity", "status", "label"
        ),
        "low_confidence_override": lambda s, d: findings.low_confidence_override(
            findings.decide_findings(verified(s, d))
        ).select("candidate_id", "severity", "low_confidence_category", "note", "confidence"),
        "finding_messages": _messages,
        "all_findings": _project(reported, *FINDING_COLUMNS),
        "sarif_rules": lambda s, d: sarif.sarif_rules(stored(s, d)),
        "sarif_results": lambda s, d: sarif.sarif_results(reported(s, d)),
        "sarif_report": lambda s, d: sarif.sarif_run_lines(stored(s, d)).select("run_id", "section", "line"),
        "sarif_write": _sarif_write,
        "unsupported_warning": lambda s, d: findings.unsupported_warning(verified(s, d)),
        "scan_summary": lambda s, d: findings.scan_summary(secret_hits(s, d), verified(s, d)),
        "cascade": cascade,
        # evaluation
        "eval_examples": lambda s, d: evaluate.eval_examples(derived.pairs(s, d)),
        "eval_stats": lambda s, d: evaluate.eval_stats(derived.pairs(s, d)),
        "balance_per_language": _project(balanced, "doc_id", "lang", "label"),
        "confusion_matrix": lambda s, d: evaluate.confusion_matrix(predictions(s, d)),
        "classifier_metrics": lambda s, d: _rounded(
            evaluate.classifier_metrics(evaluate.confusion_matrix(predictions(s, d)))
        ).select("lang", "n", "accuracy", "precision", "recall", "f1"),
        "metrics_rollup": lambda s, d: _rounded(evaluate.metrics_rollup(predictions(s, d))),
        "uncertain_counts": lambda s, d: evaluate.uncertain_counts(predictions(s, d)),
        "class_counts": lambda s, d: evaluate.class_counts(balanced(s, d)),
        # arriving and changed files
        "streaming_scan": _streaming_scan,
        "incremental_scan": _incremental,
    }
