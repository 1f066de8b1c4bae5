"""The whole scan: corpus to findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from vettica.functions.policy import POLICIES, Policy
from vettica.functions.secret_rules import SECRET_RULES, SecretRule
from vettica.functions.sink_rules import SINK_RULES, SinkRule
from vettica.operators.findings import all_findings
from vettica.operators.secrets import scan_secrets
from vettica.operators.sinks import sink_candidates
from vettica.operators.verify import classify
from vettica.sources.corpus import decode_text, restrict_to, select_changed

Scoring = Callable[[DataFrame], DataFrame]


def verified_candidates(
    corpus: DataFrame,
    add_scores: Scoring,
    sink_rules: tuple[SinkRule, ...] = SINK_RULES,
    policies: tuple[Policy, ...] = POLICIES,
) -> DataFrame:
    """Sink candidates of a (path, text) corpus with their verdicts.

    ``add_scores`` adds a ``score`` column to candidates: a column expression,
    a join by candidate_id, or ``score_in_place`` with a model.
    """
    return classify(add_scores(sink_candidates(corpus, sink_rules)), policies)


def cascade(
    corpus: DataFrame,
    add_scores: Scoring,
    secret_rules: tuple[SecretRule, ...] = SECRET_RULES,
    sink_rules: tuple[SinkRule, ...] = SINK_RULES,
    policies: tuple[Policy, ...] = POLICIES,
) -> DataFrame:
    """All findings of a (path, text) corpus.

    Both scans are narrow, so without a model the job is one map stage over
    each branch and never shuffles a file.
    """
    return all_findings(
        scan_secrets(corpus, secret_rules),
        verified_candidates(corpus, add_scores, sink_rules, policies),
    )


def incremental_scan(
    corpus: DataFrame,
    changed: DataFrame,
    add_scores: Scoring,
    landing: str | None = None,
    **options: object,
) -> DataFrame:
    """The cascade over the changed files only.

    ``corpus`` is raw (path, content, length), not pruned, so that changed files of any
    directory are read and size and content decide; or decoded (path, text), which is
    taken as already selected.  With ``landing``, a folder, the texts of the changed
    files are stored there first: the corpus is read and joined once, not once for each
    layer, and the scan reads only what changed.
    """
    if "content" in corpus.columns:
        touched = decode_text(select_changed(corpus, changed))
    else:
        touched = restrict_to(corpus.select("path", "text"), changed)
    if landing is not None:
        touched.write.parquet(landing)
        touched = corpus.sparkSession.read.schema(touched.schema).parquet(landing)
    return cascade(touched, add_scores, **options)
