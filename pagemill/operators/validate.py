"""Page checks and attempt outcomes.

The cheap checks run on the raw text; only pages that pass them are parsed.
All of it is per-row work on the capture table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.markup import let, with_elements, with_flat_elements
from pagemill.functions.text import contains_any, icontains
from pagemill.plans.rules import BLOCKED_TEXTS, MAX_ATTEMPTS, RETRY_ERRORS, RETRY_STATUSES


def too_short(html: Column, min_length: Column) -> Column:
    """P1"""
    return F.coalesce(F.length(html), F.lit(0)) < min_length


def error_phrase(html: Column, error_texts: Column) -> Column:
    """First listed phrase found anywhere in the page, ignoring case."""
    return let(F.lower(html), lambda page: F.get(
        F.filter(error_texts, lambda p: F.contains(page, F.lower(p))), F.lit(0)))


def has_element(els: Column, selector: Column) -> Column:
    """Some element matches a 'tag.class' selector."""
    wanted = F.struct(F.split_part(selector, F.lit("."), F.lit(1)).alias("tag"), F.split_part(selector, F.lit("."), F.lit(2)).alias("name"))
    return let(wanted, lambda w: F.exists(els, lambda e: (e["tag"] == w["tag"]) & F.array_contains(e["classes"], w["name"])))


def with_verdict(captures: DataFrame, html: str = "html", flat: bool = False) -> DataFrame:
    """Replace the page text by ``els`` and ``texts`` and add ``verdict``,
    ``is_valid`` and ``blocked``.

    Needs the rule columns.  A page that fails a raw-text check is not parsed;
    its arrays are null.  With ``flat`` the elements are those of :func:`with_flat_elements`, without ``texts``;
    the verdict is the same, as a required element has a class.

    The parse helper looks for error phrases in pages of ASCII characters, where lower case is the same everywhere; others
    are searched before they go to it.
    """
    short = F.col("verdict_rule") == "short"
    page, listed = F.col(html), F.col("error_texts")
    named = F.when(short, "Error page: ").otherwise("Error page detected: ")
    early = captures.withColumn("_early", F.when(
        too_short(page, F.col("min_length")), F.lit("Content too short")
    ).when(F.octet_length(page) != F.length(page), let(
        error_phrase(page, listed), lambda p: F.concat(named, p))))
    parse = with_flat_elements if flat else with_elements
    parsed = parse(early.withColumn(html, F.when(F.col("_early").isNull(), page)), html, listed)
    parsed = parsed.withColumn("_early", F.coalesce("_early", F.concat(named, F.get(listed, F.col("_phrase"))))).drop("_phrase")
    missing = F.get(F.filter(F.col("required")[F.col("page_type")],
                             lambda s: ~has_element(F.col("els"), s)), F.lit(0))
    judged = parsed.withColumn("_missing", F.when(F.col("_early").isNull(), missing))
    verdict = F.coalesce(
        F.col("_early"),
        F.concat(F.when(short, "Missing element: ").otherwise("Missing required element: "),
                 F.col("_missing")),
        F.when(short, "Content valid").otherwise("Page content valid"))
    return (judged
            .withColumn("verdict", verdict)
            .withColumn("is_valid", F.col("_early").isNull() & F.col("_missing").isNull())
            .withColumn("blocked", contains_any(F.col("verdict"), BLOCKED_TEXTS))
            .drop("_early", "_missing"))


def attempt_class(status: Column, error: Column, is_valid: Column,
                  retry_any_status: Column) -> Column:
    """P6, P7: 'success', 'retry' or 'final' for one attempt."""
    retryable_error = F.lit(False)
    for phrase in RETRY_ERRORS:
        retryable_error = retryable_error | icontains(F.coalesce(error, F.lit("")), phrase)
    return (
        F.when(status.isNull(), F.when(retryable_error, "retry").otherwise("final"))
        .when(status == 200, F.when(is_valid, "success").otherwise("retry"))
        .when(status.isin(RETRY_STATUSES) | retry_any_status, "retry")
        .otherwise("final"))


def capture_outcome(attempts: DataFrame, keys: list[str],
                    max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One row per page from its attempts (``attempt``, ``attempt_class``, ``error``).

    Only minima, counts and the last error are kept per page, so the map side
    reduces a page fetched any number of times to one row before the shuffle.
    """
    kind, n = F.col("attempt_class"), F.col("attempt")
    failed = F.when(F.col("error").isNotNull() & (n <= max_attempts), n)
    summary = attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("logged"),
        F.min(F.when(kind == "success", n)).alias("_ok"),
        F.min(F.when(kind == "final", n)).alias("_final"),
        F.max(n).alias("_last"),
        F.max_by("error", failed).alias("last_error"))
    stop = F.least("_ok", "_final")
    used = F.least(F.coalesce(stop, F.col("_last")), F.col("_last"), F.lit(max_attempts))
    outcome = (
        F.when(F.coalesce(F.col("_ok") <= max_attempts, F.lit(False))
               & ((F.col("_ok") < F.col("_final")) | F.col("_final").isNull()), "success")
        .when(F.col("_final") <= max_attempts, "failed")
        .when(F.col("_last") >= max_attempts, "exhausted")
        .otherwise("pending"))
    return summary.select(
        *keys, "logged", used.alias("attempts_used"), outcome.alias("outcome"),
        F.when(outcome == "success", F.col("_ok")).alias("success_attempt"), "last_error")
