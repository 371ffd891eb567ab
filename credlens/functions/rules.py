"""Scalar decision rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weak_label(source: Column | str, verified: tuple[str, ...]) -> Column:
    return F.when(_c(source).isin(list(verified)), "credible").otherwise("unverified")


def alert(score: Column | str, threshold: float) -> Column:
    """Alert when the confidence is strictly below the threshold."""
    return _c(score) < F.lit(threshold)


def decision(label: Column | str, alert_flag: Column | str) -> Column:
    return (F.when(_c(alert_flag), "Review")
            .when(_c(label) == "credible", "Pass")
            .otherwise("Reject"))


def sentiment_band(sentiment: Column | str) -> Column:
    s = _c(sentiment)
    return (F.when(s <= fixed.SENTIMENT_NEGATIVE_AT, "Negative")
            .when(s >= fixed.SENTIMENT_POSITIVE_AT, "Positive")
            .otherwise("Neutral"))


def emotion_category(emotion: Column | str) -> Column:
    e = F.lower(F.coalesce(_c(emotion).cast("string"), F.lit("none")))
    return (F.when(e.isin(list(fixed.POSITIVE_EMOTIONS)), "positive")
            .when(e.isin(list(fixed.NEGATIVE_EMOTIONS)), "negative")
            .otherwise("neutral"))


def score_text(score: Column | str) -> Column:
    """Score with two decimals, half away from zero."""
    return F.format_number(F.round(_c(score), 2), 2)


def explanation_text(label: Column | str, score: Column | str, emotion: Column | str,
                     terms: Column | str, n_terms: int = 5) -> Column:
    """Pipeline template: '... Key terms: a, b.' or '... Key terms: none.'"""
    t = _c(terms)
    shown = F.when(F.size(t) > 0, F.array_join(F.slice(t, 1, n_terms), ", ")).otherwise("none")
    return F.format_string(
        "This post is classified as '%s' with a credibility score of %s. "
        "Dominant emotion: %s. Key terms: %s.",
        _c(label), score_text(score), F.coalesce(_c(emotion), F.lit("unknown")), shown)


def user_explanation_text(label: Column | str, score: Column | str, emotion: Column | str,
                          terms: Column | str, n_terms: int = 5) -> Column:
    """User-facing template with its own wording for the no-terms case."""
    t = _c(terms)
    reason = F.when(
        F.size(t) > 0,
        F.format_string("Key terms influencing the score: %s.",
                        F.array_join(F.slice(t, 1, n_terms), ", ")),
    ).otherwise(fixed.USER_REASON_NONE)
    return F.format_string(
        "This post is classified as '%s' with a credibility score of %s. "
        "Dominant emotion detected: %s. %s",
        _c(label), score_text(score), F.coalesce(_c(emotion), F.lit("unknown")), reason)


def group_key(source: Column | str, lang: Column | str, cluster_by: str) -> Column:
    s = F.coalesce(_c(source), F.lit("unknown"))
    l = F.coalesce(_c(lang), F.lit("unknown"))
    if cluster_by == "label":
        return s
    if cluster_by == "lang":
        return l
    return F.concat_ws("__", s, l)


def hash_bucket(key: Column | str, buckets: int) -> Column:
    """Stable bucket of a key from the first 32 bits of its md5."""
    h = F.conv(F.substring(F.md5(_c(key)), 1, 8), 16, 10).cast("long")
    return (h % F.lit(buckets)).cast("int")
