"""External batch scorer hook and the accounting of its run (O-84, O-86, O-111).

No ``from __future__ import annotations`` here: pandas UDFs read their
type hints at definition time.
"""

import json
import logging
import warnings
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import materialize

log = logging.getLogger(__name__)


class ScorerUnavailable(Exception):
    """Raised by a scorer whose model or word lists are not there."""


# ----------------------------------------------------------------------------
# external batch scorer (O-111)
# ----------------------------------------------------------------------------
def score_batch(scorer, texts: list, strict: bool = False) -> list:
    """(status, scores) of each text.  A batch that fails is tried text by
    text, so one bad text does not cost the others; ``strict`` raises instead.
    A scorer that answers with another number of results is an error."""
    if scorer is None:
        return [(fixed.EMOTION_UNAVAILABLE, None)] * len(texts)
    if not texts:
        return []
    try:
        out = scorer(texts)
    except (ImportError, ScorerUnavailable):
        if strict:
            raise
        return [(fixed.EMOTION_UNAVAILABLE, None)] * len(texts)
    except Exception as e:
        if strict:
            raise
        if len(texts) > 1:
            return [r for t in texts for r in score_batch(scorer, [t])]
        log.warning("scorer failed on a text: %s", e)
        return [(fixed.EMOTION_FAILED, None)]
    if len(out) != len(texts):
        raise ValueError(f"the scorer gave {len(out)} results for {len(texts)} texts")
    return [(fixed.EMOTION_FAILED, None) if d is None else (fixed.EMOTION_OK, {k: float(v) for k, v in d.items()}) for d in out]


def with_scorer_emotions(df: DataFrame, scorer, text_col: str = "clean_text", on_failure: str = "lexicon") -> DataFrame:
    """Emotion scores from a caller-supplied batch scorer (for example a
    transformer model): ``scorer(list[str]) -> list[dict[str, float]]`` is
    called once per Arrow batch inside the tasks (iterator pandas UDF, the
    model is loaded once per task); None stands for a scorer that is not there.

    ``emotion_status`` is ``ok`` for scored rows (``emotion_source`` ``model``)
    and ``missing_text`` for null and empty texts, which are not sent.  Where
    the scorer fails, ``on_failure`` decides: ``lexicon`` keeps the result and
    status of ``enrich``, marked ``lexicon_fallback``; ``empty`` gives no
    scores, ``unknown`` and the status ``emotion_failed``, or
    ``nrcl_ex_unavailable`` where the scorer is not there; ``raise`` ends the
    run with the scorer's error."""
    if on_failure not in ("lexicon", "empty", "raise"):
        raise ValueError(f"on_failure: {on_failure}")
    strict = on_failure == "raise"

    @F.pandas_udf("string")
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = texts.fillna("").tolist()
            scored = iter(score_batch(scorer, [t for t in texts if t], strict))
            results = [next(scored) if t else (fixed.EMOTION_NO_TEXT, None) for t in texts]
            yield pd.Series([json.dumps({"status": s, "scores": d}) for s, d in results], dtype=object)

    scored = df.withColumn("_model", F.from_json(_score(F.col(text_col)), "status string, scores map<string,double>"))
    status, scores = F.col("_model.status"), F.col("_model.scores")
    entries = F.map_entries(scores)
    best = F.sort_array(F.transform(entries, lambda e: F.struct((-e["value"]).alias("neg"),
                                                                 e["key"].alias("emotion"))))
    model_dom = F.when(F.size(entries) > 0, F.get(best, 0)["emotion"]).otherwise("unknown")
    failed = status.isin(*fixed.EMOTION_FAILURES)
    kept = failed if on_failure == "lexicon" else F.lit(False)
    none = F.map_from_entries(F.array().cast("array<struct<key: string, value: double>>"))
    own = F.col("emotion_status") if "emotion_status" in df.columns else F.lit(fixed.EMOTION_OK)
    return (scored
            .withColumn("emotion_scores", F.when(kept, F.col("emotion_scores")).otherwise(F.coalesce(scores, none)))
            .withColumn("dominant_emotion", F.when(kept, F.col("dominant_emotion"))
                        .when(status == fixed.EMOTION_OK, model_dom).otherwise("unknown"))
            .withColumn("emotion_source", F.when(kept, "lexicon_fallback").when(status == fixed.EMOTION_OK, "model").otherwise("none"))
            .withColumn("emotion_status", F.when(kept, own).otherwise(status))
            .drop("_model"))


# ----------------------------------------------------------------------------
# accounting of a run (O-86)
# ----------------------------------------------------------------------------
def checkpoint_with_counts(df: DataFrame, name: str = "emotions") -> tuple[DataFrame, DataFrame]:
    """``df`` as a reliable checkpoint, and one row with the counts of its
    ``emotion_status``, observed while the checkpoint was written: no second
    pass.  Warns of failures.  A task that runs again counts once.

    The metrics are read from the checkpoint's own execution: an
    ``Observation`` would leave a manager in the session, and logistic models
    fitted there later could not be sent to tasks."""
    status = F.col("emotion_status")
    counts = {"n_posts": F.count(F.lit(1)), "ok": F.count_if(status == fixed.EMOTION_OK),
              "missing_text": F.count_if(status == fixed.EMOTION_NO_TEXT),
              "unavailable": F.count_if(status == fixed.EMOTION_UNAVAILABLE),
              "failed": F.count_if(status == fixed.EMOTION_FAILED),
              "failures": F.count_if(status.isin(*fixed.EMOTION_FAILURES))}
    observed = df.observe(name, *[c.alias(n) for n, c in counts.items()])
    stored = materialize(observed)
    row = observed._jdf.queryExecution().observedMetrics().apply(name)
    seen = {n: int(row.getLong(k)) for k, n in enumerate(counts)}
    if seen["failures"]:
        warnings.warn(f"emotions failed for {seen['failures']} of {seen['n_posts']} posts; they have no scores")
    return stored, df.sparkSession.createDataFrame([tuple(seen.values())], ", ".join(f"{n} long" for n in seen))
