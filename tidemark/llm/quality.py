"""Quality scores by co-training two views of a document.

One classifier sees the content (shares of symbols, digits, distinct words, repeated lines, lengths), the other
only the metadata (source, language, recorded length). Both are logistic regressions, fitted on a bounded
sample of labelled rows. In every round each view labels the documents of an unlabelled pool it is most sure of and
hands them to the other view as training rows. Each view's log-odds are then calibrated on labelled rows it was not
fitted on, and every document gets the combination of both calibrated views.

Fitting reads at most `LABELLED` + `POOL` rows; scoring is one expression over all rows, with no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, blank_if_null, stored

LABELLED, POOL, ROUNDS, HANDED, SURE = 20_000, 20_000, 3, 500, 0.9
SOURCES, LANGS = 32, 8
_SYMBOLS = r"#%&*$@|^~<>{}[]\/_=+"


def content_view(text: Column) -> dict[str, Column]:
    body = blank_if_null(text)
    n = F.length(body)
    words, lines = F.filter(F.split(body, BLANK), lambda w: w != ""), F.split(body, "\n")
    share = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    gone = lambda chars: n - F.length(F.translate(body, chars, ""))
    return {
        "log_words": F.log1p(F.size(words)),
        "word_length": F.least(share(n, F.size(words)), F.lit(50.0)) / 10,
        "symbols": share(gone(_SYMBOLS), n),
        "digits": share(gone("0123456789"), n),
        "marks": share(gone(".,;:!?"), n),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_length": F.log1p(share(n, F.size(lines))),
    }


def metadata_view(source: Column, lang: Column, n_chars: Column) -> dict[str, Column]:
    length = F.log1p(F.greatest(F.coalesce(n_chars.cast("double"), F.lit(0.0)), F.lit(0.0)))
    out = {"log_chars": length, "log_chars_squared": length * length / 10, "no_source": source.isNull().cast("double"), "no_lang": lang.isNull().cast("double")}
    for name, col, n in (("source", source, SOURCES), ("lang", lang, LANGS)):
        bucket = F.pmod(F.xxhash64(col), F.lit(n))
        out |= {f"{name}_{i}": (col.isNotNull() & (bucket == i)).cast("double") for i in range(n)}
    return out


def _fit(rows: DataFrame, view: list[str]) -> tuple[list[float], float]:
    """Weights and intercept of label `y` on the columns of `view`."""
    lr = LogisticRegression(labelCol="y", regParam=0.01, maxIter=50)
    model = lr.fit(VectorAssembler(inputCols=view, outputCol="features").transform(rows))
    return [float(c) for c in model.coefficients], float(model.intercept)


def _odds(view: dict[str, Column], fitted: tuple[list[float], float]) -> Column:
    """Log-odds of a fitted view, bounded."""
    terms = [c * F.lit(w) for c, w in zip(view.values(), fitted[0]) if w]
    return F.greatest(F.least(reduce(lambda a, b: a + b, terms, F.lit(fitted[1])), F.lit(30.0)), F.lit(-30.0))


def _first(rows: DataFrame, n: int) -> DataFrame:
    """A bounded sample: the n rows with the least hashes of their id (each task keeps n at most)."""
    return rows.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(n)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """id, content_score, metadata_score, score (0 to 1), keep (score >= 0.5) per row of `docs` (text, source, lang, n_chars).

    NULL values count as empty, unknown or 0. Labels that are NULL are ignored; of repeated labels for an id the
    greatest counts. If the labelled documents don't hold both classes, nothing can be learned: scores are the
    share of positive labels, or 0.5 without any. Repeated rows are scored alike; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).alias("id"), "text", "source", "lang", "n_chars")
    content, meta = content_view(F.col("text")), metadata_view(F.col("source"), F.col("lang"), F.col("n_chars"))
    named = [{f"{p}_{k}": v for k, v in view.items()} for p, view in (("c", content), ("m", meta))]
    columns = [F.col("id"), *[v.alias(k) for view in named for k, v in view.items()]]
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.col(label)).cast("double").alias("y"))
    known = stored(_first(known, LABELLED), "quality-labels")
    seen = stored(base.join(known, "id").dropDuplicates(["id"]).select(*columns, "y"), "quality-known")
    held = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(5)) == 0
    both_in = lambda rows: rows.select("y").distinct().count() == 2
    if not both_in(seen):
        share = known.agg(F.avg("y")).first()[0]
        flat = F.lit(0.5 if share is None else float(share))
        return base.select("id", flat.alias("content_score"), flat.alias("metadata_score"), flat.alias("score"), (flat >= 0.5).alias("keep"))
    train = seen.where(~held) if both_in(seen.where(~held)) else seen
    pool = _first(base.select("id").where("id is not null").distinct().join(known, "id", "left_anti"), POOL)
    pool = stored(base.join(stored(pool, "quality-pool"), "id").dropDuplicates(["id"]).select(*columns), "quality-unlabelled")
    views = [{k: F.col(k) for k in view} for view in named]
    rows = [train, train]
    fits = [_fit(r, list(v)) for r, v in zip(rows, views)]
    taken: DataFrame | None = None
    for _ in range(ROUNDS):
        left = pool if taken is None else pool.join(taken.select("id"), "id", "left_anti")
        handed = []
        for v, fit in zip(views, fits):
            p = 1 / (1 + F.exp(-_odds(v, fit)))
            judged = left.withColumn("p", p)
            sure = judged.where(F.col("p") >= SURE).orderBy(F.desc("p"), "id").limit(HANDED).withColumn("y", F.lit(1.0))
            sure = sure.unionByName(judged.where(F.col("p") <= 1 - SURE).orderBy("p", "id").limit(HANDED).withColumn("y", F.lit(0.0)))
            handed.append(stored(sure.drop("p"), "quality-handed"))
        rows = [rows[0].unionByName(handed[1]), rows[1].unionByName(handed[0])]
        both = handed[0].select("id").unionByName(handed[1].select("id"))
        taken = stored((both if taken is None else both.unionByName(taken)).distinct(), "quality-taken")
        fits = [_fit(r, list(v)) for r, v in zip(rows, views)]
    apart = seen.where(held) if both_in(seen.where(held)) else seen
    stacked = apart.select("y", *[_odds(v, f).alias(n) for v, f, n in zip(views, fits, ("c", "m"))])
    (wc, wm), mid = _fit(stored(stacked, "quality-calibration"), ["c", "m"])
    single = [_fit(stacked.select("y", n), [n]) for n in ("c", "m")]
    odds = [_odds(view, f) for view, f in zip((content, meta), fits)]
    p = lambda x: 1 / (1 + F.exp(-x))
    out = base.select("id", odds[0].alias("c"), odds[1].alias("m"))
    # Log-odds of both views together, with the weights that hold on rows neither was fitted on.
    scores = [p(F.col(n) * w[0] + b).alias(f"{t}_score") for n, t, (w, b) in zip(("c", "m"), ("content", "metadata"), single)]
    out = out.select("id", *scores, p(F.col("c") * wc + F.col("m") * wm + mid).alias("score"))
    return out.withColumn("keep", F.col("score") >= 0.5)
