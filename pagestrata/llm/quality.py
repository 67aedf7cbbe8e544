"""Per-document text statistics and their robust distance from prose.

Each document gets nine statistics. For each language the centre and the scatter of prose are estimated
robustly: start from medians, then concentrate (mean and covariance of the closest documents, again and
again), so that lists, tables and junk do not move the estimate although they may be a third of a corpus.
The squared Mahalanobis distance is the sum of one contribution per statistic; both are reported.
All documents count in every step; the driver sees a few numbers per language.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.rows import map_rows
from pagestrata.llm.wordlists import COMMON_SETS, JAPANESE_COMMON, LANGUAGE_BY_NAME
from pagestrata.runtime import written

STATISTICS = [
    "common_word_share", "mean_word_length", "symbol_ratio", "digit_ratio", "end_mark_share",
    "words_per_line", "marker_share", "distinct_word_ratio", "running_text_share",
]
LANGUAGES = ["en", "de", "es", "fr", "ru", "ja"]
KEPT_SHARE = 0.6
ROUNDS = 3
POOL_WEIGHT = 30.0
# At sf0.1 the farthest prose lies at 5.1, the nearest junk at 8.5.
CUTOFF = 6.5
# A line of so many words is as long as any: texts without line breaks are no less prose. Distinct words are counted by blocks, as their
# share falls with a text's length.
LONG_LINE = 100
BLOCK = 100
# Smallest spread of each statistic, so that a corpus of equal texts keeps a usable covariance.
FLOOR = [0.04, 0.2, 0.03, 0.03, 0.4, 0.6, 0.08, 0.08, 0.08]

_STRIP = ".,;:!?\"'()[]{}«»“”„‘’…*_-–—"
_JAPANESE = re.compile(r"[぀-ヿ㐀-鿿]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_MARKER = re.compile(r"\s*(?:[-*•–—·>|#+]|\d{1,3}[.)]|https?://|[\w-]+\s*[:=]\s*\S+\s*$)")
_END = frozenset(".!?…。！？:;\"”»)")


def declared_language(value: str | None) -> str | None:
    return LANGUAGE_BY_NAME.get((value or "").strip().lower())


def _distinct_ratio(tokens: list[str]) -> float:
    """Logarithm of the distinct tokens over that of all, in blocks of BLOCK tokens, weighted by their lengths."""
    total = weight = 0.0
    for start in range(0, len(tokens), BLOCK):
        block = tokens[start : start + BLOCK]
        if len(block) > 1:
            total += len(block) * math.log(len(set(block))) / math.log(len(block))
            weight += len(block)
    return total / weight if weight else 1.0


def text_statistics(text: str, declared: str | None = None) -> tuple[str, int, list[float]] | None:
    """(language, words, the statistics) of one text; None where it is blank."""
    if not text or text.isspace():
        return None
    lines = [line for line in text.splitlines() if line and not line.isspace()]
    packed = sum(map(len, text.split()))
    japanese = len(_JAPANESE.findall(text)) if not text.isascii() else 0
    words = [w.strip(_STRIP) for w in text.lower().split()]
    if 3 * japanese > packed:
        language = "ja"
        tokens = [c for c in text if not c.isspace()]
        common = JAPANESE_COMMON
        share = sum(map(common.__contains__, tokens)) / len(tokens)
    else:
        tokens = words
        counts = {k: sum(map(s.__contains__, words)) for k, s in COMMON_SETS.items()} if not text.isascii() else None
        if counts is None:
            english = sum(map(COMMON_SETS["en"].__contains__, words))
            counts = {"en": english}
            if english < 0.25 * len(words):
                counts |= {k: sum(map(COMMON_SETS[k].__contains__, words)) for k in ("de", "es", "fr")}
        language = max(counts, key=counts.get)
        if counts[language] < 0.1 * len(words):
            cyrillic = len(_CYRILLIC.findall(text)) if not text.isascii() else 0
            language = "ru" if 3 * cyrillic > packed else declared_language(declared) or "en"
            if language == "ja" or (language == "ru" and 3 * cyrillic <= packed):
                language = "en"
        common = COMMON_SETS[language]
        share = counts.get(language, 0) / len(words)
    letters = sum(map(str.isalpha, text))
    digits = sum(map(str.isdigit, text))
    running = marked = ended = 0
    for line in lines:
        marker = _MARKER.match(line) is not None
        # By length, so that a short list or a few headings in prose weigh what they hold.
        marked += len(line) * marker
        ended += len(line) * (line.rstrip()[-1] in _END)
        if language == "ja":
            piece = line.strip()
            good = len(piece) >= 8 and sum(map(common.__contains__, piece)) >= 0.1 * len(piece)
        else:
            piece = line.lower().split()
            bare = [w.strip(_STRIP) for w in piece]
            common_here = sum(map(common.__contains__, bare))
            good = len(piece) >= 4 and (common_here >= 0.12 * len(piece) or (common_here >= 0.04 * len(piece) and sum(map(str.isalpha, bare)) >= 0.8 * len(piece)))
        if good:
            running += len(line)
    total = sum(map(len, lines))
    n = len(tokens)
    return language, len(words), [
        share,
        min(math.log1p(packed / len(words)), 6.0) if language != "ja" else 0.0,
        max(0.0, (packed - letters - digits) / packed),
        digits / packed,
        ended / total,
        math.log1p(min(n / len(lines), LONG_LINE)),
        marked / total,
        _distinct_ratio(tokens),
        running / total,
    ]


def document_statistics(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> DataFrame:
    """(id, language, words, statistics ARRAY<DOUBLE>); null, empty and blank texts have null statistics."""

    def measure(c: dict[str, list]) -> dict[str, list]:
        found = [text_statistics(t, d) if t else None for t, d in zip(c["text"], c["declared"])]
        return {
            "id": c["id"],
            "language": [f and f[0] for f in found],
            "words": [f[1] if f else 0 for f in found],
            "statistics": [f and f[2] for f in found],
        }

    picked = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(language_column).cast("string").alias("declared"))
    return map_rows(picked, measure, "id long, language string, words long, statistics array<double>")


def _moments(kept: DataFrame) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Count, mean and covariance of each language (and of all together) from sums: one small row per language."""
    d = len(STATISTICS)
    sums = [F.avg(F.get("statistics", i)).alias(f"m{i}") for i in range(d)]
    products = [F.avg(F.get("statistics", i) * F.get("statistics", j)).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    out = {}
    total = 0
    pooled_mean, pooled_cov = np.zeros(d), np.zeros((d, d))
    for row in kept.groupBy("language").agg(F.count("*").alias("n"), *sums, *products).collect():
        mean = np.array([row[f"m{i}"] for i in range(d)])
        second = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        cov = second - np.outer(mean, mean)
        out[row["language"]] = (row["n"], mean, cov)
        total += row["n"]
        pooled_mean += row["n"] * mean
        pooled_cov += row["n"] * cov
    if total:
        out[""] = (total, pooled_mean / total, pooled_cov / total)
    return out


def _models(moments: dict) -> dict[str, tuple[list[float], list[list[float]]]]:
    """Mean and precision matrix of each language; small languages lean on the scatter of all."""
    floor = np.diag(np.square(FLOOR))
    models = {}
    for language in LANGUAGES:
        n, mean, cov = moments.get(language, (0, None, None))
        if not n:
            continue
        shared = (n * cov + POOL_WEIGHT * moments[""][2]) / (n + POOL_WEIGHT)
        models[language] = (mean.tolist(), np.linalg.inv(shared + floor).tolist())
    return models


def _distances(stats: DataFrame, models: dict) -> DataFrame:
    """stats with contributions and their sum, the squared distance. The models are literals: languages x statistics squared."""
    mean = F.create_map(*[x for k, (m, _) in models.items() for x in (F.lit(k), F.array(*map(F.lit, m)))])
    matrix = F.create_map(*[x for k, (_, p) in models.items() for x in (F.lit(k), F.array(*[F.array(*map(F.lit, r)) for r in p]))])
    placed = stats.withColumns({"__mean": mean[F.col("language")], "__matrix": matrix[F.col("language")]})
    placed = placed.withColumn("__dev", F.zip_with("statistics", "__mean", lambda x, m: x - m))
    parts = F.zip_with("__dev", "__matrix", lambda d, row: d * F.aggregate(F.zip_with(row, F.col("__dev"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    placed = placed.withColumn("contributions", parts)
    return placed.withColumn("squared", F.aggregate("contributions", F.lit(0.0), lambda s, v: s + v)).drop("__mean", "__matrix", "__dev")


def outlierness(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> DataFrame:
    """(id, language, words, statistics, contributions, distance, led_by, is_prose): one row per input row.

    distance is the robust Mahalanobis distance from the prose of the document's language, led_by the statistic that
    contributes most to it; is_prose is false beyond CUTOFF, and nothing else decides. The covariance is that of the kept core,
    not enlarged for what was left out, and FLOOR is added to it, so CUTOFF stands for no error rate of a normal
    distribution: it lies in the gap that both kinds of text leave. Null, empty and blank texts have nulls throughout. Repeated
    ids keep their rows; other columns are ignored; an empty table gives an empty result.
    """
    stats = written(document_statistics(documents, id_column, text_column, language_column), "text-statistics")
    measured = stats.where(F.col("statistics").isNotNull())
    d = len(STATISTICS)
    medians = measured.groupBy("language").agg(*[F.percentile_approx(F.get("statistics", i), 0.5, 1000).alias(f"q{i}") for i in range(d)]).collect()
    if not medians:
        empty = stats.select(F.col("id").alias(id_column), "language", "words", "statistics")
        added = {"contributions": "array<double>", "distance": "double", "led_by": "string", "is_prose": "boolean"}
        return empty.withColumns({name: F.lit(None).cast(kind) for name, kind in added.items()})
    wide = np.diag(1.0 / np.square(3 * np.array(FLOOR))).tolist()
    models = {r["language"]: ([r[f"q{i}"] for i in range(d)], wide) for r in medians}
    for _ in range(ROUNDS):
        placed = _distances(measured, models)
        limits = {r["language"]: r["limit"] for r in placed.groupBy("language").agg(F.percentile_approx("squared", KEPT_SHARE, 1000).alias("limit")).collect()}
        limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
        models = _models(_moments(placed.where(F.col("squared") <= limit[F.col("language")])))
    placed = _distances(stats, models)
    distance = F.when(F.col("squared").isNotNull(), F.sqrt(F.greatest(F.col("squared"), F.lit(0.0))))
    leading = F.get(F.lit(STATISTICS), (F.array_position("contributions", F.array_max("contributions")) - 1).cast("int"))
    return placed.select(
        F.col("id").alias(id_column), "language", "words", "statistics", "contributions",
        distance.alias("distance"), leading.alias("led_by"), (distance <= CUTOFF).alias("is_prose"),
    )


def found(documents: DataFrame) -> DataFrame:
    return outlierness(documents).where(~F.col("is_prose")).select("doc_id")
