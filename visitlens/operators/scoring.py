"""Legitimacy score, dominant class and free-text routing, as arithmetic over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions import rules
from visitlens.functions.labels import col

VERDICTS = ((70, "LIKELY REAL HUMAN"), (40, "UNCERTAIN / POSSIBLE VPN USER"))
LOWEST_VERDICT = "LIKELY BOT / AI TRAINING AGENT"


def _graded(steps, otherwise) -> tuple[Column, Column]:
    """(points, note) of the first condition that holds."""
    points, note = F.lit(otherwise[0]), F.lit(otherwise[1]).cast("string")
    for condition, worth, text in reversed(steps):
        points = F.when(condition, worth).otherwise(points)
        note = F.when(condition, text).otherwise(note)
    return points, note


def legitimacy(profile: DataFrame) -> DataFrame:
    """Scores an address profile from 0 to 100 and names what spoke for and against it.

    Reads ``requests_per_second``, ``has_sec_fetch_count``, ``has_client_hints_count``,
    ``request_count``, ``datacenter_provider``, ``unique_paths`` and ``duration_seconds``.
    """
    rate, n = F.col("requests_per_second"), F.col("request_count")
    sec_fetch = F.col("has_sec_fetch_count") / n * 100
    hints = F.col("has_client_hints_count") / n * 100
    provider = F.nullif(F.col("datacenter_provider"), F.lit(""))
    paths, hours = F.col("unique_paths"), F.col("duration_seconds") / 3600
    datacenter_note = F.concat(F.lit("Datacenter IP ("), provider, F.lit(")"))
    # Thresholds and points of the six factors.
    factors = [
        _graded(
            [
                (rate < 0.05, 25, F.lit("Very slow request rate (human-like)")),
                (rate < 0.2, 15, F.lit("Moderate request rate")),
            ],
            (-30, "High request rate (bot-like)"),
        ),
        _graded(
            [
                (sec_fetch > 90, 30, F.lit("Sec-Fetch headers present (real browser)")),
                (sec_fetch > 50, 15, F.lit("Partial Sec-Fetch headers")),
            ],
            (-25, "Missing Sec-Fetch headers (likely bot)"),
        ),
        _graded(
            [
                (hints > 90, 20, F.lit("Client Hints present (modern browser)")),
                (hints > 50, 10, F.lit("Partial Client Hints")),
            ],
            (-15, "Missing Client Hints"),
        ),
        _graded([(provider.isNotNull(), -20, datacenter_note)], (15, "Residential/ISP network")),
        _graded(
            [
                (paths > 5, 10, F.lit("Diverse path exploration (curious human)")),
                (paths <= 2, -10, F.lit("Narrow path targeting (bot-like)")),
            ],
            (0, None),
        ),
        _graded(
            [
                (hours > 1, 10, F.lit("Extended session duration")),
                (hours < 0.05, -10, F.lit("Very short burst session")),
            ],
            (0, None),
        ),
    ]
    total = F.lit(50)
    for points, _ in factors:
        total = total + points
    score = F.greatest(F.lit(0), F.least(F.lit(100), total))
    scored = profile.withColumn("legitimacy_score", score)
    sure, unsure = VERDICTS
    return scored.withColumn(
        "verdict",
        F.when(F.col("legitimacy_score") >= sure[0], sure[1])
        .when(F.col("legitimacy_score") >= unsure[0], unsure[1])
        .otherwise(LOWEST_VERDICT),
    ).withColumn("indicators", F.array_compact(F.array(*[note for _, note in factors])))


# Tie order of the classes a location can be coloured by; attacks take no part.
DOMINANT_ORDER = (
    ("human_count", "Human"),
    ("official_ai_count", "Official AI"),
    ("stealth_ai_count", "Stealth AI"),
    ("web_crawler_count", "Web Crawler"),
    ("monitoring_count", "Monitoring"),
)


def dominant_class(df: DataFrame, default: str = "Default") -> DataFrame:
    counts = [F.coalesce(F.col(c), F.lit(0)) for c, _ in DOMINANT_ORDER]
    top = F.greatest(*counts)
    winner = F.when(top == 0, default)
    for count, (_, name) in zip(counts, DOMINANT_ORDER):
        winner = winner.when(count == top, name)
    return df.withColumn("dominant_class", winner)


def route_text(df: DataFrame, text: Column | str = "text") -> DataFrame:
    """Adds the report a command asks for and its score; both stay empty without a keyword hit.

    Two points per keyword and three for the report's name; the first listed report wins ties.
    """
    lowered = F.lower(col(text))

    def points(name: str, keywords) -> Column:
        total = F.when(lowered.contains(name.lower()), 3).otherwise(0)
        for word in keywords:
            total = total + F.when(lowered.contains(word), 2).otherwise(0)
        return total

    scores = {topic: f"_score_{i}" for i, (topic, _, _) in enumerate(rules.REPORT_TOPICS)}
    df = df.withColumns({scores[t]: points(name, words) for t, name, words in rules.REPORT_TOPICS})
    best = F.greatest(*scores.values())
    winner = F.when(best == 0, F.lit(None).cast("string"))
    for topic, column in scores.items():
        winner = winner.when(F.col(column) == best, topic)
    return df.withColumn("report", winner).withColumn("score", best).drop(*scores.values())
