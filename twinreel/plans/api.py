"""The whole analysis: media and samples in, groups, fates and report out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinreel.constants import tolerances
from twinreel.operators import coverage as cov
from twinreel.operators import blocks, decide, graph, hamming, ranking, report
from twinreel.operators.corroborate import corroborated
from twinreel.plans.storage import settle


@dataclass
class Result:
    matches: DataFrame
    groups: DataFrame
    members: DataFrame
    fates: DataFrame
    links: DataFrame
    detail: DataFrame
    report: DataFrame
    problems: DataFrame


def match_media(media: DataFrame, samples: DataFrame, distance: int = 4, percent: float = 20.0, min_duration: float = 0.0, route: str = "auto") -> DataFrame:
    """Pairs a < b that share enough, with the coverage and span of either side."""
    return _match(media, settle(samples, "samples"), distance, percent, min_duration, route)


def _match(media: DataFrame, samples: DataFrame, distance: int, percent: float, min_duration: float, route: str) -> DataFrame:
    if route == "auto":
        # Spark takes what tasks find for small: in a join with the media it would send all pairs to the driver
        return cov.seconds_gate(blocks.pairs(samples, media, distance, percent, timed=min_duration > 0), media, min_duration)
    # the samples are read five times, frames and marks twice
    frames = settle(hamming.frame_matches(samples, tolerances(distance)[1], route), "frames")
    marks = settle(corroborated(frames, distance), "marks")
    pairs = cov.percent_gate(cov.coverage(marks, samples, media), percent)
    return cov.seconds_gate(pairs, media, min_duration)


def grouped_matches(matches: DataFrame, groups: DataFrame) -> DataFrame:
    """Matches both of whose media are in groups: those of a component that was given up are dropped where they are read."""
    media = groups.select("media_id").distinct()
    media = graph.sent(media, media.count())
    kept = matches
    for side in ("a", "b"):
        kept = kept.join(media.withColumnRenamed("media_id", side), side, "left_semi")
    return kept.select(*matches.columns)


def find_duplicates(media: DataFrame, samples: DataFrame, distance: int = 4, percent: float = 20.0, min_duration: float = 0.0, priority: str = "length", route: str = "auto") -> Result:
    cov.check_knobs(distance, percent, min_duration)
    figures = ranking.with_figures(cov.runtime_filter(media, min_duration))
    samples = settle(samples.join(figures.select("media_id"), "media_id", "left_semi"), "samples")
    matches = settle(_match(figures, samples, distance, percent, min_duration, route), "matches")
    cliques = settle(graph.groups(matches), "cliques")
    groups = settle(graph.ordered_groups(cliques, figures), "groups")
    members = groups.join(figures, "media_id")
    fated = decide.fates(members, priority)
    linked = report.group_links(members, cov.links(grouped_matches(matches, groups)), figures)
    detail = report.described(members, linked, fated, samples)
    problems = cliques.where("problem IS NOT NULL").select(F.lit("clique_search").alias("category"), F.col("component").alias("seq"), F.col("problem").alias("detail"))
    return Result(matches, groups, members, fated, linked, detail, report.text_rows(detail), problems)
