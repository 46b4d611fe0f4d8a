"""The analysis as one plan: raw spans in, every derived table out."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame

from spanlake.operators import aggregates, baseline, clock, detect, incidents, reassembly
from spanlake.operators.dedup import latest_version
from spanlake.operators.windows import window_spine, with_window
from spanlake.schemas import (
    BASELINE_LOOKBACK_SECONDS,
    BASELINE_MIN_SAMPLES,
    GROUPING_LOOKBACK_SECONDS,
    KEYS,
    ROOT_SERVICE,
    WINDOW_SECONDS,
)
from spanlake.session import checkpoint, write_scratch
from spanlake.sources.layout import Layout, span_days


class Analysis:
    """All windows of a span table, each derived table written once when first used.

    The tables live in the shared folder (as the derived tables of a running
    system do), so later steps scan columns of a file instead of redoing the
    steps before them.
    """

    def __init__(
        self,
        raw: DataFrame,
        window_seconds: int = WINDOW_SECONDS,
        lookback_seconds: int = BASELINE_LOOKBACK_SECONDS,
        min_samples: int = BASELINE_MIN_SAMPLES,
        grouping_seconds: int = GROUPING_LOOKBACK_SECONDS,
        root_service: str = ROOT_SERVICE,
    ):
        self.raw = raw
        self.window_seconds = window_seconds
        self.lookback_seconds = lookback_seconds
        self.min_samples = min_samples
        self.grouping_seconds = grouping_seconds
        self.root_service = root_service

    @cached_property
    def layout(self) -> Layout:
        return Layout.of(self.raw)

    @cached_property
    def spans(self) -> DataFrame:
        """Newest version of every span, with its window, by trace and day.

        Dealt by trace this is the only time that spans move: copies of a span meet in
        the bucket, and the tables up to the summaries stay in theirs.
        """
        newest = latest_version(self.layout.dealt(self.raw), KEYS["spans"], "ingested_at_unix_nano")
        days = span_days()
        return self.layout.write(with_window(newest, self.window_seconds).withColumns(days), "spans", list(days))

    @cached_property
    def spine(self) -> DataFrame:
        return write_scratch(window_spine(self.spans, self.window_seconds), "spine")

    @cached_property
    def links(self) -> DataFrame:
        """Non-root spans with their parents; one join serves pairs and reassembly."""
        return self.layout.write(reassembly.parent_links(self.spans), "links")

    @property
    def any_pairs(self) -> DataFrame:
        """Pairs within a trace."""
        return reassembly.pairs_of_links(self.links)

    @property
    def pairs(self) -> DataFrame:
        """Pairs within a window."""
        return self.any_pairs.filter("window_start = parent_window_start").drop("parent_window_start")

    @cached_property
    def seeds(self) -> DataFrame:
        keep = (lambda df: self.layout.write(df, "doubled")) if self.layout.buckets else checkpoint
        return self.layout.write(reassembly.span_seeds(self.spans, self.links, keep), "seeds")

    @cached_property
    def summaries(self) -> DataFrame:
        return self.layout.write(reassembly.summarize(self.seeds), "trace_summaries")

    @property
    def classifications(self) -> DataFrame:
        return reassembly.classify(self.seeds)

    @cached_property
    def stats(self) -> DataFrame:
        return write_scratch(aggregates.window_stats(self.spans, self.pairs), "window_stats")

    @property
    def service_stats(self) -> DataFrame:
        return aggregates.as_service_stats(self.stats)

    @property
    def service_edges(self) -> DataFrame:
        return aggregates.as_service_edges(self.stats)

    @cached_property
    def gaps(self) -> DataFrame:
        return write_scratch(clock.edge_gap_medians(self.pairs), "edge_gaps")

    @cached_property
    def offsets(self) -> DataFrame:
        return write_scratch(clock.offsets_from_gaps(self.gaps, self.root_service), "offsets")

    @cached_property
    def baselines(self) -> DataFrame:
        table = baseline.baselines(
            self.spans,
            self.any_pairs,
            self.stats,
            self.spine,
            self.window_seconds,
            self.lookback_seconds,
            self.min_samples,
        )
        return write_scratch(table, "baselines")

    @cached_property
    def detections(self) -> DataFrame:
        return write_scratch(detect.run_detection(self.stats, self.baselines), "detections")

    @cached_property
    def grouped(self) -> DataFrame:
        return write_scratch(incidents.group_detections(self.detections, self.window_seconds), "grouped")

    @cached_property
    def incidents(self) -> DataFrame:
        """Incidents over the whole time (``global`` mode)."""
        return write_scratch(incidents.suppress_propagated(self.grouped, self.service_edges), "incidents")

    @cached_property
    def rolling(self) -> DataFrame:
        """What each window's trailing regroup saw (``rolling`` mode), by as_of."""
        rolled = incidents.rolling_incidents(
            self.detections, self.service_edges, self.spine, self.window_seconds, self.grouping_seconds
        )
        return write_scratch(rolled, "rolling")

    SHARED = ("spans", "spine", "links")
    # After the shared tables these lines do not depend on each other.
    BRANCHES = (
        ("stats", "baselines", "detections", "grouped", "incidents", "rolling"),
        ("seeds", "summaries"),
        ("gaps", "offsets"),
    )

    def run(self) -> None:
        """Produce every derived table, independent ones at the same time."""
        for name in self.SHARED:
            getattr(self, name)
        with ThreadPoolExecutor(len(self.BRANCHES)) as pool:
            done = [pool.submit(lambda names=names: [getattr(self, n) for n in names]) for names in self.BRANCHES]
            for branch in done:
                branch.result()
