"""One scan from landed replies to a new table version, as one set of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.places import DEFAULT_PRIORITY, Gazetteer
from ..operators import enrich, ledger, lifecycle, merge
from ..operators.filters import KeywordPolicy
from ..schema import NEW_COLS, SCAN_RUN
from ..sources.policy import fresh_only, within_window
from ..sources.registry import REGISTRY, failed_sources, read_sources, skipped_replies, source_status
from ..sources.search_apis import reed_detail
from ..session import cut_lineage
from .snapshot import SnapshotTable


@dataclass(frozen=True)
class Window:
    """How far back a source looks: in days or in hours, by its own configuration."""

    max_days: int | None = None
    max_hours: int | None = None


@dataclass(frozen=True)
class ScanPolicy:
    gazetteer: Gazetteer
    keywords: KeywordPolicy = KeywordPolicy()
    expire_after_hours: int = 24
    priority: tuple[str, ...] = DEFAULT_PRIORITY
    enabled: tuple[str, ...] | None = None
    windows: dict[str, Window] = field(default_factory=dict)
    recent_days: int | None = None
    fetch_full_text: bool = True
    registry: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=lambda: REGISTRY)


@dataclass(frozen=True)
class ScanResult:
    """`rows` is the open part of the table after the scan (None for a dry run). `skipped`: replies that were no use
    and did not fail their source (closed boards, missing details, tenants that did not answer), with why."""

    rows: DataFrame | None
    new_rows: DataFrame
    counts: DataFrame
    errors: DataFrame
    totals: DataFrame
    skipped: DataFrame | None = None


def sightings_of(payloads: DataFrame, policy: ScanPolicy, scan_ts: datetime, status: DataFrame, *,
                 only: str | None = None, deep: bool = False) -> DataFrame:
    """Sightings of the sources that did not fail by `status`, within each source's window."""
    def windowed(name, adapter):
        window = policy.windows.get(name)
        if window is None:
            return adapter
        hours = within_window(window.max_days, window.max_hours, policy.recent_days, deep)
        day = F.coalesce(F.col("posted_at").cast("timestamp"), F.lit(scan_ts))
        start = F.date_trunc("day", F.lit(scan_ts))
        return lambda p: fresh_only(adapter(p), day, start, hours)

    registry = {name: windowed(name, adapter) for name, adapter in policy.registry.items()}
    rows = read_sources(payloads, policy.enabled, only, registry)
    live = status.filter(F.col("failed") == 0).select("source", "fetched_at")
    return rows.join(live, ["source", "fetched_at"], "left_semi")


def run_scan(
    open_rows: DataFrame, payloads: DataFrame, policy: ScanPolicy, scan_ts: datetime, *,
    only: str | None = None, deep: bool = False, dry_run: bool = False,
) -> ScanResult:
    """Merge the replies of one scan into the open rows, enrich snippets, expire what is gone.

    The sightings and the merged table are each written once to the shared folder, because the
    counters read them again; nothing is collected.
    """
    # A row per source, judged once: every later step reads this.
    status = cut_lineage(source_status(payloads), "status")
    seen = merge.with_identity(
        sightings_of(payloads, policy, scan_ts, status, only=only, deep=deep), policy.gazetteer)
    seen = cut_lineage(seen, "sightings")
    kept = seen.filter(policy.keywords.keeps())
    errors = failed_sources(status)

    if dry_run:
        new = merge.first_per_key(kept, content=NEW_COLS).select("first.*")
        counts = ledger.scan_counts(seen, policy.keywords.keeps(), new)
        return ScanResult(None, new.select(*NEW_COLS, *[c for c in new.columns if c not in NEW_COLS and c != "change"]), counts, errors, ledger.scan_totals(counts), skipped_replies(payloads))

    hours = policy.expire_after_hours
    merged = cut_lineage(
        merge.merge_scan(open_rows, kept, scan_ts, hours, policy.priority), "merged")
    new = merged.filter(F.col("change") == "new")
    counts = ledger.scan_counts(seen, policy.keywords.keeps(), new)
    rows = merged.drop("change")
    if policy.fetch_full_text:
        listing = F.try_variant_get("raw", "$.jobId", "string")
        rows = enrich.enrich_detail(
            rows, reed_detail(payloads), listing)
    live = status.filter(F.col("failed") == 0).select("source", "fetched_at")
    if only is not None:
        live = live.filter(F.col("source") == only)
    elif policy.enabled is not None:
        live = live.filter(F.col("source").isin(*policy.enabled))
    rows = lifecycle.expire_stale(rows, live, scan_ts, hours)
    return ScanResult(rows, new.select(*NEW_COLS, *[c for c in new.columns if c not in NEW_COLS and c != "change"]), counts, errors, ledger.scan_totals(counts), skipped_replies(payloads))


def ledger_rows(result: ScanResult, scan_ts: datetime, run_id: str) -> DataFrame:
    """The scan's ledger: one row per source that came through, one per source that failed."""
    good = result.counts.withColumns({"errors": F.lit(0), "error_detail": F.lit("")})
    rows = good.unionByName(result.errors.select(*good.columns))
    rows = rows.withColumns({
        "run_id": F.concat(F.lit(f"{run_id}-"), "source"), "started_at": F.lit(scan_ts),
        "finished_at": F.lit(scan_ts)})
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCAN_RUN.fields])


def scan_into(table: SnapshotTable, payloads: DataFrame, policy: ScanPolicy, scan_ts: datetime, *,
              ledger_path: str, run_id: str, **kwargs) -> ScanResult:
    """`run_scan` on a stored table: new version, ledger rows, result. A finished run is not redone."""
    if table.has(run_id):
        raise ValueError(f"run {run_id} is already merged")
    result = run_scan(table.read_open(), payloads, policy, scan_ts, **kwargs)
    if result.rows is not None:
        table.commit_scan(result.rows, scan_ts, policy.expire_after_hours, run_id)
        ledger.append(ledger_rows(result, scan_ts, run_id), ledger_path)
    return result
