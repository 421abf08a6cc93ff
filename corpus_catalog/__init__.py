"""Catalog of large corpora of source trees, built from DataFrame operators.

Every operator takes and returns DataFrames keyed by ``(repo, path)``.
"""

from corpus_catalog.operators.cache import (
    CacheKey,
    cost_estimate,
    evict_deleted,
    latest,
    lookup,
    prompt_requests,
    purge,
    stats,
    status,
    upsert,
)
from corpus_catalog.operators.diff import builds, change_counts, diff, diff_status, hashes
from corpus_catalog.operators.digest import corpus_fingerprint, listing_hash, scan_hash, scan_hash_of
from corpus_catalog.operators.document import documents, documents_json, token_budget
from corpus_catalog.operators.inventory import candidates, preview, scan, scan_modes
from corpus_catalog.operators.rank import key_files, other_files, scored
from corpus_catalog.operators.reports import change_report, changed_summaries
from corpus_catalog.operators.summarize import gate, redacted_text, summarize, symbols
from corpus_catalog.operators.tree import directory_counts, directory_tree
from corpus_catalog.plans.build import Build, build, context_documents, fill
from corpus_catalog.sources.rules import (
    ignore_rules,
    rule_warnings,
    rules_by_repo,
    submodule_markers,
    submodule_names,
)
from corpus_catalog.sources.cache_table import CacheTable
from corpus_catalog.sources.tables import read_snapshot, write_documents, write_snapshot
from corpus_catalog.sources.tree_source import read_trees
from corpus_catalog.streaming.watch import Watch, drop_redelivered, drop_superseded, read_settings, read_versions

__all__ = [
    "Build",
    "CacheKey",
    "CacheTable",
    "Watch",
    "build",
    "builds",
    "candidates",
    "change_counts",
    "change_report",
    "changed_summaries",
    "context_documents",
    "corpus_fingerprint",
    "cost_estimate",
    "diff",
    "diff_status",
    "directory_counts",
    "directory_tree",
    "documents",
    "documents_json",
    "drop_redelivered",
    "drop_superseded",
    "evict_deleted",
    "fill",
    "gate",
    "hashes",
    "ignore_rules",
    "key_files",
    "latest",
    "listing_hash",
    "lookup",
    "other_files",
    "preview",
    "prompt_requests",
    "purge",
    "read_settings",
    "read_snapshot",
    "read_trees",
    "read_versions",
    "redacted_text",
    "rule_warnings",
    "rules_by_repo",
    "scan",
    "scan_hash",
    "scan_hash_of",
    "scan_modes",
    "scored",
    "stats",
    "status",
    "submodule_markers",
    "submodule_names",
    "summarize",
    "symbols",
    "token_budget",
    "upsert",
    "write_documents",
    "write_snapshot",
]
