"""Statuses, issues and priorities by ordered rules, each over columns of counts and flags.

A rule list is read from the top and the first rule that holds names the status; unknown conditions do not hold.
Labels and weights are fixed values that reports are read by.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .compare import band, score

Rules = Sequence[tuple[Column, str]]


def first_of_rules(rules: Rules, otherwise: str | None) -> Column:
    return F.coalesce(*(F.when(holds, F.lit(label)) for holds, label in rules), F.lit(otherwise).cast("string"))


def held(rules: Rules) -> Column:
    """Labels of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(holds, F.lit(label)) for holds, label in rules)))


def count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _unfinished() -> Column:
    return (count("zero_charge_versions") > 0) | (count("weak_runs") > 0) | (count("empty_runs") > 0) | (count("skipped_runs") > 0)


#: What to do about a status.
ACTIONS: Mapping[str, str] = {
    "legacy_duplicate_family": "retire_or_reclassify_legacy_family",
    "legacy_family_without_canonical_replacement": "review_family_classification",
    "legacy_duplicate_or_needs_reclassification": "review_family_classification",
    "missing_from_discovery": "authenticated_dragnet_search",
    "versions_present_but_no_charges": "inspect_source_pdf",
    "charged_but_unlinked_to_residential_schedules": "add_applicability_links_after_canonical_review",
    "charged_with_residual_parse_debt": "reparse_or_retire_residue",
    "charged_but_unbounded_history": "mine_bundle_page_spans",
    "imported_but_unbounded": "mine_bundle_page_spans",
    "downloaded_duplicate_candidates": "deduplicate_then_import_bundle",
    "downloaded_not_imported": "import_discovered_bundle",
    "bounded_but_zero_charge": "reparse_existing_bundle_spans",
    "bounded_but_partial": "audit_bundle_quality_and_reparse",
    "no_versions": "search_or_seed_family_versions",
    "missing_from_matrix_but_db_populated": "expand_coverage_scope",
    "out_of_scope_but_db_populated": "decide_if_matrix_should_expand",
    "out_of_scope_reference_family": "leave_out_of_matrix_or_add_secondary_inventory",
    "covered_but_needs_work": "inspect_source_pdf",
}


def action_for(status: Column) -> Column:
    """The action of a status, none for statuses that need none."""
    return first_of_rules([(status == s, a) for s, a in ACTIONS.items()], "none")


def storm_family_status(legacy: Column, replaced: Column) -> Column:
    """Status of a storm rider family. ``legacy``: its key is of the old form; ``replaced``: its canonical families have charges."""
    charged = count("charged_versions") > 0
    return first_of_rules(
        [
            (legacy & replaced, "legacy_duplicate_family"),
            (legacy, "legacy_family_without_canonical_replacement"),
            (~charged & (count("discoveries") == 0), "missing_from_discovery"),
            (~charged, "versions_present_but_no_charges"),
            (count("schedule_links") == 0, "charged_but_unlinked_to_residential_schedules"),
            (_unfinished(), "charged_with_residual_parse_debt"),
            ((count("documents") > 0) & (count("bounded_documents") == 0), "charged_but_unbounded_history"),
        ],
        "healthy_canonical_candidate",
    )


def compliance_bundle_status() -> Column:
    """How far the compliance filings of a family have come: found, downloaded, imported, bounded, charged."""
    downloaded, imported, bounded = count("downloads") > 0, count("documents") > 0, count("bounded_documents") > 0
    return first_of_rules(
        [
            (count("discoveries") == 0, "missing_from_discovery"),
            (downloaded & ~imported & (count("distinct_files") < count("downloads")), "downloaded_duplicate_candidates"),
            (downloaded & ~imported, "downloaded_not_imported"),
            (imported & ~bounded, "imported_but_unbounded"),
            (bounded & (count("charged_versions") == 0), "bounded_but_zero_charge"),
            ((count("charged_versions") > 0) & _unfinished(), "bounded_but_partial"),
        ],
        "healthy",
    )


def schedule_inventory_status(billing_class: Column, in_matrix: Column) -> Column:
    """Whether a family is tracked: by its class, versions, charges and place in the coverage matrix."""
    return first_of_rules(
        [
            (billing_class == "legacy_or_malformed_family", "legacy_duplicate_or_needs_reclassification"),
            (count("versions") == 0, "no_versions"),
            (count("charged_versions") == 0, "versions_present_but_no_charges"),
            (~in_matrix & (billing_class == "core_billing_schedule"), "missing_from_matrix_but_db_populated"),
            (~in_matrix & billing_class.isin("ev_or_pilot_schedule", "lighting_schedule"), "out_of_scope_but_db_populated"),
            (~in_matrix, "out_of_scope_reference_family"),
            (count("charges") > 0, "covered_and_populated"),
        ],
        "covered_but_needs_work",
    )


def redline_status(charged: Column, stored: Column, corrected: Column, has_clean: Column) -> tuple[Column, Column]:
    """(status, score) of a parsed source that is or was taken for a redline; ``has_clean``: a clean companion of the date is charged."""
    status = first_of_rules(
        [
            (corrected & charged & has_clean, "prefer_clean_companion_version"),
            (corrected & charged, "review_parsed_redline_version"),
            (corrected, "leave_redline_unparsed_or_find_clean_companion"),
            (stored, "refresh_stale_false_positive_fingerprint"),
        ],
        "likely_ok",
    )
    points = {"prefer_clean_companion_version": 95, "review_parsed_redline_version": 100, "leave_redline_unparsed_or_find_clean_companion": 30, "likely_ok": 0}
    value = F.when(charged, 70).otherwise(40)
    for name, n in points.items():
        value = F.when(status == name, n).otherwise(value)
    return status, value


def redline_lead_action(clues: Column) -> Column:
    """What to do with the redlines of a family that has ``clues`` documents with clues."""
    unpaired = count("unpaired_redlines") > 0
    return first_of_rules(
        [
            (unpaired & (clues > 0), "use_redline_clues_to_find_clean_companions"),
            (unpaired, "link_redlines_to_clean_companions"),
            ((clues > 0) & (count("anomalies") + count("gaps") > 0), "compare_redlines_against_clean_versions"),
            (count("confidence") >= 80, "redline_corroboration_only"),
        ],
        "monitor_redline_family",
    )


def redline_lead_priority() -> tuple[Column, Column, Column]:
    """(action, priority, band) of a family's redlines: clues weigh most, gaps and anomalies up to a cap."""
    clues = F.greatest(count("clue_documents"), count("actionable_clues"))
    action = redline_lead_action(clues)
    weights = clues * 20 + count("unpaired_redlines") * 15 + count("supersession_clues") * 8 + count("comparative_phrases") * 5
    capped = F.least(F.lit(20), count("gaps") * 2) + F.least(F.lit(15), count("anomalies"))
    bonus = F.when(action == "use_redline_clues_to_find_clean_companions", 20).when(action == "link_redlines_to_clean_companions", 10).otherwise(0)
    priority = weights + capped + bonus
    return action, priority, band(priority, 80, 35)


def rider_date_assessment(split_dates: Column, known_dates: Column, latest_delta: Column, prorated_delta: Column, best_date: Column, latest_date: Column, fixed_charge: Column) -> Column:
    """How the dates by which a bill splits a rider fit the effective dates on record."""
    split, near = F.size(split_dates) > 0, F.lit(0.25)
    return first_of_rules(
        [
            (split & (split_dates == known_dates), "bill_split_matches_db_effective_dates"),
            (split, "bill_split_not_in_db"),
            (F.abs(latest_delta) <= near, "latest_effective_date_matches_bill"),
            (F.abs(prorated_delta) + near < F.abs(latest_delta), "mid_bill_proration_improves_match"),
            (best_date != latest_date, "different_effective_date_fits_better"),
            (fixed_charge, "fixed_charge_needs_proration_review"),
        ],
        "needs_review",
    )


def lineage_issues(has_family: Column, provisional: Column, has_start: Column, versions: Column, quality: Column, charges: Column, provenance_gaps: Column, found_by: Column) -> tuple[Column, Column]:
    """(blocking, warning) issues of a document. ``quality`` is that of its latest run, null without one; ``found_by`` is
    hash, path or null."""
    linked = versions > 0
    blocking = held(
        [
            (~has_family, "missing_tariff_family"),
            (~has_start, "missing_effective_start"),
            (~linked, "missing_version_link"),
            (linked & quality.isNull(), "not_processed"),
            (linked & (quality != "skipped") & (charges == 0), "linked_without_charges"),
        ]
    )
    warning = held(
        [
            (has_family & provisional, "provisional_family"),
            (linked & (provenance_gaps > 0), "version_provenance_gap"),
            (found_by.isNull(), "missing_discovery_match"),
            (found_by == "path", "path_only_discovery_link"),
        ]
    )
    return blocking, warning


def lineage_class(blocking: Column, warning: Column) -> Column:
    return first_of_rules([(F.size(blocking) > 0, "blocking"), (F.size(warning) > 0, "warning_only")], "clean")


def staleness(versions: Mapping[str, str], scanned: Column, has_start: Column) -> tuple[Column, Column]:
    """(reasons, priority): stages of a document whose artifact is missing or of another version than ``versions`` says.

    Columns page_version, ocr_version, normalization_version, span_version and parser_version hold what there is. Scan
    versions count for ``scanned`` documents. A document without a start that only misses artifacts has no reasons.
    """
    got = lambda k: F.col(f"{k}_version")
    other = lambda k: got(k) != versions[k]
    page = got("page").isNotNull()
    reasons = held(
        [
            (~page, "page_artifact_missing"),
            (other("page"), "page_artifact_version"),
            (page & scanned & ~got("ocr").eqNullSafe(F.lit(versions["ocr"])), "ocr_backend_version"),
            (page & scanned & ~got("normalization").eqNullSafe(F.lit(versions["normalization"])), "ocr_normalization_version"),
            (got("span").isNull(), "span_artifact_missing"),
            (other("span"), "span_artifact_version"),
            (got("parser").isNull(), "parser_run_missing"),
            (other("parser"), "parser_version"),
        ]
    )
    only_missing = F.size(F.array_except(reasons, F.array(*map(F.lit, ("page_artifact_missing", "span_artifact_missing", "parser_run_missing"))))) == 0
    reasons = F.when(only_missing & ~has_start, F.array().cast("array<string>")).otherwise(reasons)
    has = lambda *names: F.arrays_overlap(reasons, F.array(*map(F.lit, names)))
    priority = (
        F.when(has("ocr_backend_version"), 95).when(has("ocr_normalization_version"), 92).when(has("parser_version"), 90)
        .when(has("page_artifact_missing", "span_artifact_missing"), 85).otherwise(60)
    )
    return reasons, F.when(F.size(reasons) > 0, priority)


#: Priority of each way in which a parser profile touches a document.
IMPACT = {"candidate_reason": 93, "candidate_profile": 91, "latest_parser_profile": 90, "family_key": 88, "signal_match": 87, "family_prefix": 85}


def profile_impact(reasons: Column) -> Column:
    """Priority of the strongest reason, 82 for reasons of other kinds, null without any."""
    out = F.lit(82)
    for name, value in reversed(IMPACT.items()):
        out = F.when(F.array_contains(reasons, name), value).otherwise(out)
    return F.when(F.size(reasons) > 0, out)


#: Weight of each kind of work in the queue.
QUEUE_WEIGHTS = {"empty_parse": 500, "ocr_needed": 450, "stale_stage": 400, "profile_impact": 300, "strong_but_unlinked": 200, "needs_review": 150, "other": 100}


def reprocess_priority(reason: Column, quality: Column, attempt: Column, no_charges: Column, stale_ocr: Column, ocr_status: Column, linked: Column, priority: Column, has_start: Column) -> tuple[Column, Column]:
    """(category, rank score) of a row in the queue."""
    kind = F.element_at(F.split(reason, ":"), 1)
    category = first_of_rules(
        [
            ((quality == "empty") | (attempt == "empty"), "empty_parse"),
            (no_charges, "empty_parse"),
            (stale_ocr, "ocr_needed"),
            (ocr_status.isin("pending", "running"), "ocr_needed"),
            (kind == "stale_stage", "stale_stage"),
            (kind == "profile_dependency", "profile_impact"),
            ((quality == "strong") & ~linked, "strong_but_unlinked"),
            (kind == "needs_review", "needs_review"),
        ],
        "other",
    )
    weight = F.lit(0)
    for name, value in QUEUE_WEIGHTS.items():
        weight = F.when(category == name, value).otherwise(weight)
    return category, weight + F.coalesce(priority, F.lit(0)) + score((has_start, 15), (quality == "strong", 10), (ocr_status == "pending", 5)).cast("int")


def is_host(hosts: Column, own: Sequence[str]) -> Column:
    """Whether a host is one of ``own`` or ends with one."""
    out = F.lit(False)
    for name in own:
        out = out | F.lower(hosts).endswith(name)
    return out


def url_score(host: Column, filename: Column, downloadable: Column, status: Column, snapshots: Column, heuristic: Column, own: Sequence[str]) -> Column:
    """Points of a candidate address: own host, file name, whether it can be fetched, archived snapshots."""
    archived = F.when(snapshots > 0, F.least(F.lit(25), 5 + snapshots * 2)).otherwise(0)
    tried = F.when(downloadable, 40).when(status.isin(301, 302, 403, 404), 5).otherwise(0)
    return score((is_host(host, own), 40), (filename.endswith(".pdf"), 10), (heuristic.isNotNull(), 5)) + archived + tried


def docket_score(docket: Column, tariff_text: Column, clue_only: Column, proceeding: Column, referenced: Column) -> Column:
    return score((docket.isNotNull(), 25), (tariff_text, 30), (~clue_only, 20), (proceeding.isNotNull(), 10), (referenced > 0, 12))


#: Points of where a lead comes from.
PROVENANCE = {"utility": 15, "regulator": 14, "archive": 10, "reference": 5, "external": 4}


def lead_score(url: Column, host: Column, filename: Column, leaf: Column, target_leaf: Column, code: Column, rider: Column, target: Column, start: Column, docket: Column, provenance: Column, own: Sequence[str], archives: Sequence[str], regulators: Sequence[str]) -> Column:
    """Points of a historical lead: its host, what it names, what of that is looked for, where it comes from."""
    place = (
        F.when(is_host(host, own), 45).when(is_host(host, archives), 35).when(is_host(host, regulators), 40)
        .when(url.isNotNull() & (url != ""), 20).otherwise(0)
    )
    origin = F.lit(0)
    for name, points in PROVENANCE.items():
        origin = F.when(provenance == name, points).otherwise(origin)
    named = score(
        (filename != "", 12), (F.contains(leaf, target_leaf), 20), (F.upper(code) == F.upper(target), 18), (F.upper(rider) == F.upper(target), 18),
        (start.isNotNull(), 10), (docket.isNotNull(), 8),
    )
    return named + place + origin


Signal = tuple[str, float, bool]


def search_score(title: Column, snippet: Column, url: Column, signals: Sequence[Signal], combos: Sequence[tuple[Sequence[str], float]], codes_found: Column, target_hit: Column, found_by: Column, usefulness: Column, title_weight: float = 2.5, snippet_weight: float = 1.0, url_weight: float = 0.3, docket: Column | None = None, docket_prefix: str = "E-2") -> Column:
    """Points of a search result, not below zero.

    A signal (pattern, weight, whether it is looked for in addresses) counts at the first of title, snippet and address
    that has it, with that field's weight. Combinations need all their patterns in title and snippet. ``target_hit`` is
    null without a code looked for.
    """
    both = F.concat_ws(" ", title, snippet)
    total = F.lit(0.0)
    for pattern, weight, in_url in signals:
        hit = lambda c, p=pattern: F.coalesce(c.rlike(f"(?i){p}"), F.lit(False))
        at = F.when(hit(title), title_weight).when(hit(snippet), snippet_weight)
        total = total + weight * (at.when(hit(url), url_weight) if in_url else at).otherwise(0.0)
    for patterns, bonus in combos:
        every = F.lit(True)
        for p in patterns:
            every = every & both.rlike(f"(?i){p}")
        total = total + score((every, bonus))
    total = total + F.least(F.lit(2.0), codes_found * 0.5) + F.when(target_hit, 4.0).when(~target_hit, -6.0).otherwise(0.0)
    total = total + F.when(url.rlike(r"(?i)\.pdf(?:$|\?)"), 1.5).when(url.rlike(r"(?i)\.html?(?:$|\?)"), -1.5).otherwise(0.0)
    if docket is not None:
        total = total + score((docket.startswith(docket_prefix), 1.5))
    total = total + F.when(found_by > 1, F.least(F.lit(3.0), (found_by - 1) * 0.8)).otherwise(0.0)
    total = total + F.when(usefulness > 0, F.least(F.lit(2.0), usefulness * 0.3)).otherwise(0.0)
    return F.greatest(F.lit(0.0), total)
