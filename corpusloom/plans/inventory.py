"""Which query runs which operator of the survey, by its number there."""

from __future__ import annotations

#: The survey's numbers.
OPERATORS = {
    "token_counts": "S4 P1 P23",
    "registered_hosts": "S9",
    "admitted_documents": "P2 P17 J5 A5",
    "document_digests": "P3 P5 P6 P7",
    "normalized_code": "P4",
    "signals_in_documents": "P8 P9 P10",
    "licences": "P11 P12 P13 P14",
    "page_paths": "P15",
    "row_reasons": "P16 P18 P19 P24",
    "source_splits": "P20 P21",
    "code_families": "P22",
    "sanitized_diagnostics": "P25",
    "required_blocks": "P26",
    "fenced_code": "P26 P28",
    "action_calls": "P27",
    "hyphens_joined": "P29",
    "click_verdicts": "P30",
    "verified_scores": "P31 P32 P33",
    "process_failures": "P34",
    "credit_verdicts": "P35",
    "code_mutations": "P36 P49 P50",
    "code_inspections": "P37 P38",
    "static_contracts": "P39",
    "marker_counts": "P40",
    "addresses_found": "P41",
    "recovered_outcomes": "P42",
    "conversation_flags": "P43 V2 V3 V4 V5 V8",
    "ranked_sources": "P44 P45 T1",
    "source_categories": "P46 A6",
    "roofline": "P47",
    "rescored_rows": "P48",
    "assembled_rows": "P51",
    "task_documents": "P52",
    "scrubbed_documents": "C1 C3 C4",
    "scrubbed_longest_first": "C2",
    "canaries_found": "C5 C6 C7",
    "upload_gates": "C8",
    "preflight_checks": "C9",
    "rights_tables": "C10",
    "label_references": "J1 J11 U3",
    "labelled_documents": "J2",
    "stream_differences": "J3",
    "near_duplicate_links": "J4 W1",
    "corpus_policy": "J6 W2 W3",
    "sealed_bodies_found": "J7",
    "signal_locations": "J8",
    "planned_cells": "J9 W19",
    "headroom_subset": "J10 A23",
    "single_turn_rows": "J12 V6",
    "paired_outcomes": "J13 A14",
    "split_overlaps": "J14",
    "contaminated_training_rows": "J15",
    "split_leakage": "J16",
    "deduplicated_work": "J17",
    "reproduced_runs": "J18",
    "ladder_deltas": "J19",
    "repeated_signatures": "J20",
    "supervision_spans": "J21",
    "two_key_counts": "A1 A3",
    "corpus_policy_status": "A2",
    "source_yields": "A4",
    "readiness_gate": "A7",
    "exact_duplicate_groups": "A8",
    "conversation_audit": "V9",
    "trajectory_audit": "A9",
    "role_counts": "A10",
    "model_summaries": "A11 T6",
    "verified_speedups": "A11",
    "stage_fractions": "A12",
    "family_comparison": "A13",
    "paired_transitions": "A15",
    "rates_at_three_grains": "A16 A17",
    "seeds_compared": "A18 A19",
    "timing_stability": "A20",
    "median_speedups": "A21",
    "learning_curve": "A22",
    "lane_losses": "A24",
    "before_and_after": "A25",
    "run_logs": "A26",
    "verifier_confusion": "A27",
    "verdict_summary": "A28",
    "accuracy_by_tier": "A29",
    "arm_deltas": "A30",
    "commands_by_position": "A31",
    "event_names": "A32 T4",
    "repeated_lines": "A33",
    "unbalanced_families": "A34",
    "step_statistics": "A35",
    "last_event_per_user": "W4",
    "nested_subsets": "W5 W6 W7",
    "round_robin_shards": "W8",
    "collapsed_turns": "W9",
    "newest_messages": "W10",
    "conversation_prefixes": "W11",
    "group_advantages": "W12 W13",
    "flattened_by_table_function": "X8",
    "centered_advantages": "W14",
    "packed_pieces": "W15",
    "lane_balanced_order": "W16",
    "packed_sequences": "W17 U6",
    "saturation_stops": "W18",
    "refinement_rounds": "W20",
    "preferred_files": "T2",
    "selected_sessions": "T3",
    "few_shot_prompt": "T5 V11",
    "lane_faults": "U1",
    "united_releases": "U2",
    "unequal_task_sets": "U4",
    "upserted_rows": "U5",
    "markdown_sessions": "V1",
    "user_led_conversations": "V7",
    "metadata_slice": "V10",
    "pending_work": "X4",
    "repaired_texts": "X6 X7",
    "binary_elementwise": "M1",
    "unary_elementwise": "M2",
    "gated_units": "M3",
    "row_norms": "M4",
    "softmaxes": "M5",
    "row_reductions": "M6",
    "transposed": "M7",
    "matrix_product": "M8",
    "tolerant_equality": "M9",
    "generated_inputs": "M10",
    "strict_json_lines": "S1",
    "permissive_json_lines": "S2",
    "audited_json_lines": "S3",
    "json_array_records": "S5",
    "walked_text_files": "S6 S7",
    "archive_members": "S10",
    "ingested_trajectories": "S11",
    "conversation_lines": "S14",
    "written_artifacts": "S13 S17",
    "released_rows": "S18",
    "events_by_window": "X1",
    "enriched_stream": "X2",
    "first_documents_stream": "S9 X2",
    "appended_log": "X3",
}
#: Sources that need a service, or files that tables don't give: covered by tests, by the function's name.
FILES = {"sources.records": "S12 S16", "sources.paged": "S8 X5"}
