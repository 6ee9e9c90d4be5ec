"""Schemas of the record layouts."""

from __future__ import annotations

STATE = "struct<vars:map<string,bigint>,pre:map<string,bigint>,loop_entry:map<string,bigint>,run:int,it:int>"
GROUPED = "group_id string, program string, rollouts array<string>"
FLAT = "group_id string, program string, response string"
REWARD = (
    "group_id string, rollout_index int, reward double, base double, shapley_credit double, overflow_penalty double, generated int, accepted int, overflow int, rejected int, "
    "invariants array<string>, survivors array<string>, batch_score double, filter_mode string, reward_variant string, credit_filter_order string, negative_sampler string, "
    "reward_mode string, scorable boolean, n_positives int, n_negatives int"
)
LEDGER = (
    "source_sha256 string, scorable boolean, function string, loop_count int, n_positive_states int, n_negative_traces int, n_negative_states int, seed int, runs_requested int, "
    "sampler_stats struct<relation:int,escape:int,range:int,capped:boolean>, coverage_schema_version int, error string"
)
SFT = "conversations array<struct<`from`:string,value:string>>, selection struct<source:string,cell:string>"
RL = "data_source string, prompt array<struct<content:string,role:string>>, ability string, reward_model struct<ground_truth:struct<raw_code:string>,style:string>, extra_info struct<file_id:string,curation:string>"
SAMPLE = (
    "schema_version int, sample_status string, sample_error string, suite string, case_id string, source_sha256 string, hidden_source_sha256 string, sampler struct<n_runs:int,seed:int>, "
    f"sampler_runtime_policy string, positives array<{STATE}>, negatives array<{STATE}>, negative_trace_groups array<array<int>>, negative_trace_families array<string>, stats string, sampling_seconds double"
)
#: Version that ledger rows must have to count.
COVERAGE_VERSION = 9
