"""Nested types of trajectories, segments, samples and their derivatives, and the enums over them.

Types are DDL text, which every reader and function takes and which needs no session.
"""

from __future__ import annotations

TOOL_CALL = "struct<function: struct<name: string, arguments: string>>"
MESSAGE = f"struct<role: string, content: string, tool_calls: array<{TOOL_CALL}>>"
TRAJECTORY = f"trajectory_id string, repo string, resolved int, trajectory array<{MESSAGE}>"

SEGMENT_FIELDS = "seg_id string, role string, kind string, content string, tokens int, file_path string, is_current_turn boolean, turn_idx int"
SEGMENT = "struct<" + SEGMENT_FIELDS.replace(" string", ": string").replace(" int", ": int").replace(" boolean", ": boolean") + ">"
TARGET = "struct<type: string, name: string, args: string, content: string>"
SAMPLE = (
    f"sample_id string, trajectory_id string, turn_idx int, decision_idx int, repo string, resolved boolean, input_segments array<{SEGMENT}>, target_action {TARGET}, total_input_tokens int"
)
SPAN = "struct<start: int, end: int, kind: string, text: string>"
SFT_METADATA = (
    "struct<sample_id: string, trajectory_id: string, repo: string, resolved: boolean, compression_budget: int, original_tokens: int, n_segments: int,"
    " n_must_keep: int, n_stale: int, was_truncated: boolean, target_action_name: string, length_bucket: string>"
)
SFT = f"messages array<struct<role: string, content: string>>, metadata {SFT_METADATA}"
POOL = (
    "entry_id string, sample_id string, seg_id string, kind string, level string, repo string, user_intent string, original string,"
    " seg_original_chars int, sample_budget_tokens int, sample_original_tokens int"
)
COMPRESSED = POOL + ", compressed string, dropped boolean, compressed_chars int, ratio double, finish_reason string, error string, raw_compressed string"
BATCH_RESULT = (
    "custom_id string, response struct<status_code: int, body: struct<choices: array<struct<message: struct<content: string>, finish_reason: string>>, usage: struct<completion_tokens: int>>>"
)
USAGE = (
    "seq bigint, model string, status int, content_orig bigint, content_comp bigint, tools_orig bigint, tools_comp bigint, skipped bigint, skip_reason string, expanded bigint"
)
BLOCK = "request_id string, msg_idx int, block_idx int, role string, block_type string, tool_use_id string, tool_name string, tool_input string, text string"

# Kinds of segments, retention levels and the groups that rules name.
PROTECTED_KINDS = ("system_prompt", "user_turn_current", "user_turn_history")
RESULT_KINDS = ("tool_result", "log_output", "file_read")
ACTION_KINDS = ("file_operation", "bash_command", "tool_call")
KINDS = (*PROTECTED_KINDS, "assistant_thinking", "meta_action", *ACTION_KINDS, *RESULT_KINDS, "file_edit_confirm", "directory_listing")
LEVELS = ("L0", "L1", "L2", "L3")
REAL_ACTIONS = ("str_replace_editor", "execute_bash", "Read", "Edit", "Write", "Bash", "Grep", "Glob", "MultiEdit")
