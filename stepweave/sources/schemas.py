"""Schemas of the logical tables."""

from __future__ import annotations

# Fixed value: the tag of the sparse shard format.
SPARSE_FORMAT = "token_topk_sparse_v1"

PROMPTS = "episode_num int, task_id int, task_episode_idx int, task_description string, prompt_task_description string, initial_state_sha256 string"
TRAJECTORY = "episode_num int, task_id int, task_episode_idx int, task_description string, step_in_episode int, eef_pos array<double>, eef_quat array<double>, gripper_qpos array<double>, gripper_action double, done boolean"
ACTIVATION_INDEX = "layer_idx int, row_start int, row_end int, episode_num int, step_in_episode int, task_id int, task_episode_idx int, global_forward_idx int, shard_path string"
TOPK = "episode_num long, step_in_episode long, global_forward_idx long, batch_idx long, token_idx long, chunk_start_step long, executed_chunk_len long, top_feature_ids array<int>, top_feature_vals array<float>"
EVENT_FEATURES = "sample_id string, task_id int, task_description string, episode_num int, task_episode_idx int, waypoint_rank int, waypoint_step int, vision_embedding array<float>, state_vector array<float>, progress_percent double, num_steps int"
WAYPOINT_SUMMARY = "source_trajectory_records_path string, episodes array<struct<episode_num: int, task_id: int, task_episode_idx: int, task_description: string, success: boolean, num_steps: int, waypoint_indices: array<int>>>"
MANIFEST = "format string, shards array<struct<path: string, num_rows: long, row_start: long>>"
