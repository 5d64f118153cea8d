"""The records as Spark DDL."""

TASK = "id STRING, instruction STRING, start_url STRING, answer_patterns ARRAY<STRING>"
STEP = "index INT, role STRING, content STRING"
TRAJECTORY = f"source_task_id STRING, domain STRING, task STRUCT<id: STRING, instruction: STRING>, success BOOLEAN, reward DOUBLE, termination_reason STRING, steps ARRAY<STRUCT<index: INT, role: STRING, content: STRING>>, usage STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT>"
ROLLOUT = f"protocol STRING, status STRING, task_id STRING, split STRING, memory_bank STRING, retrieved_memory ARRAY<STRUCT<id: STRING, score: DOUBLE>>, trajectory STRUCT<{TRAJECTORY.replace(' STRING', ': STRING').replace(' BOOLEAN', ': BOOLEAN').replace(' DOUBLE', ': DOUBLE').replace(' STRUCT', ': STRUCT').replace(' ARRAY', ': ARRAY').replace('::', ':')}>, error STRING"
ENTRY = "id STRING, content STRING, scope STRING, confidence DOUBLE, status STRING, version INT, supersedes STRING, superseded_by STRING, source_task_id STRING, created_position INT"
SFT_EXAMPLE = "messages ARRAY<STRUCT<role: STRING, content: STRING>>, source_task_id STRING, source_steps ARRAY<INT>, label_type STRING, validation_status STRING"
MEMO = "key STRING, value STRING"
