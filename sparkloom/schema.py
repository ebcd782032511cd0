"""Types, enumerations and thresholds of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGES = "array<struct<role:string,content:string>>"
EXAMPLES = f"id string, category string, messages {MESSAGES}, tools string, source string, group_id string, status string"
ACTIVITY = "id long, session_id string, ts timestamp, model_version string, state string, event string, data string, project string"
VIOLATION_TYPE = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("code", "level", "message", "location")]))
VIOLATIONS = "array<struct<code:string,level:string,message:string,location:string>>"

# Enumerations and thresholds that results depend on.
CATEGORIES = ("tool", "loop", "plan", "sec")
ROLES = ("system", "user", "assistant", "tool")
STATUSES = ("draft", "approved", "rejected")
PLAN_STATUSES = ("APPROVED", "NEEDS_REVISION", "REJECTED")
MAX_SEQ_LEN, VAL_RATIO, SHINGLE = 8192, 0.1, 5
NEAR_DUP, EVAL_OVERLAP = 0.85, 0.3
GIVE_UP_SHARE, PASS_WINDOW, MIN_PER_TYPE = 0.15, (0.35, 0.65), 3
REQUIRED_TYPES = ("sql_injection", "resource_leak", "insecure_deserialization", "owasp")
FEEDBACK_RATIO, FEEDBACK_THRESHOLD, SUCCESS_RATE, SESSION_LIMIT = 0.3, 150, 0.2, 500
TOKEN_EDGES = (512, 1024, 2048, 4096, 8192, 16384)
GATES = {
    "tool_syntax": (100.0, None), "anti_loop": (90.0, None), "security_catch": (85.0, None), "security_fp": (0.0, 10.0), "json_validity": (100.0, None),
    "plan_json": (100.0, None), "speed_8k": (30.0, None), "regression": (97.0, None), "end_to_end": (100.0, None),
}
RUN_TRANSITIONS = {"pending": ("running", "stopped"), "running": ("completed", "failed", "stopped"), "stopped": ("pending",), "failed": ("pending",), "completed": ()}
CASE_PRIORITY = {"loop": 4, "syntax": 3, "false_negative": 5, "false_positive": 3, "cancel": 2, "success": 1}
#: tool -> parameter -> (JSON type, required)
TOOLS = {
    "git_checkout": {"repo": ("string", True), "branch": ("string", True)},
    "read_file": {"path": ("string", True)},
    "write_file": {"path": ("string", True), "content": ("string", True)},
}
