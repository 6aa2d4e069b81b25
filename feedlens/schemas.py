"""Record shapes and the fixed values that must equal the service's for right results."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the original service's; stated plainly, in order)
# ---------------------------------------------------------------------------
LANGUAGES = ("en", "es", "fr", "de", "other")
PII_TYPES = ("email", "phone", "ssn", "credit_card", "name", "address")
PERSONAS = ("executive", "technical", "business_user", "procurement")
STEPS = ("ingest", "extract", "self_check", "rewrite")
PROVIDERS = ("openai", "anthropic", "google")

DEFAULT_SOURCE = "manual"
DEFAULT_PROVIDER = "google"
DEFAULT_MODEL = "gemini-2.5-flash-lite"
DEFAULT_TEMPERATURE = 0.7
DEFAULT_MAX_TOKENS = 2000
DEFAULT_TIMEOUT_SECONDS = 30
DEFAULT_PERSONA = "executive"
MIN_CONTENT_CHARS = 10
MAX_HEADLINE_CHARS = 200
MIN_TALKING_POINTS = 3
MAX_TALKING_POINTS = 5

CACHE_KEY_PREFIX = "workflow:result:"
CACHE_TTL_SECONDS = 3600

RATE_LIMIT_REQUESTS = 10
RATE_LIMIT_WINDOW_SECONDS = 60

MAX_ATTEMPTS = 2
RETRY_WAIT_BASE, RETRY_WAIT_LEAST, RETRY_WAIT_MOST = 2, 4, 30  # seconds
NON_RETRYABLE_ERRORS = ("ValueError", "TypeError", "KeyError")

ALARM_THRESHOLD = 5
ALARM_PERIOD_SECONDS = 300
ALARM_EVALUATION_PERIODS = 2

TOKEN_ESTIMATE_FACTOR = 1.3

# USD per 1M tokens (input, output): provider, model, price_in, price_out
PRICE_ROWS = [
    ("openai", "gpt-4o-mini", 0.15, 0.60),
    ("openai", "gpt-4o", 2.50, 10.00),
    ("anthropic", "claude-sonnet-4-5", 3.0, 15.0),
    ("google", "gemini-2.5-flash", 0.075, 0.3),
    ("google", "gemini-2.5-flash-lite", 0.0375, 0.15),
    ("google", "gemini-2.5-pro", 1.25, 5.0),
]
# price used when the model is not listed: provider, price_in, price_out
DEFAULT_PRICE_ROWS = [
    ("openai", 2.50, 10.0),
    ("anthropic", 3.0, 15.0),
    ("google", 0.5, 1.5),
]

# repair texts
TEXT_NOT_SPECIFIED_ITEM = "Not specified in input"
TEXT_PROBLEM_MISSING = "Customer problem not clearly specified"
TEXT_OUTCOME_MISSING = "Desired outcome not specified"
TEXT_SELF_CHECK_REJECTED = "Self-check did not approve extraction"
TEXT_TALKING_POINT_PAD = "Additional value point "
VALUE_PROP_REQUIRED_FIELDS = ("headline", "problem", "solution", "differentiation", "call_to_action")
DEFAULT_CONFIDENCE = 0.5
DEFAULT_ACCURACY = 0.5
DEFAULT_RISK = 0.5

# placeholders of a failed run
ERROR_VALUE_PROP = {
    "headline": "Workflow execution failed",
    "problem": "An error occurred during workflow execution",
    "solution": "Please check logs and try again",
    "differentiation": "N/A",
    "call_to_action": "Review error message and retry",
    "key_talking_points": [
        "Workflow execution encountered an error",
        "Check API keys and configuration",
        "Review logs for detailed error information",
    ],
}
ERROR_ITEM = "Error"

# metric buckets (upper bounds; +Inf is added by the histogram builder)
DURATION_BUCKETS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0]
COST_BUCKETS = [0.0001, 0.001, 0.01, 0.1, 1.0, 10.0]
STEP_DURATION_BUCKETS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0]
RISK_BUCKETS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]

# metrics: name to (type, help); names and types must equal the service's, the texts are ours
METRICS = {
    "workflow_executions_total": ("counter", "Runs by provider, model and outcome"),
    "workflow_duration_seconds": ("histogram", "Run time in seconds"),
    "workflow_cost_usd": ("histogram", "Run cost in US dollars"),
    "tokens_consumed_total": ("counter", "Tokens by provider, model and direction"),
    "agent_step_duration_seconds": ("histogram", "Step time in seconds"),
    "agent_step_failures_total": ("counter", "Failed steps by step and provider"),
    "hallucination_risk_score": ("histogram", "Risk scores given by the self-check"),
    "self_check_rejections_total": ("counter", "Rejections by reason"),
    "active_workflows": ("gauge", "Runs under way in the last period"),
}

# log event names
EV_STARTED = "workflow_execution_started"
EV_COMPLETED = "workflow_execution_completed"
EV_FAILED = "workflow_execution_failed"
EV_CACHE_HIT = "cache_hit"
EV_CACHE_MISS = "cache_miss"

# ---------------------------------------------------------------------------
# Struct types
# ---------------------------------------------------------------------------
FEEDBACK = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

PII_DETECTION = T.StructType([
    T.StructField("pii_type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("location", T.StructType([
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ])),
])

INGEST_RESPONSE = T.StructType([
    T.StructField("language", T.StringType()),
    T.StructField("pii_detected", T.BooleanType()),
    T.StructField("redacted_text", T.StringType()),
    T.StructField("word_count", T.LongType()),
    T.StructField("input_quality", T.StringType()),
])

EXTRACTED = T.StructType([
    T.StructField("problem_statement", T.StringType()),
    T.StructField("current_solution", T.StringType()),
    T.StructField("desired_outcome", T.StringType()),
    T.StructField("pain_points", T.ArrayType(T.StringType())),
    T.StructField("value_drivers", T.ArrayType(T.StringType())),
    T.StructField("stakeholders", T.ArrayType(T.StringType())),
    T.StructField("timeline", T.StringType()),
    T.StructField("budget_signals", T.StringType()),
    T.StructField("confidence_score", T.DoubleType()),
])

CLAIM = T.StructType([
    T.StructField("claim", T.StringType()),
    T.StructField("supported_by_input", T.BooleanType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

SELF_CHECK = T.StructType([
    T.StructField("verifications", T.ArrayType(CLAIM)),
    T.StructField("overall_accuracy", T.DoubleType()),
    T.StructField("hallucination_risk", T.DoubleType()),
    T.StructField("approved", T.BooleanType()),
    T.StructField("rejection_reason", T.StringType()),
])

VALUE_PROP = T.StructType([
    T.StructField("headline", T.StringType()),
    T.StructField("problem", T.StringType()),
    T.StructField("solution", T.StringType()),
    T.StructField("differentiation", T.StringType()),
    T.StructField("quantified_value", T.StringType()),
    T.StructField("call_to_action", T.StringType()),
    T.StructField("persona", T.StringType()),
    T.StructField("key_talking_points", T.ArrayType(T.StringType())),
])

STEP_SCHEMAS = {"ingest": INGEST_RESPONSE, "extract": EXTRACTED,
                "self_check": SELF_CHECK, "rewrite": VALUE_PROP}

# one row per model answer; `raw` keeps the provider envelope as JSON text
RESPONSE = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("step", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("tokens_input", T.LongType()),
    T.StructField("tokens_output", T.LongType()),
    T.StructField("latency_ms", T.LongType()),
    T.StructField("finish_reason", T.StringType()),
    T.StructField("error", T.StringType()),
])

LOG_EVENT = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("logger", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("total_cost_usd", T.DoubleType()),
    T.StructField("total_latency_ms", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("cache_key", T.StringType()),
    T.StructField("field", T.StringType()),
])

NORMALIZED = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("detected_pii", T.ArrayType(PII_DETECTION)),
    T.StructField("has_pii", T.BooleanType()),
    T.StructField("cleaned_content", T.StringType()),
    T.StructField("word_count", T.IntegerType()),
    T.StructField("processed_at", T.TimestampType()),
])

# the model never sets the time; the job does
VALUE_PROP_RESULT = T.StructType([*VALUE_PROP.fields, T.StructField("generated_at", T.TimestampType())])

RESULT = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("value_proposition", VALUE_PROP_RESULT),
    T.StructField("normalized_input", NORMALIZED),
    T.StructField("extracted_data", EXTRACTED),
    T.StructField("self_check", SELF_CHECK),
    T.StructField("total_latency_ms", T.LongType()),
    T.StructField("total_cost_usd", T.DoubleType()),
    T.StructField("provider_used", T.StringType()),
    T.StructField("model_used", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
])
