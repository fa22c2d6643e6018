"""Entity tokens, online and point-in-time features, and the plain-language entity context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgate.functions.ids import TOKEN_LIFETIME, entity_token, log_prefix
from veilgate.functions.rules import RuleSet
from veilgate.operators.access import (
    ENTITY_DATA_ROLES,
    ENTITY_HISTORY_ROLES,
    ID_TYPES,
    has_token_prefix,
    is_raw_identifier,
    sorted_roles,
)
from veilgate.operators.keyed import asof_join, balanced_join, latest_per_key, lookup_join
from veilgate.operators.shield import shield

# --- Fixed values: feature sets, sections and messages -----------------------------------------

FEATURE_SETS = {
    "credit_risk": ("payment_ratio_3m", "utilization_rate", "delinquency_score", "risk_band"),
    "churn_risk": ("engagement_score", "product_count", "last_activity_days", "satisfaction_band"),
    "collections_propensity": (
        "days_past_due",
        "promise_count",
        "contact_attempts",
        "balance_band",
    ),
    "cross_sell": ("income_band", "product_gap_score", "digital_response_rate", "ltv_band"),
}
DEFAULT_SECTIONS = ("account_status", "payment_history", "risk_profile")
NO_CONTEXT = "Context unavailable for requested sections."
FEATURE_VERSION = "v2024_q4"
PERMISSION_ERROR = "Insufficient permissions"
TOKEN_ERROR = "Invalid token format. Call get_entity_token first to obtain a session token."
TOKEN_EXPIRED = "Token has expired. Call get_entity_token again to obtain a new session token."
RAW_ID_ERROR = (
    "Raw entity IDs are not accepted. Use session-scoped token from Feature Store."
)

# ----------------------------------------------------------------------------------------------

KEYS = ["entity_token", "feature_set"]


def issue_tokens(requests: DataFrame, issued_at: Column | None = None) -> DataFrame:
    """``entity_token`` per (session, id type, id value); unknown id types become an error row."""
    valid = F.coalesce(F.col("id_type").isin(*ID_TYPES), F.lit(False))
    allowed = ", ".join(f"'{t}'" for t in sorted(ID_TYPES))
    token = entity_token(F.col("session_id"), F.col("id_type"), F.col("id_value"))
    issued = requests.withColumn("entity_token", F.when(valid, token)).withColumns(
        {
            "expires_in": F.when(valid, "86400s"),
            "scoped_to": F.when(valid, F.col("agent_id")),
            "error": F.when(~valid, f"Invalid id_type. Must be one of: [{allowed}]"),
        }
    )
    if issued_at is None:
        return issued
    return issued.withColumn("expires_at", F.when(valid, issued_at + F.expr(TOKEN_LIFETIME)))


def token_is_valid(issued_at: Column, now: Column) -> Column:
    return issued_at + F.expr(TOKEN_LIFETIME) > now


def with_expiry(features: DataFrame) -> DataFrame:
    return features.withColumn("expires_at", F.col("as_of") + F.expr(TOKEN_LIFETIME))


def latest_features(history: DataFrame, tie_break: str = "version") -> DataFrame:
    """Last write wins per (entity token, feature set)."""
    return latest_per_key(history, KEYS, ["as_of", tie_break])


def fresh_features(features: DataFrame, now: Column, max_age_minutes: int | None = None) -> DataFrame:
    """Drop expired rows and, when asked, rows older than the limit."""
    kept = features.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    if max_age_minutes is not None:
        oldest = now - F.make_dt_interval(mins=F.lit(max_age_minutes))
        kept = kept.where(F.col("as_of") >= oldest)
    return kept


def data_freshness(features: DataFrame) -> DataFrame:
    return features.groupBy("entity_token").agg(F.max("as_of").alias("data_freshness"))


def point_in_time(requests: DataFrame, history: DataFrame, tie_break: str = "version") -> DataFrame:
    """For each request (token, set, event_ts) the values known at that time, never later ones."""
    return asof_join(requests, history, KEYS, "event_ts", "as_of", tie_break)


def feature_names(feature_set: Column) -> Column:
    chain = F.lit(None).cast("array<string>")
    for name, features in FEATURE_SETS.items():
        chain = F.when(feature_set == name, F.array(*[F.lit(f) for f in features])).otherwise(chain)
    return chain


def feature_vectors(requests: DataFrame, values: DataFrame, now: Column) -> DataFrame:
    """Model inputs: exactly the four known features of the requested set, numbers only.

    ``values`` holds one row per (token, set) with a ``features`` map. No role is required.
    """
    require_numeric(values)
    known = F.coalesce(F.col("feature_set").isin(*FEATURE_SETS), F.lit(False))
    options = ", ".join(f"'{s}'" for s in sorted(FEATURE_SETS))
    joined = balanced_join(requests, values.select(*KEYS, "features"), KEYS, "left")
    names = feature_names(F.col("feature_set"))
    return joined.withColumn("_names", names).select(
        *requests.columns,
        F.when(
            known,
            F.map_from_arrays(
                F.col("_names"),
                F.transform("_names", lambda n: F.try_element_at(F.col("features"), n)),
            ),
        ).alias("features"),
        F.when(known, F.coalesce(F.col("event_ts"), now)).alias("as_of"),
        F.when(known, F.lit(FEATURE_VERSION)).alias("feature_version"),
        F.when(~known, f"Unknown feature set. Available: [{options}]").alias("error"),
        log_prefix(F.col("entity_token")).alias("log_token"),
    )


def require_numeric(values: DataFrame) -> None:
    """Feature values must be a map to numbers; checked on the schema, before any row is read."""
    kind = values.schema["features"].dataType
    if not (isinstance(kind, T.MapType) and isinstance(kind.valueType, T.NumericType)):
        raise TypeError(f"features must map names to numbers, got {kind.simpleString()}")


def with_named_features(values: DataFrame, columns: list[str]) -> DataFrame:
    """Fold four value columns into a ``features`` map named by the row's feature set."""
    return values.withColumn(
        "features",
        F.map_from_arrays(
            feature_names(F.col("feature_set")), F.array(*[F.col(c).cast("double") for c in columns])
        ),
    ).drop(*columns)


def narrative(sections: Column) -> Column:
    """Plain-language text from the section structs of a row, in fixed order.

    A section that was not asked for, or that the row lacks, adds nothing; contact preferences
    never add text.
    """

    def wanted(name: str) -> Column:
        return F.array_contains(sections, name) & F.col(name).isNotNull()

    def text(path: str) -> Column:
        return F.coalesce(F.col(path).cast("string"), F.lit("UNKNOWN"))

    def number(path: str) -> Column:
        return F.format_number(F.coalesce(F.col(path), F.lit(0)), 0)

    account = F.concat(
        F.lit("Account status is "),
        text("account_status.status"),
        F.lit(". Credit limit: $"),
        number("account_status.credit_limit"),
        F.lit(". Current balance: $"),
        number("account_status.balance"),
        F.lit("."),
    )
    payments = F.concat(
        F.lit("Payment history (last 12 months): "),
        F.coalesce(F.col("payment_history.on_time_12m"), F.lit(0)).cast("string"),
        F.lit(" on-time, "),
        F.coalesce(F.col("payment_history.missed_12m"), F.lit(0)).cast("string"),
        F.lit(" missed."),
    )
    risk = F.concat(
        F.lit("Risk tier: "),
        text("risk_profile.risk_tier"),
        F.lit(". Score band: "),
        text("risk_profile.score_band"),
        F.lit("."),
    )
    joined = F.concat_ws(
        " ",
        F.when(wanted("account_status"), account),
        F.when(wanted("payment_history"), payments),
        F.when(wanted("risk_profile"), risk),
    )
    return F.when(joined == "", NO_CONTEXT).otherwise(joined)


def entity_context(
    requests: DataFrame, online: DataFrame, rules: RuleSet, now: Column | None = None
) -> DataFrame:
    """Role gate, token gate, lookup, narrative and shield; refused requests keep an error row.

    ``requests``: entity_token, sections (null for the default), agent_id, agent_role; with ``now`` also
    ``issued_at``, and tokens older than their lifetime (or without a time) are refused. ``online``:
    one row per token with the section structs and ``last_updated``.
    """
    permitted = F.coalesce(F.col("agent_role").isin(*ENTITY_DATA_ROLES), F.lit(False))
    error = F.when(~permitted, PERMISSION_ERROR).when(
        ~F.coalesce(has_token_prefix(F.col("entity_token")), F.lit(False)), TOKEN_ERROR
    )
    if now is not None:
        alive = F.coalesce(token_is_valid(F.col("issued_at"), now), F.lit(False))
        error = error.when(~alive, TOKEN_EXPIRED)
    default = F.array(*[F.lit(s) for s in DEFAULT_SECTIONS])
    checked = (
        requests.withColumn("error", error)
        .withColumn(
            "sections", F.when(F.size("sections") > 0, F.col("sections")).otherwise(default)
        )
        .withColumn("required_roles", F.when(~permitted, sorted_roles(ENTITY_DATA_ROLES)))
    )
    told = (
        balanced_join(checked, online, ["entity_token"], "left")
        .withColumn("_text", F.when(F.col("error").isNull(), narrative(F.col("sections"))))
    )
    protected = shield(told, "_text", rules, "agent_role")
    return protected.select(
        *checked.columns,
        F.col("safe_text").alias("narrative"),
        F.when(F.col("error").isNull(), F.col("last_updated")).alias("data_freshness"),
        F.col("was_modified").alias("pii_masked"),
        "status",
    )


def entity_history(
    requests: DataFrame, records: DataFrame, rules: RuleSet, as_of: Column
) -> DataFrame:
    """Records of an entity within the requested days and types, summaries shielded.

    ``requests``: request_id, entity_token, date_range_days, record_types (empty for any),
    agent_role. ``records``: entity_token, record_id, record_type, summary, date. A refused
    request keeps one row with its error.
    """
    permitted = F.coalesce(F.col("agent_role").isin(*ENTITY_HISTORY_ROLES), F.lit(False))
    error = F.when(~permitted, PERMISSION_ERROR).when(
        is_raw_identifier(F.col("entity_token")), RAW_ID_ERROR
    )
    checked = requests.withColumn("error", error).withColumn(
        "required_roles", F.when(~permitted, sorted_roles(ENTITY_HISTORY_ROLES))
    )
    found = lookup_join(
        records,
        checked.where(F.col("error").isNull()).drop("error", "required_roles"),
        ["entity_token"],
        "inner",
        spread=["record_id"],
    ).where(
        (F.col("date") >= as_of - F.make_dt_interval(F.col("date_range_days")))
        & (
            F.coalesce(F.size("record_types"), F.lit(0)).isin(-1, 0)
            | F.array_contains("record_types", F.col("record_type"))
        )
    )
    safe = shield(found, "summary", rules, "agent_role").select(
        "request_id",
        "entity_token",
        "agent_role",
        "record_id",
        "record_type",
        "date",
        F.col("safe_text").alias("summary"),
        "status",
    )
    refused = checked.where(F.col("error").isNotNull()).select(
        "request_id", "entity_token", "agent_role", "error", "required_roles"
    )
    return safe.unionByName(refused, allowMissingColumns=True)
