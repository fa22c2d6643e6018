"""Who may call what: role gates fixed in code, and role policies given as data."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgate.functions.ids import TOKEN_PREFIX, stable_id
from veilgate.functions.rules import RuleSet

ALL = "all"
DEFAULT_ROLE = "public"

# --- Fixed values: roles accepted by the tools, and the default role policy --------------------

ENTITY_HISTORY_ROLES = ("analyst", "collections-agent", "servicing-agent", "fraud-agent")
ENTITY_DATA_ROLES = ("analyst", "collections-agent", "servicing-agent", "fraud-agent", "ml-service")
GOVERNANCE_ROLES = (
    "governance-reviewer",
    "platform-admin",
    "compliance-officer",
    "model-risk-analyst",
)
TOOL_ROLES = {
    "search_entity_history": ENTITY_HISTORY_ROLES,
    "get_entity_context": ENTITY_DATA_ROLES,
    "query_audit_trail": GOVERNANCE_ROLES,
    "get_pii_exposure_report": GOVERNANCE_ROLES,
}
PERMISSION_ERROR = "Insufficient permissions"
ID_TYPES = ("internal_id", "crm_id", "hashed_email")
ABSOLUTE_BLOCK = ("US_SSN", "CREDIT_CARD", "US_DRIVER_LICENSE", "US_PASSPORT")


@dataclass(frozen=True)
class RolePolicy:
    tools: tuple[str, ...]
    max_top_k: int
    domains: tuple[str, ...] = (ALL,)
    plaintext: tuple[str, ...] = ()
    rate_limit: int | None = None


@dataclass(frozen=True)
class AccessPolicy:
    roles: Mapping[str, RolePolicy]
    absolute_block: tuple[str, ...] = ABSOLUTE_BLOCK
    max_chunk_words: int = 512
    min_score: float = 0.40
    require_session: bool = True
    names: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        if DEFAULT_ROLE not in self.roles:
            raise ValueError(f"a policy needs the role {DEFAULT_ROLE!r}")
        object.__setattr__(self, "names", tuple(self.roles))

    def rules_for(self, rules: RuleSet) -> RuleSet:
        """Protection rules with this policy's plain-text grants; the absolute block wins."""
        grants = {name: role.plaintext for name, role in self.roles.items()}
        return rules.with_plaintext(grants).hardened(self.absolute_block)

    # One row per grant: sizes are those of the policy file.

    def tools_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(name, tool) for name, role in self.roles.items() for tool in role.tools]
        return F.broadcast(spark.createDataFrame(rows, "effective_role string, tool_name string"))

    def domains_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(name, d) for name, role in self.roles.items() for d in role.domains]
        return F.broadcast(spark.createDataFrame(rows, "effective_role string, domain string"))

    def limits_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(name, role.max_top_k, role.rate_limit) for name, role in self.roles.items()]
        return F.broadcast(
            spark.createDataFrame(rows, "effective_role string, max_top_k int, rate_limit int")
        )


# The default policy, every role with its full list of tools.
DEFAULT_POLICY = AccessPolicy(
    {
        "governance-admin": RolePolicy(
            (
                "search_knowledge_base",
                "get_document_context",
                "search_entity_history",
                "evaluate_retrieval_quality",
                "get_decision_lineage",
                "query_pii_audit",
                "validate_data_policy",
                "get_quality_metrics",
                "get_entity_context",
                "get_ml_features",
                "get_entity_token",
            ),
            20,
        ),
        "model-risk": RolePolicy(
            (
                "search_knowledge_base",
                "get_document_context",
                "get_decision_lineage",
                "query_pii_audit",
                "validate_data_policy",
                "get_quality_metrics",
            ),
            10,
        ),
        "data-steward": RolePolicy(
            ("search_knowledge_base", "get_document_context", "get_decision_lineage", "validate_data_policy", "get_quality_metrics"), 10
        ),
        "compliance-officer": RolePolicy(
            (
                "query_pii_audit",
                "get_decision_lineage",
                "validate_data_policy",
                "get_quality_metrics",
            ),
            10,
        ),
        "fraud-agent": RolePolicy(
            ("search_knowledge_base", "get_document_context", "search_entity_history", "evaluate_retrieval_quality", "get_entity_context", "get_entity_token"), 10, ("fraud", "risk", "servicing"), ("ACCOUNT_NUMBER",), 60
        ),
        "collections-agent": RolePolicy(
            ("search_knowledge_base", "get_document_context", "search_entity_history", "evaluate_retrieval_quality", "get_entity_context", "get_entity_token"),
            8,
            ("collections", "servicing", "risk"),
            ("EMAIL_ADDRESS", "PHONE_NUMBER"),
            120,
        ),
        "servicing-agent": RolePolicy(
            ("search_knowledge_base", "get_document_context", "search_entity_history", "evaluate_retrieval_quality", "get_entity_context", "get_entity_token"), 8, ("servicing", "collections"), ("EMAIL_ADDRESS",), 180
        ),
        "analyst": RolePolicy(
            (
                "search_knowledge_base",
                "get_document_context",
                "evaluate_retrieval_quality",
                "get_entity_context",
                "get_entity_token",
                "get_ml_features",
            ),
            15,
            ("servicing", "risk"),
            (),
            60,
        ),
        "ml-service": RolePolicy(
            ("get_ml_features", "get_entity_token", "evaluate_retrieval_quality"), 5, (ALL,), (), 600
        ),
        "public": RolePolicy(
            ("search_knowledge_base", "validate_data_policy"), 3, ("public",), (), 10
        ),
    }
)

# ----------------------------------------------------------------------------------------------


def load_policy(path: str) -> AccessPolicy:
    """Read a role policy file (YAML); anything malformed raises before data is touched."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        raw = yaml.safe_load(handle)
    if not isinstance(raw, dict) or not isinstance(raw.get("roles"), dict):
        raise ValueError(f"{path}: a policy file must map roles to grants")

    def many(value) -> tuple[str, ...]:
        return (value,) if isinstance(value, str) else tuple(value or ())

    roles = {
        name: RolePolicy(
            many(entry["allowed_tools"]),
            int(entry["max_top_k"]),
            many(entry.get("allowed_domains", ALL)),
            tuple(t for t, how in (entry.get("pii_overrides") or {}).items() if how == "plaintext"),
            entry.get("rate_limit_per_minute"),
        )
        for name, entry in raw["roles"].items()
    }
    shared = raw.get("global") or {}
    return AccessPolicy(
        roles,
        many(shared.get("absolute_block_entities", ABSOLUTE_BLOCK)),
        int(shared.get("max_chunk_size_tokens", 512)),
        float(shared.get("min_retrieval_score", 0.40)),
        bool(shared.get("require_session_id", True)),
    )


def sorted_roles(roles) -> Column:
    return F.array_sort(F.array(*[F.lit(r) for r in roles]))


# -- gates fixed in code ---------------------------------------------------------------------------


def gate_tools(calls: DataFrame, tool: str = "tool_name", role: str = "agent_role") -> DataFrame:
    """Add ``allowed``, ``error`` and ``required_roles`` (sorted) from the built-in role lists."""
    allowed, required = F.lit(True), F.lit(None).cast("array<string>")
    for name, roles in TOOL_ROLES.items():
        hit = F.col(tool) == name
        allowed = F.when(hit, F.coalesce(F.col(role).isin(*roles), F.lit(False))).otherwise(allowed)
        required = F.when(hit, sorted_roles(roles)).otherwise(required)
    return (
        calls.withColumn("allowed", allowed)
        .withColumn("error", F.when(~F.col("allowed"), PERMISSION_ERROR))
        .withColumn("required_roles", F.when(~F.col("allowed"), required))
    )


def is_raw_identifier(token: Column) -> Column:
    return token.rlike(r"(?U)^\d+$") & (F.length(token) > 8)


def has_token_prefix(token: Column) -> Column:
    return F.startswith(token, F.lit(TOKEN_PREFIX))


def may_read_session(session: Column, caller: Column, role: Column) -> Column:
    """Governance roles read every session, others those starting with their own first 8 characters."""
    own = (F.length(caller) > 0) & F.startswith(session, F.substring(caller, 1, 8))
    return F.coalesce(role.isin(*GOVERNANCE_ROLES), F.lit(False)) | F.coalesce(own, F.lit(False))


# -- gates given as data ----------------------------------------------------------------------------


def with_effective_role(
    calls: DataFrame, policy: AccessPolicy, role: str = "agent_role", block_unknown: bool = False
) -> DataFrame:
    """Map unknown roles to the default role, or mark them ``blocked`` when asked to."""
    known = F.coalesce(F.col(role).isin(*policy.names), F.lit(False))
    status = F.when(known, "ok").otherwise("blocked" if block_unknown else "defaulted")
    return calls.withColumn(
        "effective_role", F.when(known, F.col(role)).otherwise(F.lit(DEFAULT_ROLE))
    ).withColumn("role_status", status)


def permitted(calls: DataFrame, policy: AccessPolicy) -> DataFrame:
    """Calls whose effective role may use their tool."""
    return calls.join(
        policy.tools_frame(calls.sparkSession), ["effective_role", "tool_name"], "left_semi"
    )


def denied(calls: DataFrame, policy: AccessPolicy) -> DataFrame:
    return calls.join(
        policy.tools_frame(calls.sparkSession), ["effective_role", "tool_name"], "left_anti"
    )


def with_domain_permission(
    calls: DataFrame, policy: AccessPolicy, domain: str = "domain"
) -> DataFrame:
    """Add ``domain_allowed``; a role granted ``all`` may read every domain."""
    grants = policy.domains_frame(calls.sparkSession)
    everywhere = [name for name, r in policy.roles.items() if ALL in r.domains]
    direct = grants.withColumnRenamed("domain", domain).withColumn("_granted", F.lit(True))
    joined = calls.join(direct, ["effective_role", domain], "left")
    return joined.withColumn(
        "domain_allowed",
        F.coalesce(F.col("_granted"), F.lit(False)) | F.col("effective_role").isin(*everywhere),
    ).drop("_granted")


def with_limits(calls: DataFrame, policy: AccessPolicy) -> DataFrame:
    return calls.join(policy.limits_frame(calls.sparkSession), "effective_role", "left")


def has_session(session: Column) -> Column:
    return F.coalesce(F.length(F.trim(session)) > 0, F.lit(False))


def unauthorized_events(refused: DataFrame, key: str, at: Column) -> DataFrame:
    """One HIGH event per refused call."""
    return refused.select(
        stable_id(F.lit("UNAUTHORIZED_ACCESS"), F.col(key)).alias("event_id"),
        F.lit("UNAUTHORIZED_ACCESS").alias("event_type"),
        "agent_id",
        "agent_role",
        "tool_name",
        F.lit("HIGH").alias("severity"),
        F.col("tool_name").alias("denied_tool"),
        at.alias("timestamp"),
    )
