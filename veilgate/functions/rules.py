"""Protection rules: plain data on the driver, compiled into Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from veilgate.functions import sqltext
from veilgate.functions.patterns import DEFAULT_THRESHOLD, ENTITY_TYPES, MODES


@dataclass(frozen=True)
class EntityRule:
    entity_type: str
    mode: str
    score_threshold: float = DEFAULT_THRESHOLD
    allowed_agent_roles: tuple[str, ...] = ()

    def __post_init__(self):
        if self.entity_type not in ENTITY_TYPES:
            raise ValueError(f"unknown entity type {self.entity_type!r}")
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[EntityRule, ...] = ()
    global_mode: str = "mask"
    block_on_unknown_agent: bool = True
    audit_all_events: bool = True
    _by_type: Mapping[str, EntityRule] = field(init=False, repr=False, compare=False, default=None)

    def __post_init__(self):
        if self.global_mode not in MODES:
            raise ValueError(f"unknown global mode {self.global_mode!r}")
        object.__setattr__(self, "_by_type", {r.entity_type: r for r in self.rules})

    # -- driver-side lookups ------------------------------------------------------------------

    def threshold(self, entity_type: str) -> float:
        rule = self._by_type.get(entity_type)
        return rule.score_threshold if rule else DEFAULT_THRESHOLD

    def mode(self, entity_type: str) -> str:
        rule = self._by_type.get(entity_type)
        return rule.mode if rule else self.global_mode

    # -- derived rule sets --------------------------------------------------------------------

    def with_plaintext(self, overrides: Mapping[str, Iterable[str]]) -> RuleSet:
        """Add role exemptions given as ``{role: entity types shown in plain text}``."""
        changed = []
        for rule in self.rules:
            extra = [r for r, types in overrides.items() if rule.entity_type in types]
            roles = tuple(dict.fromkeys((*rule.allowed_agent_roles, *extra)))
            changed.append(replace(rule, allowed_agent_roles=roles))
        return replace(self, rules=tuple(changed))

    def hardened(self, absolute_block: Iterable[str]) -> RuleSet:
        """Force block mode without exemptions for the named types, configured or not."""
        absolute = tuple(absolute_block)
        kept = [r for r in self.rules if r.entity_type not in absolute]
        forced = [
            EntityRule(t, "block", min(self.threshold(t), DEFAULT_THRESHOLD)) for t in absolute
        ]
        return replace(self, rules=tuple(forced + kept))

    # -- compilation --------------------------------------------------------------------------

    def mode_of(self, entity: str) -> str:
        """SQL text for the mode of an entity type expression."""
        return sqltext.lookup(entity, {r.entity_type: r.mode for r in self.rules}, self.global_mode)

    def threshold_of(self, entity: str) -> str:
        limits = {r.entity_type: float(r.score_threshold) for r in self.rules}
        return sqltext.lookup(entity, limits, DEFAULT_THRESHOLD)

    def exempt_types(self, role: str | None) -> str:
        """SQL text for the entity types a role sees in plain text; a null role sees none."""
        granted = [
            f"CASE WHEN {role} IN ({sqltext.texts(r.allowed_agent_roles)}) "
            f"THEN {sqltext.text(r.entity_type)} END"
            for r in self.rules
            if role is not None and r.allowed_agent_roles
        ]
        if not granted:
            return sqltext.empty("string")
        return f"array_compact(array({', '.join(granted)}))"

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (r.entity_type, r.mode, float(r.score_threshold), list(r.allowed_agent_roles))
            for r in self.rules
        ]
        return spark.createDataFrame(
            rows,
            "entity_type string, mode string, score_threshold double, "
            "allowed_agent_roles array<string>",
        )


def load_rules(path: str) -> RuleSet:
    """Read a rule file (YAML). Anything malformed raises before data is touched."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        raw = yaml.safe_load(handle)
    if not isinstance(raw, dict):
        raise ValueError(f"{path}: a rule file must be a mapping")
    rules = tuple(
        EntityRule(
            entry["entity_type"],
            entry["mode"],
            float(entry.get("score_threshold", DEFAULT_THRESHOLD)),
            tuple(entry.get("allowed_agent_roles") or ()),
        )
        for entry in raw.get("entities") or ()
    )
    return RuleSet(
        rules,
        raw.get("global_mode", "mask"),
        bool(raw.get("block_on_unknown_agent", True)),
        bool(raw.get("audit_all_events", True)),
    )


# --- Fixed values: the recommended rules and the smaller fallback rules -----------------------

RECOMMENDED_RULES = RuleSet(
    (
        EntityRule("US_SSN", "block", 0.70),
        EntityRule("CREDIT_CARD", "block", 0.75),
        EntityRule("US_DRIVER_LICENSE", "block", 0.75),
        EntityRule("US_PASSPORT", "block", 0.75),
        EntityRule("ACCOUNT_NUMBER", "token", 0.85, ("fraud-agent", "platform-admin")),
        EntityRule("US_BANK_NUMBER", "token", 0.80),
        EntityRule("US_ROUTING_NUMBER", "token", 0.85),
        EntityRule("PERSON", "mask", 0.80),
        EntityRule(
            "EMAIL_ADDRESS", "mask", 0.90, ("collections-agent", "servicing-agent", "platform-admin")
        ),
        EntityRule("PHONE_NUMBER", "mask", 0.75, ("collections-agent", "platform-admin")),
        EntityRule("LOCATION", "mask", 0.75),
        EntityRule("US_ZIP_CODE", "mask", 0.80, ("analytics-agent",)),
        EntityRule("DATE_TIME", "mask", 0.85),
        EntityRule("US_NPI", "mask", 0.90),
    )
)

FALLBACK_RULES = RuleSet(
    (
        EntityRule("US_SSN", "block"),
        EntityRule("CREDIT_CARD", "block"),
        EntityRule("US_BANK_NUMBER", "mask"),
        EntityRule("ACCOUNT_NUMBER", "token", allowed_agent_roles=("fraud-agent",)),
        EntityRule(
            "EMAIL_ADDRESS", "mask", allowed_agent_roles=("collections-agent", "servicing-agent")
        ),
        EntityRule("PHONE_NUMBER", "mask", allowed_agent_roles=("collections-agent",)),
        EntityRule("PERSON", "mask"),
        EntityRule("LOCATION", "mask"),
    ),
    audit_all_events=False,
)

# ----------------------------------------------------------------------------------------------
