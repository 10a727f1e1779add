"""Controlled vocabularies of extraction records.

Fixed values, from the data model's public schema.
"""

from __future__ import annotations

CLAIM_STATUS = ("reported", "suspected", "alleged", "considered", "admitted", "found", "convicted", "acquitted", "dismissed", "ordered")
ACTION_STATUS = ("reported", "sought", "commenced", "issued", "granted", "denied", "dismissed", "imposed", "ordered", "agreed", "upheld", "varied", "pending", "adjourned", "withdrawn", "revoked", "lifted", "completed")
RISK_TYPES = {
    "market_misconduct": ("insider_dealing", "market_manipulation", "false_trading", "improper_trading"),
    "fraud_dishonesty": ("fraud", "deception", "misappropriation"),
    "financial_crime": ("bribery_corruption", "money_laundering", "aml_failure"),
    "licensing_fitness": ("unlicensed_activity", "fitness_propriety", "professional_misconduct"),
    "client_protection": ("client_suitability", "client_asset_failure", "client_investor_harm"),
    "systems_controls": ("systems_controls_failure", "risk_management_failure"),
    "governance_oversight": ("conflict_of_interest", "supervision_failure", "director_duty_breach"),
    "disclosure_reporting": ("disclosure_misconduct", "reporting_failure", "false_misleading_information"),
    "cybersecurity": ("cybersecurity_failure",),
    "legal_process": ("regulator_noncooperation", "legal_noncompliance"),
    "other": ("other",),
}
ACTION_TYPES = {
    "investigative": ("investigation", "information_notice", "inspection_search", "arrest", "arrest_warrant"),
    "proceeding": ("charge", "prosecution", "proceeding_commenced"),
    "procedural": ("hearing", "trial", "adjournment", "bail", "remand", "appeal_review", "procedural_order"),
    "decision": ("finding", "conviction", "plea", "settlement"),
    "sanction": ("fine", "reprimand", "suspension", "revocation", "prohibition", "disqualification", "imprisonment", "community_service"),
    "administrative": ("costs", "listing_cancellation", "remediation_governance", "winding_up_dissolution"),
    "remedial": ("compensation", "disgorgement_restoration"),
    "protective": ("injunction_asset_freeze", "restriction_notice", "trading_suspension"),
    "other": ("other",),
}
GEOGRAPHY_ROLES = ("incorporated_in", "resident_in", "operates_in", "listed_in", "regulated_in", "proceeding_in", "conduct_in", "assets_in", "restricted_in", "other")
MENTION_TYPES = ("person", "person_group", "organization", "fund", "financial_instrument", "unknown")
RELEVANCES = ("primary", "secondary")
INVOLVEMENTS = ("subject", "affected", "authority", "intermediary", "related")
MATTER_KINDS = ("investigation", "disciplinary_proceeding", "civil_proceeding", "criminal_proceeding", "tribunal_proceeding", "appeal_or_review")
RELATIONSHIP_KINDS = ("affiliation", "ownership", "control", "family", "service", "instrument", "membership", "other")
QUALIFIERS = ("exact", "approximately", "up_to", "over", "at_least")


def family_of(families: dict[str, tuple[str, ...]]) -> dict[str, str]:
    return {t: family for family, types in families.items() for t in types}
