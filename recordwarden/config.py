"""Policy of one audit run: thresholds, required fields, territories, costs."""

from __future__ import annotations

from dataclasses import dataclass, field

from .model import COMPANIES, CONTACTS, DEALS, HIGH, MEDIUM
from .sources.atlas import REGION_COUNTRIES


@dataclass(frozen=True)
class RequiredField:
    column: str
    severity: int
    reason: str


def _default_required_fields() -> dict[str, list[RequiredField]]:
    return {
        CONTACTS: [
            RequiredField("email", HIGH, "without an address nobody can reach or match this person"),
            RequiredField("owner", HIGH, "nobody is responsible for following up"),
            RequiredField("lifecycle_stage", HIGH, "scoring, nurturing and funnel reports skip it"),
            RequiredField("country", MEDIUM, "it cannot be assigned to a territory"),
        ],
        COMPANIES: [
            RequiredField("domain", HIGH, "matching and enrichment both start from the domain"),
            RequiredField("owner", HIGH, "nobody is responsible for the account"),
            RequiredField("industry", MEDIUM, "segments and scores lose accuracy"),
        ],
        DEALS: [
            RequiredField("amount", HIGH, "the forecast counts it as nothing"),
            RequiredField("close_date", HIGH, "the forecast cannot place it in a period"),
            RequiredField("owner", HIGH, "nobody is responsible for moving it forward"),
        ],
    }


# Mailbox names that belong to a role rather than a person.
ROLE_MAILBOXES = (
    "info", "sales", "admin", "support", "contact", "hello", "office", "team",
    "help", "no-reply", "noreply",
)


@dataclass
class AuditConfig:
    stale_deal_days: int = 30
    decayed_contact_days: int = 183
    required_fields: dict[str, list[RequiredField]] = field(default_factory=_default_required_fields)
    role_mailboxes: tuple[str, ...] = ROLE_MAILBOXES
    owner_regions: dict[str, str] = field(default_factory=dict)
    region_countries: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(REGION_COUNTRIES))

    def __post_init__(self) -> None:
        if self.stale_deal_days < 0 or self.decayed_contact_days < 0:
            raise ValueError("day thresholds must not be negative")

    @property
    def routing_enabled(self) -> bool:
        return bool(self.owner_regions) and bool(self.region_countries)


def make_config(
    *,
    stale_deal_days: int = 30,
    decayed_contact_days: int = 183,
    territory_routing: bool = True,
    owner_regions: dict[str, str] | None = None,
) -> AuditConfig:
    """Policy from the few settings a user normally changes.

    Routing stays off until an owner map is given; the engine cannot know a team.
    """
    assigned = (owner_regions or {}) if territory_routing else {}
    return AuditConfig(
        stale_deal_days=stale_deal_days,
        decayed_contact_days=decayed_contact_days,
        owner_regions={name: region for name, region in assigned.items() if name and region},
    )


def months_to_days(months: float) -> int:
    return round(months * 30.44)


# Minutes of work per finding, by check and severity.
REMEDIATION_MINUTES = {
    ("duplicate_contacts", HIGH): 15.0,
    ("duplicate_companies", HIGH): 20.0,
    ("duplicate_companies", MEDIUM): 20.0,
    ("missing_fields_contacts", HIGH): 10.0,
    ("missing_fields_contacts", MEDIUM): 4.0,
    ("missing_fields_companies", HIGH): 10.0,
    ("missing_fields_companies", MEDIUM): 4.0,
    ("missing_fields_deals", HIGH): 10.0,
    ("missing_fields_deals", MEDIUM): 4.0,
    ("decayed_contacts", MEDIUM): 3.0,
    ("email_deliverability", HIGH): 5.0,
    ("email_deliverability", MEDIUM): 3.0,
    ("routing_contacts", HIGH): 20.0,
    ("routing_companies", HIGH): 20.0,
    ("stale_deals", HIGH): 15.0,
    ("past_close_date", HIGH): 10.0,
}


@dataclass
class CostAssumptions:
    hourly_cost: float = 75.0
    remediation_minutes: dict[tuple[str, int], float] = field(
        default_factory=lambda: dict(REMEDIATION_MINUTES)
    )
    fallback_minutes: float = 5.0
    # Fixed values: (days neglected, share of the amount at risk), longest first.
    risk_bands: tuple[tuple[int, float], ...] = ((90, 0.75), (60, 0.50), (30, 0.25))

    def cost_of(self, minutes: float) -> float:
        return round(minutes / 60.0 * self.hourly_cost, 2)
