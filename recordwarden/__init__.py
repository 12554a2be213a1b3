"""Data-quality audits of CRM tables as Spark DataFrames."""

from .config import AuditConfig, CostAssumptions, RequiredField, make_config, months_to_days
from .model import COMPANIES, CONTACTS, DEALS, HIGH, LOW, MEDIUM, CrmTables
from .plans.audit import CHECK_NAMES, run_checks
from .plans.correction_bundle import build_corrections, write_corrections
from .plans.report import Report, build_report
from .sources.csv_tables import load_crm

__all__ = [
    "AuditConfig", "CHECK_NAMES", "COMPANIES", "CONTACTS", "CostAssumptions", "CrmTables", "DEALS",
    "HIGH", "LOW", "MEDIUM", "Report", "RequiredField", "build_corrections", "build_report",
    "load_crm", "make_config", "months_to_days", "run_checks", "write_corrections",
]
