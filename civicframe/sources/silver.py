"""The silver tables: declared schemas, natural keys and partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TAIL = "provenance string, bronze_uri string, extra_data string, ingested_at timestamp"


@dataclass(frozen=True)
class Table:
    columns: str
    key: tuple[str, ...]
    partition: tuple[str, ...] = ()

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(f"{self.columns}, {TAIL}")


def _t(columns: str, key: str, partition: str = "") -> Table:
    """Columns without a type are strings."""
    ddl = ", ".join(x if " " in x else f"{x} string" for x in columns.split(", "))
    return Table(ddl, tuple(key.split()), tuple(partition.split()))


#: Column names, types, keys and partitions of the silver layer; day(x) partitions by the date of x.
TABLES = {
    "court_cases": _t("court_identifier, case_number, registration_date_bs, registration_date_ad date, case_type, division, category, section, plaintiff, defendant, original_case_number, case_id, priority, registration_number, case_status, verdict_date_bs, verdict_date_ad date, verdict_judge, verdict_type, case_subject, hearing_count, status, enriched_at timestamp, document_sources", "court_identifier case_number", "court_identifier day(registration_date_ad)"),
    "court_hearings": _t("court_identifier, case_number, hearing_date_bs, hearing_date_ad date, serial_no, bench, bench_type, judge_names, lawyer_names, case_status, decision_type, remarks, scraped_at timestamp", "court_identifier case_number hearing_date_bs serial_no", "court_identifier day(hearing_date_ad)"),
    "court_entities": _t("court_identifier, case_number, side, name, address, nes_id", "court_identifier case_number side name", "court_identifier"),
    "courts": _t("identifier, court_type, full_name_nepali, full_name_english", "identifier"),
    "charge_sheets": _t("charge_sheet_id, title, filed_date_bs, filed_date_ad date, court_identifier, case_number, accused_names, offence, amount_npr double, summary", "charge_sheet_id", "filed_date_ad"),
    "procurement_tenders": _t("tender_id, public_entity, public_entity_nes_id, title, category, notice_date_bs, notice_date_ad date, submission_deadline_ad date, estimated_cost_npr double, fiscal_year, status", "tender_id", "fiscal_year"),
    "procurement_awards": _t("award_id, tender_id, public_entity, contractor_name, contractor_nes_id, award_amount_npr double, award_date_bs, award_date_ad date, fiscal_year, contract_status", "award_id", "fiscal_year"),
    "procurement_contractors": _t("firm_name, proprietor_name, address, nes_id, is_blacklisted boolean, blacklist_date_bs, blacklist_date_ad date, effective_until_bs, effective_until_ad date, duration, reason, recommending_office", "firm_name blacklist_date_bs", "blacklist_date_ad"),
    "projects": _t("project_id, name, ministry, implementing_agency, level, province, district, fiscal_year, allocated_npr double, expenditure_npr double, status", "project_id", "fiscal_year level"),
    "budget_lines": _t("budget_line_id, fiscal_year, level, ministry, program, project_id, budget_head, source, allocated_npr double, revised_npr double, actual_npr double", "budget_line_id fiscal_year", "fiscal_year level"),
    "audit_findings": _t("finding_id, audited_entity, audited_entity_nes_id, fiscal_year, finding_type, amount_npr double, description, report_date_ad date, status", "finding_id", "fiscal_year"),
    "asset_declarations": _t("declaration_id, official_name, official_nes_id, position, office, fiscal_year, declaration_date_ad date, declared_assets", "declaration_id", "fiscal_year"),
    "company_registry": _t("registration_no, company_name, nes_id, company_type, registration_date_ad date, status, registered_office, paid_up_capital_npr double, directors", "registration_no", "status"),
    "ministerial_decisions": _t("decision_id, ministry, decision_date_bs, decision_date_ad date, subject, summary, related_entities", "decision_id", "day(decision_date_ad)"),
    "gazette_entries": _t("gazette_id, part, publication_date_bs, publication_date_ad date, title, body", "gazette_id", "day(publication_date_ad)"),
}


def partition_columns(table: str) -> dict[str, Column]:
    return {p.replace("day(", "").rstrip(")") + ("_day" if p.startswith("day(") else ""): F.to_date(p[4:-1]) if p.startswith("day(") else F.col(p) for p in TABLES[table].partition}


def conform(df: DataFrame, table: str) -> DataFrame:
    """The declared columns in order, leniently cast; what is missing is null."""
    return df.select(*((F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in TABLES[table].schema.fields))


def promote(bronze: DataFrame, silver: DataFrame, table: str, since: str | None = None) -> DataFrame:
    """Silver with bronze merged on the natural key: the last ingested row of a key wins; rows without a whole key stay out."""
    from civicframe.operators.upsert import latest, upsert

    key = list(TABLES[table].key)
    new = conform(bronze, table).dropna(subset=key)
    if since:
        new = new.where(F.col("ingested_at") >= F.lit(since).cast("timestamp"))
    return upsert(conform(silver, table), latest(new, key, ["ingested_at", "bronze_uri"]), key)


def write(df: DataFrame, table: str, path: str) -> None:
    """Only the partitions that ``df`` has are replaced."""
    parts = partition_columns(table)
    derived = {k: v for k, v in parts.items() if k.endswith("_day")}
    out = df.withColumns(derived) if derived else df
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
