"""Explicit schemas, closed sets and parameters of the ledger."""

from __future__ import annotations

MONEY = "decimal(28,6)"

SOURCE_RECORDS = f"source_type string, evidence_identity string, record_locator string, source_record_id string, transaction_type string, transaction_date date, amount {MONEY}, currency string, description string, record_ord long"
SOURCE_LINKS = "transaction_id string, source_record_id string, role string, link_ord string"
DECISIONS = "transaction_id string, merchant_override string, category_override string, note string"
DESCRIPTION_MAP = "description string, merchant string"
MERCHANT_MAP = "merchant string, category string"
STATEMENT_DATES = "evidence_identity string, statement_date date"
MANUAL_EVIDENCE = "id string, type string, date string, amount string, currency string, description string"
SCHEDULE_RULES = "id string, enabled boolean, type string, amount string, currency string, description string, first_occurrence_date string, note string"
SCHEDULE_EXECUTION = "rule_id string, last_processed_occurrence_date string, last_source_record_id string, last_transaction_id string, last_action string"
FEEDBACK = "id string, created_at string, status string, content string, context struct<runtime:string,page:string,workspace:string,entity_type:string,entity_id:string>"
BANK_TRANSACTIONS = "transaction_id string, transaction_date string, amount string, description string, source_email string, source_index int"
APP_ROWS = "row_image string, merchant_text string, merchant_score double, amount string, occurred_at string, occurred_on string, occurred_at_precision string, issues array<string>, notes array<string>"
POLICIES = "source_type string, processing_order int, takes_authority boolean, candidate_scope string, on_ambiguous string"

# Fixed values of the domain.
TYPES = ("income", "expense")
ROLES = ("authoritative", "supporting")
UNCLASSIFIED = "待分类"
OTHER_EXPENSE = "其他支出"
OTHER_INCOME = "其他收入"
GENERAL_SHOPPING = "综合购物"
OTHER_EXPENSE_REVIEW = "other_expense_review"
HIGH_VALUE_REVIEW = "high_value_general_shopping_review"
REPAYMENT_WORD = "还款"
CATEGORY_SOURCES = ("transaction_override", "merchant_default", "unclassified", "income_default")
FEEDBACK_STATUS = ("open", "resolved")
FEEDBACK_RUNTIMES = ("desktop_web", "mini_h5", "weapp")

# Parameters.
REFUND_LOOKBACK_DAYS = 30
MATCH_WINDOW_DAYS = 3
STATEMENT_DAY = 10
HIGH_VALUE = 1000
TREND_MONTHS = 12
TOP_MERCHANTS = 8
SECONDARY_WINDOW_DAYS = 7
LOW_SCORE = 0.90

#: The two policies: bank statements come first and take authority over manual entries
#: that match alone; manual entries join what they match alone, and doubt is a conflict.
DEFAULT_POLICIES = (("bank", 100, True, "manual", "create"), ("manual", 200, False, "any", "fail"))
