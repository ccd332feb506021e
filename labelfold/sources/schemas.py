"""Typed schemas of the 14 ledger tables of the design record (SRC-10, §1.4).

Each table is a Spark DDL string, so scans read with a declared schema (no
inference pass).  uuid → STRING, jsonb → STRING (parse with ``from_json``),
vector(384) → ARRAY<FLOAT>, money → DECIMAL(15,2), scores → DECIMAL(5,4).
The constraints that Spark does not enforce (NOT NULL, varchar length, code
lists, unique keys, references) are kept next to the schemas and turned into
data-quality rules by ``quality_rules`` (DQ-2..4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import duplicated_keys, orphans, rule_violations

# Table → DDL (column order and types of the design record).
DDL = {
    "users": "id STRING NOT NULL, email STRING NOT NULL, password_hash STRING NOT NULL, full_name STRING, "
             "is_active BOOLEAN NOT NULL, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL, "
             "last_login_at TIMESTAMP, settings STRING",
    "accounts": "id STRING NOT NULL, user_id STRING NOT NULL, parent_account_id STRING, name STRING NOT NULL, "
                "type STRING, currency STRING NOT NULL, balance DECIMAL(15,2) NOT NULL, is_active BOOLEAN NOT NULL, "
                "sort_order INT NOT NULL, metadata STRING, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL",
    "categories": "id STRING NOT NULL, user_id STRING NOT NULL, name STRING NOT NULL, parent_id STRING, "
                  "type STRING NOT NULL, color STRING, icon STRING, description STRING, is_active BOOLEAN NOT NULL, "
                  "sort_order INT NOT NULL, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL",
    "stores": "id STRING NOT NULL, user_id STRING NOT NULL, name STRING NOT NULL, address STRING, metadata STRING, "
              "created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL",
    "receipts": "id STRING NOT NULL, user_id STRING NOT NULL, store_id STRING, file_path STRING NOT NULL, "
                "file_name STRING NOT NULL, file_size BIGINT NOT NULL, mime_type STRING, ocr_text STRING, "
                "extracted_data STRING, receipt_date DATE, total_amount DECIMAL(15,2), "
                "processing_status STRING NOT NULL, uploaded_at TIMESTAMP NOT NULL, processed_at TIMESTAMP, "
                "created_at TIMESTAMP NOT NULL",
    "transaction_groups": "id STRING NOT NULL, user_id STRING NOT NULL, receipt_id STRING, store_id STRING, "
                          "name STRING, total_amount DECIMAL(15,2), transaction_date DATE NOT NULL, "
                          "created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL",
    "transactions": "id STRING NOT NULL, account_id STRING NOT NULL, transaction_group_id STRING, "
                    "type STRING NOT NULL, amount DECIMAL(15,2) NOT NULL, currency STRING NOT NULL, "
                    "description STRING NOT NULL, category_id STRING, predicted_category_id STRING, "
                    "transaction_date DATE NOT NULL, source STRING, external_id STRING, comment STRING, "
                    "metadata STRING, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL",
    "tags": "id STRING NOT NULL, user_id STRING NOT NULL, name STRING NOT NULL, color STRING, "
            "created_at TIMESTAMP NOT NULL",
    "transaction_tags": "transaction_id STRING, tag_id STRING",
    "transfers": "id STRING NOT NULL, from_account_id STRING NOT NULL, to_account_id STRING NOT NULL, "
                 "amount DECIMAL(15,2) NOT NULL, currency STRING NOT NULL, description STRING, "
                 "transfer_date DATE NOT NULL, fee DECIMAL(15,2), fee_category_id STRING, metadata STRING, "
                 "created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL",
    "training_data": "id STRING NOT NULL, user_id STRING NOT NULL, transaction_id STRING, "
                     "embedding ARRAY<FLOAT> NOT NULL, category_id STRING NOT NULL, source STRING NOT NULL, "
                     "confidence_threshold DECIMAL(5,4), is_validated BOOLEAN NOT NULL, created_at TIMESTAMP NOT NULL",
    "user_classifier_models": "id STRING NOT NULL, user_id STRING NOT NULL, model_type STRING NOT NULL, "
                              "model_version STRING NOT NULL, model_path STRING NOT NULL, "
                              "embedding_model_name STRING NOT NULL, embedding_dimension INT NOT NULL, "
                              "parameters STRING, training_samples_count INT NOT NULL, accuracy DECIMAL(5,4), "
                              "precision DECIMAL(5,4), recall DECIMAL(5,4), f1_score DECIMAL(5,4), "
                              "training_duration_seconds INT, is_active BOOLEAN NOT NULL, "
                              "trained_at TIMESTAMP NOT NULL, created_at TIMESTAMP NOT NULL, "
                              "updated_at TIMESTAMP NOT NULL",
    "model_training_history": "id STRING NOT NULL, user_id STRING NOT NULL, model_id STRING, "
                              "training_type STRING NOT NULL, samples_count INT NOT NULL, "
                              "categories_count INT NOT NULL, duration_seconds INT NOT NULL, status STRING NOT NULL, "
                              "error_message STRING, metrics STRING, triggered_by STRING NOT NULL, "
                              "started_at TIMESTAMP NOT NULL, completed_at TIMESTAMP, created_at TIMESTAMP NOT NULL",
    "feedback_events": "id STRING NOT NULL, user_id STRING NOT NULL, transaction_id STRING NOT NULL, "
                       "predicted_category_id STRING, correct_category_id STRING NOT NULL, "
                       "prediction_confidence DECIMAL(5,4), feedback_type STRING NOT NULL, "
                       "is_used_for_training BOOLEAN NOT NULL, created_at TIMESTAMP NOT NULL",
}

# varchar(n) limits.
VARCHAR = {
    "users": {"email": 255, "password_hash": 255, "full_name": 255},
    "accounts": {"name": 255, "type": 50, "currency": 3},
    "categories": {"name": 255, "type": 20, "color": 7, "icon": 50},
    "stores": {"name": 255},
    "receipts": {"file_path": 500, "file_name": 255, "mime_type": 100, "processing_status": 50},
    "transaction_groups": {"name": 255},
    "transactions": {"type": 20, "currency": 3, "source": 100, "external_id": 255},
    "tags": {"name": 100, "color": 7},
    "transfers": {"currency": 3},
    "training_data": {"source": 50},
    "user_classifier_models": {"model_type": 50, "model_version": 20, "model_path": 500,
                               "embedding_model_name": 100},
    "model_training_history": {"training_type": 50, "status": 20, "triggered_by": 50},
    "feedback_events": {"feedback_type": 50},
}

# Code lists stated in the column notes.
CODES = {
    ("accounts", "type"): ("bank", "cash", "card", "wallet"),
    ("categories", "type"): ("income", "expense"),
    ("receipts", "processing_status"): ("pending", "processing", "completed", "failed"),
    ("transactions", "type"): ("income", "expense"),
    ("transactions", "source"): ("receipt", "bank_statement", "manual"),
    ("training_data", "source"): ("user_feedback", "manual", "auto_confirmed"),
    ("user_classifier_models", "model_type"): ("LogisticRegression", "MLPClassifier", "SVM"),
    ("model_training_history", "training_type"): ("full", "incremental", "retrain"),
    ("model_training_history", "status"): ("pending", "running", "completed", "failed"),
    ("model_training_history", "triggered_by"): ("manual", "scheduler", "feedback_threshold", "periodic"),
    ("feedback_events", "feedback_type"): ("correction", "confirmation", "rejection"),
}

# Unique keys.
UNIQUE = {
    "users": [("email",)],
    "tags": [("user_id", "name")],
    "transaction_tags": [("transaction_id", "tag_id")],
    "user_classifier_models": [("user_id",)],
}

# References (table, column) → (parent table, parent column).
REFS = {
    ("accounts", "user_id"): ("users", "id"), ("accounts", "parent_account_id"): ("accounts", "id"),
    ("categories", "user_id"): ("users", "id"), ("categories", "parent_id"): ("categories", "id"),
    ("stores", "user_id"): ("users", "id"),
    ("receipts", "user_id"): ("users", "id"), ("receipts", "store_id"): ("stores", "id"),
    ("transaction_groups", "user_id"): ("users", "id"),
    ("transaction_groups", "receipt_id"): ("receipts", "id"),
    ("transaction_groups", "store_id"): ("stores", "id"),
    ("transactions", "account_id"): ("accounts", "id"),
    ("transactions", "transaction_group_id"): ("transaction_groups", "id"),
    ("transactions", "category_id"): ("categories", "id"),
    ("transactions", "predicted_category_id"): ("categories", "id"),
    ("tags", "user_id"): ("users", "id"),
    ("transaction_tags", "transaction_id"): ("transactions", "id"),
    ("transaction_tags", "tag_id"): ("tags", "id"),
    ("transfers", "from_account_id"): ("accounts", "id"), ("transfers", "to_account_id"): ("accounts", "id"),
    ("transfers", "fee_category_id"): ("categories", "id"),
    ("training_data", "user_id"): ("users", "id"), ("training_data", "transaction_id"): ("transactions", "id"),
    ("training_data", "category_id"): ("categories", "id"),
    ("user_classifier_models", "user_id"): ("users", "id"),
    ("model_training_history", "user_id"): ("users", "id"),
    ("model_training_history", "model_id"): ("user_classifier_models", "id"),
    ("feedback_events", "user_id"): ("users", "id"),
    ("feedback_events", "transaction_id"): ("transactions", "id"),
    ("feedback_events", "predicted_category_id"): ("categories", "id"),
    ("feedback_events", "correct_category_id"): ("categories", "id"),
}


def read_ledger_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """Scan one ledger table with its declared schema (SRC-10)."""
    return spark.read.schema(DDL[table]).format(fmt).load(path)


def _not_null_columns(table: str) -> list[str]:
    out = []
    for part in DDL[table].split(", "):
        if part.endswith("NOT NULL"):
            out.append(part.split(" ", 1)[0])
    return out


def quality_rules(df: DataFrame, table: str) -> DataFrame:
    """NOT NULL, varchar length and code-list violations of one table, one pass (DQ-4)."""
    rules: dict[str, F.Column] = {}
    for c in _not_null_columns(table):
        rules[f"{c}_not_null"] = F.col(c).isNull()
    for c, n in VARCHAR.get(table, {}).items():
        rules[f"{c}_max_{n}"] = F.length(c) > n
    for (t, c), codes in CODES.items():
        if t == table:
            rules[f"{c}_code"] = F.col(c).isNotNull() & ~F.col(c).isin(*codes)
    return rule_violations(df, table, rules)


def unique_violations(df: DataFrame, table: str) -> list[DataFrame]:
    """Duplicated unique keys of a table (DQ-2)."""
    return [duplicated_keys(df, list(k)) for k in UNIQUE.get(table, [])]


def reference_violations(tables: dict[str, DataFrame], table: str) -> dict[str, DataFrame]:
    """Orphan rows per reference column of ``table`` (DQ-3); NULL references are allowed."""
    out = {}
    for (t, c), (pt, pc) in REFS.items():
        if t == table and pt in tables:
            out[c] = orphans(tables[t], c, tables[pt], pc)
    return out
