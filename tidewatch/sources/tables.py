"""Tables, CSV files, JSON payloads and the literal dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values that results depend on: declared services, in the order in which they are matched.
PROFILES = [
    ("bankone", "BankOne Financial", "banking", ["bankone.com", "auth.bankone.com", "secure-bank.example.com"], ["credentials", "account_number", "otp"]),
    ("paypal", "PayPal Payment Services", "payments", ["paypal.com", "services.paypal.com", "signin.paypal.com"], ["credentials", "card_data", "otp", "financial_records"]),
    ("google", "Google Accounts", "identity_provider", ["google.com", "accounts.google.com", "myaccount.google.com"], ["credentials", "profile_data", "otp", "security_keys"]),
    ("microsoft", "Microsoft 365 / Entra", "productivity", ["microsoft.com", "signin.microsoftonline.com", "portal.office.com", "login.microsoftonline.com"], ["credentials", "enterprise_id", "otp"]),
]
# Fixed values that results depend on: hosts blocked before load, subdomains included.
BLOCKED_HOSTS = ["test-phish-dnr-blocked.example.com"]

OBSERVATION = "collectionId string, page struct<domain:string,url:string,isHTTPS:boolean>, forms array<struct<action:string,hasPasswordField:boolean>>, inputs array<struct<detectedDataTypes:array<string>,isPassword:boolean,isOtp:boolean>>, scripts array<struct<src:string>>, requestedDataTypes array<string>, threatLevel string, modelScore double, policyAction string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header and declared types; an empty file is an error."""
    df = spark.read.schema(schema).csv(path, header=True)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def write_splits(df: DataFrame, path: str) -> None:
    """A folder for each split; a row may be in several (column splits: array)."""
    df.withColumn("split", F.explode("splits")).drop("splits").write.mode("overwrite").partitionBy("split").parquet(path)


def write_csv_splits(df: DataFrame, path: str) -> None:
    """One pass: CSV files with a header in a folder for each split; a row may be in several (column splits: array), or in none."""
    df.withColumn("split", F.explode("splits")).drop("splits").write.mode("overwrite").partitionBy("split").csv(path, header=True)


def read_csv_split(spark: SparkSession, path: str, split: str, schema: str) -> DataFrame:
    """The rows of one split with declared types; only its folder is read. A split without rows is an error."""
    if isinstance(schema, str):
        schema = f"{schema}, split string"
    df = spark.read.schema(schema).csv(path, header=True).filter(F.col("split") == split).drop("split")
    if df.isEmpty():
        raise ValueError(f"no rows in split {split} of {path}")
    return df


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def profiles(spark: SparkSession) -> DataFrame:
    rows = [(i, *p) for i, p in enumerate(PROFILES)]
    return spark.createDataFrame(rows, "ord int, service_id string, service_name string, service_category string, official_domains array<string>, documented_data_categories array<string>")


def payloads(df: DataFrame, body: str = "body") -> DataFrame:
    """df with payload (null where the body is no JSON object) parsed to OBSERVATION."""
    return df.withColumn("payload", F.from_json(body, OBSERVATION, {"mode": "PERMISSIVE"}))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, extension, size, sha256 and content of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


# Fixed values that results depend on: columns of the stored tables. Keys and references are checked by operators.store.orphans and operators.quality, since Parquet tables don't enforce them.
TABLES = {
    "service_profiles": "service_id VARCHAR(64) NOT NULL, service_name VARCHAR(128) NOT NULL, category VARCHAR(64) NOT NULL, declared_behavior STRING, created_at TIMESTAMP DEFAULT current_timestamp()",
    "service_domains": "id INT NOT NULL, service_id VARCHAR(64) NOT NULL, domain VARCHAR(255) NOT NULL, is_primary BOOLEAN DEFAULT false",
    "model_versions": "model_id VARCHAR(64) NOT NULL, version VARCHAR(32) NOT NULL, model_type VARCHAR(64) NOT NULL, sha256_hash VARCHAR(64) NOT NULL, is_active BOOLEAN DEFAULT true, created_at TIMESTAMP DEFAULT current_timestamp()",
    "policy_versions": "policy_id VARCHAR(64) NOT NULL, version VARCHAR(32) NOT NULL, description STRING, is_active BOOLEAN DEFAULT true, created_at TIMESTAMP DEFAULT current_timestamp()",
    "observations": "observation_id VARCHAR(64) NOT NULL, collection_id VARCHAR(64) NOT NULL, page_domain VARCHAR(255) NOT NULL, page_url_sanitized VARCHAR(1024) NOT NULL, is_https BOOLEAN NOT NULL, form_count INT DEFAULT 0, input_count INT DEFAULT 0, script_count INT DEFAULT 0, requested_data_types STRING, threat_level VARCHAR(32), model_score FLOAT, policy_action VARCHAR(32), observed_at TIMESTAMP DEFAULT current_timestamp()",
}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """The stored tables, where they aren't there yet."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
