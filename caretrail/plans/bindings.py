"""Views over the given tables in the shapes that the jobs take. The SQL runs in Spark and in other engines alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"]

NAMES = ["HTN", "T2DM", "A-Fib", "GERD", "Type 2 diabetes", "Migraine headache", "Skin rash", "Coronary artery disease", "Asthma", "Kidney stone",
         "Colon polyp", "Lymph node swelling", "Fibromyalgia", "Osteo arthritis", "Ovarian cyst", "a mole (left arm)", "Unclear finding", "CKD", "Prostatitis", "Anemia"]
_NAME_CASE = "CASE p_partkey % 23 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " ELSE p_name END"

VIEWS = {
    "terms": f"""SELECT p_partkey AS id, {_NAME_CASE} AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE lower(p_type) END AS notes,
 CASE p_type WHEN 'ECONOMY' THEN 'skin' WHEN 'SMALL' THEN ' Cardio ' WHEN 'MEDIUM' THEN 'renal' WHEN 'PROMO' THEN 'gi' WHEN 'STANDARD' THEN 'endocrine' ELSE 'other' END AS system,
 CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS organ, CASE WHEN p_size % 5 = 0 THEN NULL ELSE concat('Left ', p_type) END AS location, p_size, p_retailprice FROM part""",
    "dated": """SELECT o_orderkey AS id, o_custkey, o_totalprice,
 CASE o_orderkey % 8 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)
  WHEN 2 THEN concat(substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4), '-MAR-', CAST(1 + o_orderkey % 28 AS STRING)) WHEN 3 THEN substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7)
  WHEN 4 THEN '2017 to 2024' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE concat(substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4), '-SEP') END AS d,
 1990 + (o_orderkey % 3000) / CAST(100 AS DOUBLE) AS year, CAST(1990 + o_custkey % 10 AS DOUBLE) AS low, CAST(1990 + o_custkey % 10 + o_custkey % 21 AS DOUBLE) AS high FROM orders""",
    "patients": """SELECT c_custkey AS patient_id, c_name, 1940 + c_custkey % 60 AS birth_year, c_custkey % 12 + 1 AS birth_month FROM customer""",
    "condition_mentions": """SELECT o.o_custkey AS patient_id, l.l_orderkey AS record_id,
 CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate) AS BIGINT) AS seq,
 p.p_name AS name_medical,
 CASE p.p_type WHEN 'ECONOMY' THEN 'skin' WHEN 'SMALL' THEN ' Cardio ' WHEN 'MEDIUM' THEN 'renal' WHEN 'PROMO' THEN 'gi' WHEN 'STANDARD' THEN 'endocrine' ELSE 'other' END AS system,
 CASE WHEN p.p_size % 3 = 0 THEN NULL ELSE p.p_brand END AS organ,
 CASE WHEN l.l_linenumber % 4 = 0 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS date_diagnosed,
 l_linestatus = 'O' AS date_inherited,
 CASE l_returnflag WHEN 'A' THEN 'documented' WHEN 'N' THEN 'suspected' ELSE 'resolved' END AS status,
 s.s_name AS provider_name, n.n_name AS facility_name
FROM lineitem l JOIN orders o ON o_orderkey=l_orderkey JOIN part p ON p_partkey=l_partkey JOIN supplier s ON s_suppkey=l_suppkey JOIN nation n ON n_nationkey=s_nationkey""",
    "health_records": """SELECT o_custkey AS patient_id, o_orderkey AS id, concat('record-', CAST(o_orderkey AS STRING), '.pdf') AS filename,
 CASE WHEN o_orderstatus='P' THEN 'demo' END AS record_type FROM orders""",
    "measurements": """SELECT user_id AS record_id, event_id AS seq,
 CASE event_id % 11 WHEN 0 THEN 'HbA1c' WHEN 1 THEN 'Fasting Glucose' WHEN 2 THEN 'Fasting plasma glucose' WHEN 3 THEN 'Blood Pressure Systolic' WHEN 4 THEN 'Blood Pressure Diastolic' WHEN 5 THEN 'LDL Cholesterol' WHEN 6 THEN 'Total Cholesterol' WHEN 7 THEN 'Hemoglobin' WHEN 8 THEN 'eGFR' WHEN 9 THEN 'Hgb' ELSE 'Vitamin D' END AS name,
 CASE event_id % 11 WHEN 0 THEN floor((value % 10) * 10) / CAST(10 AS DOUBLE) WHEN 1 THEN CAST(floor(value) AS DOUBLE)+60 WHEN 2 THEN floor((value % 10) * 10) / CAST(10 AS DOUBLE) WHEN 3 THEN CAST(floor(value) AS DOUBLE)+90 WHEN 4 THEN CAST(floor(value) AS DOUBLE)+50 WHEN 5 THEN CAST(floor(value) AS DOUBLE)+90 WHEN 6 THEN CAST(floor(value) AS DOUBLE)+150 WHEN 7 THEN floor((value % 18) * 10) / CAST(10 AS DOUBLE) WHEN 8 THEN CAST(floor(value) AS DOUBLE)+20 WHEN 9 THEN floor((value % 18) * 10) / CAST(10 AS DOUBLE) ELSE CAST(floor(value) AS DOUBLE) END AS value_numeric,
 CASE event_id % 11 WHEN 0 THEN '%' WHEN 2 THEN 'mmol/L' WHEN 3 THEN 'mmHg' WHEN 4 THEN 'mmHg' WHEN 7 THEN 'g/dL' WHEN 8 THEN 'mL/min' WHEN 9 THEN 'g/dL' ELSE 'mg/dL' END AS unit,
 CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS STRING) END AS date FROM events""",
    "known_conditions": """SELECT DISTINCT user_id AS record_id, CASE user_id % 9 WHEN 0 THEN 'Essential Hypertension' WHEN 1 THEN 'Diabetic neuropathy' WHEN 2 THEN 'Impaired fasting glucose' WHEN 3 THEN 'Dyslipidemia' WHEN 4 THEN 'Iron anemia' WHEN 5 THEN 'CKD stage 2' ELSE 'Asthma' END AS name_medical FROM events""",
    "clinical_notes": """SELECT o_custkey AS patient_id, o_orderkey AS record_id,
 concat('Patient: ', c_name, chr(10), 'DOB: ', CAST(CAST(o_orderdate AS DATE) AS STRING), chr(10), 'MRN: ', CAST(o_orderkey AS STRING), chr(10),
 'Attending physician: Dr. No', CAST(c_nationkey AS STRING), ', email dr', CAST(c_nationkey AS STRING), '@clinic.example.com', chr(10),
 'Phone: 555-010-', CAST(1000 + o_orderkey % 9000 AS STRING), chr(10), chr(10), c_name, ' was seen; SSN 123-45-', CAST(1000 + c_custkey % 9000 AS STRING), '.', chr(10), 'Diagnosis: Hypertension') AS text
FROM orders JOIN customer ON c_custkey=o_custkey""",
    "call_log": """SELECT event_id AS seq, concat(CAST(user_id AS STRING), ':', CAST(CAST(ts AS DATE) AS STRING)) AS call_id, concat('model-', CAST(user_id % 7 AS STRING)) AS model, ts,
 CASE event_type WHEN 'error' THEN 429 WHEN 'view' THEN 500 WHEN 'signup' THEN 402 ELSE 200 END AS http_status FROM events""",
    "responses": """SELECT o_orderkey AS chunk_id, concat('```ndjson', chr(10),
 CASE WHEN o_orderkey % 5 = 0 THEN 'not json at all' ELSE concat('{"type":"condition","name_medical":"', o_orderpriority, '","earliest_date":', CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE concat('"', CAST(CAST(o_orderdate AS DATE) AS STRING), '"') END, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ',"notes":null' END, '}') END, chr(10),
 '{"type":"measurement","name":"LDL","value_numeric":', CASE WHEN o_orderkey % 4 = 0 THEN '"170"' ELSE CAST(100 + o_orderkey % 100 AS STRING) END, ',"unit":"mg/dL","date":null}', chr(10),
 CASE WHEN o_orderkey % 2 = 0 THEN concat('{"type":"report_provider","name":"Dr. No', CAST(o_custkey % 9 AS STRING), '","specialty":null,"email":null,"phone":null,"evidence":null}') ELSE '{"type":"unknown"}' END, chr(10), '```') AS content FROM orders""",
    "models": """SELECT concat(p_name, '-', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ':free' END) AS id, p_partkey % 11 <> 0 AS benchmarked,
 CAST(p_size * 2 AS DOUBLE) AS intelligence, p_retailprice / 20 AS agentic, p_partkey * 1000 AS context_length FROM part""",
    "contacts": """SELECT o_custkey AS patient_id, o_orderkey AS record_id, 1 AS contact_no, concat('No', CAST(c_nationkey AS STRING), ', attending') AS name,
 concat('dr', CAST(c_nationkey AS STRING), '@clinic.example.com') AS email, CASE WHEN o_orderkey % 2 = 0 THEN concat('555-', CAST(o_orderkey AS STRING)) END AS phone, 'line 4' AS evidence FROM orders JOIN customer ON c_custkey = o_custkey
 UNION ALL SELECT o_custkey, o_orderkey, 2, 'Nurse Joy', 'joy@clinic.example.com', '555-2', 'line 9' FROM orders WHERE o_orderkey % 3 = 0""",
}


def view_sql(*names: str) -> str:
    """WITH clause that defines the views."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " "


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    for t in BASE:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
