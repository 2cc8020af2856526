"""Column names and types of the tables, and how missing values are written."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
PROCESSED_COLUMNS = [
    *RAW_COLUMNS,
    "business_name_clean", "business_name_normalized", "business_name_length", "business_name_token_count",
    "business_address_clean", "business_address_normalized", "business_address_length", "business_address_token_count",
    "country_clean",
]
_INTS = {c for c in PROCESSED_COLUMNS if c.endswith(("_length", "_token_count"))}

RAW = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
PROCESSED = T.StructType([T.StructField(c, T.IntegerType() if c in _INTS else T.StringType()) for c in PROCESSED_COLUMNS])
GROUND_TRUTH = T.StructType([T.StructField("source1_entity_id", T.StringType()), T.StructField("matched_entity_ids", T.StringType())])
CANDIDATES = T.StructType([T.StructField("source1_entity_id", T.StringType()), T.StructField("candidate_entity_ids", T.StringType())])
SUBMISSION = T.StructType([T.StructField("source1_entity_id", T.StringType()), T.StructField("match_entity_ids", T.StringType())])
