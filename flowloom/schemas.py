"""Schemas of the tables that the operators exchange. Missing values are NULL, never NaN."""

from __future__ import annotations

EDGES = "year INT, source STRING, target STRING, value DOUBLE"
NODES = "id STRING, label STRING, pk STRING, country STRING, sector STRING, id_str STRING"
INDICATORS = "country STRING, year INT, code STRING, value DOUBLE"
ECONOMIES = "id STRING, region STRING, is_aggregate BOOLEAN"
PORT_TRADE = "commodity STRING, commodity_desc STRING, cty_code STRING, month STRING, value DOUBLE"
NATIONAL = "country STRING, year INT, row STRING, col STRING, value DOUBLE"
METRICS_LOG = "name STRING, value DOUBLE, step BIGINT"
#: Metric columns of a results file.
TEST_METRICS = "STRUCT<direction_acc: DOUBLE, gain_dir_acc: DOUBLE, drop_dir_acc: DOUBLE, drop_f1: DOUBLE, r2: DOUBLE, rmse: DOUBLE, mae: DOUBLE, smape: DOUBLE, target_neg_frac: DOUBLE, pred_neg_frac: DOUBLE>"
RESULTS = f"test_metrics {TEST_METRICS}, best_val_metrics MAP<STRING, DOUBLE>, best_epoch BIGINT, args MAP<STRING, STRING>"


def require(df, schema_ddl: str):
    """df, if it has the named columns with these types; an error that names the others."""
    from pyspark.sql.types import StructType

    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(schema_ddl) if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"missing or of another type: {', '.join(wrong)}")
    return df
