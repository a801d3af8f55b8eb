"""CSV export of any result."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no nested values: text lists are joined, other nesting becomes JSON."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            columns.append(F.array_join(field.name, ",").alias(field.name))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            columns.append(F.to_json(field.name).alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


# Microseconds survive the round trip, quotes are doubled as CSV readers expect,
# and the null mark keeps null apart from the empty text.
OPTIONS = {
    "header": "true",
    "escape": '"',
    "nullValue": r"\N",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}


def export_csv(df: DataFrame, path: str) -> None:
    _flat(df).write.mode("overwrite").options(**OPTIONS).csv(path)


def read_csv_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**OPTIONS).csv(path)
