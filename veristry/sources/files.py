"""CSV registries in, exports out, and key-latest tables on plain Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_registry(spark: SparkSession, path: str, columns: list[str], mapping: dict[str, Column | str], admit: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV with a header, mapped to canonical columns, and the lines that could not be read.

    Every source column is read as text and trimmed; blank and 'N/A' are null.
    ``mapping`` gives each canonical column's expression over the source
    columns; ``admit`` drops source rows for which it isn't true.
    """
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _bad string"
    raw = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("columnNameOfCorruptRecord", "_bad").csv(path)
    clean = [F.when(F.upper(F.trim(f"`{c}`")).isin("", "N/A"), None).otherwise(F.trim(f"`{c}`")).alias(c) for c in columns]
    # Spark reads the column of bad lines only beside others
    others = F.concat_ws("", *[F.col(f"`{c}`") for c in columns]) >= ""
    good, broken = raw.where(F.col("_bad").isNull() & others).select(clean), F.col("_bad").isNotNull() & others
    good = good.where(admit) if admit is not None else good
    return good.select([(F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in mapping.items()]), raw.where(broken).select(F.col("_bad").alias("line"))


def read_strict(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a text file in which every field is quoted and none holds a quote, by position; and the lines of any other form."""
    pattern = "^" + ",".join(['"([^"]*)"'] * len(columns)) + "$"
    lines = spark.read.text(path)
    fits = F.col("value").rlike(pattern)
    return lines.where(fits).select([F.regexp_extract("value", pattern, k).alias(c) for k, c in enumerate(columns, 1)]), lines.where(~fits).select(F.col("value").alias("line"))


def append_audited(rows: DataFrame, path: str) -> DataFrame:
    """Appends to the table at ``path``; one row with its number of rows before, the rows added and the rows after."""
    spark = rows.sparkSession
    count = lambda: spark.read.schema(rows.schema).parquet(path).count()
    before = count()
    rows.write.mode("append").parquet(path)
    after = count()
    return spark.range(1).select(F.lit(before).cast("long").alias("before"), F.lit(after - before).cast("long").alias("added"), F.lit(after).cast("long").alias("after"))


def delete_state(state: str, registry: DataFrame, matches: DataFrame, imports: DataFrame) -> dict[str, DataFrame]:
    """The tables without a state: its matches, then its registry rows, then imports whose name or notes name it."""
    gone = registry.where(F.col("state") == state)
    named = F.coalesce(F.lower("name").contains(state.lower()), F.lit(False)) | F.coalesce(F.lower("notes").contains(state.lower()), F.lit(False))
    return {"matches": delete_keys(matches, gone.select(F.col("id").alias("registry_id")), ["registry_id"]), "registry": registry.where(~F.col("state").eqNullSafe(state)), "imports": imports.where(~named)}


def first_by_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each source key; rows without a key are kept."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | F.col(key).isNull()).drop("_n")


def source_id(name: Column, given: Column, state: Column) -> Column:
    """The given id, else the name's number, else a hash of state and name, which doesn't depend on the row's place."""
    number = F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit(""))
    return F.coalesce(F.nullif(given, F.lit("")), number, F.concat(state, F.lit("-"), F.substring(F.sha2(F.lower(name), 256), 1, 12)))


def clean_phone(phone: Column, area: str = "000") -> Column:
    """(aaa) nnn-nnnn from 10 digits, or from 7 with the default area code; else null."""
    d = F.regexp_replace(phone, r"\D", "")
    d = F.when(F.length(d) == 7, F.concat(F.lit(area), d)).when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) == 10, F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4)))


def with_raw(rows: DataFrame, batch: str) -> DataFrame:
    """Rows with their batch id and the whole record as JSON."""
    return rows.withColumn("raw_data", F.to_json(F.struct(*rows.columns))).withColumn("import_batch_id", F.lit(batch))


def not_loaded(incoming: DataFrame, loaded: DataFrame, by: str = "state") -> DataFrame:
    """Incoming rows of groups of which nothing is loaded yet."""
    return incoming.join(loaded.select(by).distinct(), by, "left_anti")


def import_audit(incoming: DataFrame, loaded: DataFrame) -> DataFrame:
    """One row: records given, records added, and a checksum that doesn't depend on their order."""
    return incoming.agg(F.count("*").alias("records"), F.count_distinct("state").alias("states"), F.sum(F.crc32(F.encode(F.concat_ws("|", "id", "state", "district_name"), "UTF-8"))).alias("checksum")).crossJoin(loaded.agg(F.count("*").alias("before")))


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], keep_first: list[str]) -> DataFrame:
    """Old and new rows, one for each key: the new row's values, but the old row's for ``keep_first``."""
    o = old.select(*[F.col(c).alias(f"_old_{c}") for c in old.columns])
    j = new.join(o, [new[k] == o[f"_old_{k}"] for k in keys], "full")
    known = F.col(keys[0]).isNotNull()
    return j.select([F.when(F.col(f"_old_{keys[0]}").isNotNull() & (F.lit(c in keep_first) | ~known), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) for c in old.columns])


def delete_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without those of the given keys, as for a state or a batch that is taken back."""
    return rows.join(gone.select(keys).distinct(), keys, "left_anti")


def export_csv(rows: DataFrame, path: str, names: dict[str, str] | None = None, quote_all: bool = False) -> None:
    """Writes CSV with a header; quotes inside values are doubled; ``names`` renames columns."""
    out = rows.select([F.col(c).alias((names or {}).get(c, c)) for c in rows.columns])
    out.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", quote_all).csv(path)


def backfill_sites(registry: DataFrame, states: list[str] | None = None) -> DataFrame:
    """Registry rows whose missing web site is filled from the administrator's e-mail domain, personal domains aside."""
    from ..functions.urls import mail_domain

    d = mail_domain(F.col("email"))
    ok = F.col("website_url").isNull() & d.isNotNull()
    ok = ok & F.col("state").isin(states) if states else ok
    return registry.withColumn("filled", F.coalesce(ok, F.lit(False))).withColumn("website_url", F.when(ok, F.concat(F.lit("https://www."), d)).otherwise(F.col("website_url")))
