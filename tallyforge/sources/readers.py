"""Tables, CSV files, the star schema as transactions, and its dirty twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.exact import SENTINEL
from tallyforge.sources.schema import COLUMNS, TERRITORIES, raw_schema, validate_schema

FORMATS = ("parquet", "orc", "json", "csv", "delta")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A stored table. Delta needs its package on the classpath and says so where it is not."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; one of {', '.join(FORMATS)}")
    try:
        return spark.read.format(kind).load(path)
    except Exception as error:
        if kind == "delta" and "delta" in str(error).lower():
            raise ImportError("the delta format needs the Delta Lake package on Spark's classpath; parquet is always there") from error
        raise


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, check_header: bool = True) -> DataFrame:
    """A CSV file with header under a fixed schema; malformed rows stay, with nulls and their text in _corrupt_record.

    The schema binds by position, so the header's names are checked first.
    """
    schema = schema or raw_schema()
    if check_header:
        names = spark.read.option("header", True).csv(path).columns
        wrong = [f"{have} for {want}" for have, want in zip(names, schema.names) if have != want]
        if wrong or len(names) < len(schema.names):
            from tallyforge.sources.schema import SchemaValidationError

            raise SchemaValidationError(f"header of {path}: {'; '.join(wrong) or 'too few columns'}")
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").schema(corrupt).csv(path)


def ingest(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Checked raw transactions of a CSV file and the row counts; an empty file raises.

    The file is parsed once for counting and once by whoever uses the rows; nothing is cached.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    parsed = read_csv(spark, path)
    # The parser tells corrupt rows by the columns that are asked for, so all are.
    rows, corrupt, _ = parsed.agg(F.count(F.lit(1)), F.count("_corrupt_record"), F.bit_xor(F.xxhash64(*COLUMNS))).first()
    if not rows:
        raise ValueError(f"{path} holds no rows")
    clean = parsed.drop("_corrupt_record")
    return clean, {"rows": rows, "corrupt": corrupt, "extra": validate_schema(clean, raw_schema())}


def region_dimension(spark: SparkSession, territories=TERRITORIES) -> DataFrame:
    """The static dimension. A VALUES relation carries exact statistics, so joins pick it as build side unaided."""
    rows = ", ".join(f"('{r}', '{t}')" for r, t in territories)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS d(region, sales_territory)")


def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    places = table("nation").join(F.broadcast(table("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = table("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "r_name")
    return (
        table("lineitem")
        .join(table("part").select("p_partkey", "p_type", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema as cleansed transactions. A few customers are unknown and a few dates missing, by key."""
    known = F.when(F.col("o_custkey") % 97 == 0, F.lit(SENTINEL)).otherwise(F.concat(F.lit("CUST"), F.col("o_custkey").cast("string")))
    return _star(spark, sf_dir).select(
        F.concat(F.lit("TXN"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("transaction_id"),
        known.alias("customer_id"),
        F.concat(F.lit("PROD"), F.col("l_partkey").cast("string")).alias("product_id"),
        F.col("p_type").alias("category"),
        F.when(F.col("o_orderkey") % 211 != 0, F.col("o_orderdate").cast("date")).alias("purchase_date"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("p_retailprice").alias("unit_price"),
        F.col("l_extendedprice").alias("total_amount"),
        F.col("r_name").alias("region"),
        F.col("o_orderpriority").alias("payment_method"),
        (18 + F.col("o_custkey") % 63).cast("int").alias("customer_age"),
        F.col("c_mktsegment").alias("customer_segment"),
    )


#: Formats in which the dirty twin writes dates, dealt by h % 8.
WRITTEN_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd MMM yyyy", "MMMM dd, yyyy", "yyyy-MM-dd'T'HH:mm:ss", "MM-dd-yyyy HH:mm")


def dirty_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transactions with every kind of defect, in bands of an integer hash of the keys (h, 0 to 999)."""
    star = _star(spark, sf_dir)
    h = (31 * F.col("l_orderkey") + 17 * F.col("l_partkey") + 7 * F.col("l_suppkey") + F.col("l_linenumber")) % 1000
    star = star.withColumn("h", h)
    band = lambda low, high: F.col("h").between(low, high)
    date = F.lit(None).cast("string")
    for k, f in enumerate(WRITTEN_FORMATS):
        date = F.when(F.col("h") % 8 == k, F.date_format(F.col("o_orderdate").cast("timestamp"), f)).otherwise(date)
    number = lambda c: F.col(c).cast("double")
    out = star.select(
        F.concat(F.lit("TXN"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("transaction_id"),
        F.when(~band(100, 104), F.concat(F.lit("CUST"), F.col("o_custkey").cast("string"))).alias("customer_id"),
        F.concat(F.lit("PROD"), F.col("l_partkey").cast("string")).alias("product_id"),
        F.when(band(110, 129), None).when(band(130, 139), F.upper("p_type")).when(band(140, 149), F.lower("p_type")).when(band(150, 159), F.concat(F.lit("  "), "p_type", F.lit(" "))).when(band(160, 164), F.lit("mystery_box")).otherwise(F.col("p_type")).alias("category"),
        F.when(band(0, 9), F.lit("31/02/2024")).when(band(10, 24), None).otherwise(date).alias("purchase_date"),
        F.when(band(200, 209), None).when(band(210, 214), -1.0).when(band(215, 219), number("l_quantity") * 100).otherwise(number("l_quantity")).alias("quantity"),
        number("p_retailprice").alias("unit_price"),
        F.when(band(300, 319), None).when(band(320, 324), number("l_extendedprice") * 10).when(band(325, 329), -number("l_extendedprice")).otherwise(number("l_extendedprice")).alias("total_amount"),
        F.when(band(400, 409), None).when(band(410, 419), F.regexp_replace(F.lower("r_name"), " ", "_")).otherwise(F.col("r_name")).alias("region"),
        F.when(band(430, 434), None).when(band(435, 444), F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("payment_method"),
        F.when(band(500, 509), None).when(band(510, 514), 200.0).when(band(515, 519), -5.0).otherwise((18 + F.col("o_custkey") % 63).cast("double")).alias("customer_age"),
        F.when(band(520, 524), None).otherwise(F.col("c_mktsegment")).alias("customer_segment"),
        "h",
    )
    return out.drop("h").unionByName(out.filter("h < 10").drop("h"))
