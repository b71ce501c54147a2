"""Fixed schemas of the race tables and of the report table.

Column names are those the course statistics use; ``4c`` (fourth-corner
position) is stored as ``corner4``.  Times and carried weights are
DECIMAL(4,1) so bucket edges such as ``32.4 BETWEEN 32.0 AND 32.4`` compare
exactly.
"""

from pyspark.sql.types import (
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

DEC41 = DecimalType(4, 1)

RACE = StructType([
    StructField("race_id", LongType(), False),
    StructField("place_id", IntegerType()),
    StructField("length", IntegerType()),
    StructField("race_type", StringType()),
    StructField("turf_cond", StringType()),
    StructField("days", IntegerType()),
    StructField("name", StringType()),
    StructField("date_and_time", TimestampNTZType()),
    StructField("circling", StringType()),
    StructField("terms", StringType()),
    StructField("race_rank", StringType()),
])

RESULT = StructType([
    StructField("seq", LongType()),
    StructField("race_id", LongType(), False),
    StructField("horse_no", IntegerType()),
    StructField("horse_id", LongType()),
    StructField("jockey_id", LongType()),
    StructField("arrival_order", IntegerType()),
    StructField("frame_no", IntegerType()),
    StructField("popularity_order", IntegerType()),
    StructField("horse_sex", StringType()),
    StructField("horse_weight", IntegerType()),
    StructField("horse_age", IntegerType()),
    StructField("jokey_weight", DEC41),
    StructField("corner4", IntegerType()),
    StructField("seconds_3f", DEC41),
])

REFUND = StructType([
    StructField("race_id", LongType()),
    StructField("horse_no", IntegerType()),
    StructField("ticket_type", IntegerType()),
    StructField("refund", LongType()),
])

HORSE = StructType([StructField("id", LongType())])

JOCKEY = StructType([
    StructField("id", LongType()),
    StructField("name", StringType()),
])

MASTER_PLACE = StructType([
    StructField("id", IntegerType()),
    StructField("name", StringType()),
])

ANALYSIS = StructType([
    StructField("analysis_key", StringType()),
    StructField("place_id", IntegerType()),
    StructField("length", IntegerType()),
    StructField("memo", StringType()),
    StructField("turf_cond", StringType()),
    StructField("race_type", StringType()),
    StructField("days", StringType()),
    StructField("data", StringType()),
])

TABLE_SCHEMAS = {
    "race": RACE,
    "result": RESULT,
    "refund": REFUND,
    "horse": HORSE,
    "jockey": JOCKEY,
    "master_place": MASTER_PLACE,
}

# Ticket types of the refund table.
WIN_TICKET = 1
PLACE_TICKET = 2
