"""Message tables from tables, lines and streams, and what emissions are written to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a message table.
MESSAGE = "seq bigint, ts_ms bigint, wall_ms bigint, subject string, payload string, reply_to string, replaying boolean"


def messages(df: DataFrame, seq: Column | str, ts_ms: Column, subject: Column, payload: Column, reply_to: Column | None = None, wall_ms: Column | None = None, replaying: Column | None = None) -> DataFrame:
    """A message table from any table."""
    return df.select(
        (F.col(seq) if isinstance(seq, str) else seq).cast("bigint").alias("seq"), ts_ms.cast("bigint").alias("ts_ms"), (ts_ms if wall_ms is None else wall_ms).cast("bigint").alias("wall_ms"),
        subject.cast("string").alias("subject"), F.coalesce(payload.cast("string"), F.lit("")).alias("payload"),
        (F.lit(None) if reply_to is None else reply_to).cast("string").alias("reply_to"), F.coalesce(F.lit(False) if replaying is None else replaying, F.lit(False)).alias("replaying"),
    )


def events(spark: SparkSession, sf_dir: str, payload: str = "value", per_user: bool = True) -> DataFrame:
    """The ``events`` table as messages ``events.<type>.<user>`` (or ``events.<type>``)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    ts = F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp"))
    subject = F.concat(F.lit("events."), F.col("event_type"), F.lit("."), F.col("user_id").cast("string")) if per_user else F.concat(F.lit("events."), F.col("event_type"))
    return messages(df, "event_id", ts, subject, F.col(payload))


def lines(spark: SparkSession, rows: list[str], start_ms: int = 1000, step_ms: int = 1) -> DataFrame:
    """``SUBJECT|payload`` lines as messages, a step apart."""
    made = []
    for k, line in enumerate(rows):
        subject, _, payload = line.partition("|")
        made.append((k, start_ms + k * step_ms, start_ms + k * step_ms, subject.strip(), payload, None, False))
    return spark.createDataFrame(made, MESSAGE)


def clamped(df: DataFrame) -> DataFrame:
    """Messages whose times never go back: each takes the latest time of its subject so far."""
    from pyspark.sql import Window

    w = Window.partitionBy("subject").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("ts_ms", F.max("ts_ms").over(w))


def kafka_options(config: dict) -> dict[str, str]:
    """Options of Spark's Kafka source or sink from an import or export form."""
    out = {"kafka.bootstrap.servers": ",".join(s.split("://")[-1] for s in config.get("servers", []))}
    if config.get("user"):
        out["kafka.sasl.jaas.config"] = f'org.apache.kafka.common.security.plain.PlainLoginModule required username="{config["user"]}" password="{config.get("password", "")}";'
    if config.get("tls"):
        out["kafka.security.protocol"] = "SASL_SSL" if config.get("user") else "SSL"
    if config.get("connect-timeout-ms"):
        out["kafka.socket.connection.setup.timeout.ms"] = str(int(config["connect-timeout-ms"]))
    if config.get("reconnect-wait-ms"):
        out["kafka.reconnect.backoff.ms"] = str(int(config["reconnect-wait-ms"]))
    if config.get("max-pending"):
        out["maxOffsetsPerTrigger"] = str(int(config["max-pending"]))
    return out


def import_stream(spark: SparkSession, entry: dict, config: dict) -> DataFrame:
    """A live message table from one entry of an import form; topics hold the subject as their key.
    Catch-up starts at the earliest offset, and the checkpoint takes the place of acknowledgements."""
    reader = spark.readStream.format("kafka")
    for k, v in kafka_options(config).items():
        reader = reader.option(k, v)
    topic = entry.get("stream") or (entry.get("subjects") or [entry["subject"]])[0].split(".")[0]
    raw = reader.option("subscribe", topic).option("startingOffsets", "earliest" if entry.get("stream") else "latest").load()
    return messages(raw, F.col("offset"), F.unix_millis("timestamp"), F.col("key").cast("string"), F.col("value").cast("string"))


def export_rows(emissions: DataFrame, config: dict) -> DataFrame:
    """Rows for Spark's Kafka sink, with the origin and replay headers if the form asks for them."""
    headers = []
    if config.get("origin-header"):
        headers.append(F.struct(F.lit(config["origin-header"]).alias("key"), F.lit("tidegate").cast("binary").alias("value")))
    if config.get("replay-header") and "replaying" in emissions.columns:
        headers.append(F.struct(F.lit(config["replay-header"]).alias("key"), F.col("replaying").cast("string").cast("binary").alias("value")))
    columns = [F.element_at(F.split("subject", r"\."), 1).alias("topic"), F.col("subject").alias("key"), F.col("payload").alias("value")]
    return emissions.select(*columns, *([F.array(*headers).alias("headers")] if headers else []))


def envelopes(rows: DataFrame) -> DataFrame:
    """One JSON text ``{"subject", "payload"}`` per row; payloads that hold a NUL are skipped."""
    return rows.where(~F.contains("payload", F.lit("\0"))).select(F.to_json(F.struct("subject", "payload")).alias("value"))
