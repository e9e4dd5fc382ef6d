"""Position-controlled key-value retrieval examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as T

#: What a prompt begins with; a fixed value.
PREFIX = "Extract the value corresponding to the specified key from the records below. Return only the value.\n\nRecords:\n"


def sampled(rows: DataFrame, index: str, n: int, seed: int) -> DataFrame:
    """n rows by the order of a seeded hash, with sample_index from 0: the same rows wherever the seed is the same."""
    picked = rows.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(index).cast("string")))).orderBy("__h", index).limit(n)
    order = F.row_number().over(_once("__h", index))  # n rows
    return picked.withColumn("sample_index", order - 1).drop("__h")


def _once(*order: str):
    from pyspark.sql import Window

    return Window.orderBy(*order)


def grid(spark, sizes: list[int], positions: list[float]) -> DataFrame:
    """Every size with every position: the cells of a benchmark, a literal table."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("num_keys"), F.lit(float(p)).alias("position_ratio")) for n in sizes for p in positions]))
    return spark.range(1).select(cells.alias("c")).select("c.*")


def with_cells(rows: DataFrame, sizes: list[int], positions: list[float]) -> DataFrame:
    """Each row once for every cell."""
    cells = F.array(*[F.struct(F.lit(n).alias("num_keys"), F.lit(float(p)).alias("position_ratio")) for n in sizes for p in positions])
    return rows.withColumn("c", F.explode(cells)).select(*rows.columns, "c.num_keys", "c.position_ratio")


def cropped(records: Column, key: Column, n: Column) -> Column:
    """The record of `key`, then the first n - 1 others."""
    own, rest = F.filter(records, lambda r: r["key"] == key), F.filter(records, lambda r: r["key"] != key)
    return F.concat(F.slice(own, 1, 1), F.slice(rest, F.lit(1), F.greatest(n - 1, F.lit(0))))


def moved(records: Column, key: Column, at: Column) -> Column:
    """The records with that of `key` at index `at`; fails if there is none."""
    own, rest = F.filter(records, lambda r: r["key"] == key), F.filter(records, lambda r: r["key"] != key)
    return F.when(F.size(own) == 0, F.raise_error(F.concat(F.lit("target key not found: "), key)).cast("array<struct<key:string,value:string>>")).otherwise(
        F.concat(F.slice(rest, F.lit(1), at), F.slice(own, 1, 1), F.slice(rest, at + 1, F.size(records)))
    )


def line(r: Column) -> Column:
    return F.concat(F.lit("Key: "), r["key"], F.lit(" | Value: "), r["value"], F.lit("\n"))


def body(records: Column) -> Column:
    return F.array_join(F.transform(records, line), "")


def prompt(records: Column, key: Column, prefix: str = PREFIX) -> Column:
    return F.concat(F.lit(prefix), body(records), F.lit("\nQuestion: What is the value associated with key "), key, F.lit("?\nAnswer:"))


def examples(rows: DataFrame, sizes: list[int], positions: list[float], name: str = "kv") -> DataFrame:
    """rows (source_index, sample_index, key, value, records) -> an example for each row and cell, records cropped to the
    cell's size and the target moved to its position; token counts are of the rendered texts."""
    each = with_cells(rows, sizes, positions).withColumn("records", cropped(F.col("records"), F.col("key"), F.col("num_keys")))
    each = each.withColumn("target_index", T.target_index(F.col("position_ratio"), F.size("records"))).withColumn("records", moved(F.col("records"), F.col("key"), F.col("target_index")))
    start = T.token_count(F.concat(F.lit(PREFIX), body(F.slice("records", F.lit(1), F.col("target_index")))))
    own = T.token_count(line(F.get("records", F.col("target_index"))))
    return (
        each.withColumn("prompt", prompt(F.col("records"), F.col("key")))
        .withColumn("actual_prompt_tokens", T.token_count(F.col("prompt")))
        .withColumn("target_record_token_start", start)
        .withColumn("target_record_token_end", F.col("target_record_token_start") + own)
        .withColumn("example_id", F.format_string(f"{name}%d_pos%.2f_sample%d", "num_keys", "position_ratio", "sample_index"))
        .drop("records")
    )


def revalued(rows: DataFrame) -> DataFrame:
    """rows (example_id, key, prompt) with every record's value replaced by five digits of a hash of its key and example.

    The prompt is rebuilt from its lines; `value` becomes the target's new one.
    """
    lines = F.split("prompt", "\n")
    pattern = r"^Key: (.*?) \| Value: (.+)$"

    def fresh(key: Column) -> Column:
        digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("example_id"), key)), 1, 8), 16, 10).cast("long")
        return (digits % 90_000 + 10_000).cast("string")

    def renewed(x: Column) -> Column:
        key = F.regexp_extract(x, pattern, 1)
        return F.when(x.rlike(pattern), F.concat(F.lit("Key: "), key, F.lit(" | Value: "), fresh(key))).otherwise(x)

    return rows.withColumn("prompt", F.array_join(F.transform(lines, renewed), "\n")).withColumn("value", fresh(F.col("key")))


def samples_of(spark, samples: int | DataFrame) -> DataFrame:
    """(sample_index): the numbers below `samples`, or those that a table gives."""
    return samples.select(F.col("sample_index").cast("long")) if isinstance(samples, DataFrame) else spark.range(samples).withColumnRenamed("id", "sample_index")


#: Parts for each core of narrow rows that much is made of.
PARTS = 4


def dealt(rows: DataFrame) -> DataFrame:
    """rows, narrow ones of which many large ones are made, dealt to all cores: a file of few bytes, or of one row group, is else one task."""
    return rows.repartition(PARTS * rows.sparkSession.sparkContext.defaultParallelism)


def mini(spark, sizes: list[int], positions: list[float], samples: int | DataFrame, seed: int) -> DataFrame:
    """Examples of n short records: eight letters and eight digits from hashes of the sample, distinct by their index in them.

    A sample's records are the same at all positions: they are made once for each size, then placed. The first is asked for.
    """
    n = F.col("num_keys")

    def h(i: Column, what: str) -> Column:
        return F.md5(F.concat_ws(":", F.lit(f"{seed}{what}"), n.cast("string"), F.col("sample_index").cast("string"), i.cast("string")))

    def key(i: Column) -> Column:
        return F.concat(F.translate(F.substring(h(i, "k"), 1, 6), "0123456789", "ghijklmnop"), F.lpad(F.translate(i.cast("string"), "0123456789", "qrstuvwxyz"), 3, "q"))

    def value(i: Column) -> Column:
        return F.concat(F.lpad((F.conv(F.substring(h(i, "v"), 1, 6), 16, 10).cast("long") % 90_000 + 10_000).cast("string"), 5, "0"), F.lpad(i.cast("string"), 3, "0"))

    records = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(key(i).alias("key"), value(i).alias("value")))
    made = dealt(samples_of(spark, samples)).withColumn("num_keys", F.explode(F.array(*[F.lit(x) for x in sizes]))).withColumn("records", records)
    made = made.select("sample_index", "num_keys", F.get("records", F.lit(0)).alias("own"), F.transform("records", line).alias("lines"))
    rows = made.withColumn("position_ratio", F.explode(F.array(*[F.lit(float(p)) for p in positions]))).withColumn("target_index", T.target_index(F.col("position_ratio"), n))
    rows = rows.select("*", F.col("own.key").alias("key"), F.col("own.value").alias("value"))
    at = F.col("target_index")
    placed = F.concat(F.slice("lines", F.lit(2), at), F.slice("lines", 1, 1), F.slice("lines", at + 2, n))
    question = F.concat(F.lit("\nQuestion: What is the value associated with key "), F.col("key"), F.lit("?\nAnswer:"))
    record = line(F.struct(F.lit("a").alias("key"), F.lit("1").alias("value")))  # keys are letters and values digits, so every line has as many tokens
    return (
        rows.withColumn("prompt", F.concat(F.lit(PREFIX), F.array_join(placed, ""), question))
        .withColumn("actual_prompt_tokens", T.token_count(F.lit(PREFIX)) + n * T.token_count(record) + T.token_count(question))
        .withColumn("example_id", F.format_string("mini%d_pos%.2f_sample%d", "num_keys", "position_ratio", "sample_index"))
        .withColumnRenamed("num_keys", "num_records")
        .select("example_id", "num_records", "position_ratio", "sample_index", "target_index", "key", "value", "prompt", "actual_prompt_tokens")
    )


def budget_fit(lines: DataFrame, fixed: int, targets: list[int]) -> DataFrame:
    """lines (i, n): tokens of record line i, from 1 -> for each target the count of records whose prompt comes closest.

    Token counts of lines add up, as no token spans a line end; running totals are taken in stretches of i, so lines may be
    any number. The first of equally close counts wins.
    """
    from lexforge.operators.prefix import with_running_total

    upto = with_running_total(lines, [], "i", "n", "before").withColumn("total", F.col("before") + F.col("n") + fixed)
    each = upto.withColumn("target_tokens", F.explode(F.array(*[F.lit(t) for t in targets])))
    delta = F.abs(F.col("total") - F.col("target_tokens"))
    return each.groupBy("target_tokens").agg(F.min_by(F.struct("i", "total"), F.struct(delta, F.col("i"))).alias("b")).select("target_tokens", F.col("b.i").alias("num_records"), F.col("b.total").alias("tokens"))


def needles(spark, lengths: list[int], positions: list[float], samples: int | DataFrame, seed: int) -> DataFrame:
    """Needle probes: numbered filler lines up to a token budget with one line of evidence at a share of it.

    A cell's filler is the same for all samples: it is made once for each cell, and the cells, a literal table, are broadcast. Tokens
    do not span line ends, so the counts of the parts add up.
    """
    filler = lambda a, n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("Reference item "), F.lpad((i + a).cast("string"), 5, "0"), F.lit(" is on file.\n"))), "")
    per = 7  # tokens of a filler line
    fixed = 6 + 9  # of the evidence and of the question
    total = F.greatest(F.lit(2), F.floor((F.col("context_length_target") - fixed) / per)).cast("int")
    cells = grid(spark, lengths, positions).withColumnRenamed("num_keys", "context_length_target")
    cells = cells.withColumn("lines", total).withColumn("ahead", F.greatest(F.lit(1), F.floor(F.col("lines") * F.col("position_ratio")).cast("int"))).withColumn("after", F.greatest(F.lit(1), F.col("lines") - F.col("ahead")))
    tail = F.concat(filler(F.col("ahead"), F.col("after")), F.lit("Question: What is the access code?\nAnswer:"))
    cells = cells.withColumns({"before": filler(F.lit(0), F.col("ahead")), "tail": tail})
    cells = cells.withColumns({"evidence_token_start": T.token_count(F.col("before")), "tail_tokens": T.token_count(F.col("tail"))})
    rows = dealt(samples_of(spark, samples)).join(F.broadcast(cells))
    code = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("context_length_target").cast("string"), F.format_string("%.2f", "position_ratio"), F.col("sample_index").cast("string"))), 1, 8), 16, 10).cast("long")
    evidence = F.concat(F.lit("The access code is "), F.col("answer"), F.lit(".\n"))
    return (
        rows.withColumn("answer", F.lpad((code % 1_000_000).cast("string"), 6, "0"))
        .withColumn("evidence", evidence)
        .withColumn("prompt", F.concat("before", "evidence", "tail"))
        .withColumn("evidence_token_end", F.col("evidence_token_start") + T.token_count(F.col("evidence")))
        .withColumn("actual_prompt_tokens", F.col("evidence_token_end") + F.col("tail_tokens"))
        .withColumn("example_id", F.format_string("needle%d_pos%.2f_sample%d", "context_length_target", "position_ratio", "sample_index"))
        .select("example_id", "context_length_target", "position_ratio", "sample_index", "answer", "prompt", "evidence_token_start", "evidence_token_end", "actual_prompt_tokens")
    )
