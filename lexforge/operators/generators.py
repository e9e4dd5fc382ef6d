"""Retrieval training data: templates, groups of records with a query for each, near-miss values, fits to a length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators.retrieval import dealt

#: Letters of generated values, without I and O; fixed values.
LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
#: Task, split, header, line and end of a prompt; fixed values.
TEMPLATES = (
    ("kv_lookup", "train", "Record list:\n", "{key} = {value}\n", "The stored value for {key} is"),
    ("kv_lookup", "eval", "Catalog extract:\n", "entry {key} stores value {value}\n", "The catalog value assigned to {key} is"),
    ("passkey", "train", "Archive notes:\n", "The active recovery code assigned to {key} is {value}.\n", "When {key} is summarized, the active recovery code is"),
    ("passkey", "eval", "Recovery file:\n", "For {key}, the active recovery marker is {value}.\n", "The active marker repeated for {key} is"),
    ("copy_span", "train", "Verification passages:\n", 'The verification phrase for {key} is "{value}".\n', "The verification phrase for {key} is repeated as"),
    ("copy_span", "eval", "Copied phrase archive:\n", 'Channel {key} carries the exact phrase "{value}".\n', "The exact phrase copied for {key} is"),
    ("ledger_lookup", "train", "Ledger records:\n", "ledger {key} -> confirmation {value}\n", "The confirmation attached to ledger {key} is"),
    ("ledger_lookup", "eval", "Audit ledger excerpt:\n", "confirmation attached to {key}: {value}\n", "The audit confirmation for {key} is"),
)
#: A record with more fields than its value: task, split, header, line and end of a prompt, and what else fills a line; fixed values.
MULTI_FIELD = (
    ("multi_field", "train", "User records:\n", "ID {key} | city: {city} | token: {value} | color: {color}\n", "The token for ID {key} is"),
    ("multi_field", "eval", "Account table:\n", "account {key}; token={value}; city={city}; color={color}\n", "The account token for {key} is"),
)
#: Lines of the records that are not asked for, where they differ from the line of the one that is; fixed values.
DECOYS = {("passkey", "train"): "A decoy recovery code for {key} is {value}.\n", ("passkey", "eval"): "Inactive marker for {key}: {value}.\n"}
CITIES, COLORS = ("Oslo", "Lima", "Cairo", "Kyoto", "Quito", "Perth"), ("red", "blue", "green", "amber", "violet", "silver")
#: Where the record stands in long-context training, and the mixtures of lengths, answers and templates there; fixed values.
DENSE_POSITIONS = (("p02", 0.02), ("p05", 0.05), ("p10", 0.10), ("p25", 0.25), ("p50", 0.50), ("p75", 0.75), ("p90", 0.90), ("p95", 0.95), ("p98", 0.98))
LENGTH_WEIGHTS = ((2048, 0.15), (3072, 0.35), (4096, 0.50))
ANSWER_WEIGHTS = (("alphanumeric", 0.60), ("number", 0.40))
TEMPLATE_WEIGHTS = (("kv_only", 0.70), ("record_kv", 0.20), ("hard_kv", 0.10))
FAMILIES = ("same_value_prefix", "same_value_suffix", "single_char_near_miss", "mixed_random")


def number(c: Column, salt: str, digits: int = 7) -> Column:
    """A number from the first hexadecimal digits of a hash of c and the salt."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), c)), 1, digits), 16, 10).cast("long")


def letter(n: Column) -> Column:
    return F.substring(F.lit(LETTERS), (n % len(LETTERS) + 1).cast("int"), F.lit(1))


def value_of(c: Column, kind: Column) -> Column:
    """A value for a seed string: five digits, or two letters, a dash and four digits."""
    digits = (number(c, "n") % 90_000 + 10_000).cast("string")
    mixed = F.concat(letter(number(c, "a")), letter(number(c, "b")), F.lit("-"), (number(c, "d") % 9_000 + 1_000).cast("string"))
    return F.when(kind == "number", digits).otherwise(mixed)


def mutated(value: Column, seed: Column) -> Column:
    """value with one letter or digit, picked by a hash of the seed, replaced by a different one."""
    places = F.filter(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(value, i, F.lit(1)).rlike("[A-Za-z0-9]"))
    at = F.get(places, (number(seed, "p") % F.size(places)).cast("int"))
    old, r = F.substring(value, at, F.lit(1)), number(seed, "r")
    index = F.instr(F.lit(LETTERS), old) - 1
    digit = ((F.coalesce(F.expr("null").cast("int"), F.when(old.rlike("[0-9]"), old).cast("int")) + 1 + r % 9) % 10).cast("string")
    other = F.when(index >= 0, letter(index + 1 + r % (len(LETTERS) - 1))).otherwise(letter(r))
    return F.overlay(value, F.when(old.rlike("[0-9]"), digit).otherwise(other), at, 1)


def near_misses(gold: Column, kind: Column, family: Column, seed: Column, n: int) -> Column:
    """n different values that are not the gold one, from twice as many tries; families keep its first or last three
    characters, change one, or mix changes with fresh values."""

    def one(i: Column) -> Column:
        s = F.concat(seed, F.lit(":"), i.cast("string"))
        fresh, near = value_of(s, kind), mutated(gold, s)
        return (
            F.when(family == "same_value_prefix", F.concat(F.substring(gold, 1, 3), F.substring(fresh, F.lit(4), F.length(fresh))))
            .when(family == "same_value_suffix", F.concat(F.substring(fresh, F.lit(1), F.length(fresh) - 3), F.substring(gold, -3, 3)))
            .when((family == "single_char_near_miss") | (number(s, "m") % 100 < 65), near)
            .otherwise(fresh)
        )

    tries = F.transform(F.sequence(F.lit(1), F.lit(2 * n + 4)), one)
    return F.slice(F.array_distinct(F.filter(tries, lambda x: x != gold)), 1, n)


def templates() -> Column:
    """An array of all templates as structs."""
    names = ("task_type", "split", "header", "line", "final")
    return F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, row)]) for row in TEMPLATES])


def filled(template: Column, key: Column, value: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{key}"), key), F.lit("{value}"), value)


def groups(spark: SparkSession, n: int | DataFrame, records: int, seed: int) -> DataFrame:
    """A group for each template and number below n, or each number `g` that a table gives: (group_id, task_type, split, answer_type, records of distinct keys, the template)."""
    numbers = n if isinstance(n, DataFrame) else spark.range(n).withColumnRenamed("id", "g")
    rows = dealt(numbers.select("g")).select("g", F.inline(templates()))
    gid = F.concat_ws("-", F.lit(str(seed)), "task_type", "split", F.col("g").cast("string"))
    rows = rows.withColumn("group_id", gid).withColumn("answer_type", F.when(number(F.col("group_id"), "t") % 100 < 60, "alphanumeric").otherwise("number"))

    def record(i: Column) -> Column:
        s = F.concat(F.col("group_id"), F.lit("/"), i.cast("string"))
        return F.struct(F.concat(letter(number(s, "k")), F.lpad((number(s, "l") % 1000).cast("string"), 3, "0"), F.lpad(i.cast("string"), 2, "0")).alias("key"), value_of(s, F.col("answer_type")).alias("value"))

    return rows.withColumn("records", F.transform(F.sequence(F.lit(0), F.lit(records - 1)), record)).drop("g")


def queries_of(rows: DataFrame) -> DataFrame:
    """Every record of a group as the gold one of a query; the other values are its distractors."""
    lines = F.transform("records", lambda r: filled(F.col("line"), r["key"], r["value"]))
    each = rows.select("*", F.explode(F.array(lines)).alias("__lines"))  # once for a group, not for each of its queries
    each = each.select("*", F.posexplode("records").alias("q", "r"))
    context = F.concat("header", F.array_join("__lines", ""))
    before = F.concat("header", F.array_join(F.slice("__lines", F.lit(1), F.col("q")), ""))
    own = F.get("__lines", F.col("q"))
    return (
        each.withColumn("prompt", F.concat(context, filled(F.col("final"), F.col("r.key"), F.col("r.value"))))
        .withColumn("evidence_token_start", T.token_count(before))
        .withColumn("evidence_token_end", F.col("evidence_token_start") + T.token_count(own))
        .withColumn("prompt_tokens", T.token_count(F.col("prompt")))
        .select(
            F.concat("group_id", F.lit("-q"), F.col("q").cast("string")).alias("example_id"),
            "task_type",
            "split",
            "answer_type",
            F.col("r.key").alias("key"),
            F.col("r.value").alias("gold_value"),
            F.transform(F.filter("records", lambda r, i: i != F.col("q")), lambda r: r["value"]).alias("distractor_values"),
            "prompt",
            "prompt_tokens",
            "evidence_token_start",
            "evidence_token_end",
            (F.col("prompt_tokens") - F.col("evidence_token_end")).alias("evidence_to_answer_distance"),
        )
    )


def fitted(rows: DataFrame, target: int, least: int) -> DataFrame:
    """rows (group_id, header, line, final, records) -> with `kept`, the most records, in order, whose prompt has `target` tokens
    at most, and `tokens`; groups that do not fit with `least` records are left out.

    A line's tokens do not depend on its neighbours, so a running sum over a group's lines replaces a search.
    """
    lines = rows.select("group_id", "final", "header", F.posexplode(F.transform("records", lambda r: T.token_count(filled(F.col("line"), r["key"], r["value"])))).alias("i", "n"), "records")
    key = F.get("records", F.lit(0))["key"]
    fixed = T.token_count(F.col("header")) + T.token_count(filled(F.col("final"), key, F.lit("")))
    run = lines.withColumn("tokens", fixed + F.sum("n").over(Window.partitionBy("group_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    best = run.filter(F.col("tokens") <= target).groupBy("group_id").agg(F.max("i").alias("i"), F.max("tokens").alias("tokens"))
    return best.filter(F.col("i") + 1 >= least).select("group_id", (F.col("i") + 1).alias("kept"), "tokens")


def counters(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n): one-dimensional counts, all in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    return rows.select(each.alias("c")).groupBy("c.dimension", "c.value").agg(F.count("*").alias("n"))


def weighted(c: Column, salt: str, choices: tuple[tuple[object, float], ...]) -> Column:
    """One of the choices by weight: a hash of c and the salt is a uniform number, and the first choice whose running weight
    reaches it is taken."""
    u = (number(c, salt) / float(1 << 28)) * sum(w for _, w in choices)
    out, upto = F.when(F.lit(False), F.lit(choices[0][0])), 0.0
    for value, w in choices[:-1]:
        upto += w
        out = out.when(u <= upto, F.lit(value))
    return out.otherwise(F.lit(choices[-1][0]))


#: Tokens of a line of filler.
FILLER_TOKENS = 8


def filler(label: Column, tokens: Column) -> Column:
    """Text of exactly so many tokens, single spaces between and a line end after; '' for none: numbered lines that a hash of the
    label varies, cut to the budget."""
    line = lambda i: F.array(*[F.lit(x) for x in ("The", "archive", "keeps", "note")], number(F.concat(label, F.lit("#"), i.cast("string")), "f").cast("string"), *[F.lit(x) for x in ("on", "file", ".")])
    lines = F.flatten(F.transform(F.sequence(F.lit(0), F.floor(tokens / FILLER_TOKENS).cast("int")), line))
    return F.when(tokens > 0, F.concat(F.array_join(F.slice(lines, F.lit(1), tokens), " "), F.lit("\n"))).otherwise("")


def decoy_line(task: Column, split: Column, line: Column) -> Column:
    """The line of records that are not asked for."""
    out = F.when(F.lit(False), "")
    for (t, s), x in DECOYS.items():
        out = out.when((task == t) & (split == s), x)
    return out.otherwise(line)


def filled_fields(template: Column, r: Column, seed: Column) -> Column:
    """A line with key, value, and a city and a color that a hash picks."""
    pick = lambda names, salt: F.element_at(F.array(*[F.lit(x) for x in names]), (number(F.concat(seed, r["key"]), salt) % len(names) + 1).cast("int"))
    return F.replace(F.replace(filled(template, r["key"], r["value"]), F.lit("{city}"), pick(CITIES, "city")), F.lit("{color}"), pick(COLORS, "color"))


def placed_blocks(rows: DataFrame, target: int, ratios: list[float]) -> DataFrame:
    """rows (group_id, task_type, split, header, line, final, records) -> an example for each group and ratio: the block of records,
    of which the first is asked for, with filler before and after it up to `target` tokens, the share `ratio` before.

    Budgets are what the block, the question and the answer leave; a block that is too long has no filler. Tokens do not
    span line ends, so the counts of the parts add up.
    """
    gold = F.get("records", F.lit(0))
    own = filled_fields(F.col("line"), gold, F.col("group_id"))
    rest = F.transform(F.slice("records", F.lit(2), F.size("records")), lambda r: filled_fields(decoy_line(F.col("task_type"), F.col("split"), F.col("line")), r, F.col("group_id")))
    at = (number(F.col("group_id"), "place") % F.size("records")).cast("int")
    each = rows.withColumn("ratio", F.explode(F.array(*[F.lit(float(x)) for x in ratios]))).withColumns({"own": own, "rest": rest, "at": at, "gold": gold["value"], "key": gold["key"]})
    each = each.withColumns({"ahead": F.concat("header", F.array_join(F.slice("rest", F.lit(1), F.col("at")), "")), "behind": F.array_join(F.slice("rest", F.col("at") + 1, F.size("rest")), "")})
    each = each.withColumn("tail", F.concat(F.lit("\nSummary line:\n"), F.replace("final", F.lit("{key}"), F.col("key"))))
    fixed = sum((T.token_count(F.col(x)) for x in ("ahead", "own", "behind", "tail", "gold")), F.lit(1))  # and a full stop
    each = each.withColumn("budget", F.greatest(F.lit(0), F.lit(target) - fixed).cast("int")).withColumn("before", F.floor(F.col("budget") * F.col("ratio")).cast("int"))
    # a step of their own: the prompt, which is counted twice, would be made again for each count
    fillers = F.struct(filler(F.concat("group_id", F.lit("-pre")), F.col("before")).alias("pre"), filler(F.concat("group_id", F.lit("-post")), F.col("budget") - F.col("before")).alias("post"))
    each = each.select("*", F.explode(F.array(fillers)).alias("f")).select("*", "f.pre", "f.post")
    start = T.token_count(F.col("pre")) + T.token_count(F.col("ahead"))
    out = each.select(
        F.format_string("%s-%.2f", "group_id", "ratio").alias("example_id"),
        "task_type",
        "split",
        "ratio",
        "key",
        F.col("gold").alias("gold_value"),
        F.concat("pre", "ahead", "own", "behind", "post", "tail").alias("prompt"),
        start.alias("evidence_token_start"),
        (start + T.token_count(F.col("own"))).alias("evidence_token_end"),
    )
    out = out.select("*", F.explode(F.array(T.token_count(F.col("prompt")))).alias("prompt_tokens"))
    return out.withColumn("full_tokens", F.col("prompt_tokens") + T.token_count(F.col("gold_value")) + 1)


def with_shared_filler(queries: DataFrame, groups: DataFrame, tokens: int) -> DataFrame:
    """queries_of() with the same filler before each prompt of a group: made once for each group and joined, not once for each query."""
    made = groups.select("group_id", F.explode(F.array(filler(F.concat("group_id", F.lit("-pre")), F.lit(tokens)))).alias("__f"))
    made = made.select("group_id", "__f", F.explode(F.array(T.token_count(F.col("__f")))).alias("__n"))  # once for each group
    q = queries.withColumn("group_id", F.regexp_replace("example_id", r"-q\d+$", ""))
    # both sides are estimated by the small table they are made of, and fillers of all groups are no broadcast
    out = q.join(made.hint("merge"), "group_id").withColumn("prompt", F.concat("__f", "prompt"))
    return out.withColumns({c: F.col(c) + F.col("__n") for c in ("prompt_tokens", "evidence_token_start", "evidence_token_end")}).drop("__f", "__n", "group_id")


def dense_line(template: Column, key: Column, value: Column, i: Column) -> Column:
    record = F.concat(F.lit("record_id: R"), F.lpad(i.cast("string"), 6, "0"), F.lit(" | lookup_key: "), key, F.lit(" | lookup_value: "), value, F.lit("\n"))
    return F.when(template == "record_kv", record).otherwise(F.concat(F.lit("key: "), key, F.lit(" | value: "), value, F.lit("\n")))


#: Tokens of the shortest record line, `key: A | value: 1`, and decoys that are made beyond those that can fit.
LEAST_LINE, SPARE = 7, 4


def dense_examples(spark: SparkSession, samples: int | DataFrame, lengths: list[int], seed: int, positions=DENSE_POSITIONS, most: int = 400) -> DataFrame:
    """Key-value examples of long contexts: `samples` (a number, or a table of `sample`s) for each length and each of nine positions. Template and answer type are
    weighted choices; of hard_kv, seven keys in ten share the target's first five characters; near misses of a family come
    first among the decoys. The most records, `most` of them at most, whose text has the length's tokens at most, found by a
    running sum of their lines; the target stands at its position among them.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("target_length"), F.lit(name).alias("evidence_position"), F.lit(ratio).alias("position_ratio")) for n in lengths for name, ratio in positions])
    numbers = samples if isinstance(samples, DataFrame) else spark.range(samples).withColumnRenamed("id", "sample")
    rows = dealt(numbers.select("sample")).select("sample", F.explode(cells).alias("c")).select("sample", "c.*")
    rows = rows.withColumn("example_id", F.concat_ws("-", F.lit(str(seed)), F.col("target_length").cast("string"), "evidence_position", F.col("sample").cast("string")))
    e = F.col("example_id")
    rows = rows.withColumns({"template": weighted(e, "template", TEMPLATE_WEIGHTS), "answer_type": weighted(e, "answer", ANSWER_WEIGHTS), "family": F.element_at(F.array(*[F.lit(x) for x in FAMILIES]), (number(e, "family") % len(FAMILIES) + 1).cast("int"))})
    key = lambda s: F.concat(letter(number(s, "k")), letter(number(s, "l")), letter(number(s, "m")), letter(number(s, "n")), F.lit("-"), F.lpad((number(s, "o") % 100_000).cast("string"), 5, "0"))
    rows = rows.withColumns({"key": key(e), "gold": value_of(e, F.col("answer_type"))})
    # a step of their own: within the decoys the near misses would be made again for each of them
    rows = rows.select("*", F.explode(F.array(near_misses(F.col("gold"), F.col("answer_type"), F.col("family"), e, 8))).alias("near"))

    def decoy(i: Column) -> Column:
        s = F.concat(e, F.lit("/"), i.cast("string"))
        own = F.when((F.col("template") == "hard_kv") & (number(s, "h") % 100 < 70), F.concat(F.substring("key", 1, 5), F.lpad(((number(s, "o") + i) % 100_000).cast("string"), 5, "0"))).otherwise(key(s))
        return F.struct(own.alias("key"), F.coalesce(F.get("near", i), value_of(s, F.col("answer_type"))).alias("value"))

    def upto(n: Column) -> Column:
        return F.filter(F.transform(F.sequence(F.lit(0), n - 1), decoy), lambda r: (r["key"] != F.col("key")) & (r["value"] != F.col("gold")))

    # a line has LEAST_LINE tokens at least, so more decoys than `room` can't be used; all are made only where too many of these are left out
    room = F.floor(F.col("target_length") / LEAST_LINE).cast("int")
    few = rows.withColumn("room", room).select("*", F.explode(F.array(upto(F.greatest(F.lit(1), F.least(F.lit(most), F.col("room") + SPARE))))).alias("few"))
    rows = few.select("*", F.explode(F.array(F.when((F.size("few") >= F.col("room")) | (F.col("room") + SPARE >= most), F.col("few")).otherwise(upto(F.lit(most))))).alias("decoys"))
    zero = F.lit(0)
    query = F.when(F.col("template") == "record_kv", F.concat(F.lit("lookup_key: "), "key", F.lit(" | lookup_value:"))).otherwise(F.concat(F.lit("key: "), "key", F.lit(" | value:")))
    rows = rows.withColumn("query", query).withColumn("fixed", T.token_count(dense_line(F.col("template"), F.col("key"), F.col("gold"), zero)) + T.token_count(F.col("query")) + T.token_count(F.col("gold")))
    sizes = F.transform("decoys", lambda r: T.token_count(dense_line(F.col("template"), r["key"], r["value"], zero)))
    rows = rows.select("*", F.explode(F.array(sizes)).alias("sizes"))
    fits = F.aggregate("sizes", F.struct(F.col("fixed").alias("t"), F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, x: F.struct(F.when(a["go"] & (a["t"] + x <= F.col("target_length")), a["t"] + x).otherwise(a["t"]).alias("t"), F.when(a["go"] & (a["t"] + x <= F.col("target_length")), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["go"] & (a["t"] + x <= F.col("target_length"))).alias("go")))
    rows = rows.select("*", F.explode(F.array(fits)).alias("fit")).withColumn("records_in_context", F.col("fit.n") + 1)
    at = T.target_index(F.col("position_ratio"), F.col("records_in_context"))
    own = F.array(F.struct(F.col("key"), F.col("gold").alias("value")))
    rows = rows.withColumn("at", at).withColumn("records", F.concat(F.slice("decoys", F.lit(1), F.col("at")), own, F.slice("decoys", F.col("at") + 1, F.col("fit.n") - F.col("at"))))
    text = lambda r: F.array_join(F.transform(r, lambda x, i: dense_line(F.col("template"), x["key"], x["value"], i)), "")
    start = T.token_count(text(F.slice("records", F.lit(1), F.col("at"))))
    return rows.select(
        "example_id", "target_length", "evidence_position", "position_ratio", "template", "answer_type", "family", "key",
        F.col("gold").alias("gold_value"), "records_in_context", F.col("at").alias("target_index"),
        F.concat(text(F.col("records")), F.col("query")).alias("prompt"), F.col("fit.t").alias("full_tokens"), start.alias("evidence_token_start"),
    )
