"""Secret scans: labelled, prefixed and hexadecimal secrets, and tokens that a battery of randomness tests singles out.

Column expressions only: texts stay in the JVM, and no row leaves its task but for counts of test results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import cut

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}"
#: Runs that can be an encoded value; shorter ones can't be told from words.
TOKEN, LEAST = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}", 16
KINDS = ("assign", "access", "hex", "random")

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings, the narrowest first, by their alphabets in the order of values.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "hex_upper": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "base36_upper": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
#: Percent of letters in English prose, a to z.
LETTERS = dict(zip(_LOWER, (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)))
#: What people write into names beside small letters: capitals in so many letters, each digit and each other sign in percent.
CAPITALS, DIGIT, SIGN = 0.15, 0.8, 1.5
#: A test rejects randomness beyond so many standard deviations; the share of false ones among the tokens singled out in
#: each class of encoding and length; steps of a standard deviation by which results are counted, and their number.
CRITICAL, RATE, STEP, STEPS = 3.3, 0.01, 16, 160


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def before(sizes: Column, chunk: int = 256) -> Column:
    """For each of the sizes the sum of those before it, in two levels: n entries take n * chunk steps, not n squared."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    n = F.size(sizes)
    of = F.transform(F.sequence(F.lit(0), F.floor(n / chunk).cast("int")), lambda j: total(F.slice(sizes, j * chunk + 1, F.lit(chunk))))
    return let(of, lambda sums: let(F.transform(F.sequence(F.lit(1), F.size(sums)), lambda j: total(F.slice(sums, F.lit(1), j - 1))), lambda starts: F.transform(
        sizes, lambda _, i: F.get(starts, F.floor(i / chunk).cast("int")) + total(F.slice(sizes, F.floor(i / chunk).cast("int") * chunk + 1, i % chunk))
    )))


def located(text: Column, pattern: str) -> Column:
    """The pattern's matches from left to right: (start, end, match), in code points, end exclusive.

    Where they lie follows from the lengths of the matches and of what stands between them."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("n"), m.alias("match")))
        return let(pairs, lambda ps: let(before(F.transform(ps, lambda p: p["gap"] + p["n"])), lambda starts: F.zip_with(
            ps, starts, lambda p, s: F.struct((s + p["gap"]).alias("start"), (s + p["gap"] + p["n"]).alias("end"), p["match"].alias("match"))
        )))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def _regular(alphabet: str) -> str:
    return "^[" + alphabet.replace("-", r"\-") + "]+$"


def encoding_of(token: Column) -> Column:
    """The place in ENCODINGS of the narrowest one; null for tokens of one kind of sign, and of signs that no encoding mixes."""
    out = F.lit(None).cast("int")
    for k, alphabet in reversed(list(enumerate(ENCODINGS.values()))):
        out = F.when(token.rlike(_regular(alphabet)), F.lit(k)).otherwise(out)
    small, large, digit = (token.rlike(x) for x in ("[a-z]", "[A-Z]", "[0-9]"))
    return F.when((small & large) | ((small | large) & digit), out)


def concentration(alphabet: str) -> float:
    """How far ordinary names are from using the alphabet evenly: its size times the sum of their signs' squared shares, less 1."""
    weight = lambda c: LETTERS[c] * (1 - CAPITALS) if c in LETTERS else LETTERS[c.lower()] * CAPITALS if c.lower() in LETTERS else DIGIT if c in _DIGITS else SIGN
    w = [weight(c) for c in alphabet]
    return len(w) * sum(x * x for x in w) / sum(w) ** 2 - 1


def cube_root_score(x: Column, mean: Column, excess: Column) -> Column:
    """The standard normal score of a chi-squared value of this mean; excess: 1, and more if it is not central."""
    spread = F.lit(2.0) * excess / (F.lit(9.0) * mean)
    return (F.cbrt(x / mean) - (F.lit(1.0) - spread)) / F.sqrt(spread)


def tested(token: Column) -> Column:
    """(class, step) of a token: the class of its encoding and length, and how little its signs look like an ordinary name's,
    in steps of 1 / STEP standard deviations, 0 at most; null if a test finds it no random text of its encoding.

    The battery: chi-squared of the signs' counts against an even use of the alphabet; runs of signs of its upper and lower half;
    correlation of each sign's value with the next one's.
    """
    pick = lambda values, e: F.get(F.array(*[F.lit(v) for v in values]), e)
    halves = [("0" * (len(a) // 2)) + "1" * (len(a) - len(a) // 2) for a in ENCODINGS.values()]

    def runs(s: Column, n: Column, e: Column) -> Column:
        def of(bits: Column) -> Column:
            without = lambda x: n - F.length(F.replace(bits, F.lit(x), F.lit("")))
            ones = without("1")
            mean = F.lit(2.0) * ones * (n - ones) / n + 1
            found = (without("01") + without("10")) / 2 + 1
            return let(F.struct(mean.alias("m"), found.cast("double").alias("r")), lambda x: F.when(x["m"] > 2, (x["r"] - x["m"]) / F.sqrt((x["m"] - 1) * (x["m"] - 2) / (n - 1))).otherwise(F.lit(99.0)))

        return let(F.call_function("translate", s, pick(ENCODINGS.values(), e), pick(halves, e)), of)

    def serial(s: Column, n: Column, e: Column) -> Column:
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
        values = F.transform(F.filter(F.split(s, "", -1), lambda c: c != ""), lambda c: F.instr(pick(ENCODINGS.values(), e), c).cast("double"))
        centred = let(values, lambda v: let(total(v) / n, lambda m: F.transform(v, lambda x: x - m)))
        count = n.cast("int")
        product = lambda v: total(F.zip_with(F.slice(v, F.lit(1), count - 1), F.slice(v, F.lit(2), count - 1), lambda x, y: x * y))
        return let(centred, lambda v: let(total(F.transform(v, lambda x: x * x)), lambda q: F.when(q > 0, (product(v) / q + F.lit(1.0) / n) * F.sqrt(n)).otherwise(F.lit(99.0))))

    def battery(s: Column, e: Column) -> Column:
        n = F.length(s).cast("double")
        size = pick([float(len(a)) for a in ENCODINGS.values()], e)
        squares = F.aggregate(F.filter(F.split(pick(ENCODINGS.values(), e), "", -1), lambda c: c != ""), F.lit(0.0), lambda t, c: t + F.pow(n - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0)))

        def judged(x: Column) -> Column:
            free = x["size"] - 1
            even = cube_root_score(x["chi"], free, F.lit(1.0))
            off = x["n"] * pick([concentration(a) for a in ENCODINGS.values()], e)
            name = cube_root_score(x["chi"], free + off, F.lit(1.0) + off / (free + off))
            random = (even <= CRITICAL) & (F.abs(runs(s, x["n"], e)) <= CRITICAL) & (F.abs(serial(s, x["n"], e)) <= CRITICAL)
            step = F.greatest(F.ceil(name * STEP), F.lit(-STEPS)).cast("int")
            group = e * 32 + F.least(F.floor(F.log2(x["n"])), F.lit(31)).cast("int")
            return F.struct(group.alias("group"), F.when(random & (step <= 0), step).alias("step"))

        return let(F.struct(n.alias("n"), size.alias("size"), (squares * size / n - n).alias("chi")), judged)

    signs = F.regexp_replace(token, "=+$", "")
    return let(F.struct(signs.alias("s"), encoding_of(signs).alias("e")), lambda x: F.when(x["e"].isNotNull(), battery(x["s"], x["e"])))


def scanned(text: Column) -> Column:
    """(base, tokens) of a text: its base spans (start, kind, end) in order, and its tested tokens (start, end, group, step)."""
    has = lambda t, *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    spans = lambda xs, kind: F.transform(xs, lambda x: F.struct(x["start"], F.lit(kind).alias("kind"), x["end"]))
    assign = F.when(has(F.lower(text), "passw", "secret", "token", "api"), spans(F.filter(located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 6), 0)).otherwise(none)

    def all_of(tokens: Column) -> Column:
        some = F.size(tokens) > 0  # the others lie within tokens
        access = F.when(some & has(text, "AKIA"), spans(located(text, ACCESS), 1)).otherwise(none)
        hexes = F.when(some, spans(located(text, HEX), 2)).otherwise(none)
        results = F.transform(tokens, lambda x: F.struct(x["start"], x["end"], tested(x["match"]).alias("t")))
        kept = F.transform(F.filter(results, lambda x: x["t"].isNotNull()), lambda x: F.struct(x["start"], x["end"], x["t"]["group"].alias("group"), x["t"]["step"].alias("step")))
        return F.struct(F.array_sort(F.concat(assign, access, hexes)).alias("base"), kept.alias("tokens"))

    return let(located(text, TOKEN), all_of)


def thresholds(found: DataFrame) -> dict[int, int]:
    """found (tokens) -> for each class the largest step at which the Benjamini-Hochberg rule holds: among the tokens up to it, ordinary
    names would be a share of RATE at most. A table of counts by class and step decides, a few thousand rows however many tokens."""
    counts = found.select(F.explode("tokens").alias("x")).groupBy("x.group", "x.step").count()
    within = Window.partitionBy("group")
    chance = F.get(F.array(*[F.lit(math.erfc(k / STEP / math.sqrt(2)) / 2) for k in range(STEPS + 1)]), -F.col("step"))
    ranked = counts.withColumns({"all": F.sum("count").over(within), "up_to": F.sum("count").over(within.orderBy(F.asc_nulls_last("step")))})
    held = ranked.filter(F.col("step").isNotNull() & (chance * F.col("all") <= RATE * F.col("up_to")))
    return dict(held.groupBy("group").agg(F.max("step")).collect())  # a row for each encoding and power of two


def secrets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random), a row for each row.

    spans are kind:start:end in code points, end exclusive, by start and then kind. Base kinds are labelled values, access keys
    and long hexadecimal runs. Kind random: tokens of 16 signs or more that fit an encoding, pass its randomness tests, and look so
    little like names that, by the counts of all tokens of their encoding and length in the table, 1 % of such at most are names;
    those that meet a base span are left to it. Null and empty texts have no spans; repeated rows are scanned each; an empty table
    gives no rows. Each text is scanned once, in any task; what is kept of it are places and two numbers for each token.
    """
    found = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), scanned(F.coalesce("text", F.lit(""))).alias("x")).select("doc_id", "x.base", "x.tokens"))
    least = thresholds(found)
    limit = F.lit(None).cast("int")
    if least:
        limit_of = F.create_map(*[F.lit(v) for pair in least.items() for v in pair])
    added = F.filter("tokens", lambda x: (x["step"] <= (F.try_element_at(limit_of, x["group"]) if least else limit)) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    random = F.transform(added, lambda x: F.struct(x["start"], F.lit(3).alias("kind"), x["end"]))
    name = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda xs, k: F.size(F.filter(xs, lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", "base", random.alias("random")).select(
        "doc_id",
        *[count("base", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:3])],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "random"))).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
