"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A portable token: a run of letters, a run of digits, or one other visible character.
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
#: Fields that may hold a record's text, first found first; fixed values.
TEXT_FIELDS = ("text", "content", "contents", "body", "body_text", "article", "document", "markdown", "raw_text", "abstract")


#: Unicode white space; fixed values.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end; trim() alone knows the plain space only."""
    return F.trim(c, F.lit(SPACES))


def clean_text(c: Column) -> Column:
    """Line ends as \\n, control characters as spaces, single spaces, none around line ends, at most one empty line."""
    for pattern, to in (
        (r"\r\n?", "\n"),
        (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " "),
        (r"[ \t\f\x0B]+", " "),
        (r" *\n *", "\n"),
        (r"\n{3,}", "\n\n"),
    ):
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def usable(c: Column, min_chars: int, min_alpha: float) -> Column:
    """Long enough, and of its visible characters a share of min_alpha or more are letters."""
    letters = F.length(F.regexp_replace(c, r"\P{L}", ""))
    visible = F.length(F.regexp_replace(c, r"(?U)\s", ""))
    return (F.length(c) >= min_chars) & F.coalesce(F.try_divide(letters, visible) >= min_alpha, F.lit(False))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    return F.size(tokens(c)).cast("long")


def token_id(c: Column, size: int = 60_000, reserved: int = 5) -> Column:
    """A token's id by its hash, above the reserved ones."""
    return (F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("long") % size + reserved).cast("int")


def token_ids(c: Column) -> Column:
    return F.transform(tokens(c), lambda t: token_id(t))


def fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def normalized(c: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", " ")


def first_line(c: Column) -> Column:
    """The first line of the stripped text, stripped; '' for an empty one."""
    return strip(F.split(strip(c), r"\R|[\x1C-\x1E]", 2)[0])


def uuids(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(UUID), F.lit(0))


def record_values(c: Column, value: str = UUID) -> Column:
    """The values of `Value: ...` records, in order."""
    return F.regexp_extract_all(c, F.lit(f"Value: ({value})"), F.lit(1))


def index_of(values: Column, value: Column) -> Column:
    """Position of the first such element from 0; -1 without one."""
    return (F.array_position(values, value) - 1).cast("int")


def target_index(ratio: Column, n: Column) -> Column:
    """ratio * (n - 1) rounded half to even, within 0 and n - 1."""
    return F.greatest(F.lit(0), F.least(n - 1, F.bround(ratio * (n - 1)).cast("int")))


def uuid_of(c: Column) -> Column:
    """md5 laid out as a UUID."""
    h = F.md5(c)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def stable_seed(name: Column, base: int = 42) -> Column:
    """base, then for each character v * 131 + its code modulo 1,000,000,007."""
    codes = F.transform(F.filter(F.split(name, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(base).cast("long"), lambda v, x: (v * 131 + x) % 1_000_000_007)


def error_class(correct: Column, wrong: Column, made_up: Column, malformed: Column) -> Column:
    """The first that holds, in this order."""
    return (
        F.when(correct == 1, "correct").when(wrong == 1, "wrong_context_value").when(made_up == 1, "hallucinated_value").when(malformed == 1, "format_error").otherwise("other")
    )


#: Upper bounds of the buckets of a predicted index's share of the last index.
INDEX_BUCKETS = ((0.10, "front_0_10"), (0.25, "early_10_25"), (0.50, "mid_25_50"), (0.75, "late_50_75"), (0.90, "tail_75_90"))
INDEX_BUCKET_NAMES = ("not_in_context", "target_0", *(name for _, name in INDEX_BUCKETS), "end_90_100")


def index_bucket(index: Column, n: Column) -> Column:
    share = index / F.greatest(F.lit(1), n - 1)
    out = F.when(index < 0, "not_in_context").when(index == 0, "target_0")
    for bound, name in INDEX_BUCKETS:
        out = out.when(share < bound, name)
    return out.otherwise("end_90_100")


def quarter_bucket(index: Column, n: int = 140) -> Column:
    """Quarters of n records; a missing index, null or -1, has a bucket of its own."""
    q = n // 4
    out = F.when(index.isNull() | (index < 0), "no_index")
    for k in range(3):
        out = out.when(index < q * (k + 1), f"{q * k}-{q * (k + 1) - 1}")
    return out.otherwise(f"{3 * q}-{n - 1}")


def extract_text(schema, c: Column) -> Column:
    """The text of a nested record of known schema: a string is itself, a struct its first non-empty text field, an
    array its non-empty elements with an empty line between, anything else ''."""
    from pyspark.sql import types as T

    if isinstance(schema, T.StringType):
        return F.coalesce(c, F.lit(""))
    if isinstance(schema, T.StructType):
        fields = {f.name: f.dataType for f in schema.fields}
        found = [F.nullif(extract_text(fields[x], c[x]), F.lit("")) for x in TEXT_FIELDS if x in fields]
        return F.coalesce(*found, F.lit("")) if found else F.lit("")
    if isinstance(schema, T.ArrayType):
        each = F.transform(c, lambda x: extract_text(schema.elementType, x))
        return F.coalesce(F.array_join(F.filter(each, lambda x: x != ""), "\n\n"), F.lit(""))
    return F.lit("")


def compacted(c: Column, head: int = 8, tail: int = 8) -> Column:
    """A long text's first and last lines with the number of those left out between them."""
    lines = F.split(c, "\n")
    n = F.size(lines)
    short = F.concat(F.slice(lines, 1, head), F.array(F.concat(F.lit("... "), (n - head - tail).cast("string"), F.lit(" lines ..."))), F.slice(lines, -tail, tail))
    return F.when(n <= head + tail, c).otherwise(F.array_join(short, "\n"))


def percent(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100.0)
