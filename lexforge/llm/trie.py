"""Prefix trie of conversations: nodes of shared first turns, and subtree sums by heavy-path decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import cut

#: Conversations of one group share the first turns of its first; a conversation takes fewer than HEAD of them.
GROUP, HEAD = 20, 4
#: Numbers of turns that share a task in running values, and conv_ids that share a piece of a node's list.
STRETCH, PIECE = 4096, 1 << 16

_xor: Callable = lambda x, y: x.bitwiseXOR(y)
_plus: Callable = lambda x, y: x + y


def scanned(rows: DataFrame, key: str, stretch: str, order: list[Column], values: dict[str, tuple], also: DataFrame | None = None, last: bool = False) -> DataFrame:
    """rows with running values: name -> (column, aggregate, how two of its results combine), over the rows of the key up to each.

    Rows are summed within (key, stretch), and shifted by what the stretches before make up, a row for each, so a long key is
    spread over its stretches. With `last`, later stretches come first. also: a table of columns by key, joined to
    the stretches' rows on the way.
    """
    inside = Window.partitionBy(key, stretch).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy(F.desc(stretch) if last else F.asc(stretch)).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, stretch).agg(*[f(x).alias(f"__{n}") for n, (x, f, _) in values.items()])
    shift = totals.select(key, stretch, *[F.coalesce(f(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n, (_, f, _) in values.items()])
    if also is not None:
        shift = shift.join(also, key)
    out = rows.withColumns({n: f(x).over(inside) for n, (x, f, _) in values.items()}).join(shift, [key, stretch])
    return out.withColumns({n: both(F.col(n), F.col(f"__{n}")) for n, (_, _, both) in values.items()}).drop(*[f"__{n}" for n in values])


def _h(depth: Column, digest: Column, k: int) -> Column:
    """A turn's hash at its depth; prefixes are told apart by two 64-bit sums (exclusive or) of them, whatever made them up."""
    return F.xxhash64(depth.cast("long"), digest, F.lit(k))


def members(conversations: DataFrame, group: int = GROUP, head: int = HEAD) -> DataFrame:
    """conversations -> (c, depth, a, b, pa, pb, words, last): for each rebuilt conversation and depth, 0 included, the node (a, b)
    that it passes, that node's parent, the words of its last turn and whether the conversation ends there."""
    text, role = (F.coalesce(x, F.lit("")) for x in ("text", "role"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.floor(F.col("turn") / STRETCH).cast("long"), F.lit(-(1 << 62))).alias("stretch"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long").alias("words"),
    )
    first = F.row_number().over(Window.partitionBy("c").orderBy("turn", "digest"))
    heads = (
        turns.filter(F.col("c") % group == 0)
        .withColumn("k", first)
        .filter(F.col("k") < head)
        .groupBy(F.col("c").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("k", "digest", "words"))).alias("head"))  # fewer than `head` turns
    )
    convs = (
        turns.groupBy("c")
        .agg(F.count("*").alias("own"))
        .withColumns({"h": (F.crc32(F.col("c").cast("string").cast("binary")) % head).cast("int"), "base": F.col("c") - F.col("c") % group})
        .join(heads, "base", "left")
        .withColumn("head", F.when(F.col("head").isNull(), F.array().cast("array<struct<k:int,digest:binary,words:bigint>>")).otherwise(F.slice("head", 1, F.col("h"))))
        .withColumn("m", F.size("head"))
        .withColumn("n", F.col("m") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    )
    convs = cut(convs.select("c", "h", "m", "n", "head"))
    k = F.col("k")
    of_head = lambda j: F.aggregate(F.slice("head", 1, k), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(_h(x["k"], x["digest"], j)))
    turn = F.get("head", k - 1)
    shared = convs.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m")))).select(
        "c", k.cast("long").alias("depth"), of_head(0).alias("a"), of_head(1).alias("b"), _h(k, turn["digest"], 0).alias("x"), _h(k, turn["digest"], 1).alias("y"), F.coalesce(turn["words"], F.lit(0).cast("long")).alias("words"), (k == F.col("n")).alias("last")
    )
    order = [F.col("turn"), F.col("digest")]
    # of the head's prefixes, own turns need the whole one
    whole = convs.withColumn("k", F.col("m")).select("c", "h", "m", "n", of_head(0).alias("a0"), of_head(1).alias("b0"))
    ranked = scanned(turns.repartition("c", "stretch"), "c", "stretch", order, {"o": (F.lit(1), F.sum, _plus)}, also=whole)
    own = ranked.filter("o > h").withColumn("depth", F.col("o") - F.col("h") + F.col("m"))
    own = own.withColumns({"x": _h(F.col("depth"), F.col("digest"), 0), "y": _h(F.col("depth"), F.col("digest"), 1)})
    own = scanned(own, "c", "stretch", [F.col("depth")], {"a": (F.col("x"), F.bit_xor, _xor), "b": (F.col("y"), F.bit_xor, _xor)})
    own = own.select("c", "depth", _xor(F.col("a"), F.col("a0")).alias("a"), _xor(F.col("b"), F.col("b0")).alias("b"), "x", "y", "words", (F.col("depth") == F.col("n")).alias("last"))
    up = lambda s, x: F.when(F.col("depth") > 0, _xor(F.col(s), F.col(x)))
    return own.unionByName(shared).select("c", "depth", "a", "b", up("a", "x").alias("pa"), up("b", "y").alias("pb"), "words", "last")


def ends_of(rows: DataFrame) -> DataFrame:
    """members -> (a, b, ends_sha256) of nodes where conversations end: the hash of their conv_ids.

    A node's ids are joined in pieces of PIECE numbers, in any task; the pieces of one node, in order, go through one
    task that holds a hash, since a SHA-256 is made from front to back.
    """
    number = F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string"))
    pieces = rows.filter("last").groupBy("a", "b", F.floor(F.col("c") / PIECE).alias("piece")).agg(F.array_join(number, ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def batch() -> pa.RecordBatch:
            a, b, s = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.string())], ["a", "b", "ends_sha256"])

        for x in batches:
            for a, b, ids in zip(*(x.column(k).to_pylist() for k in (0, 1, 3))):
                if (a, b) == now:
                    state.update(b"," + ids.encode())
                    continue
                if now:
                    out.append((*now, state.hexdigest()))
                    if len(out) == 8192:
                        yield batch()
                now, state = (a, b), hashlib.sha256(ids.encode())
        if now:
            out.append((*now, state.hexdigest()))
        if out:
            yield batch()

    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "piece").mapInArrow(run, "a long, b long, ends_sha256 string")


def with_paths(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with `path` and `top`: the heavy path through each, named after the smallest conversation at its lower end, and the
    depth where it begins.

    The heavy child is the one that most conversations pass, so what hangs from a node by a light edge is passed by half of
    its conversations at most. Each path ends in a node without children; along the conversation that leads there,
    the path is what follows the last light node.
    """
    children = nodes.filter("depth > 0").groupBy("pa", "pb").agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", "conv_id", "a", "b")).alias("heavy"))
    children = cut(children.select("pa", "pb", "n_children", F.col("heavy.a").alias("a"), F.col("heavy.b").alias("b")))
    marked = (
        nodes.join(children.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children"), ["a", "b"], "left")
        .join(children.select("a", "b", F.lit(False).alias("light")), ["a", "b"], "left")
        .withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "light": F.coalesce("light", F.lit(True))})
    )
    marked = cut(marked)
    ends = marked.filter("n_children = 0").select(F.col("conv_id").alias("c"))
    along = cut(rows.select("c", "depth", "a", "b").join(ends, "c", "left_semi").join(marked.select("a", "b", "light"), ["a", "b"]))
    top = along.filter("light").groupBy("c").agg(F.max("depth").alias("top"))
    paths = along.join(top, "c").filter("depth >= top").select("a", "b", F.col("c").alias("path"), "top")
    return marked.drop("light").join(paths, ["a", "b"])


def path_totals(paths: DataFrame) -> DataFrame:
    """paths (path, parent_path, passed, leaves, tokens) -> (path, leaves, tokens) with those of all paths below.

    A path and what it hangs from differ by a factor of two at least in the conversations that pass their tops, so paths are
    settled by powers of two, the smallest first: one round for each power that occurs.
    """
    left = cut(paths.withColumn("k", F.floor(F.log2("passed")).cast("int")))
    sizes, settled = dict(left.groupBy("k").count().collect()), None  # 63 rows at most
    for k in sorted(sizes):
        ready = left.filter(F.col("k") == k)
        settled = ready if settled is None else settled.unionByName(ready)
        del sizes[k]
        if sizes:
            up = ready.groupBy(F.col("parent_path").alias("path")).agg(F.sum("leaves").alias("l"), F.sum("tokens").alias("t"))
            more = left.filter(F.col("k") > k).join(up, "path", "left")
            left = cut(more.withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "tokens": F.col("tokens") + F.coalesce("t", F.lit(0))}).drop("l", "t"), sum(sizes.values()))
    return settled.select("path", "leaves", "tokens")


def prefix_trie(conversations: DataFrame, group: int = GROUP, head: int = HEAD) -> DataFrame:
    """conversations (conv_id, turn, role, text, ...) -> a row for each node of the trie of rebuilt conversations: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation takes its first h turns, h from a hash of its conv_id and under `head`, from the first of its `group`. Turns
    stand in the order of turn, null first, those that share a number in the order of a digest of role and text; repeated rows
    are turns of their own. A null role or text is empty. Rows without a conv_id belong to no conversation. An empty table has
    no root and gives no rows. Nodes are aggregates of narrow rows; subtree sums run along heavy paths, in stretches
    of depths, so neither a turn that all share nor a very long conversation needs one task.
    """
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = cut(members(conversations, group, head))
    nodes = cut(rows.groupBy("a", "b").agg(F.min("c").alias("conv_id"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.count("*").alias("n_convs"), F.min("words").alias("words")))
    pathed = cut(with_paths(rows, nodes))
    root = pathed.filter("depth = 0").first()
    if root is None:
        return conversations.sparkSession.createDataFrame([], ", ".join(f"{x} {'string' if x == 'ends_sha256' else 'long'}" for x in out))
    parents = pathed.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path"))
    # the root's children are most of all nodes, and need no join
    below_root = F.col("depth") == 1
    top = pathed.filter("depth <= 1").withColumns({"parent_conv_id": F.when(below_root, F.lit(root["conv_id"]).cast("long")), "parent_path": F.when(below_root, F.lit(root["path"]).cast("long"))})
    tree = cut(top.unionByName(pathed.filter("depth > 1").join(parents, ["pa", "pb"])).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))
    at_top = F.max(F.when(F.col("depth") == F.col("top"), F.struct("parent_path", "pa", "pb", "n_convs")))
    paths = cut(tree.groupBy("path").agg(F.sum("saved").alias("tokens"), at_top.alias("t")).select("path", "t.*", F.col("n_convs").alias("passed"), F.lit(1).cast("long").alias("leaves"), "tokens"))
    totals = path_totals(paths.drop("pa", "pb", "n_convs"))
    hung = paths.select("path", "pa", "pb").filter("pa IS NOT NULL").join(totals, "path").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("leaves").alias("l"), F.sum("tokens").alias("t"))
    own = tree.join(hung, ["a", "b"], "left").withColumns({
        "l": F.coalesce("l", F.lit(0)) + (F.col("n_children") == 0).cast("long"),
        "t": F.coalesce("t", F.lit(0)) + F.col("saved"),
        "stretch": F.floor(F.col("depth") / STRETCH),
    })
    sums = {"n_leaves": (F.col("l"), F.sum, _plus), "saved_tokens": (F.col("t"), F.sum, _plus)}
    summed = scanned(own.repartition("path", "stretch"), "path", "stretch", [F.desc("depth")], sums, last=True)
    none = hashlib.sha256(b"").hexdigest()
    return summed.join(ends_of(rows), ["a", "b"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none))).select(*out)
