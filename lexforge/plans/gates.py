"""Queries of the gates between sources: near-duplicates and leaked evaluation items."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import leaks as L
from lexforge.operators import nearcopies
from lexforge.plans.common import Query, documents, plain, table


def near_copies(spark, d):
    return plain(nearcopies.near_copies(documents(spark, d)))


def cross_source_copies(spark, d):
    """Classes that more than one source has a part in: how many documents and sources, and what each class would lose."""
    c = nearcopies.near_copies(documents(spark, d)).groupBy("class").agg(F.count("*").alias("docs"), F.count_distinct("source").alias("sources"))
    return plain(c.filter("sources > 1"))


def leaked_items(spark, d):
    return plain(L.leaks(documents(spark, d), table(spark, d, "benchmark")))


def leak_free(spark, d):
    return plain(L.without_leaks(documents(spark, d), table(spark, d, "benchmark")).select("seq", "source", F.length("text").alias("chars")))


_CLASSES = r"""WITH RECURSIVE w AS (SELECT doc_id AS seq, source, regexp_extract_all(lower(coalesce(text, '')), '[^ \t-\r]+') AS w FROM documents),
f AS (SELECT seq, source, array_to_string(w, ' ') AS fp, w FROM w),
reps AS (SELECT fp, min(seq) AS rep, any_value(w) AS w FROM f GROUP BY fp),
sh AS (SELECT DISTINCT rep, unnest(list_transform(range(0, greatest(len(w) - 5, 0) + 1), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM reps),
sizes AS (SELECT rep, count(*) AS n FROM sh GROUP BY rep),
pairs AS (SELECT a.rep AS u, b.rep AS v, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.rep <> b.rep GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN sizes x ON x.rep = u JOIN sizes y ON y.rep = v WHERE 5 * common >= 4 * (x.n + y.n - common)),
reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT reach.a, links.v FROM reach JOIN links ON links.u = reach.b),
roots AS (SELECT a AS rep, min(b) AS class FROM reach GROUP BY a),
classes AS (SELECT seq, source, class, seq = class AS kept FROM f JOIN reps USING (fp) JOIN roots USING (rep))"""
_LEAKS = rf"""WITH words AS (SELECT doc_id AS seq, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
runs AS (SELECT DISTINCT seq, unnest(list_transform(range(0, len(w) - {L.RUN} + 1), lambda i: array_to_string(w[i + 1:i + {L.RUN}], ' '))) AS run FROM words),
known AS (SELECT DISTINCT item_id, unnest(list_transform(range(0, len(w) - {L.RUN} + 1), lambda i: array_to_string(w[i + 1:i + {L.RUN}], ' '))) AS run FROM items),
leaks AS (SELECT seq, item_id, count(*) AS runs FROM runs JOIN known USING (run) GROUP BY ALL)"""

QUERIES: dict[str, Query] = {
    "near_copies": (near_copies, f"{_CLASSES} SELECT * FROM classes"),
    "cross_source_copies": (cross_source_copies, f"{_CLASSES} SELECT class, count(*) AS docs, count(DISTINCT source) AS sources FROM classes GROUP BY class HAVING count(DISTINCT source) > 1"),
    "leaked_items": (leaked_items, f"{_LEAKS} SELECT * FROM leaks"),
    "leak_free": (leak_free, f"{_LEAKS} SELECT doc_id AS seq, source, length(text)::BIGINT AS chars FROM documents WHERE doc_id NOT IN (SELECT seq FROM leaks)"),
}
