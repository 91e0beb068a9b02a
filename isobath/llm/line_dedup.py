"""Line dedup with content-defined chunks.

Each text is split into lines and each line is hashed. A rolling hash over the last two line hashes
ends a chunk where it is 0 modulo ``period``, so chunk boundaries depend on nearby lines only and
resist shifts. A chunk of at least ``min_lines`` lines with a word in it that occurs more than once in
the table is removed everywhere but at its first occurrence (smallest doc_id, then position). Hashes
only find candidates; occurrences count as equal when their bytes are.

Nulls and empty texts: a null text stays null and an empty one empty, with nothing removed. Rows with
equal doc_id and text are one document and get the same result; rows of one doc_id with different
texts are told apart by the text's MD5, smaller one first. A null doc_id comes first. Columns named
like an output are replaced; all others pass through untouched, whatever their names. An empty table gives
an empty one. A text of any length is taken whole; its lines are rows of their own until it is put together again.

Only DataFrame operations are used. Lines are hashed once over all texts, and again in documents that have a
candidate. A hot chunk is pre-aggregated before each shuffle; whole texts are shuffled once by document, those
with candidates twice, and by content only the chunks that repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobath.llm.shared import WORD, discard, materialise, shielded, table

PERIOD = 3
MIN_LINES = 2
KEY = ["d", "t"]
NONE = -(2**63)


def chunked(docs: DataFrame, period: int = PERIOD) -> DataFrame:
    """Adds chunks: array of (k, n_lines, body), null for a null text. explode() keeps line arrays from being recomputed in lambdas."""

    def boxed(df: DataFrame, name: str, **parts: Column) -> DataFrame:
        return df.withColumn(name, F.explode(F.array(F.struct(*[c.alias(n) for n, c in parts.items()]))))

    line_hash = lambda line: F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")
    split = boxed(docs, "_s", lines=F.split(F.col("text"), "\n"))
    hashed = boxed(split, "_h", hashes=F.transform("_s.lines", line_hash))
    shifted = F.concat(F.array(F.lit(0).cast("long")), F.slice("_h.hashes", F.lit(1), F.size("_h.hashes") - 1))
    rolled = F.zip_with(shifted, F.col("_h.hashes"), lambda a, b: (a * 31 + b) % period)
    ends = F.filter(F.transform(rolled, lambda r, i: F.when(r == 0, i + 1)), lambda e: e.isNotNull())
    cut = boxed(hashed, "_c", ends=F.array_union(ends, F.array(F.size("_s.lines"))))
    starts = F.concat(F.array(F.lit(0)), F.slice("_c.ends", F.lit(1), F.size("_c.ends") - 1))
    spans = boxed(cut, "_p", spans=F.zip_with(starts, F.col("_c.ends"), lambda a, b: F.struct(a.alias("start"), (b - a).alias("n"))))

    def chunk(span: Column, k: Column) -> Column:
        return F.struct(k.alias("k"), span["n"].alias("n_lines"), F.array_join(F.slice("_s.lines", span["start"] + 1, span["n"]), "\n").alias("body"))

    return boxed(spans, "_b", chunks=F.transform("_p.spans", chunk)).withColumn("chunks", F.col("_b.chunks")).drop("_s", "_h", "_c", "_p", "_b")


def dedup_lines(docs: DataFrame, period: int = PERIOD, min_lines: int = MIN_LINES) -> DataFrame:
    """docs with text cleaned, n_lines, n_removed (lines) and n_chunks_removed."""
    hidden, back = shielded(docs)
    name = dict(zip(docs.columns, hidden, strict=True))
    key = F.coalesce(name["doc_id"], F.lit(NONE)).alias("d"), F.unhex(F.md5(F.col(name["text"]).cast("binary"))).alias("t")
    keyed = docs.toDF(*hidden).select("*", *key)

    # chunks that may go, by a hash that only finds candidates: written once, read for the counts and for the rows
    whole = chunked(keyed.select(*KEY, F.col(name["text"]).alias("text")), period).select(*KEY, F.explode("chunks").alias("c"))
    eligible = whole.filter((F.col("c.n_lines") >= min_lines) & F.col("c.body").rlike(WORD))
    at = materialise(eligible.select(*KEY, F.col("c.k").alias("k"), F.xxhash64("c.body").alias("h")), "chunks")
    often = at.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    candidates = at.join(often, "h", "left_semi").groupBy(*KEY).agg(F.collect_set("k").alias("ks"))
    marked = materialise(keyed.join(candidates, KEY, "left"), "marked")
    discard(at)

    # byte comparison, in documents that have candidates: of those with the same bytes the first one stays
    suspects = chunked(marked.filter("ks is not null").withColumn("text", F.col(name["text"])), period)
    some = suspects.select(*KEY, F.explode(F.filter("chunks", lambda c: F.array_contains("ks", c["k"]))).alias("c"))
    first = some.groupBy(F.col("c.body").alias("body")).agg(F.min(F.struct(*KEY, F.col("c.k").alias("k"))).alias("first"))
    stay = first.select("first.*").groupBy(*KEY).agg(F.collect_set("k").alias("stay"))
    done = suspects.join(stay, KEY, "left").withColumn("gone", F.array_except("ks", F.coalesce("stay", F.array().cast("array<int>"))))
    left = F.filter("chunks", lambda c: ~F.array_contains("gone", c["k"]))
    lost = F.filter("chunks", lambda c: F.array_contains("gone", c["k"]))
    total = F.aggregate(lost, F.lit(0).cast("long"), lambda acc, c: acc + c["n_lines"])
    cleaned = done.select(*hidden, F.when(F.size("gone") == 0, F.col(name["text"])).otherwise(F.array_join(F.transform(left, lambda c: c["body"]), "\n")).alias("cleaned"), total.alias("lines"), F.size(lost).cast("long").alias("chunks"))
    zero = F.lit(0).cast("long")
    both = cleaned.unionByName(marked.filter("ks is null").select(*hidden, F.col(name["text"]).alias("cleaned"), zero.alias("lines"), zero.alias("chunks")))
    text = F.col(name["text"])
    n_lines = F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    kept = [F.col("cleaned").alias("text") if c == "text" else x for c, x in zip(docs.columns, back, strict=True) if c not in ("n_lines", "n_removed", "n_chunks_removed")]
    return both.select(*kept, n_lines.alias("n_lines"), F.col("lines").alias("n_removed"), F.col("chunks").alias("n_chunks_removed"))


def op4_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "n_chunks_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def cleaned_sql(documents: str = "documents", period: int = PERIOD, min_lines: int = MIN_LINES) -> str:
    """DuckDB CTEs ending in ``cleaned``: doc_id, text, n_lines, n_removed, n_chunks_removed."""
    return f"""
l_split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM {documents} WHERE text IS NOT NULL),
l_hash AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l_split),
l_roll AS (SELECT *, CASE WHEN (coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * 31 + h) % {period} = 0 THEN 1 ELSE 0 END AS cut FROM l_hash),
l_no AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM l_roll),
l_chunk AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM l_no GROUP BY doc_id, k),
l_rank AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, k) AS rn FROM l_chunk),
l_gone AS (SELECT *, rn > 1 AND n >= {min_lines} AND regexp_matches(body, '{WORD}') AS gone FROM l_rank),
cleaned AS (
  SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text, CAST(sum(n) AS BIGINT) AS n_lines,
    CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_chunks_removed
  FROM l_gone GROUP BY doc_id)"""


ORACLE = f"WITH {cleaned_sql()} SELECT doc_id, n_lines, n_removed, n_chunks_removed, sha256(text) AS kept_sha256 FROM cleaned"
