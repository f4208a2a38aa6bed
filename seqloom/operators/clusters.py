"""Cluster maps of several programs, abundance matrices and seed statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import without_size

#: Columns of parsed maps: line number, query read, target cluster, identity in percent (null where not given), is_seed.
DIALECTS = ("uc", "vsearch", "uparse8", "uparse9", "unoise", "cdhit", "paf")
#: Counts of more samples aren't made a matrix.
MATRIX_SAMPLES = 10_000


def parsed(lines: DataFrame, dialect: str, line: str = "line", order: str = "line_no") -> DataFrame:
    """line_no, query, target, identity, is_seed of the lines of a cluster map; lines that are no assignment are left out."""
    f = F.split(line, "\t")
    row = lines.select(F.col(order).alias("line_no"), F.col(line).alias("_l"), f.alias("_f")).filter("_l <> '' AND _l NOT LIKE '#%'")
    g = lambda k: F.get("_f", F.lit(k))
    number = lambda c: c.try_cast("double")

    def made(keep: Column, query: Column, target: Column, identity: Column, seed: Column) -> DataFrame:
        return row.filter(keep).select("line_no", query.alias("query"), target.alias("target"), identity.alias("identity"), seed.alias("is_seed"))

    never = F.lit(False)
    if dialect == "uc":
        return made(g(0) == "H", g(8), g(9), number(g(3)), never)
    if dialect == "vsearch":
        seed = g(0) == "S"
        return made(g(0).isin("H", "S"), g(8), F.when(seed, g(8)).otherwise(g(9)), F.when(seed, 100.0).otherwise(number(g(3))), seed)
    if dialect == "uparse8":
        seed = g(1) == "otu"
        return made(g(1).isin("otu", "match", "chimera"), g(0), F.when(seed, g(0)).otherwise(g(4)), number(g(2)), seed)
    if dialect == "uparse9":
        top = F.regexp_extract(g(2), r"top=([^;(]+)", 1)
        identity = F.regexp_extract(g(2), r"\(([\d.]+)%\)", 1)
        seed = g(1).rlike("^otu")
        return made(g(1).rlike("^otu|^match|^perfect|^noisy|^good") & (seed | (top != "")), g(0), F.when(seed, g(0)).otherwise(top), F.when(seed, 100.0).otherwise(number(identity)), seed)
    if dialect == "unoise":
        return made(g(1).rlike("^(denoise|amp)"), g(0), F.regexp_extract(g(2), r"(?:top|parent)=([^;(]+)", 1), F.lit(None).cast("double"), g(1).rlike("^amp"))
    if dialect == "paf":
        return made(F.size("_f") >= 12, g(0), g(5), 100 * number(g(9)) / number(g(10)), never)
    if dialect == "cdhit":
        member = row.withColumn("cluster", F.when(F.col("_l").startswith(">Cluster"), F.regexp_extract("_l", r"(\d+)", 1)))
        # every line gets the cluster of the header line above it, then its representative
        block = Window.orderBy("line_no")
        filled = member.withColumn("cluster", F.last("cluster", True).over(block)).filter(~F.col("_l").startswith(">"))
        name, star = F.regexp_extract("_l", r">(\S+?)\.\.\.", 1), F.col("_l").endswith("*")
        seen = filled.select("line_no", "cluster", name.alias("query"), star.alias("is_seed"), F.regexp_extract("_l", r"([\d.]+)%", 1).alias("_i"))
        own = Window.partitionBy("cluster")
        target = F.max(F.when(F.col("is_seed"), F.col("query"))).over(own)
        return seen.select("line_no", "query", target.alias("target"), F.when(F.col("is_seed"), 100.0).otherwise(F.col("_i").try_cast("double")).alias("identity"), "is_seed")
    raise ValueError(f"unknown dialect {dialect}; known: {', '.join(DIALECTS)}")


def targets(assignments: DataFrame) -> DataFrame:
    """One row for each target of an assignment: a chimera a+b counts for both, by half."""
    parts = F.split("target", r"\+")
    return assignments.select("*", F.size(parts).alias("n_targets"), F.explode(parts).alias("otu")).withColumn("otu", without_size(F.trim("otu")))


def counts(assignments: DataFrame, occurrences: DataFrame) -> DataFrame:
    """otu, sample_id, n (double) of targets() joined to occurrences (query, sample_id, n)."""
    joined = assignments.join(occurrences, "query")
    return joined.groupBy("otu", "sample_id").agg(F.sum(F.col("n") / F.col("n_targets")).alias("n"))


def added(*parts: DataFrame) -> DataFrame:
    """Counts of several maps (further reads, reference clusters) in one."""
    return reduce(DataFrame.unionByName, parts).groupBy("otu", "sample_id").agg(F.sum("n").alias("n"))


def sample_names(long: DataFrame) -> list[str]:
    """The samples of counts() in order, as columns of matrix(); raises for more than MATRIX_SAMPLES."""
    names = [r[0] for r in long.filter("sample_id IS NOT NULL").select("sample_id").distinct().limit(MATRIX_SAMPLES + 1).collect()]
    if len(names) > MATRIX_SAMPLES:
        raise ValueError(f"the counts have over {MATRIX_SAMPLES} samples; use their long form")
    return sorted(names)


def matrix(long: DataFrame, samples: list[str]) -> DataFrame:
    """otu and a rounded count for each sample of the list; the list is the map's, so its columns are bounded and known."""
    made = long.groupBy("otu").pivot("sample_id", samples).agg(F.first("n"))
    return made.select("otu", *[F.coalesce(F.round(F.col(f"`{s}`")), F.lit(0)).cast("bigint").alias(s) for s in samples])


def resolved(assignments: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assignments whose otu is known, and the unknown otus with how often they occur."""
    found = assignments.join(known, "otu", "left_semi")
    lost = assignments.join(known, "otu", "left_anti").groupBy("otu").agg(F.count("*").alias("n"))
    return found, lost


def indexed_percentiles(df: DataFrame, groups: list[str], value: str, points: tuple[int, ...] = (0, 10, 50, 90, 100)) -> DataFrame:
    """groups, point, value: the sorted value at index floor((n - 1) * point / 100)."""
    own = Window.partitionBy(*groups)
    ranks = df.filter(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(own.orderBy(value)) - 1).withColumn("_n", F.count("*").over(own))
    at = F.explode(F.array(*[F.struct(F.lit(p).alias("point"), F.floor((F.col("_n") - 1) * p / 100).alias("i")) for p in points]))
    return ranks.select(*groups, value, "_i", at.alias("_p")).filter("_i = _p.i").select(*groups, F.col("_p.point").alias("point"), F.col(value).alias("value"))


def derep_map(lines: DataFrame, line: str = "line", order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """Samples (idx, name) and occurrences (query, size, idx, n) of a dereplication map."""
    head = lines.filter(F.col(line).startswith("#SMPLS"))
    pair = F.explode(F.slice(F.split(line, "\t"), 2, 1 << 20))
    named = head.select(pair.alias("p")).filter("p <> ''").select(F.substring_index("p", ":", 1).cast("int").alias("idx"), F.expr("substr(p, instr(p, ':') + 1)").alias("name"))
    body = lines.filter(~F.col(line).startswith("#") & (F.col(line) != ""))
    first = F.get(F.split(line, "\t"), F.lit(0))
    rows = body.select(without_size(first).alias("query"), F.regexp_extract(first, r";size=(\d+)", 1).try_cast("bigint").alias("size"), F.explode_outer(F.slice(F.split(line, "\t"), 2, 1 << 20)).alias("p"))
    occ = rows.select("query", "size", F.get(F.split("p", ":"), F.lit(0)).try_cast("int").alias("idx"), F.get(F.split("p", ":"), F.lit(1)).try_cast("bigint").alias("n"))
    return named, occ


def with_reads(occ: DataFrame, reads: DataFrame, read_id: str = "read_id") -> tuple[DataFrame, DataFrame]:
    """Reads of a dereplication map with their size, and the ids of the map that no read has."""
    sizes = occ.groupBy("query").agg(F.max("size").alias("size"))
    named = reads.withColumn("query", without_size(F.col(read_id)))
    return named.join(sizes, "query"), sizes.join(named, "query", "left_anti").select("query")


def derep_map_problems(occ: DataFrame) -> DataFrame:
    """Reads whose counts by sample don't add up to their size."""
    return occ.groupBy("query").agg(F.max("size").alias("size"), F.sum("n").alias("counted")).filter(~F.col("size").eqNullSafe(F.col("counted")))
