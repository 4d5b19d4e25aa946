"""Import specifiers and the files that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import urls

from .lineage import cut

# Fixed values that results depend on: import statements and import calls; what they name is their group.
STATEMENT = r"""import\s+(?:[^"'`]+?\s+from\s+)?["']([^"']+)["']"""
CALL = r"""import\(\s*["']([^"']+)["']\s*\)"""
# Fixed values that results depend on: what is added to a relative specifier, in the order in which files are tried.
ENDINGS = ["", ".js", ".mjs", "/index.js"]


def import_specifiers(sources: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, turn, specifier): what each source imports, its statements in order, then its calls in order."""
    found = F.concat(F.regexp_extract_all(text, F.lit(STATEMENT), F.lit(1)), F.regexp_extract_all(text, F.lit(CALL), F.lit(1)))
    return sources.select(path, F.posexplode(found).alias("turn", "specifier"))


def import_edges(sources: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(base, turn, specifier, is_external, resolvable, path) of every import of the sources, resolved among them."""
    found = import_specifiers(sources, path, text).select(F.concat(path, F.lit(chr(0)), F.col("turn").cast("string")).alias("_import"), F.col(path).alias("base"), "turn", "specifier")
    return resolved_imports(found, sources.select(path).distinct(), "_import", path=path).drop("_import")


def reachable(edges: DataFrame, roots: DataFrame, source: str = "base", target: str = "path", most_rounds: int = 10_000) -> DataFrame:
    """(target, round) of all that can be reached from roots (target) over edges, and in how many steps.

    A round joins only what the one before found; each is a checkpoint, so plans stay short and a lost executor costs a
    round. Rounds are as many as the longest shortest path; only whether one found anything reaches the driver. Steps and
    what was seen grow with the sources and are estimated too small, so they are merged, never broadcast.
    """
    steps = cut(edges.select(F.col(source).alias("_from"), F.col(target)).distinct())
    seen = frontier = cut(roots.select(target).distinct().withColumn("round", F.lit(0)))
    for n in range(1, most_rounds + 1):
        ahead = frontier.select(F.col(target).alias("_from")).join(steps.hint("merge"), "_from").select(target).distinct()
        frontier = ahead.join(seen.hint("merge"), target, "left_anti").withColumn("round", F.lit(n))
        frontier = cut(frontier)
        if frontier.isEmpty():
            return seen
        seen = cut(seen.union(frontier)) if n % 10 == 0 else seen.union(frontier)
    raise RuntimeError(f"still new ones after {most_rounds} rounds")


def resolved_imports(found: DataFrame, files: DataFrame, key: str, base: str = "base", specifier: str = "specifier", path: str = "path") -> DataFrame:
    """found (key: unique; base: absolute path of the importing file) with is_external, resolvable and path.

    A specifier that starts with neither ./ nor ../ is external and resolvable as it stands (as a null one is). Of the
    others the first candidate among the files counts; without one, path is the plain path. One shuffle of four
    candidates a relative import against the different files, merged: neither side fits a broadcast at every size.
    """
    s = F.col(specifier)
    relative = F.coalesce(s.startswith("./") | s.startswith("../"), F.lit(False))
    direct = urls.without_dots(F.concat(F.regexp_replace(base, "[^/]*$", ""), s))
    placed = found.withColumn("direct", F.when(relative, F.regexp_replace(direct, "(?<=.)/$", "")))
    tried = placed.filter("direct IS NOT NULL").select(key, F.posexplode(F.array(*[F.concat("direct", F.lit(e)) for e in ENDINGS])).alias("turn", "tried"))
    hits = tried.join(files.select(F.col(path).alias("tried")).hint("merge"), "tried", "left_semi").groupBy(key).agg(F.min_by("tried", "turn").alias("hit"))
    out = placed.join(hits.hint("merge"), key, "left")
    return out.select(*found.columns, F.col("direct").isNull().alias("is_external"), (F.col("direct").isNull() | F.col("hit").isNotNull()).alias("resolvable"), F.coalesce("hit", "direct", specifier).alias("path"))
