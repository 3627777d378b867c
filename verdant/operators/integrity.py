"""Reference integrity of a site: what its sources name, what is there, and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.functions import refs as R
from verdant.functions import text as T
from verdant.operators.kpi import place_in

# Folders that aren't looked at, rules of what is generated, optional or kept.
IGNORED_DIRS = [
    ".git", ".quarto", "_site", "_freeze", "_cache", ".Rproj.user", "renv", "packrat", "node_modules", ".cache", "docs", "_check_reports", "_quarantine_unused",
    "_quarantine_source_clutter", "_quarantine_generated_html",
]
GENERATED = r"(^|/)[^/]+_files/|\.js$|\.html$|^scripts/check_site\.R$"
OPTIONAL = r"^README\.(md|Rmd)$"
COPIES = r" - (Copia|Copy|copia|copy)\.(qmd|Rmd|md|html|css|js|R)$"
PRIORITIES = ["alta", "média", "baixa", "manter"]
KEEP_RULES = ["^expedicoes/.+_files/", "^figures/brand/", "^figures/logo_inst/", "^figures/logo_", "^figures/video/", "^_input_data/", "^docs/", "^_site/"]
LARGE_MIB = 20


def is_ignored(path: Column | str, dirs: list[str] = IGNORED_DIRS) -> Column:
    """Whether a part of a path is an ignored folder or ends in _files."""
    return F.exists(F.split(path, "/"), lambda p: p.isin(*dirs) | p.endswith("_files"))


def references(contents: DataFrame, patterns: dict[str, str], file: str = "file", text: str = "text") -> DataFrame:
    """(file, type, ref): the first groups of all matches of each pattern, case aside; one scan of the texts."""
    found = F.array(*[F.struct(F.lit(k).alias("type"), F.regexp_extract_all(F.col(text), F.lit(f"(?i){p}"), F.lit(1)).alias("refs")) for k, p in patterns.items()])
    rows = contents.select(F.col(file).alias("file"), F.explode(found).alias("m"))
    return rows.select("file", F.col("m.type").alias("type"), F.explode("m.refs").alias("ref"))


def cleaned(refs: DataFrame, exts: list[str] | None = None) -> DataFrame:
    """Distinct references that may be files, cleaned, of some extensions if given, with their target paths."""
    rows = refs.withColumn("ref", R.clean_ref("ref")).where(~R.is_invalid("ref"))
    rows = rows if exts is None else rows.where(R.ends_with_ext("ref", exts))
    return rows.dropDuplicates(["file", "type", "ref"]).withColumn("target", R.resolve("ref", "file"))


def checked(refs: DataFrame, paths: DataFrame, dirs: DataFrame | None = None, html_sources: bool = False, path: str = "path") -> DataFrame:
    """``refs`` with whether their targets exist among ``paths`` (files) and ``dirs``; what can't be resolved counts as there.

    ``html_sources``: a page of that name as .qmd, .Rmd or .md will do.
    A folder exists as such, with or without an index page.
    """
    there = paths.select(F.col(path).alias("_p")).distinct()
    if dirs is not None:
        there = there.unionByName(dirs.select(F.col(path).alias("_p"))).distinct()
    names = F.array("target")
    if html_sources:
        stem = F.regexp_replace("target", r"\.html$", "")
        names = F.when(F.col("ref").endswith(".html"), F.array("target", *[F.concat(stem, F.lit(e)) for e in (".qmd", ".Rmd", ".md")])).otherwise(names)
    keyed = refs.select("file", "type", "ref", "target", F.explode(names).alias("_name"))
    keyed = keyed.join(there, F.col("_name") == F.col("_p"), "left").groupBy("file", "type", "ref", "target").agg(F.bool_or(F.col("_p").isNotNull()).alias("exists"))
    return keyed.withColumn("exists", F.col("exists") | F.col("target").isNull())


def case_matches(refs: DataFrame, paths: DataFrame, path: str = "path", pos: str | None = None) -> DataFrame:
    """``refs`` that don't exist with the first path that differs in case only, or null."""
    first = paths.groupBy(F.lower(path).alias("_lower")).agg(F.min_by(path, pos or path).alias("case_match"))
    return refs.where("not exists").join(first, F.lower("target") == F.col("_lower"), "left").drop("_lower")


def missing(refs: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """References whose target isn't there in any case."""
    return case_matches(refs, paths, path).where("case_match is null").drop("case_match")


def wrong_case(refs: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    return case_matches(refs, paths, path).where("case_match is not null")


def unused(paths: DataFrame, refs: DataFrame, path: str = "path", target: str = "target") -> DataFrame:
    """Paths that no reference names, case aside."""
    used = refs.select(F.lower(target).alias("_used")).where("_used is not null").distinct()
    return paths.join(used, F.lower(path) == F.col("_used"), "left_anti")


def case_duplicates(paths: DataFrame, path: Column | str = "path") -> DataFrame:
    """All rows whose lower-case path another row has too."""
    rows = paths.withColumn("lower_path", F.lower(path))
    again = rows.groupBy(F.col("lower_path").alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again")
    return rows.join(again, F.col("lower_path").eqNullSafe(F.col("_again")), "left_semi")


def large(inventory: DataFrame, size: str = "size_mb", most: float = LARGE_MIB) -> DataFrame:
    return inventory.where(F.col(size) > most)


def empty(inventory: DataFrame, size: str = "n_bytes") -> DataFrame:
    return inventory.where(F.col(size) == 0)


def expected(spark, names: list[str], paths: DataFrame, path: str = "path") -> DataFrame:
    """(expected_file, exists) of a list."""
    want = spark.createDataFrame([(n,) for n in names], "expected_file string")
    there = paths.select(F.col(path).alias("_p")).distinct()
    return want.join(there, F.col("expected_file") == F.col("_p"), "left").select("expected_file", F.col("_p").isNotNull().alias("exists"))


def packages(contents: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Distinct packages that R sources load."""
    r = contents.where(R.extension(file).isin("r", "qmd", "rmd"))
    return r.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(R.PACKAGE_PATTERN), F.lit(1))).alias("package")).distinct()


def summary(checks: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(kind, item, n) per check, then the total of the critical ones."""
    rows = None
    for item, (kind, df) in checks.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(item).alias("item"), "n")
        rows = one if rows is None else rows.unionByName(one)
    total = rows.where("kind = 'critical'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("kind"), F.lit("critical").alias("item"), "n")
    return rows.unionByName(total)


def sources_flagged(issues: DataFrame, file: str = "file") -> DataFrame:
    """``issues`` with is_generated and is_optional by their source; an empty report has the columns too."""
    return issues.withColumn("is_generated", F.col(file).rlike(GENERATED)).withColumn("is_optional", F.col(file).rlike(OPTIONAL))


def issues(rows: DataFrame, priority: Column | str, kind: str, file: Column, problem: Column, action: Column | str) -> DataFrame:
    """A report in the form of the action plan."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(lit(priority).alias("priority"), F.lit(kind).alias("type"), file.alias("file"), problem.alias("problem"), lit(action).alias("action"))


def action_plan(parts: list[DataFrame]) -> DataFrame:
    """All issues by priority, type and file."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("place", place_in("priority", PRIORITIES)).orderBy("place", "type", "file")


def target_counts(refs: DataFrame, target: str = "target") -> DataFrame:
    """References per target, the most named first."""
    return refs.groupBy(target).agg(F.count("*").alias("n")).orderBy(F.desc("n"), target)


def quarantine(unused_paths: DataFrame, path: str = "path", keep: list[str] | None = None, move: list[str] | None = None) -> DataFrame:
    """What to do with unused files: move by an extra rule first, keep by a rule next, else move."""
    rules = F.col(path).rlike("|".join(KEEP_RULES + (keep or [])))
    extra = F.col(path).rlike("|".join(move)) if move else F.lit(False)
    rows = unused_paths.withColumn("keep_by_rule", rules).withColumn("move_by_extra_rule", extra)
    return rows.withColumn("action", F.when(F.col("move_by_extra_rule"), "quarantine_candidate").when(F.col("keep_by_rule"), "keep").otherwise("quarantine_candidate"))


def clutter(paths: DataFrame, path: str = "path", ignored: str = r"^(\.git|_site|docs|_freeze|_cache|_check_reports|_quarantine_unused|_quarantine_source_clutter|\.Rproj.user|renv|node_modules)/") -> DataFrame:
    """Copies of sources by their names, outside ignored folders."""
    return paths.where(~F.col(path).rlike(ignored) & F.col(path).rlike(COPIES))


def still_there(plan: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """The rows of a plan whose file exists."""
    return plan.join(paths.select(F.col(path).alias("_p")).distinct(), F.col(path) == F.col("_p"), "left_semi")


def literal_fixes(text: Column | str, fixes: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    out = T._c(text)
    for old, new in fixes:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out
