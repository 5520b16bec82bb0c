"""Findings in code and text: issues, patches, secrets contract, symbol checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamstone.functions import text as T

#: Modules whose unused import is no finding.
EXEMPT_IMPORTS = ("os", "sys", "json", "re", "math")


def except_issues(lines: DataFrame) -> DataFrame:
    """``file_id, n, action`` of bare and silent except clauses in (file_id, n, line); the next line is looked at."""
    following = F.lead("line").over(Window.partitionBy("file_id").orderBy("n"))
    bare = F.col("line").rlike(r"^\s*except\s*:")
    silent = F.col("line").rlike(r"^\s*except\b.*:\s*$") & F.coalesce(F.col("following").rlike(r"^\s*pass\s*$"), F.lit(False))
    return lines.withColumn("following", following).withColumn("action", F.when(bare, "bare_except").when(silent, "silent_pass")).where(F.col("action").isNotNull()).select("file_id", "n", "action")


def unused_imports(files: DataFrame) -> DataFrame:
    """``file_id, module`` of lines ``import module ...`` whose module's name stands nowhere else in the file, not even within a word."""
    lines = F.regexp_extract_all("content", F.lit(r"(?md)^[ \t]*(import[ \t]+\w+.*)$"), F.lit(1))
    each = files.select("file_id", "content", F.explode(lines).alias("line")).withColumn("module", F.regexp_extract("line", r"^import[ \t]+(\w+)", 1))
    without = lambda text: F.length(text) - F.length(F.replace(text, F.col("module"), F.lit("")))
    return each.where(~F.col("module").isin(*EXEMPT_IMPORTS) & (without(F.col("content")) == without(F.col("line")))).select("file_id", "module")


#: Text secrets by label (category, severity, pattern).
TEXT_SECRETS = (
    ("token_assignment", "auth", "high", r"""(?i)(?:token|api_?key|secret)\s*[:=]\s*["'][A-Za-z0-9_\-]{16,}["']"""),
    ("password_assignment", "db", "critical", r"""(?i)(?:password|passwd|pwd)\s*[:=]\s*["'][^"'\s]{6,}["']"""),
    ("private_key", "crypto", "critical", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("cloud_key_id", "cloud", "critical", r"\bAKIA[A-Z0-9]{16}\b"),
    ("email", "pii", "low", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
)
_WEIGHT = {"critical": 1.0, "high": 0.7, "medium": 0.4, "low": 0.1}


#: Least entropy of a value and least confidence of a finding.
ENTROPY_FLOOR, MIN_CONFIDENCE = 3.0, 0.5


def secret_signals(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, label, category, severity, n``: how often each kind of secret is shown in each text."""
    found = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("category"), F.lit(c).alias("severity"), F.size(F.regexp_extract_all(text_col, F.lit(p), F.lit(0))).alias("n")) for a, b, c, p in TEXT_SECRETS])
    return df.where(F.col(text_col).isNotNull()).select(id_col, F.explode(found).alias("f")).select(id_col, "f.*").where(F.col("n") > 0)


def secret_findings(df: DataFrame, id_col: str, text_col: str, least: float = MIN_CONFIDENCE) -> DataFrame:
    """``id_col, label, category, severity, line_number, masked_value, confidence`` of every match in every line.

    A value is masked but for its first four characters.  The confidence is a
    quarter of the value's entropy, at most 1; assigned values below
    ENTROPY_FLOOR and findings below ``least`` are left out.  Null texts have none.
    """
    lines = df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("p", "line"))
    kinds = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("category"), F.lit(c).alias("severity"), F.regexp_extract_all("line", F.lit(p), F.lit(0)).alias("found")) for a, b, c, p in TEXT_SECRETS])
    each = lines.select(id_col, (F.col("p") + 1).alias("line_number"), F.explode(F.filter(kinds, lambda k: F.size(k.getField("found")) > 0)).alias("k")).select(id_col, "line_number", "k.label", "k.category", "k.severity", F.explode("k.found").alias("value"))
    rated = each.withColumn("h", F.round(T.entropy(F.col("value")), 6)).withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("h") / 4), 3))
    kept = rated.where((F.col("confidence") >= least) & (~F.col("label").endswith("_assignment") | (F.col("h") >= ENTROPY_FLOOR)))
    return kept.select(id_col, "label", "category", "severity", "line_number", F.concat(F.substring("value", 1, 4), F.lit("****")).alias("masked_value"), "confidence")


def secret_risk(signals: DataFrame, id_col: str) -> DataFrame:
    """``id_col, risk, level``: the weight of the worst kind found, HIGH above .5, MODERATE above .1."""
    weight = F.create_map(*[F.lit(x) for p in _WEIGHT.items() for x in p])[F.col("severity")]
    risk = signals.groupBy(id_col).agg(F.round(F.max(weight), 3).alias("risk"))
    return risk.withColumn("level", F.when(F.col("risk") > 0.5, "HIGH").when(F.col("risk") > 0.1, "MODERATE").otherwise("LOW"))


def symbol_match(texts: DataFrame, id_col: str, names: DataFrame, text_col: str) -> DataFrame:
    """``id_col, referenced, matched, match_ratio`` of the symbols that texts refer to, against known ``name``s."""
    each = texts.select(id_col, F.explode(T.referenced_symbols(F.col(text_col))).alias("name"))
    known = names.select("name").where(F.col("name").isNotNull()).distinct().withColumn("_k", F.lit(1))
    return (
        each.join(known, "name", "left")
        .groupBy(id_col)
        .agg(F.count(F.lit(1)).alias("referenced"), F.count("_k").alias("matched"))
        .withColumn("match_ratio", F.round(F.col("matched") / F.col("referenced"), 3))
    )


def patched(content, old, new):
    """The content with the first occurrence of ``old`` replaced (Columns); unchanged where it is not found."""
    at = F.instr(content, old)
    return F.when(at > 0, F.concat(F.substring(content, F.lit(1), at - 1), new, F.substring(content, at + F.length(old), F.length(content)))).otherwise(content)


def patch_score(df: DataFrame) -> DataFrame:
    """Add ``after, delta, quality, raw_state, safe`` to patches (content, old, new), as a dry run.

    ``quality`` falls with the rise of entropy (1 where it does not rise).  A
    rise above 0.5 is UNSTABLE, one above 0 WEAK; an unstable patch is healed
    to WEAK before it is judged, so ``safe`` tells whether its raw state is sound.
    """
    made = df.withColumn("after", patched(F.col("content"), F.col("old"), F.col("new")))
    delta = F.round(T.entropy(F.col("after")) - T.entropy(F.col("content")), 6)
    quality = F.round(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("delta")) / 8), 6)
    return made.withColumn("delta", delta).withColumn("quality", quality).withColumn("raw_state", F.when(F.col("delta") > 0.5, "UNSTABLE").when(F.col("delta") > 0, "WEAK").otherwise("STABLE")).withColumn("safe", F.col("raw_state") != "UNSTABLE")


def patch_report(scored: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., patches, skipped, quality, state``: the mean quality of patches, STABLE from 0.8, WEAK from 0.5."""
    per = scored.where(F.col("quality").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("patches"), F.count_if(~F.col("safe")).alias("skipped"), F.round(F.avg("quality"), 3).alias("quality"))
    return per.withColumn("state", F.when(F.col("quality") >= 0.8, "STABLE").when(F.col("quality") >= 0.5, "WEAK").otherwise("UNSTABLE"))


def patch_actions(files: DataFrame, lines: DataFrame, drift: DataFrame) -> DataFrame:
    """``file_id, action, detail`` of everything a patch could mend: unused imports, except clauses, symbols that are gone."""
    a = unused_imports(files).select("file_id", F.lit("unused_import").alias("action"), F.col("module").alias("detail"))
    b = except_issues(lines).select("file_id", "action", F.col("n").cast("string").alias("detail"))
    c = drift.where(F.col("side") == "only_left").select("file_id", F.lit("symbol_drift").alias("action"), F.col("name").alias("detail"))
    return a.unionByName(b).unionByName(c)


def deterministic(*outputs: DataFrame) -> bool:
    """Whether several results hold the same rows, by order-free hashes (one number each)."""
    return len({df.select(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)").alias("h")).agg(F.sum("h"), F.count("*")).first() for df in outputs}) == 1
