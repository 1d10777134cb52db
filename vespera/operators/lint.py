"""Lint rules over pages, citations and claims, each a join, an anti-join or a text predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vespera.operators import graph
from vespera.sources import storage

# Phrases and markers that results depend on.
RISKY_PHRASES = (
    "confirmed malware", "malware confirmed", "confirmed exfiltration", "exfiltration occurred", "exfiltration confirmed", "data was stolen",
    "confirmed compromise", "definitely malicious", "definite malware",
)
REVIEW_MARKERS = ("investigator", "analyst", "asserts", "alleges", "claims", "describes", "describe", "diagnosis", "note:", "notes:", "according to", "claim a:", "claim b:")
LINT_MARKERS = REVIEW_MARKERS + ("quoted", "says", "argues", "reported")
CONFIRMATION_PHRASES = ("confirmed malware", "malware confirmed", "confirmed exfiltration", "confirmed compromise", "definite malware", "definitely malicious")
EXFILTRATION_PHRASES = ("exfiltration occurred", "data was stolen", "data theft confirmed", "confirmed exfiltration")
PAGE_LINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
CITED = r"Source:|Evidence:|raw_sources/|\[\[|claim_\d+|evt_\d+"
SEVERITIES = ("Critical", "High", "Medium", "Low")


def contains_any(text: Column, words) -> Column:
    if not words:
        return F.lit(False)
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))


def risky_lines(pages: DataFrame, phrases=RISKY_PHRASES, markers=REVIEW_MARKERS) -> DataFrame:
    """page, line_no, phrase of every unattributed line that holds a phrase. pages: page, body."""
    lines = pages.select("page", F.posexplode(F.split("body", "\n")).alias("line_no", "line")).where(contains_any(F.col("line"), phrases) & ~contains_any(F.col("line"), markers))
    held = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(F.col("line")), p))
    return lines.select("page", "line_no", F.explode(held).alias("phrase"))


def newly_risky(old: DataFrame, new: DataFrame, **rules) -> DataFrame:
    """page, phrase: phrases that a page has now and had not before."""
    return risky_lines(new, **rules).select("page", "phrase").distinct().join(risky_lines(old, **rules).select("page", "phrase"), ["page", "phrase"], "left_anti")


def missing(wanted: DataFrame, there: DataFrame, key: str, rule: str, severity: str) -> DataFrame:
    """A finding for each wanted key that is not there."""
    return wanted.select(key).distinct().join(there.select(key), key, "left_anti").select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(key).cast("string").alias("page"))


def incompatible_types(entities: DataFrame, allowed=("file", "process", "command")) -> DataFrame:
    """key, types: values that occur under several types which do not go together. entities: type, value."""
    g = entities.groupBy(F.lower("value").alias("key")).agg(F.array_sort(F.collect_set("type")).alias("t")).where(F.size("t") > 1)
    return g.where(F.size(F.array_except("t", F.array(*map(F.lit, allowed)))) > 0).select("key", F.array_join("t", ",").alias("types"))


def summary(findings: DataFrame) -> DataFrame:
    """One row, a count a severity, zero where there is none."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SEVERITIES])


def finding(rows: DataFrame, rule: str, severity: str, page, detail="") -> DataFrame:
    """rule, severity, page, detail: a finding for each row."""
    text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), text(page).alias("page"), text(detail).alias("detail"))


def asserted_lines(pages: DataFrame, phrases, markers=LINT_MARKERS) -> DataFrame:
    """page, line_no, phrase: one row an unattributed line, with the first of the phrases that it holds."""
    at = {p: i for i, p in enumerate(phrases)}
    order = F.create_map(*[F.lit(x) for kv in at.items() for x in kv])[F.col("phrase")]
    return risky_lines(pages, phrases, markers).groupBy("page", "line_no").agg(F.min_by("phrase", order).alias("phrase"))


def links(pages: DataFrame) -> DataFrame:
    """page, target: every distinct page that a page links to, without folder and suffix."""
    raw = pages.select("page", F.explode(F.regexp_extract_all("body", F.lit(PAGE_LINK), F.lit(1))).alias("raw"))
    return raw.select("page", F.regexp_replace(F.regexp_replace(F.trim("raw"), "^.*/", ""), r"(?<=.)\.[^.]*$", "").alias("target")).distinct()


def broken_links(pages: DataFrame) -> DataFrame:
    """page, target: links to pages that are not there."""
    return links(pages).join(pages.select(F.col("page").alias("target")), "target", "left_anti").select("page", "target")


def orphans(pages: DataFrame, roots=("index",)) -> DataFrame:
    """page: pages that no page links to; roots need no link."""
    return pages.where(~F.col("page").isin(*roots)).select("page").join(links(pages).select(F.col("target").alias("page")), "page", "left_anti")


def broken_citations(pages: DataFrame, files: DataFrame, pattern: str = r"Source: ([^)\n]+)\)") -> DataFrame:
    """page, path: cited evidence files (group 1 of the pattern) that are not there. files: path."""
    cited = pages.select("page", F.explode(F.regexp_extract_all("body", F.lit(pattern), F.lit(1))).alias("path")).distinct()
    return cited.join(files.select("path"), "path", "left_anti").select("page", "path")


def unknown_ids(pages: DataFrame, known: DataFrame, pattern: str = r"\bclaim_\d{4,}\b") -> DataFrame:
    """page, id: ids in page texts that known (column id) does not hold."""
    used = pages.select("page", F.explode(F.regexp_extract_all("body", F.lit(pattern), F.lit(0))).alias("id")).distinct()
    return used.join(known.select("id"), "id", "left_anti").select("page", "id")


def uncited_facts(facts: DataFrame) -> DataFrame:
    """facts: title, fact. Those that name no source, page, claim or event."""
    return facts.where((F.col("fact") != "") & ~F.col("fact").rlike(CITED))


def unrelated(claims: DataFrame, contradictions: DataFrame) -> DataFrame:
    """claims (title) that share no blank-separated word with the title or first claim of any contradiction."""
    words = lambda *c: F.explode(F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", *c)), r"\s+"), lambda w: w != ""))).alias("word")
    against = contradictions.select(words("title", "claim_a")).distinct()
    linked = claims.select("title", words("title")).join(against, "word", "left_semi").select("title").distinct()
    return claims.join(linked, "title", "left_anti")


def unmentioned(values: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """values whose key no line of any page contains, in any case. Null keys are left out, the empty one is in every page.

    What has no blank is contained in one word, so keys are looked for in the distinct words of all pages, which are far
    fewer than their lines. A key with blanks is looked for in the lines too, if the longest of its words was found.
    """
    words = lambda text: F.split(F.translate(text, "\t\r\n", "   "), " ")
    asked = values.where(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("low", F.lower(key))
    named = asked.select("low", F.array_max(F.transform(words(F.col("low")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("part")).distinct()
    there = pages.select(F.explode(F.array_distinct(words(F.lower("body")))).alias("question")).distinct().select(F.lit(0).alias("qid"), "question")
    parts = graph.matches(there, named.select(F.col("part").alias("label")).distinct()).select(F.col("label").alias("part")).distinct()
    found = named.join(storage.stored(parts, "parts"), "part", "left_semi")  # read twice
    several = found.where("part != low").unionByName(named.where("part = ''"))
    line = pages.select(F.explode(F.array_distinct(F.split("body", "\n"))).alias("question")).distinct().select(F.lit(0).alias("qid"), "question")
    held = graph.matches(line, several.select(F.col("low").alias("label"))).select(F.col("label").alias("low")).distinct()
    return asked.join(found.where("part = low").select("low").unionByName(held), "low", "left_anti").drop("low")


def stale(pages: DataFrame, cutoff: Column) -> DataFrame:
    """pages (page, modified) that are more than five seconds older than the last merge."""
    return pages.where(F.col("modified") + F.expr("INTERVAL 5 SECONDS") < cutoff)


def with_meta(findings: DataFrame) -> DataFrame:
    """findings, and one more that advises a review if any is critical."""
    any_ = findings.agg(F.count_if(F.col("severity") == "Critical").alias("n")).where("n > 0")
    return findings.unionByName(finding(any_, "C5", "Critical", "(meta)", "critical findings: hold risky changes for review"))


def every(pages: DataFrame, written: DataFrame, claims: DataFrame, conflicts: DataFrame, entities: DataFrame, iocs: DataFrame, manifest: DataFrame, files: DataFrame, stale_pages: DataFrame, names, report: str) -> DataFrame:
    """rule, severity, page, detail: the findings of all rules. names: the pages that a case must have, report one of them."""
    return with_meta(union(rules(pages, written, claims, conflicts, entities, iocs, manifest, files, stale_pages, names, report).values()))


def union(parts) -> DataFrame:
    first, *rest = parts
    for x in rest:
        first = first.unionByName(x)
    return first


def rules(pages: DataFrame, written: DataFrame, claims: DataFrame, conflicts: DataFrame, entities: DataFrame, iocs: DataFrame, manifest: DataFrame, files: DataFrame, stale_pages: DataFrame, names, report: str) -> dict[str, DataFrame]:
    """The findings of each rule that looks at rows, by its name."""
    strong = F.col("confidence").isin("High", "Confirmed")
    spark = pages.sparkSession
    wanted = spark.createDataFrame([(n,) for n in names if n != report], "page string")
    guard = claims.agg(
        F.count_if(strong & (F.size("supporting") >= 2)).alias("backed"), F.count_if(strong).alias("strong"), F.count_if(strong & F.lower(F.concat_ws(" ", "title", "inference")).contains("exfil")).alias("exfil"),
        F.count_if(F.lower(F.concat_ws(" ", "title", "inference", F.array_join("facts", " "))).rlike("transfer|upload|sent ")).alias("sent"),
    )
    unless = lambda df, count: df.crossJoin(F.broadcast(guard)).where(F.col(count) == 0)  # noqa: E731  one row
    final = pages.where(F.col("page") == report)
    facts = claims.select("title", F.explode("facts").alias("fact"))
    hyp, why = F.lit("hypotheses"), F.when(F.col("sent") > 0, " (a transfer is on record, but no claim of it is strong)").otherwise("")
    return {
        "H1": finding(wanted.join(written, "page", "left_anti"), "H1", "High", F.col("page")),
        "C1": finding(unless(asserted_lines(pages, CONFIRMATION_PHRASES), "backed"), "C1", "Critical", F.col("page"), F.col("phrase")),
        "C2": finding(unless(risky_lines(final, CONFIRMATION_PHRASES, ()).select("page", "phrase").distinct(), "strong"), "C2", "Critical", F.col("page"), F.col("phrase")),
        "C3": finding(broken_citations(pages, files), "C3", "Critical", F.col("page"), F.col("path")),
        "C4": finding(unless(asserted_lines(pages, EXFILTRATION_PHRASES), "exfil"), "C4", "Critical", F.col("page"), F.concat("phrase", why)),
        "H2": finding(files.select("path").join(manifest.select("path"), "path", "left_anti"), "H2", "High", F.col("path")),
        "H3": finding(claims.where(strong & (F.size("supporting") < 2)), "H3", "High", hyp, F.col("title")),
        "H4": finding(unknown_ids(final, claims.select(F.col("claim_id").alias("id"))), "H4", "High", F.col("page"), F.col("id")),
        "M1": finding(unrelated(claims.where(F.size("contradicting") == 0), conflicts), "M1", "Medium", hyp, F.col("title")),
        "M2": finding(claims.where(((F.col("inference") != "") & (F.size("facts") == 0)) | (F.size("supporting") == 0)), "M2", "Medium", hyp, F.col("title")),
        "M3": finding(uncited_facts(facts), "M3", "Medium", hyp, F.col("title")),
        "M4": finding(stale_pages, "M4", "Medium", F.col("page")),
        "M5": finding(broken_links(pages), "M5", "Medium", F.col("page"), F.col("target")),
        "M6": finding(unmentioned(conflicts, pages.where("page = 'contradictions'"), "title"), "M6", "Medium", F.lit("contradictions"), F.col("title")),
        "L1": finding(incompatible_types(entities), "L1", "Low", F.lit("entities"), F.col("key")),
        "L2": finding(orphans(pages), "L2", "Low", F.col("page")),
        "L3": finding(unmentioned(entities, pages.where("page != 'entities'"), "value"), "L3", "Low", F.lit("entities"), F.col("value")),
        "L5": finding(alone(iocs, entities), "L5", "Low", F.lit("iocs"), F.col("artifact")),
    }


def alone(iocs: DataFrame, entities: DataFrame) -> DataFrame:
    """Indicators (artifact, source) whose source mentions nothing but themselves, so that nothing is related to them."""
    at = entities.select(F.lower("value").alias("low"), F.explode("sources").alias("source"))
    near = iocs.select("artifact", "source").join(at, "source").where(F.lower("artifact") != F.col("low")).select("artifact", "source").distinct()
    return iocs.join(near, ["artifact", "source"], "left_anti")
