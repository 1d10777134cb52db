"""Answers to questions from the compiled state: one job for any number of questions.

The route is a column. What a route needs of the state is cut to the few rows that an answer may show before it is
brought together, so the one row that every question meets stays small however large the state is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vespera.functions import names as N
from vespera.functions import text as X
from vespera.operators import graph
from vespera.operators.merge import rank
from vespera.plans.evidence import follow_up
from vespera.sources import storage

CONFIRM = ("compromise", "malware", "exfiltration")
#: Lines of a list in an answer at most, by kind (part of the answers' form).
EVENTS, TITLES, FACTS, STEPS, SOURCES, ALL_SOURCES = 5, 3, 3, 6, 6, 200
INSUFFICIENT = "Evidence is insufficient."
COLUMNS = ("qid", "route", "classification", "confidence", "insufficient", "body", "evidence", "caveats", "pages", "sources")


@dataclass
class Tables:
    """claims, iocs, contradictions, events, entities as compiled; files: path of every known source."""

    claims: DataFrame
    iocs: DataFrame
    contradictions: DataFrame
    events: DataFrame
    entities: DataFrame
    files: DataFrame


def _first(rows: DataFrame, order: list, value: Column, k: int, name: str) -> DataFrame:
    """One row with a list of the first k values; only k rows are brought together."""
    keys = [o.alias(f"o{i}") for i, o in enumerate(order)]
    top = rows.select(*keys, value.alias("v")).orderBy(*[f"o{i}" for i in range(len(order))]).limit(k)
    return top.agg(F.transform(F.array_sort(F.collect_list(F.struct(*[f"o{i}" for i in range(len(order))], "v"))), lambda x: x["v"]).alias(name))


def reduced(s: Tables) -> DataFrame:
    """The state in one row of bounded size: counts, the strongest claims, the first events of the kinds that routes ask for."""
    strong, low = rank(F.col("confidence")) >= 3, F.lower("title")
    topics = [F.coalesce(F.bool_or(strong & low.contains(t)), F.lit(False)).alias(f"strong_{t}") for t in CONFIRM]
    about = lambda word: F.max_by(F.struct("title", "confidence", F.slice("facts", 1, FACTS).alias("facts"), F.slice("supporting", 1, SOURCES).alias("supporting")), F.when(low.contains(word), F.struct(rank(F.col("confidence")), "title")))
    c = s.claims.agg(F.count("*").alias("n_claims"), *topics, about("persist").alias("persistence"), about("beacon").alias("network"))
    is_network = X.event_type(F.col("description")) == "network_connection"
    line = F.concat(F.col("description"), F.lit(" (Source: "), "path", F.lit(")"))
    steps, number = follow_up(s.claims), F.regexp_extract("claim_id", r"(\d+)$", 1).cast("long")
    told = F.concat("text", F.lit(" (from "), "claim_id", F.lit(")"))
    remote = s.events.where(is_network).select("seq", F.explode(F.regexp_extract_all("description", F.lit(X.IP), F.lit(0))).alias("ip")).where(N.notable_ip(F.col("ip")))
    parts = [
        _first(s.claims, [-rank(F.col("confidence")), number], F.struct(F.concat("title", F.lit(" ("), "confidence", F.lit(")")).alias("t"), "confidence"), TITLES, "strongest"),
        _first(s.contradictions, [F.col("title")], F.concat("title", F.lit(": "), "claim_b"), ALL_SOURCES, "conflicts"),
        _first(s.events.where(is_network), [F.col("seq")], line, EVENTS, "network_events"),
        _first(remote, [F.col("seq"), F.col("ip")], F.col("ip"), 1, "remote"),
        _first(s.events.where(F.lower("description").startswith("hash reputation")), [F.col("seq")], line, 1, "reputation"),
        _first(steps.where("kind = 'step'"), [number, F.col("pos")], told, STEPS, "steps"),
        _first(steps.where("kind = 'question'"), [number, F.col("pos")], told, STEPS, "questions"),
        _first(s.files.select("path").distinct(), [F.col("path")], F.col("path"), ALL_SOURCES, "all_sources"),
        s.iocs.agg(F.count("*").alias("n_iocs")), s.files.agg(F.count_distinct("path").alias("n_sources")), s.events.agg(F.count_if(is_network).alias("n_network")), s.contradictions.agg(F.count("*").alias("n_conflicts")),
    ]
    for p in parts:
        c = c.crossJoin(p)  # one row each
    # titles of the highest confidence that any claim has
    highest = F.filter("strongest", lambda x: x["confidence"] == F.element_at("strongest", 1)["confidence"])
    return c.withColumn("titles", F.when(F.size("strongest") > 0, F.transform(highest, lambda x: x["t"])).otherwise(F.array().cast("array<string>")))


def named(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """qid, label, paths: the longest entity that each question names, the first of equals, and the files that mention it."""
    e = entities.select(F.col("value").alias("label"), "seq", "type", "key", "sources")
    hit = graph.longest_match(questions, e)
    # every type of the same spelling counts
    at = hit.select("qid", "label", F.lower("label").alias("low")).join(e.select(F.lower("label").alias("low"), F.explode("sources").alias("path")), "low")
    return at.groupBy("qid", "label").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def mentioning(found: DataFrame, events: DataFrame, files: DataFrame | None) -> DataFrame:
    """named()'s rows with the sources of events that tell of the label and of files whose path or text holds it. files: path, text.

    found is one row a question at most. Labels are looked up in the texts by their prefixes, so nothing is paired that
    shares none (graph.matches).
    """
    found = storage.stored(found, "named")  # it is read three times
    asked = found.select(F.col("qid").alias("asked"), "label")
    hit = lambda path, text: graph.matches(path.select(F.col("path").alias("qid"), text.alias("question")), asked).select(F.col("asked").alias("qid"), "label", F.col("qid").alias("path"))
    every = found.select("qid", "label", F.explode("paths").alias("path")).unionByName(hit(events, F.col("description")))
    if files is not None:
        every = every.unionByName(hit(files, F.concat_ws("\n", "path", "text")))
    return every.groupBy("qid", "label").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def generic(questions: DataFrame, s: Tables) -> DataFrame:
    """qid, body, classification, confidence, evidence, pages, sources for questions of which the state knows a word.

    Words are those of question_tokens. The first hypothesis with one is told, else the first indicator, else how many
    events have one (EVENTS at most) and the first. Events that would echo an overclaim are left out.
    """
    asked = questions.select("qid", F.explode(F.array_distinct(X.question_tokens(F.col("question")))).alias("w"))

    words = asked.select("w").distinct()

    def first(rows: DataFrame, text: Column, what: Column, k: int) -> DataFrame:
        """qid, x: the first k of each question, in order. Each word keeps its first k before it meets the questions that use it."""
        by_word = rows.select(what.alias("x"), F.explode(F.array_distinct(F.filter(X.question_tokens(text), lambda w: w != ""))).alias("w")).join(words, "w", "left_semi")
        top = by_word.withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy("x"))).where(F.col("r") <= k).drop("r")
        met = asked.join(top, "w").select("qid", "x").distinct()
        met = met.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("x"))).where(F.col("r") <= k)
        return met.groupBy("qid").agg(F.array_sort(F.collect_list("x")).alias("x"))  # k at most

    claim = F.struct("claim_id", "title", "confidence", "inference")
    ioc = F.struct("seq", "artifact", "type", "confidence", "reason")
    h = first(s.claims, F.concat_ws(" ", "title", "inference"), claim, 1).select("qid", F.element_at("x", 1).alias("h"))
    i = first(s.iocs, F.concat_ws(" ", "artifact", "reason"), ioc, 1).select("qid", F.element_at("x", 1).alias("i"))
    e = first(s.events.where(~N.echoes(F.col("description"))), F.col("description"), F.struct("seq", "description", "path"), EVENTS).withColumnRenamed("x", "e")
    x = questions.select("qid").join(h, "qid", "left").join(i, "qid", "left").join(e, "qid", "left").where("h is not null or i is not null or e is not null")
    hyp, ind, events = F.col("h").isNotNull(), F.col("i").isNotNull(), F.coalesce("e", F.expr("cast(array() as array<struct<seq:string,description:string,path:string>>)"))
    body = (
        F.when(hyp, F.concat(F.lit("Hypothesis on record: "), F.col("h.title"), F.lit(" (confidence: "), F.col("h.confidence"), F.lit("). "), F.col("h.inference")))
        .when(ind, F.concat(F.lit("Indicator on record: "), F.col("i.artifact"), F.lit(" ("), F.col("i.type"), F.lit(", confidence: "), F.col("i.confidence"), F.lit("). "), F.col("i.reason")))
        .otherwise(F.concat(F.size(events).cast("string"), F.lit(" event(s) of the timeline match. The first: "), F.element_at(events, 1)["description"]))
    )
    kind = F.when(hyp, "hypothesis").when(ind, "inference").otherwise("fact")
    sure = F.when(hyp, F.col("h.confidence")).when(ind, F.col("i.confidence")).otherwise("Medium")
    pages = F.filter(F.array(F.when(hyp, "hypotheses"), F.when(F.size(events) > 0, "timeline"), F.when(ind, "iocs")), lambda p: p.isNotNull())
    return x.select("qid", body.alias("body"), kind.alias("classification"), sure.alias("confidence"), F.transform(events, lambda y: y["description"]).alias("evidence"), pages.alias("pages"), F.array_sort(F.array_distinct(F.transform(events, lambda y: y["path"]))).alias("sources"))


def answers(questions: DataFrame, s: Tables, texts: DataFrame | None = None) -> DataFrame:
    """questions: qid, question. COLUMNS and answer, the rendered text. texts: path, text of the sources, to look for names in.

    A state without claims and indicators can confirm or deny nothing.
    """
    routed = questions.select("qid", "question", X.route(F.col("question")).alias("route"))
    only = routed.where("route = 'sources'")
    found = mentioning(named(only, s.entities), s.events, texts)
    free = generic(routed.where("route = 'generic'"), s).select("qid", F.struct("body", "classification", "confidence", "evidence", "pages", "sources").alias("g"))
    q = routed.crossJoin(F.broadcast(reduced(s))).join(found, "qid", "left").join(free, "qid", "left")  # one row of bounded size
    route = F.col("route")
    confirm = route.isin(*CONFIRM)
    yes = F.when(route == "malware", F.col("strong_malware")).when(route == "compromise", F.col("strong_compromise")).when(route == "exfiltration", F.col("strong_exfiltration")).otherwise(False)
    nothing = (F.col("n_claims") == 0) & (F.col("n_iocs") == 0)
    name = F.concat(F.upper(F.substring(route, 1, 1)), F.substring(route, 2, 99))
    none = F.array().cast("array<string>")
    beyond = lambda n: F.when(F.col(n) > ALL_SOURCES, F.array(F.concat(F.lit("and "), (F.col(n) - ALL_SOURCES).cast("string"), F.lit(" more")))).otherwise(none)
    insufficient = (
        F.when(confirm, nothing).when(route == "persistence", F.col("persistence").isNull()).when(route == "network", F.col("n_network") == 0)
        .when(route == "signature", F.size("reputation") == 0).when(route == "contradiction", F.size("conflicts") == 0)
        .when(route == "sources", F.col("label").isNull()).when(route == "next_steps", F.size(F.concat("steps", "questions")) == 0).otherwise(F.col("g").isNull())
    )
    address = F.when(F.size("remote") > 0, F.concat(F.lit(" A remote address to note: "), F.element_at("remote", 1), F.lit("."))).otherwise("")
    body = (
        F.when(confirm & yes, F.concat(F.lit("Yes. "), name, F.lit(" is supported at high confidence.")))
        .when(confirm, F.concat(F.lit("No. "), name, F.lit(" is not confirmed.")))
        .when(route == "persistence", F.concat(F.lit("Persistence is a hypothesis: "), F.col("persistence.title"), F.lit(".")))
        .when(route == "network", F.concat(F.lit("Yes. "), F.col("n_network").cast("string"), F.lit(" network event(s) are on record."), address))
        .when(route == "signature", F.lit("No signature check was recorded."))
        .when(route == "contradiction", F.concat(F.col("n_conflicts").cast("string"), F.lit(" contradiction(s) are on record.")))
        .when(route == "sources", F.concat("label", F.lit(" is mentioned in: "), F.array_join(F.slice("paths", 1, SOURCES), ", "), F.when(F.size("paths") > SOURCES, F.concat(F.lit(" and "), (F.size("paths") - SOURCES).cast("string"), F.lit(" more."))).otherwise(".")))
        .when(route == "next_steps", F.lit("Steps and questions that the hypotheses leave:"))
        .otherwise(F.col("g.body"))
    )
    evidence = (
        F.when(confirm, F.transform("titles", lambda t: F.concat(F.lit("Hypothesis: "), t))).when(route == "persistence", F.col("persistence.facts")).when(route == "network", F.col("network_events"))
        .when(route == "signature", F.col("reputation")).when(route == "next_steps", F.concat("steps", F.transform("questions", lambda t: F.concat(F.lit("Open question: "), t)))).when(route == "generic", F.col("g.evidence")).otherwise(none)
    )
    caveats = F.when(confirm | route.isin("contradiction", "persistence", "generic"), F.concat("conflicts", beyond("n_conflicts"))).otherwise(none)
    listed = F.when(confirm, F.array(F.lit("hypotheses"), F.lit("contradictions"))).when(route == "persistence", F.array(F.lit("hypotheses"))).when(route.isin("network", "signature"), F.array(F.lit("timeline")))
    pages = listed.when(route == "contradiction", F.array(F.lit("contradictions"))).when(route == "sources", F.array(F.lit("entities"))).when(route == "next_steps", F.array(F.lit("open_questions"))).otherwise(F.coalesce("g.pages", none))
    cited = lambda c: F.array_distinct(F.filter(F.transform(c, N.source_path), lambda p: p != ""))
    sources = F.when(confirm, F.concat("all_sources", beyond("n_sources"))).when(route == "persistence", F.col("persistence.supporting")).when(route == "network", cited("network_events")).when(route == "signature", cited("reputation")).when(route == "contradiction", cited("conflicts")).when(route == "sources", F.slice("paths", 1, SOURCES)).when(route == "generic", F.col("g.sources"))
    kind = F.when(route == "next_steps", "inference").when(route.isin("signature", "sources") | (confirm & yes), "fact").when(route == "generic", F.col("g.classification")).otherwise("hypothesis")
    sure = F.when((confirm & yes) | (route == "sources"), "High").when(route == "persistence", F.col("persistence.confidence")).when(route == "network", F.coalesce("network.confidence", F.lit("Low"))).when(confirm & (F.col("n_claims") == 0), "Low").when(route == "generic", F.col("g.confidence")).otherwise("Medium")
    blank = lambda c: F.when(F.col("insufficient"), none).otherwise(F.coalesce(c, none))
    x = q.withColumn("insufficient", insufficient)
    x = x.select(
        "qid", "route", F.when(F.col("insufficient"), "hypothesis").otherwise(kind).alias("classification"), F.when(F.col("insufficient"), "Low").otherwise(F.coalesce(sure, F.lit("Low"))).alias("confidence"), "insufficient",
        F.when(F.col("insufficient"), INSUFFICIENT).otherwise(body).alias("body"), blank(evidence).alias("evidence"), blank(caveats).alias("caveats"), blank(pages).alias("pages"), blank(sources).alias("sources"),
    )
    return x.withColumn("answer", rendered())


def rendered() -> Column:
    """The text of an answer from COLUMNS: its body and a block for each list that is not empty. Insufficient ones are one sentence."""
    block = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n{title}:\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise("")
    linked = F.transform("pages", lambda p: F.concat(F.lit("[["), p, F.lit("]]")))
    sure = F.concat(F.lit("\n\nConfidence:\n"), "confidence", F.lit(" ("), "classification", F.lit(")"))
    whole = F.concat(F.lit("Answer:\n"), "body", block("Evidence", F.col("evidence")), block("Contradictions", F.col("caveats")), sure, block("Pages", linked), block("Sources", F.col("sources")))
    return F.when(F.col("insufficient"), F.col("body")).otherwise(whole)


def with_fallback(answered: DataFrame, lexical: DataFrame) -> DataFrame:
    """Insufficient answers are replaced by lexical ones, marked and of low confidence. lexical: qid, snippet."""
    x = answered.join(lexical.select("qid", "snippet"), "qid", "left")
    use = F.col("insufficient") & F.col("snippet").isNotNull()
    text = F.concat(F.lit("Answer:\n"), "snippet", F.lit("\n\nNote: taken from the raw sources; the compiled state has no answer.\n\nConfidence:\nLow (fact)"))
    kept = [c for c in answered.columns if c not in ("classification", "confidence", "insufficient", "answer")]
    return x.select(*kept, F.when(use, "fact").otherwise(F.col("classification")).alias("classification"), F.when(use, "Low").otherwise(F.col("confidence")).alias("confidence"), (F.col("insufficient") & ~use).alias("insufficient"), F.when(use, text).otherwise(F.col("answer")).alias("answer"), use.alias("fell_back"))
