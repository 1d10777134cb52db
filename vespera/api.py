"""A case: evidence below one folder, its compiled tables below another."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespera.operators import diff, embed, evaluate, graph, history, lint, merge, retrieval, review
from vespera.operators import trace as T
from vespera.plans import answers, evidence, index, methods, pages, replay, report
from vespera.sources import files as listed
from vespera.sources import storage
from vespera.sources.evidence import scan, with_rows

# Schemas of tables that may not be there yet.
SCHEMAS = {
    "manifest": "path string, sha string, status string, kind string, at string",
    "pages": "page string, body string, at string",
    "report": "page string, body string, at string",
    "reviews": "review_id string, page string, status string, phrases array<string>, proposed string, prior string",
    "history": "title string, claim_id string, step string, confidence string, assessment string, supporting_count int, contradicting_count int",
    "claims": "claim_id string, title string, confidence string, inference string, facts array<string>, supporting array<string>, contradicting array<string>",
    "conflicts": "title string, seq string, rule string, claim_a string, claim_b string, path string",
    "contradictions": "title string, seq string, rule string, claim_a string, claim_b string, path string",
    "events": "ts string, description string, path string, seq string, relation string, actor_type string, actor string, target_type string, targets array<string>",
    "entities": "type string, key string, value string, sources array<string>, n_sources long, seq string",
    "iocs": "type string, key string, artifact string, first_seen string, source string, confidence string, reason string, seq string",
    "nodes": "id string, type string, label string, seq string",
    "edges": "source string, target string, type string, evidence string",
    "event_index": "event_id string, key string, ts string, event_type string, description string, source_path string, evidence_text string, confidence string",
    "entity_index": "entity_id string, key string, entity_type string, value string, source_paths array<string>, related_pages array<string>",
    "claim_index": "claim_id string, claim_type string, claim_text string, confidence string, supporting_evidence array<struct<source_path:string,evidence_text:string>>, contradicting_evidence array<struct<source_path:string,evidence_text:string>>, linked_pages array<string>",
    "changes": "path string, state string",
    "snapshots": "name string, page string, body string",
}
PAGES = "page string, body string"
KEY_QUESTION = "What is the overall assessment?"


def cases(spark: SparkSession, roots: str, states: str) -> list[dict]:
    """case, has_evidence, has_state of every case below the two folders."""
    raw, made = set(storage.names(spark, roots)), set(storage.names(spark, states))
    return [{"case": c, "has_evidence": c in raw, "has_state": c in made} for c in sorted(raw | made)]


class Case:
    def __init__(self, spark: SparkSession, root: str, state: str, extract: Callable[[DataFrame], dict[str, DataFrame]] = evidence.extract, traced: bool = True, embedder: embed.Embedder | None = None):
        """extract: what turns parsed files into the tables of facts (evidence.RAW); extractor.extracting gives one that may ask a model.

        embedder: how the vector method sees texts; hashed features if none is given.
        """
        self.spark, self.root, self.at = spark, root, state.rstrip("/")
        self.extract, self.traced, self.embedder = extract, traced, embedder
        self.versions = storage.Versions(spark, self.at)

    def files(self, step: str | None = None) -> DataFrame:
        return scan(self.spark, self.root, step)

    def read(self, name: str) -> DataFrame:
        """A table of the last version; one that was never written is empty if its schema is known, else KeyError."""
        at = self.versions.folders(name)
        if not at:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.parquet(*at)

    def write(self, since: int | None = None, **tables: DataFrame) -> None:
        """Write tables and make them the next version, at once; since: the version they were made from, if any matters."""
        self.versions.commit({name: self.versions.stage(name, df) for name, df in tables.items()}, since)

    def trace(self, command: str) -> T.Trace:
        return T.Trace(self.spark, f"{self.at}/logs/traces", command, self.traced)

    def record(self, log: str, at: datetime | None = None, **fields: str) -> None:
        """Append one line to a JSON log of the case, with the time (now, if none is given)."""
        time = F.lit(at) if at else F.current_timestamp()
        self.spark.range(1).select(time.alias("at"), *[F.lit(v).alias(k) for k, v in fields.items()]).write.mode("append").json(f"{self.at}/logs/{log}")

    def log(self, name: str, schema: str) -> DataFrame:
        """A log's rows by time; a log that was never written is empty."""
        if not storage.exists(self.spark, f"{self.at}/logs/{name}"):
            return self.spark.createDataFrame([], "at timestamp, " + schema)
        return self.spark.read.schema("at timestamp, " + schema).json(f"{self.at}/logs/{name}").orderBy("at")

    def traces(self) -> DataFrame:
        if not storage.exists(self.spark, f"{self.at}/logs/traces"):
            return self.spark.createDataFrame([], T.SCHEMA)
        return self.spark.read.schema(T.SCHEMA).json(f"{self.at}/logs/traces").orderBy("started", "trace_id")

    def pages(self) -> DataFrame:
        """page, body of all pages; the report is a stub until one is made."""
        made = self.read("report").select("page", "body")
        stub = self.spark.createDataFrame([(report.PAGE, report.STUB)], PAGES).join(made, "page", "left_anti")
        return self.read("pages").select("page", "body").unionByName(made).unionByName(stub)

    def changes(self, step: str | None = None, force: bool = False, files: DataFrame | None = None) -> DataFrame:
        """path, state of the files that an ingest would read: new, changed, failed and, with force, all."""
        every = merge.changed_sources((self.files(step) if files is None else files).select("path", "sha"), self.read("manifest"))
        return every if force else every.where("state != 'unchanged'")

    def ingest(self, step: str | None = None, dry_run: bool = False, hold: bool = False, force: bool = False) -> DataFrame:
        """path, state of the files that were new or changed; their facts are added to those on record and merged.

        Only these files are read and parsed, and only those buckets of events, entities, indicators and conflicts are
        written anew that their facts fall into. Facts of files that are gone, and of earlier versions of a file, stay. hold
        queues pages that newly hold a risky phrase; they keep their former body until someone approves. force reads files
        again though they did not change. dry_run writes nothing and gives page, diff: how pages would change. If another
        ingest commits first, this one is done again upon its version.
        """
        while True:
            try:
                return self._ingest(step, dry_run, hold, force)
            except storage.Conflict:
                continue

    def _ingest(self, step: str | None, dry_run: bool, hold: bool, force: bool) -> DataFrame:
        began, since = datetime.now(timezone.utc), self.versions.last()
        with self.trace("ingest") as t:
            with t.step("scan"):
                files = self.files(step)
                todo = with_rows(files.join(self.changes(step, force, files), "path")).persist()
                todo_paths = todo.select("path", "state")
                n = todo.count()
            if not n:
                return todo_paths
            with t.step("extract"):
                found = self.extract(todo)
                # what comes later is later in order, so the facts on record go first in every merge
                batch = f"{since:06d}\x03"
                found = {k: df.withColumn("seq", F.concat(F.lit(batch), "seq")) for k, df in found.items()}
                before = {k: self.versions.folders(k, since) for k in found}
                added = {} if dry_run else {k: self.versions.stage(k, df) for k, df in found.items()}
                new = {k: self.spark.read.parquet(*added[k]) if added else df for k, df in found.items()}
                raw = {k: self.spark.read.parquet(*before[k]).unionByName(df) if before[k] else df for k, df in new.items()}
            with t.step("merge"):
                manifest = self.read("manifest").join(todo_paths, "path", "left_anti").unionByName(todo.select("path", "sha", F.lit("processed").alias("status"), "kind", F.lit(f"{began:%Y-%m-%dT%H:%M:%SZ}").alias("at")))
                prior = self.read("claims").select(F.lower("title").alias("key"), F.substring("claim_id", 7, 20).cast("long").alias("num"))
                if dry_run:
                    state = evidence.merged(raw)
                    claimed = evidence.claims(raw["raw_iocs"], state.contradictions, prior)
                    return diff.unified(self.read("pages"), pages.render(state, claimed, evidence.open_questions(manifest, claimed)))
                staged = {}
                for name, (table, key, facts, merge_, back) in evidence.KEYED.items():
                    staged |= self.versions.upsert(name, facts(new[table]), key, merge_, back, since)
                was = self.versions.tables(since) if since else {}
                keyed = lambda name: [f for k, fs in sorted({**was, **staged}.items()) if k.startswith(f"{name}/") for f in fs]
                read = lambda name: self.spark.read.parquet(*(staged.get(name) or keyed(name))) if name in staged or keyed(name) else self.spark.createDataFrame([], SCHEMAS[name])  # noqa: E731  later steps read what is written
                staged["contradictions"] = self.versions.stage("contradictions", evidence.contradictions(read("conflicts"), read("iocs")))
                claimed = evidence.claims(raw["raw_iocs"], read("contradictions"), prior)
                staged |= {name: self.versions.stage(name, df) for name, df in {"claims": claimed, "manifest": manifest, "changes": todo_paths}.items()}
                state, claimed = evidence.State(read("events"), read("entities"), read("iocs"), read("contradictions")), read("claims")
            with t.step("index"):
                nodes, edges = evidence.graph(raw["mentions"], state.events)
                nodes = nodes.unionByName(claimed.select(F.col("claim_id").alias("id"), F.lit("hypothesis").alias("type"), F.substring("title", 1, 80).alias("label"), F.lit("\x7f").alias("seq")))
                made = {
                    "nodes": nodes, "edges": edges.unionByName(evidence.claim_edges(claimed)), "claim_index": index.claims(claimed, state.contradictions),
                    "event_index": index.events(state.events, index.numbers(self.read("event_index"), "event_id")), "entity_index": index.entities(state.entities, state.iocs, claimed, index.numbers(self.read("entity_index"), "entity_id")),
                }
                staged |= {name: self.versions.stage(name, df) for name, df in made.items()}
            with t.step("pages"):
                body = pages.render(state, claimed, evidence.open_questions(read("manifest"), claimed))
                staged |= self._published(body, "pages", hold)
            with t.step("commit"):
                self.versions.commit(staged, since, added)
            todo.unpersist()
        self.record("ingest", began, step=step or "", n_changed=str(n))  # pages are stamped later than that
        return self.read("changes")

    def _published(self, new: DataFrame, name: str, hold: bool) -> dict[str, list[str]]:
        """Stage pages; with hold, those that newly hold a risky phrase wait in the queue, unless this body was decided on before."""
        staged = {}
        if hold:
            old, waiting = self.read(name), self.read("reviews")
            taken = waiting.select(F.substring("review_id", 5, 20).cast("long").alias("num"))
            asked = review.queue(old, new, taken).join(waiting.select("page", "proposed"), ["page", "proposed"], "left_anti")
            staged["reviews"] = self.versions.stage("reviews", waiting.unionByName(asked.select(*waiting.columns)))
            new = review.held_back(new, self.spark.read.parquet(*staged["reviews"]))
        now = F.lit(f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}")
        return staged | {name: self.versions.stage(name, new.select("page", "body", now.alias("at")))}

    def reviews(self, status: str | None = None) -> DataFrame:
        r = self.read("reviews")
        return (r.where(F.col("status") == status) if status else r).orderBy("review_id")

    def decide(self, review_id: str, verdict: str) -> bool:
        """Approve or reject a pending review; an approved page takes its proposed body. False if none was pending."""
        since = self.versions.last()
        one = self.reviews("pending").where(F.col("review_id") == review_id)
        if verdict not in ("approved", "rejected") or not one.limit(1).count():
            return False
        name = "report" if one.first()["page"] == report.PAGE else "pages"
        tables = {"reviews": review.decide(self.read("reviews"), self.spark.createDataFrame([(review_id, verdict)], "review_id string, verdict string"))}
        if verdict == "approved":
            taken = one.select("page", F.col("proposed").alias("body"), F.lit(f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}").alias("at"))
            tables[name] = self.read(name).join(one.select("page"), "page", "left_anti").unionByName(taken)
        self.write(since, **tables)
        self.record("review", review_id=review_id, verdict=verdict)
        return True

    def report(self, hold: bool = False) -> DataFrame:
        """Make the report page from the state."""
        with self.trace("report") as t, t.step("render"):
            since, claims = self.versions.last(), self.read("claims")
            steps = evidence.follow_up(claims).where("kind = 'step'")
            made = report.render(self.read("events"), self.read("entities"), self.read("iocs"), claims, self.read("contradictions"), steps, self.read("manifest"))
            self.versions.commit(self._published(made, "report", hold), since)
        return self.read("report")

    def tables(self) -> answers.Tables:
        return answers.Tables(self.read("claims"), self.read("iocs"), self.read("contradictions"), self.read("events"), self.read("entities"), self.read("manifest"))

    def methods(self, questions: DataFrame) -> DataFrame:
        """qid, method, ..., answer: five methods over questions (qid, question)."""
        return methods.every(self.files(), self.read("nodes"), self.read("edges"), self.tables(), questions, self.embedder)

    def answered(self, path: str) -> tuple[DataFrame, DataFrame]:
        """(items, answers of all methods) of a file of questions."""
        items = methods.load_questions(self.spark, path)
        return items, self.methods(items.select(F.col("id").alias("qid"), "question")).withColumnRenamed("qid", "id")

    def scorecard(self, path: str, only: list[str] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
        """A row a method over a file of questions; aliases tell which method a label of expected_best_method means.

        The card is kept below the case's folder, as JSON and as Markdown.
        """
        items, said = self.answered(path)
        if aliases:
            items = items.replace(aliases, subset=["expected_best_method"])
        said = said.where(F.col("method").isin(*only)) if only else said
        card = evaluate.scorecard(said, items).orderBy("method")
        rows = [r.asDict() for r in card.collect()]  # a row a method
        name = f"{self.at}/scorecards/{path.rstrip('/').rpartition('/')[2].rpartition('.')[0]}" + ("-" + "-".join(only) if only else "")
        storage.write_text(self.spark, name + ".json", json.dumps(rows, indent=1))
        storage.write_text(self.spark, name + ".md", evaluate.card_text(rows))
        return self.spark.createDataFrame(rows, card.schema)

    def evaluate(self, path: str) -> DataFrame:
        """id, passed, failures of the compiled state's answers to a file of questions."""
        items = methods.load_questions(self.spark, path)
        said = answers.answers(items.select(F.col("id").alias("qid"), "question"), self.tables(), self.files().select("path", "text"))
        said = said.withColumnRenamed("qid", "id").withColumn("method", F.lit("state"))
        bad = evaluate.checks(said, items).where("not passed").groupBy("id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "term"))).alias("failures"))
        return items.select("id", "question").join(bad, "id", "left").select("id", "question", F.col("failures").isNull().alias("passed"), "failures").orderBy("id")

    def questions_file(self, folder: str) -> str | None:
        """The questions of this case below a folder: the file for all methods if there is one, else the plain one."""
        case = self.root.rstrip("/").rpartition("/")[2]
        there = [f"{folder.rstrip('/')}/{case}{end}" for end in ("_methods_eval.json", "_eval.json")]
        return next((f for f in there if storage.exists(self.spark, f)), None)

    def export_pages(self, target: str) -> list[str]:
        """Write every required page, the graph and a note on how to read them as Markdown files below target."""
        target, names = target.rstrip("/"), []
        for r in self.pages().where(F.col("page").isin(*pages.NAMES)).toLocalIterator():  # one row a page, eight at most
            storage.write_text(self.spark, f"{target}/{r['page']}.md", r["body"] + "\n")
            names.append(f"{r['page']}.md")
        lines = [r["line"] for r in self.export_graph().orderBy("n").collect()]  # the edges of a diagram at most
        told = graph.summary(self.read("nodes"), self.read("edges")).orderBy(F.desc("section"), "line").collect()  # a row a type
        storage.write_text(self.spark, f"{target}/graph.md", "\n".join(["# graph", "", *(r["line"] for r in told), "", "```mermaid", "graph LR", *lines, "```", ""]))
        storage.write_text(self.spark, f"{target}/README.md", "# Pages of a case\n\nStart at [[index]]. Pages link to one another by name; each line cites its source.\nThey are written anew at each export, so notes belong into files of their own.\n")
        return sorted([*names, "graph.md", "README.md"])

    def open_questions(self) -> DataFrame:
        """text: the questions on the page of open questions, as it stands."""
        page = self.read("pages").where("page = 'open_questions'")
        return page.select(F.explode(F.split("body", "\n")).alias("line")).where(F.col("line").startswith("- ")).select(F.trim(F.substring("line", 3, 1 << 30)).alias("text"))

    def export_timeline(self, target: str, size: int | None = None) -> int:
        """Write the timeline as files of `size` lines (PART_LINES by default) below target, by the tasks that hold them, and a list of them; gives their number."""
        made = storage.stored(pages.timeline_parts(self.read("events"), size or pages.PART_LINES), "parts")
        name = F.format_string("part-%08d.md", "part")
        listed.write_texts(made.select(name.alias("path"), F.concat("body", F.lit("\n")).alias("text")), target)
        lines = made.select("part", F.concat(F.lit("- ["), name, F.lit("]: "), F.col("lines").cast("string"), F.lit(" line(s), from "), F.substring_index(F.substring("body", 3, 40), "\n", 1)).alias("line")).orderBy("part")
        lines.select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(f"{target.rstrip('/')}/contents")
        return made.count()

    def answer(self, question: str) -> dict:
        """The routed answer with all its parts; the best lexical snippet where the state is insufficient."""
        q = self.spark.createDataFrame([(1, question)], "qid long, question string")
        files = self.files().select("path", "text")
        best = self.rag(question, 1).select(F.lit(1).cast("long").alias("qid"), F.concat("snippet", F.lit(" (Source: "), "path", F.lit(")")).alias("snippet"))
        return answers.with_fallback(answers.answers(q, self.tables(), files), best).first().asDict()

    def query(self, question: str) -> dict:
        return self.answer(question)

    def rag(self, question: str, k: int = 5) -> DataFrame:
        files = self.files()
        top = storage.stored(retrieval.bm25(files, question, k, "path"), "top")
        hits = files.join(F.broadcast(top.select(F.col("doc_id").alias("path"))), "path", "left_semi")  # k rows; only their lines are looked at
        return top.join(retrieval.snippet(hits, question, "path"), "doc_id").select(F.col("doc_id").alias("path"), "score", "snippet").orderBy(F.desc("score"), "path")

    def vector(self, question: str, k: int = 5) -> DataFrame:
        asked = self.spark.createDataFrame([(question,)], "text string").select(F.lit(0).alias("doc_id"), "text")
        return retrieval.hash_cosine(retrieval.distinct_chunks(self.files(), "path"), asked, k).select("doc_id.*", "cosine")

    def graph_query(self, question: str) -> DataFrame:
        """node, neighbour, type: the neighbours of the node with the longest label that the question names."""
        q = self.spark.createDataFrame([(1, question)], "qid long, question string")
        hit = graph.longest_match(q, self.read("nodes").select("id", "label", F.struct("seq", "id").alias("seq"))).select(F.col("id").alias("node"))
        e = self.read("edges")
        both = e.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "type").unionByName(e.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "type"))
        return both.join(F.broadcast(hit), "node").distinct().orderBy("neighbour", "type")  # one node

    def lint(self) -> DataFrame:
        """rule, severity, page, detail of all findings."""
        body = self.pages()
        return lint.every(
            body, self.read("pages").select("page"), self.read("claims"), self.read("contradictions"), self.read("entities"), self.read("iocs"),
            self.read("manifest").select("path"), self.files().select("path"), self.stale_pages(), pages.NAMES, report.PAGE,
        )

    def stale_pages(self) -> DataFrame:
        """Pages written before the last merge began."""
        last = self.log("ingest", "step string").agg(F.max("at").alias("last"))
        return lint.stale(self.read("pages").select("page", F.to_timestamp("at").alias("modified")).crossJoin(F.broadcast(last)), F.col("last"))

    def growth(self) -> DataFrame:
        return replay.growth(self.files())

    def wipe(self) -> None:
        """Remove the whole state; the evidence stays."""
        storage.remove(self.spark, self.at)

    def evolve(self, questions: str | None = None, key_question: str = KEY_QUESTION, fresh: bool = True) -> list[dict]:
        """Ingest the step folders in order; after each, keep a snapshot, check, answer, and note how hypotheses moved.

        The steps of a case are few, and each is an ingest, so this is a loop of the driver. A report of the replay is kept.
        """
        names = [n for n in storage.names(self.spark, self.root) if n.startswith("step_")]
        if not names:
            raise FileNotFoundError(f"no folder step_... below {self.root}")
        if fresh:
            self.wipe()
        out = []
        for name in names:
            before = {k: self.read(k) for k in ("claims", "contradictions", "pages")}
            added = self.ingest(name).count()
            claims, key = self.read("claims"), F.lower("title").alias("key")
            new = history.new_rows(before["claims"].select(key), claims.select(key, "title"), ["key"])
            moved = history.changed(before["claims"].select(key, "confidence"), claims.select(key, "confidence"), ["key"], "confidence").join(claims.select(key, "title"), "key")
            against = history.new_rows(before["contradictions"], self.read("contradictions"), ["title"])
            said = self.answer(key_question)
            found = lint.summary(self.lint()).first().asDict()
            got = self.evaluate(questions).agg(F.count("*").alias("n"), F.count_if("passed").alias("k")).first() if questions else None
            steps = history.steps_of(claims, name, F.lit(said["body"]))
            self.write(history=history.with_step(self.read("history"), steps))
            self.snapshot(f"after_{name}")
            changed = diff.sides(before["pages"], self.read("pages")).select("page").orderBy("page")
            titles = lambda df: [r["title"] for r in df.orderBy("title").collect()]
            out.append({
                "step": name, "files": added, "pages": [r["page"] for r in changed.collect()], "new_hypotheses": titles(new), "confidence_changes": [r.asDict() for r in moved.select("title", "old", "new").orderBy("title").collect()],
                "new_contradictions": titles(against), "findings": found, "questions": got["n"] if got else None, "passed": got["k"] if got else None, "assessment": said["body"],
            })
        storage.write_text(self.spark, f"{self.at}/replay.json", json.dumps(out, indent=1))
        storage.write_text(self.spark, f"{self.at}/replay.md", replay.report(out))
        return out

    def snapshot(self, name: str) -> None:
        """Keep all tables and pages of the last version under a name; one of the same name is replaced."""
        body = self.versions.stage(f"snapshot_{name}", self.pages())
        storage.write_text(self.spark, f"{self.at}/snapshots/{name}.json", json.dumps({"tables": self.versions.tables(), "pages": body}, sort_keys=True))

    def snapshots(self) -> list[str]:
        return [n.removesuffix(".json") for n in storage.names(self.spark, f"{self.at}/snapshots", False)]

    def at_snapshot(self, name: str, table: str) -> DataFrame:
        """A table, or pages, as a snapshot has it."""
        kept = json.loads(storage.read_text(self.spark, f"{self.at}/snapshots/{name}.json"))
        tables = kept["tables"]
        folders = kept["pages"] if table == "pages" else tables.get(table) or [f for n in sorted(tables) if n.startswith(f"{table}/") for f in tables[n]]
        return self.spark.read.parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[table])

    def diff(self, old: str, new: str) -> DataFrame:
        """page, diff: unified diffs of the pages that differ."""
        return diff.unified(self.at_snapshot(old, "pages"), self.at_snapshot(new, "pages")).orderBy("page")

    def line_diff(self, old: str, new: str) -> DataFrame:
        return pages.line_diff(self.at_snapshot(old, "pages"), self.at_snapshot(new, "pages")).orderBy("page", "sign", "line")

    def export_graph(self) -> DataFrame:
        return graph.mermaid(self.read("edges").select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
