"""The typed relationship graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vespera.operators import merge
from vespera.sources import storage

#: Members of a group that one task pairs with so many others.
BLOCK = 2048
#: Nodes of more sources are counted in matrices of so many nodes a side, from about so many mentions a side, where that is less work.
COMMON, CELLS, ROWS = 8, 1024, 4_000_000
#: Sources whose names are sent to every task, at most.
NAMED = 1_000_000
#: Lengths of the prefixes by which labels are looked up in a text.
PREFIXES = (1, 2, 4, 8, 16, 32)
#: Characters of a text that are looked up at once, about, and labels that are sent along at once, about.
SEGMENT, LABELS = 2048, 200_000
#: Labels that are looked for one by one, at most.
FEW = 256
#: Mentions of the given nodes that are sent to every task, at most.
SENT = 200_000
#: Edges of a diagram, and labels of a type in a summary, at most.
DIAGRAM_EDGES, LISTED_LABELS = 200, 12


def related(mentions: DataFrame) -> DataFrame:
    """mentions: node, source. a < b that share a source, with the least shared source as evidence and the number of shared ones.

    All pairs of a source are the result, so its size is that of the pairs. Pairs with a node of one source are made once and
    need no merge. Nodes of more than COMMON sources are counted in matrices of blocks of nodes where their sources would
    make more pairs than a quarter of the cells; other pairs are made by source and merged, each at most COMMON times where
    that holds. A source of more than BLOCK nodes is dealt by blocks of its nodes, so that no task pairs the whole of it.
    """
    m = mentions.select("node", "source").distinct()
    size = m.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("source", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    m = m.join(m.groupBy("node").agg(F.count("*").alias("n_sources")), "node").join(size, "source", "left")
    m = storage.stored(m.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "mentions")
    common = m.where(F.col("n_sources") > COMMON)
    of = common.groupBy("source").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).alias("pairs")).first()
    nodes = common.select("node").distinct().count()
    dense = of["pairs"] > nodes * nodes / 8
    least, greatest = F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
    out = _met(m, F.col("n_sources") == 1).select(least, greatest, F.col("source").alias("evidence"), F.lit(1).cast("long").alias("n_shared"))
    # pairs of two common nodes are not even looked at where they are counted
    pairs = _met(m.where("n_sources > 1"), F.col("n_sources") <= COMMON if dense else F.lit(True)).select(least, greatest, "source")
    out = out.unionByName(pairs.groupBy("a", "b").agg(F.min("source").alias("evidence"), F.count("*").alias("n_shared")))
    return out.unionByName(_counted(common.select("node", "source"), nodes, of["rows"])) if dense else out


def _met(m: DataFrame, which) -> DataFrame:
    """source, x, y: each node x of which a condition holds with every other node y of its source; pairs of two such nodes once."""
    some = m.where(which).select("source", F.col("node").alias("x"), "block")
    others = m.select("source", F.col("node").alias("y"), which.alias("too"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return some.join(others, ["source", "block"]).where("not too or x < y").select("source", "x", "y")


#: Sources whose sum of powers of two a double holds exactly.
BITS = 52


def _counted(mentions: DataFrame, nodes: int, rows: int) -> DataFrame:
    """related() of distinct mentions by matrices of CELLS x CELLS nodes, each of about ROWS mentions a side; their counts are added up.

    Sources are numbered in order, so that a node is sent with an array of numbers. A product of two matrices tells which
    of BITS sources any two nodes share: a source is a power of two there, the least source the greatest power.
    """
    numbers = merge.numbered(mentions.select("source").distinct(), ["source"], start=-1, name="id")
    sources = numbers.count()
    blocks = -(-nodes // CELLS)
    parts = max(1, -(-rows // (blocks * ROWS)), -(-sources // ROWS))
    known = lambda df: F.broadcast(df) if sources <= NAMED else df
    m = mentions.join(known(numbers), "source").withColumn("part", (F.col("id") * parts / max(1, sources)).cast("int"))
    m = m.groupBy("node", "part").agg(F.collect_list("id").alias("ids")).withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
    m = storage.stored(m, "numbered")
    first = m.select("node", "ids", "part", F.lit(True).alias("first"), F.col("block").alias("p"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("q"))
    second = m.select("node", "ids", "part", F.lit(False).alias("first"), F.explode(F.sequence(F.lit(0), "block")).alias("p"), F.col("block").alias("q"))

    def count(key, t):
        import numpy as np
        import pyarrow as pa

        t = t.sort_by("node").combine_chunks()
        names, lists, first = t["node"].combine_chunks(), t["ids"].combine_chunks(), t["first"].to_numpy()
        ids, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        sides = []
        for side in (first, ~first):
            at = np.flatnonzero(side)  # in order of names
            sides.append((at, np.repeat(np.arange(len(at)), size[at]), ids[np.repeat(side, size)]))
        shared = np.intersect1d(sides[0][2], sides[1][2])
        ends = np.arange(0, len(shared) + BITS, BITS)
        put = []
        for _, node, source in sides:
            place = np.minimum(np.searchsorted(shared, source), max(0, len(shared) - 1))
            keep = np.flatnonzero(shared[place] == source) if len(shared) else np.zeros(0, np.int64)
            by = keep[np.argsort(place[keep], kind="stable")]
            put.append((node[by], place[by], np.searchsorted(place[by], ends)))
        least, n = np.full((len(sides[0][0]), len(sides[1][0])), -1, np.int32), np.zeros((len(sides[0][0]), len(sides[1][0])), np.int32)
        for c in range(len(ends) - 1):
            held = []
            for (node, place, edge), power in zip(put, (True, False)):
                known, row = np.unique(node[edge[c] : edge[c + 1]], return_inverse=True)
                bit = place[edge[c] : edge[c + 1]] - ends[c]
                w = np.zeros((len(known), BITS))
                w[row, bit] = np.exp2(BITS - 1 - bit) if power else 1.0
                held.append((known, w))
            which = held[0][1] @ held[1][1].T
            cells = np.ix_(held[0][0], held[1][0])
            n[cells] += np.bitwise_count(which.astype(np.int64))
            found = least[cells]
            new = (found < 0) & (which > 0)
            found[new] = ends[c] + BITS - np.frexp(which[new])[1]
            least[cells] = found
        if key[0].as_py() == key[1].as_py():
            n = np.triu(n, 1)  # both sides are the same nodes
        i, j = np.nonzero(n)
        x, y = sides[0][0][i], sides[1][0][j]
        take = lambda k: names.take(pa.array(k))
        return pa.table({"a": take(np.minimum(x, y)), "b": take(np.maximum(x, y)), "id": pa.array(shared[least[i, j]].astype(np.int64)), "n_shared": pa.array(n[i, j].astype(np.int64))})

    kind = dict(mentions.dtypes)["node"]
    got = first.unionByName(second).groupBy("p", "q", "part").applyInArrow(count, f"a {kind}, b {kind}, id long, n_shared long")
    if parts > 1:
        got = got.groupBy("a", "b").agg(F.min("id").alias("id"), F.sum("n_shared").alias("n_shared"))
    return got.join(known(numbers.select("id", F.col("source").alias("evidence"))), "id").select("a", "b", "evidence", "n_shared")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame, nodes: list) -> DataFrame:
    """node, neighbour for the given nodes; both directions count."""
    return both_ways(edges).where(F.col("a").isin(nodes)).select(F.col("a").alias("node"), F.col("b").alias("neighbour")).distinct()


def neighbours_of(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, neighbour: what shares a source with each of the given nodes (a column node), straight from the mentions (node, source).

    The nodes' sources are found first, then the other nodes of these sources; pairs of other nodes are never made, so a
    source of many nodes costs its size. The given side is sent along if it has at most SENT rows, which are counted; else
    both sides meet by source.
    """
    m = mentions.select("node", "source")
    asked = m.join(nodes.select("node").distinct(), "node", "left_semi").distinct()
    if asked.limit(SENT + 1).count() <= SENT:
        asked = F.broadcast(asked)
    return m.select(F.col("node").alias("neighbour"), "source").join(asked, "source").where("neighbour != node").select("node", "neighbour").distinct()


def matches(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """questions: qid, question. labels: label and others. The distinct qid and columns of labels for every label that a question contains, in any case.

    A label is looked up by the longest of its prefixes whose length is in PREFIXES among all stretches of the question
    of these lengths: an equi join instead of a nested loop. Then the whole label must be contained. Long questions are
    cut into segments that overlap by the longest label. Labels are sent to the questions, LABELS of them at a time, so
    no text is shuffled. Up to FEW labels are looked for in each question one by one, which reads it as often but makes
    no stretches. Empty labels never match.
    """
    named = labels.where("label != ''").withColumn("_label", F.lower("label"))
    fit = F.array_max(F.filter(F.array(*map(F.lit, PREFIXES)), lambda n: n <= F.length("_label")))
    named = named.withColumn("_prefix", F.substr("_label", F.lit(1), fit))
    known = named.agg(F.count("*").alias("n"), F.max(F.length("_label")).alias("longest"), F.array_sort(F.collect_set(F.length("_prefix"))).alias("sizes")).first()  # one row, a few lengths
    low = questions.select("qid", F.lower("question").alias("_low"))
    if not known["n"]:
        return low.select("qid").join(labels.limit(0), F.lit(False)).select("qid", *labels.columns)
    if known["n"] <= FEW:
        distinct = named.groupBy("_label").agg(F.collect_set(F.struct(*labels.columns)).alias("_rows"))
        told = distinct.agg(F.collect_list(F.struct("_label", "_rows")).alias("_labels"))  # FEW at most
        held = low.crossJoin(F.broadcast(told)).select("qid", F.explode(F.filter("_labels", lambda x: F.contains(F.col("_low"), x["_label"]))).alias("x"))
        return held.select("qid", F.explode("x._rows").alias("r")).select("qid", *[F.col(f"r.`{c}`").alias(c) for c in labels.columns]).distinct()
    step = max(SEGMENT, 4 * known["longest"])
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_low")), F.lit(step))
    cut = low.select("qid", "_low", F.explode(starts).alias("_at")).select("qid", F.substr("_low", F.col("_at"), F.lit(step + known["longest"])).alias("_low"))
    # every stretch of n characters, by a look ahead from each place; substr would count from the start each time
    runs = F.flatten(F.array(*[F.array_distinct(F.regexp_extract_all("_low", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))) for n in known["sizes"]]))
    keyed = cut.select("qid", "_low", F.explode(F.array_distinct(runs)).alias("_prefix"))
    blocks, out = -(-known["n"] // LABELS), None
    for b in range(blocks):
        some = named.where(F.pmod(F.xxhash64("_label"), F.lit(blocks)) == b) if blocks > 1 else named
        hit = keyed.join(F.broadcast(some), "_prefix").where(F.contains("_low", "_label")).select("qid", *labels.columns)
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def longest_match(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """questions: qid, question. labels: label, seq and others. For each question the row of the longest label it contains, the first of equals."""
    rest = [c for c in labels.columns]
    best = matches(questions, labels).groupBy("qid").agg(F.min_by(F.struct(*rest), F.struct(-F.length("label"), F.col("seq"))).alias("x"))
    return best.select("qid", *[F.col(f"x.{c}").alias(c) for c in rest if c != "seq"])


def nodes_by_type(nodes: DataFrame, listed: int = LISTED_LABELS) -> DataFrame:
    """type, n (distinct labels), labels (the first by name)."""
    each = nodes.select("type", "label").distinct()
    first = each.groupBy("type").agg(F.count("*").alias("n"))
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy("label"))).where(F.col("r") <= listed)
    names = ranked.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("labels"))
    return first.join(names, "type")


def edges_by_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """section, line: a Markdown summary, a line a type."""
    more = F.when(F.col("n") > F.size("labels"), F.concat(F.lit(", and "), (F.col("n") - F.size("labels")).cast("string"), F.lit(" more"))).otherwise("")
    n = nodes_by_type(nodes).select(F.lit("nodes").alias("section"), F.concat(F.lit("- **"), "type", F.lit("** ("), F.col("n").cast("string"), F.lit("): "), F.array_join("labels", ", "), more).alias("line"))
    return n.unionByName(edges_by_type(edges).select(F.lit("edges").alias("section"), F.concat(F.lit("- **"), "type", F.lit("**: "), F.col("n").cast("string")).alias("line")))


def diagram_id(node):
    """An id that diagrams accept. Where characters had to be replaced, a digest keeps different nodes apart."""
    text = node.cast("string")
    plain = F.regexp_replace(text, "[^A-Za-z0-9_]", "_")
    apart = F.when(plain == text, plain).otherwise(F.concat(plain, F.lit("_"), F.substring(F.md5(text), 1, 6)))
    return F.when(apart.rlike("^[0-9]") | (apart == ""), F.concat(F.lit("n_"), apart)).otherwise(apart)


def mermaid(edges: DataFrame, limit: int = DIAGRAM_EDGES) -> DataFrame:
    """n, line: lines of a diagram, the first edges by (a, b), then how many are left out."""
    top = edges.select("a", "b").orderBy("a", "b").limit(limit)
    drawn = top.select(F.row_number().over(Window.orderBy("a", "b")).alias("n"), F.concat(F.lit("    "), diagram_id(F.col("a")), F.lit(" --> "), diagram_id(F.col("b"))).alias("line"))
    rest = edges.agg(F.count("*").alias("k")).where(F.col("k") > limit)
    return drawn.unionByName(rest.select(F.lit(limit + 1).alias("n"), F.concat(F.lit("    %% "), (F.col("k") - limit).cast("string"), F.lit(" more edge(s) left out")).alias("line")))
