"""Secrets, with DataFrame functions only.

Fixed patterns give the base. Further tokens are judged by two character Markov models of first order, one of random
strings and one of ordinary identifiers: a token is reported if the log-likelihood ratios of its transitions are high
enough on average and in sum, so a short token needs a higher average than a long one.

The default samples are made by rule: strings from hashes, identifiers from a list of words in four styles. A labelled
table can be given instead (fit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The patterns of the base kinds.
ASSIGN = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Tokens that are judged: of 20 characters or more, or of 12 to 19 with a digit among them; = only as padding at the end.
#: Shorter ones, and those of 12 to 19 without a digit, have too few transitions to be told from words and are never reported.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{20,}|(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{12,19}(?![A-Za-z0-9+/_-]))={0,2}"
#: Mean log-likelihood ratio a transition, and sum of a token's, from which it counts as random.
MIN_RATIO, MIN_EVIDENCE = 0.7, 13.0
#: Elements that an inner fold handles before what it found is appended to the whole.
FOLDED = 256
SAMPLES = 20_000
SEED = 5
SMOOTHING = 0.5
#: Parts of the ordinary identifiers that the default samples join in the usual styles.
IDENTIFIER_WORDS = (
    "get set is has make build read write open close load save find list index count total user name value key data item node "
    "file path url host port request response client server config option handler manager service factory context state event "
    "message error result status type kind size length start end next first last min max default current update delete insert "
    "select create table column row query filter map reduce sort group join test spec component module package version token "
    "account customer order payment invoice address session cookie header body content image button style layout grid menu "
    "international representation communication administration understanding transportation responsibility characteristic "
    "abschnitt aufgabe bericht datei eingabe ausgabe ergebnis fehler gruppe kunde nachricht pfad rechnung schnittstelle speicher "
    "verbindung verzeichnis zeichenkette geschwindigkeit einrichtung verarbeitung gesellschaft berechtigung zusammenhang schluessel "
    "pflicht sicherheit zeitpunkt wirtschaft moeglichkeit schreiben berichten freiheit tatsaechlich nichts erbe heimat "
    "fichier dossier chemin erreur utilisateur valeur connexion affichage requete nouveau tableau reseau lieu mieux jeu "
    "archivo carpeta usuario clave conexion consulta respuesta desarrollo trabajo informacion llamada guerra siempre"
).split()


def default_samples(spark: SparkSession, n: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """text, is_random: n random strings (base 64, hexadecimal, base 62) and n identifiers in four styles, by rule."""
    i = F.col("id")
    digest = F.unhex(F.sha2(F.concat_ws(":", F.lit(seed), i), 512))
    b64 = F.base64(digest)
    text = F.when(i % 3 == 0, F.substring(b64, 1, 40)).when(i % 3 == 1, F.substring(F.lower(F.hex(digest)), 1, 40)).otherwise(F.substring(F.regexp_replace(b64, "[+/=]", ""), 1, 40))
    words = F.array(*map(F.lit, IDENTIFIER_WORDS))
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64(i, F.lit(seed * 100 + k)), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int"))
    w = [word(k) for k in range(4)]
    cap = [F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 99)) for x in w]
    style = F.when(i % 4 == 0, F.concat_ws("_", *w)).when(i % 4 == 1, F.concat(w[0], *cap[1:])).when(i % 4 == 2, F.concat_ws("-", *w[:3], (i % 100).cast("string"))).otherwise(F.upper(F.concat_ws("_", *w[:3])))
    base = spark.range(n)
    return base.select(text.alias("text"), F.lit(True).alias("is_random")).unionByName(base.select(style.alias("text"), F.lit(False).alias("is_random")))


def _code(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c) - 1


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, row by row of ALPHABET; at most its square of sums reach the driver."""
    k = len(ALPHABET)
    n = F.length("text")
    pairs = samples.where(n >= 2).select("is_random", F.explode(F.expr("transform(sequence(1, length(text) - 1), i -> substring(text, i, 2))")).alias("pair"))
    a, b = F.instr(F.lit(ALPHABET), F.substring("pair", 1, 1)), F.instr(F.lit(ALPHABET), F.substring("pair", 2, 1))
    rows = pairs.select("is_random", a.alias("a"), b.alias("b")).where("a > 0 and b > 0").groupBy("a", "b", "is_random").count().collect()
    counts = {True: [0.0] * k * k, False: [0.0] * k * k}
    for r in rows:
        counts[r["is_random"]][(r["a"] - 1) * k + r["b"] - 1] += r["count"]
    import math

    total = {s: [sum(x[i * k : (i + 1) * k]) for i in range(k)] for s, x in counts.items()}
    p = lambda s, i: (counts[s][i] + SMOOTHING) / (total[s][i // k] + SMOOTHING * k)
    return [math.log(p(True, i) / p(False, i)) for i in range(k * k)]


def _fold(items: Column, zero: Column, none: str, step) -> Column:
    """aggregate(items) with a state and a list of found elements; step(state, item) gives (state, array of found).

    Elements are folded in parts of FOLDED, whose findings are appended part by part: time stays near linear where
    appending to one array element by element would copy it each time. none: the type of the list.
    """
    part = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / FOLDED).cast("int"))), lambda g: F.slice(items, g * FOLDED + 1, F.lit(FOLDED)))
    start = F.struct(zero.alias("state"), F.expr(f"cast(array() as array<{none}>)").alias("found"))

    def one(acc, x):
        state, found = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["found"], found).alias("found"))

    def many(acc, xs):
        inner = F.aggregate(xs, F.struct(acc["state"].alias("state"), F.expr(f"cast(array() as {none})").alias("found")), one)
        return F.element_at(F.transform(F.array(inner), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["found"], F.array(r["found"])).alias("found"))), 1)

    return F.flatten(F.aggregate(part, start, many)["found"])


def _starts(pieces: Column, found: Column) -> Column:
    """Start of each match in code points, from the pieces between matches and the matches."""
    both = F.zip_with(F.slice(pieces, 1, F.greatest(F.size(found), F.lit(1))), found, lambda p, m: F.struct(F.length(p).alias("p"), F.length(F.coalesce(m, F.lit(""))).alias("m")))
    return _fold(both, F.lit(0), "array<int>", lambda at, x: (at + x["p"] + x["m"], F.array(at + x["p"])))


SPAN = "struct<start:int,kind:int,end:int>"


def _apart(base: Column, more: Column) -> Column:
    """The spans of more (which do not overlap one another) that overlap none of base: one pass over both in order.

    A span of more waits until a start of base, or of the next span, shows that it is free.
    """
    mark = lambda c, own: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["kind"].alias("kind"), x["end"].alias("end")))
    last = F.struct(F.lit(2**31 - 1).alias("start"), F.lit(True).alias("own"), F.lit(0).alias("kind"), F.lit(2**31 - 1).alias("end"))
    events = F.concat(F.array_sort(F.concat(mark(base, False), mark(more, True))), F.array(last))
    zero = F.struct(F.lit(0).alias("covered"), F.expr(f"cast(null as {SPAN})").alias("waits"))

    def step(state, x):
        free = state["waits"].isNotNull() & (x["start"] >= state["waits"]["end"])
        own = F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
        waits = F.when(x["own"] & (x["start"] >= state["covered"]), own)
        covered = F.when(x["own"], state["covered"]).otherwise(F.greatest(state["covered"], x["end"]))
        return F.struct(covered.alias("covered"), waits.alias("waits")), F.filter(F.array(F.when(free, state["waits"])), lambda w: w.isNotNull())

    return F.when((F.size(base) > 0) & (F.size(more) > 0), _fold(events, zero, f"array<{SPAN}>", step)).otherwise(more)


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """array<struct<start,kind,end>> of the matches that keep(index, match) lets pass."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    starts = _starts(F.split(text, pattern, -1), found)
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    all_ = F.filter(
        F.zip_with(starts, found, lambda s, m: F.when(m.isNotNull(), F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(m)).alias("end"), m.alias("m")))),
        lambda x: x.isNotNull(),
    )
    kept = F.transform(F.filter(all_, lambda x: keep(x["m"])), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.when(text.rlike(pattern), kept).otherwise(empty)


def find_secrets(docs: DataFrame, ratios: list[float] | None = None, min_ratio: float = MIN_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (array<struct<start,kind,end>>, by start, then kind; kind indexes KINDS) of each document.

    Spans are in code points, ends exclusive. A null text is empty. The model's tokens overlap no base span. Repeated
    rows are each reported; nothing is shuffled, one scan does it all, in time near linear in a text's spans.
    """
    if ratios is None:
        ratios = fit(default_samples(docs.sparkSession))
    k = len(ALPHABET)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    text = F.col("text")

    def random(m: Column) -> Column:
        codes = F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: _code(F.substr(m, i, F.lit(1))))
        steps = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda a, b: F.element_at(table, a * k + b + 1))
        return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0))) >= F.greatest(F.lit(MIN_EVIDENCE), min_ratio * (F.length(m) - 1))

    base = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    base = base.select(
        "doc_id",
        F.concat(
            _spans(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
            _spans(text, ACCESS, 1, lambda m: F.length(m) >= 16),
            _spans(text, HEX, 2, lambda m: F.lit(True)),
        ).alias("base"),
        _spans(text, TOKEN, 3, random).alias("more"),
    )
    base = base.select("doc_id", "base", _apart(F.col("base"), F.col("more")).alias("more"))
    return base.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", "more")).alias("spans"))
