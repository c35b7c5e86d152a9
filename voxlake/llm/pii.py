"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Patterns of shape and checksum find the base spans. These seed a graph of lexical patterns (the one or two words to
the left of a span) and instances (its text). Instances that look like identifiers but match no base pattern join the
graph by their contexts. Scores flow between both sides for some rounds: a pattern's confidence is the score of its
instances over all its occurrences in the corpus, an unseen instance's score the mean confidence of its contexts.
Instances in patterns of high confidence become spans of the pattern's kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, fresh, read_table, store

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with possessive repeats and starts bound to the start of a run (or the end of the match before),
#: which find the same matches in time linear in the text.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Words that look like identifiers.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*"
SPACE = r"[\x20\x09-\x0D]+"
#: A pattern counts from so many different seeds of a kind; it is trusted from such a confidence, an instance from such a score.
LEAST_SEEDS, LEAST_CONFIDENCE, LEAST_SCORE, ROUNDS = 3, 0.6, 0.6, 3
#: The last two words of a reversed gap, which lead it; possessive, so linear in their length.
LEFT_WORDS = r"\A[\x20\x09-\x0D]*+[^\x20\x09-\x0D]*+(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)?"
#: Parts that redaction splits the rows of a repeated text into.
SALTS = 16


def _matches(text: Column, pattern: str, kind: int, guard: Column) -> Column:
    """Matches as structs with the length of the gap before each, in order; positions follow by summing."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    rows = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("at"),
            F.length(p["gap"]).alias("gap"),
            F.length(p["value"]).alias("size"),
            p["value"].alias("value"),
            F.reverse(F.regexp_extract(F.reverse(p["gap"]), LEFT_WORDS, 0)).alias("left"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,at:int,gap:int,size:int,value:string,left:string>>")
    return F.when(guard, F.filter(rows, lambda r: r["value"].isNotNull())).otherwise(none)


def _valid() -> Column:
    value, digits = F.col("value"), F.regexp_replace("value", "[^0-9]", "")
    ip = F.forall(F.split(value, r"\."), lambda p: p.try_cast("double") <= 255)
    card = F.length(digits).between(16, 19)
    return (
        F.when(F.col("kind") == 0, F.lit(True))
        .when(F.col("kind") == 1, ip)
        .when(F.col("kind") == 2, F.when(card, F.call_function("luhn_check", F.when(card, digits))).otherwise(False))
        .when(F.col("kind") == 3, F.length(digits).between(8, 15))
        .otherwise(True)
    )


def _left_words(left: Column) -> tuple[Column, Column]:
    """Last word, and last two words, before a match: lower case, identifiers as #, ^ at the start of the context."""
    words = F.transform(F.filter(F.split(F.lower(left), SPACE), lambda w: w != ""), lambda w: F.when(w.rlike("[0-9@]"), F.lit("#")).otherwise(w))
    one = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("^"))
    return one, F.concat_ws(" ", F.coalesce(F.try_element_at(words, F.lit(-2)), F.lit("^")), one)


def matches(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """One row per base match or identifier-like word of docs(row, doc_id, text), or one of kind null for a document
    without any: row, doc_id, key, kind (4: identifier-like, outside all base spans), start, stop, value, one, two."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    guards = (F.contains(text, F.lit("@")), text.rlike(r"[0-9]\.[0-9]"), text.rlike("[0-9]"), F.contains(text, F.lit("+")))
    found = [_matches(text, p, k, g) for k, (p, g) in enumerate(zip(PATTERNS, guards, strict=True))]
    found.append(_matches(text, CANDIDATE, 4, text.rlike("[0-9@]")))
    own = F.lit(None).cast("int") if key is None else key
    rows = docs.select("row", "doc_id", own.alias("key"), F.explode_outer(F.concat(*found)).alias("m")).select("row", "doc_id", "key", "m.*").repartition("row")
    inside = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(inside)).withColumn("start", F.col("stop") - F.col("size"))
    rows = rows.withColumn("ok", _valid()).where("kind is null or ok")
    # identifier-like words shed the punctuation around them
    lead = F.length("value") - F.length(F.ltrim(F.col("value"), F.lit("([{<\"'")))
    trail = F.length("value") - F.length(F.rtrim(F.col("value"), F.lit(")]}>\"'.,;:!?")))
    own = F.col("kind") == 4
    rows = rows.withColumns({"start": F.when(own, F.col("start") + lead).otherwise(F.col("start")), "stop": F.when(own, F.col("stop") - trail).otherwise(F.col("stop")), "value": F.when(own, F.rtrim(F.ltrim(F.col("value"), F.lit("([{<\"'")), F.lit(")]}>\"'.,;:!?"))).otherwise(F.col("value"))})
    base = F.col("kind") < 4
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("stop"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumns({"before": before, "after": after})
    digits = F.length(F.regexp_replace("value", "[^0-9]", ""))
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("after"), F.col("stop")) >= F.col("stop"))
    identifier = free & (F.length("value") >= 5) & ((digits >= 3) | F.contains(F.col("value"), F.lit("@")))
    rows = rows.withColumn("kind", F.when(own & ~identifier, F.lit(None)).otherwise(F.col("kind")))
    one, two = _left_words(F.col("left"))
    return rows.select("row", "doc_id", "key", "kind", "start", "stop", "value", one.alias("one"), two.alias("two"))


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, times) over the whole texts of docs(text) for patterns(pattern) of one or two words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.when(w.rlike("[0-9@]"), F.lit("#")).otherwise(w))
    both = F.zip_with(words, F.concat(F.array(F.lit("^")), hashed), lambda w, v: F.array(w, F.concat_ws(" ", v, w)))
    every = docs.select(F.explode(F.filter(both, lambda p: p[0].isNotNull())).alias("p")).select(F.explode("p").alias("pattern"))
    # where Spark finds the patterns' table small enough to broadcast, each occurrence is counted where it is read
    return every.join(patterns.distinct(), "pattern").groupBy("pattern").agg(F.count("*").alias("times"))


def discover(found: DataFrame, docs: DataFrame, least_seeds: int = LEAST_SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """(one, two, instance, new_kind) of trusted unseen identifiers from matches(docs) and the texts."""
    spark = docs.sparkSession
    rows = found.where("kind is not null").select(F.explode(F.array("one", "two")).alias("pattern"), F.lower("value").alias("instance"), "kind").where("pattern not rlike '[#^]'")
    edges = rows.groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n"))
    seeds = edges.where("kind < 4")
    patterns = store(seeds.groupBy("pattern", F.col("kind").alias("as_kind")).agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least_seeds).select("pattern", "as_kind"), "patterns")
    empty = "one string, two string, instance string, new_kind int"
    known = patterns.select("pattern").distinct()
    if known.isEmpty():
        return spark.createDataFrame([], empty)
    times = store(occurrences(docs, store(known, "pattern-words")), "occurrences")
    graph = store(edges.join(known, "pattern", "left_semi"), "graph")
    unseen = graph.where("kind = 4").join(patterns, "pattern")
    fixed = graph.where("kind < 4").select("pattern", F.col("kind").alias("as_kind"), F.col("n").cast("double").alias("mass"))
    score = None
    for _ in range(rounds):
        mass = fixed
        if score is not None:
            mass = mass.unionAll(unseen.join(score, ["instance", "as_kind"]).select("pattern", "as_kind", (F.col("n") * F.col("score")).alias("mass")))
        sums = mass.groupBy("pattern", "as_kind").agg(F.sum("mass").alias("mass"))
        confidence = store(sums.join(patterns, ["pattern", "as_kind"]).join(times, "pattern").select("pattern", "as_kind", F.least(F.lit(1.0), F.col("mass") / F.col("times")).alias("confidence")), "confidence")
        score = store(
            unseen.join(confidence, ["pattern", "as_kind"]).groupBy("instance", "as_kind").agg((F.sum(F.col("n") * F.col("confidence")) / F.sum("n")).alias("score")),
            "score",
        )
    trusted = confidence.where(F.col("confidence") >= LEAST_CONFIDENCE)
    good = unseen.join(trusted, ["pattern", "as_kind"]).join(score.where(F.col("score") >= LEAST_SCORE), ["instance", "as_kind"])
    return good.groupBy("pattern", "instance").agg(F.max_by("as_kind", F.struct("confidence", -F.col("as_kind"))).alias("new_kind"))


def spans(docs: DataFrame, least_seeds: int = LEAST_SEEDS, rounds: int = ROUNDS, key: Column | None = None) -> DataFrame:
    """docs(row, doc_id, text), row unique, as row, doc_id, key (of `key`, an expression), base and all: sorted arrays of (kind, start, stop).

    Positions are code points, stops exclusive. Null and empty texts have no spans; every row comes back once.
    Matches that fail their check are dropped without another try. A pattern takes part from `least_seeds` different
    seeds of a kind. Only matches are shuffled, by row; graph sums are combined before their shuffles.
    """
    found = store(matches(docs, key), "matches")
    new = discover(found, docs, least_seeds, rounds)
    kinds = found.select("row", "doc_id", "key", "kind", "start", "stop")
    if new.columns[0] == "pattern":
        new = store(new, "discovered")
        unseen = found.where("kind = 4").select("row", "doc_id", "key", "start", "stop", F.explode(F.array("one", "two")).alias("pattern"), F.lower("value").alias("instance"))
        more = unseen.join(new, ["pattern", "instance"]).groupBy("row", "start").agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.max("stop").alias("stop"), F.min("new_kind").alias("kind"))
        kinds = kinds.withColumn("new", F.lit(False)).unionByName(more.withColumn("new", F.lit(True)))
    else:
        kinds = kinds.withColumn("new", F.lit(False))
    span = F.struct(F.col("kind").cast("int").alias("kind"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    own = F.col("kind").isNotNull() & (F.col("kind") < 4)
    return kinds.groupBy("row").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"),
        F.first("key", ignorenulls=True).alias("key"),
        F.array_sort(F.collect_list(F.when(own & ~F.col("new"), span))).alias("base"),
        F.array_sort(F.collect_list(F.when(own, span))).alias("all"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; n_chars, where there is one, follows.

    All rows and columns stay, repeated rows too; null and empty texts have nothing to replace. Equal texts have equal
    spans, so spans find their rows by two hashes of the text and don't depend on the order of a scan; the rows of a
    text that is repeated are dealt over SALTS parts.
    """
    keys, all_spans, salt = (fresh(n, docs) for n in ("key", "spans", "salt"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = spans(texts, key=key).where(F.size("all") > 0).groupBy("key").agg(F.first("all").alias(all_spans))
    found = store(found.withColumnRenamed("key", keys).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "spans")
    numbered = docs.withColumn(keys, key).withColumn(salt, F.pmod(F.xxhash64(*columns(docs)), F.lit(SALTS)).cast("int"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_place = F.array_sort(F.transform(all_spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    begin = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substr(F.col("text"), (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        put = F.when(s["start"] >= state["at"], F.array(gap, F.element_at(names, s["kind"] + 1))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(state["parts"], put).alias("parts"), F.greatest(state["at"], s["stop"]).alias("at"))

    text = F.aggregate(by_place, begin, step, lambda state: F.concat(F.array_join(state["parts"], ""), F.substr(F.col("text"), (state["at"] + 1).cast("int"))))
    out = numbered.join(found.hint("merge"), [keys, salt], "left").withColumn("text", F.when(F.col(all_spans).isNotNull(), text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(all_spans).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns(docs))


def _listed(column: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all whole documents."""
    docs = read_table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans(docs).select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("all").alias("spans"))
