"""Personal data: fixed patterns, and identifiers that bootstrapping finds from their contexts.

The base patterns give seed entities. What stands around a seed is a lexical pattern: the unit before it, the two
before it, and the one before with the one after; a unit is a word with the marks behind it, or the begin of a line.
A pattern scores by the share of its instances that are known, an instance by the patterns it occurs with, and both
are worked out in turn over the graph of patterns and instances. Patterns that do well there are scored again with
all that the texts hold in their place, plain words included. Values in patterns that end up trusted are reported as well.
Only built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.llm.shared import attach, may_contain, row_key, stage

# The base patterns. Starts that the pattern itself would pass over are left out by lookbehind, and
# loops that can't give anything back are possessive, so long runs cost linear time and no stack.
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)

#: Words with a digit that may be identifiers.
CANDIDATE = r"(?<![A-Za-z0-9@._+-])[A-Za-z0-9@._+-]*[0-9][A-Za-z0-9@._+-]*"
FOUND = "context"
MORE = "array<struct<start:int,end:int,kind:string>>"
#: Rounds of scoring; a pattern is trusted from this score and so many distinct known instances on.
ROUNDS, TRUST, SUPPORT = 3, 0.6, 3
#: A pattern's score is the lower end of the interval of so many standard errors around its share of known instances.
DOUBT = 1.96

#: One text in so many has the first look at plain words, which refutes most of the patterns that can be refuted.
FIRST_LOOK = 16

#: Matches that are worked on together.
BLOCK = 128
SPANS = "array<struct<start:int,end:int,value:string,left:string,right:string>>"

#: Characters of a word, and the units that contexts are made of; context units are shorter than ``UNIT_LENGTH``.
WORDS = "A-Za-z0-9@._+-"
UNIT = rf"[{WORDS}]++[^\s{WORDS}]*+|[^\s{WORDS}]++|\n"
AFTER = rf"^[^\s{WORDS}]*+\s++([{WORDS}]++[^\s{WORDS}]*+|[^\s{WORDS}]++)"
AROUND, UNIT_LENGTH = 48, 40


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def blocks(array: Column) -> Column:
    """An array, not empty, in pieces of ``BLOCK``."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int")), lambda b: F.slice(array, b * BLOCK + 1, F.lit(BLOCK)))


def spans(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their places in code points and what stands around them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def paired(gaps: Column) -> Column:
        # The begin of a text is that of a line.
        near = lambda gap, i: F.concat(F.when(i == 0, "\n").otherwise(""), F.right(gap, F.lit(AROUND)))
        around = F.transform(gaps, lambda gap, i: F.struct(F.length(gap).alias("skip"), near(gap, i).alias("left"), F.left(F.get(gaps, i + 1), F.lit(AROUND)).alias("right")))
        return F.zip_with(around, found, lambda a, value: F.struct(a["skip"].alias("skip"), a["left"].alias("left"), a["right"].alias("right"), value.alias("value")))

    pairs = once(F.split(text, pattern, -1), paired)

    def add(done: Column, pair: Column) -> Column:
        start = done["at"] + pair["skip"]
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"), pair["left"].alias("left"), pair["right"].alias("right"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    def offset(done: Column, block: Column) -> Column:
        return F.struct((done["at"] + block["at"]).alias("at"), F.concat(done["begins"], F.array(done["at"])).alias("begins"))

    def moved(block: Column, begin: Column) -> Column:
        move = lambda s: F.struct((s["start"] + begin).alias("start"), (s["end"] + begin).alias("end"), s["value"].alias("value"), s["left"].alias("left"), s["right"].alias("right"))
        return F.transform(block["spans"], move)

    # Places count from the begin of a block of matches, then from that of the text: adding to an array copies it.
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    matches = F.filter(pairs, lambda p: p["value"].isNotNull())
    own = once(matches, lambda m: F.transform(blocks(m), lambda block: F.aggregate(block, start, add)))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))
    everything = once(own, lambda o: F.flatten(F.zip_with(o, F.aggregate(o, none, offset, lambda done: done["begins"]), moved)))
    return F.when(F.size(found) > 0, everything).otherwise(F.array().cast(SPANS))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.split(F.reverse(number), "")

    def worth(digit: Column, place: Column) -> Column:
        twice = digit.cast("int") * 2
        return F.when(place % 2 == 0, digit.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.filter(turned, lambda d: d != ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    number = F.length(digits(value))
    if kind == "card":
        return F.when(number.between(*CARD_DIGITS), luhn(digits(value))).otherwise(False)
    return number.between(*PHONE_DIGITS) if kind == "phone" else F.lit(True)


def base(kind: str, text: Column) -> Column:
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]")}
    tried = hint.get(kind, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"))
    return F.when(tried, F.filter(spans(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))).otherwise(F.array().cast(SPANS))


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, base spans by kind, and candidate spans that overlap none of them."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", row_key().alias("row_key"), *[base(k, text).alias(k) for k in KINDS], F.when(text.rlike("[0-9]"), spans(text, CANDIDATE)).otherwise(F.array().cast(SPANS)).alias("candidates"))
    return rows.withColumn("candidates", F.when((F.size("candidates") > 0) & (F.size(F.concat(*KINDS)) > 0), unmet(F.col("candidates"), F.concat(*KINDS))).otherwise(F.col("candidates")))


def unmet(some: Column, others: Column) -> Column:
    """The spans of ``some`` that overlap none of ``others``; neither is empty, ``some`` is in order and without overlaps.

    Blocks of neighbours are held against each other first, spans only where their blocks meet.
    """

    def meet(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    def bounded(block: Column) -> Column:
        ends = F.array_max(F.transform(block, lambda s: s["end"]))
        return F.struct(block[0]["start"].alias("start"), ends.alias("end"), block.alias("spans"))

    def left(block: Column, all_: Column) -> Column:
        near = F.flatten(F.transform(F.filter(all_, lambda b: meet(b, block)), lambda b: b["spans"]))
        return once(near, lambda n: F.filter(block["spans"], lambda s: ~F.exists(n, lambda k: meet(k, s))))

    places = F.transform(others, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    ordered = once(F.array_sort(places), lambda o: F.transform(blocks(o), bounded))
    own = once(some, lambda x: F.transform(blocks(x), bounded))
    return once(F.struct(own.alias("own"), ordered.alias("all_")), lambda x: F.flatten(F.transform(x["own"], lambda block: left(block, x["all_"]))))


def folded(text: Column) -> Column:
    """Lower case, a 0 for each digit, and no empty lines."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"\n\s+", "\n"), "[0-9]", "0"))


def patterns(before: Column, last: Column, after: Column) -> Column:
    """The lexical patterns of a value: the unit before it, the two before it, and those on both sides.

    The begin of a line says nothing by itself; it needs a unit after the value.
    """
    all_ = F.array(last, F.concat_ws(" ", before, last), F.concat_ws(" _ ", last, after))
    given = F.array(last != "\n", (before != "") & (last != "\n"), after != "")
    short = F.filter(F.zip_with(all_, given, lambda p, ok: F.when(ok, p)), lambda p: p.isNotNull())
    return F.when((last != "") & (F.length(last) < UNIT_LENGTH), short).otherwise(F.array().cast("array<string>"))


def contexts(span: Column) -> Column:
    """The patterns that a span occurs in."""
    units = lambda text: F.regexp_extract_all(folded(text), F.lit(UNIT), F.lit(0))
    at = lambda u, i: F.coalesce(F.get(u, F.size(u) - i), F.lit(""))
    after = F.regexp_extract(folded(F.coalesce(span["right"], F.lit(""))), AFTER, 1)
    return once(units(span["left"]), lambda u: patterns(at(u, 2), at(u, 1), after))


def plain_words(texts: DataFrame, trusted: DataFrame) -> DataFrame:
    """pattern and plain, the distinct words without a digit or @ that the texts hold in the pattern's place."""
    units = F.regexp_extract_all(folded(F.concat(F.lit("\n"), F.coalesce("text", F.lit("")))), F.lit(UNIT), F.lit(0))

    def place(u: Column, i: Column) -> Column:
        named = {"before": F.get(u, i - 2), "last": F.get(u, i - 1), "word": F.get(u, i), "after": F.get(u, i + 1)}
        return F.struct(*[F.coalesce(c, F.lit("")).alias(k) for k, c in named.items()])

    places = once(units, lambda u: F.transform(u, lambda _, i: place(u, i)))
    rows = texts.select(F.explode(places).alias("p")).select("p.*").filter((F.col("last") != "") & ~F.col("word").rlike(r"[0@\n]"))
    rows = rows.withColumn("last_key", F.xxhash64("last"))
    # Of patterns of two units, the last one or the one before the value; of others the only one.
    own = F.when(F.contains("pattern", F.lit(" _ ")), F.substring_index("pattern", " _ ", 1)).otherwise(F.substring_index("pattern", " ", -1))
    near = may_contain(rows, "last_key", trusted.select(F.xxhash64(own).alias("key")), "key")
    after = F.when(F.col("after") != "\n", F.col("after")).otherwise("")
    cases = near.select(F.explode(patterns(F.col("before"), F.col("last"), after)).alias("pattern"), "word").withColumn("key", F.xxhash64("pattern"))
    cases = may_contain(cases, "key", trusted.select(F.xxhash64("pattern").alias("key")), "key").select("pattern", "word").distinct()
    return cases.groupBy("pattern").agg(F.count(F.lit(1)).alias("plain"))


def plain_counts(texts: DataFrame, proposed: DataFrame) -> DataFrame:
    """pattern and plain of those staged ``proposed`` patterns that plain words don't refute.

    Plain words refute a pattern if they alone put its score under ``TRUST``, were all of its instances known. More words
    only lower it, so what the texts of a first look refute is refuted, and all texts are read for the others only: pairs of
    pattern and word then are as many as the instances allow, not as the words of the texts.
    """
    possible = lower_share(F.col("instances"), F.col("instances") + F.coalesce("plain", F.lit(0))) >= TRUST

    def unrefuted(patterns: DataFrame, some: DataFrame) -> DataFrame:
        return patterns.join(plain_words(some, patterns), "pattern", "left").filter(possible)

    some = texts.filter(F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(FIRST_LOOK)), F.lit(FIRST_LOOK)) == 0)
    left = stage(unrefuted(proposed.select("pattern", "instances"), some).drop("plain"), "unrefuted")
    return unrefuted(left, texts)


def lower_share(known: Column, n: Column, z: float = DOUBT) -> Column:
    """Lower end of the score interval of a share ``known / n``: few instances prove little."""
    share = known / n
    return (share + z * z / 2 / n - z * F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) / n + z * z / 4 / n / n)) / (1 + z * z / n)


def scored(edges: DataFrame, rounds: int) -> DataFrame:
    """Scores of the patterns of staged ``edges`` (pattern, value, kind, seed, plain) after some rounds."""
    values = edges.groupBy("value").agg(F.max("seed").cast("double").alias("known"), F.count(F.lit(1)).alias("degree"))
    scores = None
    for i in range(rounds):
        with_known = attach(edges, stage(values, "instances"), "value", "degree")
        scores = stage(
            with_known.groupBy("pattern").agg(
                lower_share(F.sum("known"), F.count(F.lit(1)) + F.max("plain")).alias("score"),
                F.count(F.lit(1)).alias("instances"),
                F.sum((F.col("known") >= TRUST).cast("long")).alias("support"),
                *[F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
            ),
            "patterns",
        )
        if i + 1 < rounds:
            # An instance is unknown only if all of its patterns are wrong; seeds stay known.
            linked = attach(edges, scores.select("pattern", "score", "instances", "support"), "pattern", "instances")
            doubt = F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999)) * (F.col("support") >= SUPPORT).cast("double")))
            values = linked.groupBy("value").agg(
                F.greatest(F.max("seed").cast("double"), 1 - F.exp(doubt)).alias("known"), F.count(F.lit(1)).alias("degree")
            )
    return scores.filter((F.col("score") >= TRUST) & (F.col("support") >= SUPPORT))


def trusted_patterns(found: DataFrame, texts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The patterns that the graph of patterns and instances trusts, from a staged table of ``entities`` and its texts.

    A pattern has the kind of most of its seeds, or none where its support was discovered.
    """
    edge = lambda span, kind: (F.explode(contexts(span)).alias("pattern"), span["value"].alias("value"), F.lit(kind).alias("kind"))
    exploded = [found.select(F.explode(c).alias("s")).select(*edge(F.col("s"), i)) for i, c in enumerate((*KINDS, "candidates"))]
    edges = exploded[0]
    for more in exploded[1:]:
        edges = edges.unionByName(more)
    # What is a seed and a candidate in one pattern counts as a seed.
    edges = edges.groupBy("pattern", "value").agg(F.min("kind").alias("kind"))
    edges = stage(edges.withColumn("seed", (F.col("kind") < len(KINDS)).cast("int")).withColumn("plain", F.lit(0).cast("long")), "edges")
    proposed = stage(scored(edges, rounds), "proposed")
    # Plain words can only lower scores, so no other pattern needs the look at the texts and the second scoring.
    held = stage(plain_counts(texts, proposed).withColumnRenamed("plain", "words"), "held")
    again = attach(edges, held, "pattern", "instances").filter("instances is not null").drop("instances")
    again = again.withColumn("plain", F.coalesce("words", F.lit(0))).drop("words")
    kept = scored(stage(again, "edges"), rounds)
    most = F.greatest(*[F.col(f"n_{k}") for k in KINDS])
    kind = F.coalesce(*[F.when((F.col(f"n_{k}") == most) & (most > 0), k) for k in KINDS], F.lit(FOUND))
    return kept.select("pattern", kind.alias("kind"), "score", "instances")


def discovered(found: DataFrame, texts: DataFrame) -> DataFrame:
    """row_key and the spans of candidates in a trusted pattern, each with the kind of the best such pattern."""
    trusted = stage(trusted_patterns(found, texts), "trusted")
    rows = found.filter(F.size("candidates") > 0).select("row_key", F.explode("candidates").alias("s"))
    rows = rows.select("row_key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.explode(contexts(F.col("s"))).alias("pattern"))
    hits = attach(rows, trusted, "pattern", "instances").filter("instances is not null")
    best = hits.groupBy("row_key", "start", "end").agg(F.max(F.struct("score", "pattern", "kind")).alias("best"))
    return best.groupBy("row_key").agg(F.collect_list(F.struct("start", "end", "best.kind")).alias("more"))


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts and digest of the base spans, and all spans.

    A null text is empty. Null and repeated doc_ids are rows like any other; an empty table gives none; other
    columns are ignored. Spans are kind:start:end in code points, sorted by start, then kind, comma-joined.
    Those that the method adds are ``context`` in ``spans``; ``found`` lists them with the kind they are taken for.
    """
    found = stage(entities(docs), "entities")

    def named(kind: str, number: int, array: Column) -> Column:
        return F.transform(array, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    def joined(array: Column) -> Column:
        return F.concat_ws(",", F.transform(F.array_sort(array), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    own = F.concat(*[named(k, i, F.col(k)) for i, k in enumerate(KINDS)])
    more = named(FOUND, len(KINDS), F.coalesce("more", F.array().cast(MORE)))
    guessed = F.concat_ws(",", F.transform(F.array_sort(F.coalesce("more", F.array().cast(MORE))), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    rows = found.join(discovered(found, docs), "row_key", "left")
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(own), 256).alias("base_sha256"),
        joined(F.concat(own, more)).alias("spans"),
        F.size(more).cast("long").alias("n_found"),
        guessed.alias("found"),
    )
