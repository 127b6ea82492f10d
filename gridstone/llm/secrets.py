"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query: a disjunction of sets of
trigrams, one set of which every match must contain. The index posts the documents of each
trigram that a query names (of lower-cased text); postings are intersected per set, and only
documents that answer a rule's query are verified with its expression. Rules without
mandatory trigrams are run on every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.llm.common import let, materialize, small_enough

#: Alternatives of one query at most; expressions with more are scanned fully.
MOST_SETS = 64
#: Candidate documents that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_CANDIDATES = 500_000


@dataclass(frozen=True)
class Rule:
    """pattern: for both Python's and Java's re; least: characters that group `group` of a match must have."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The base kinds in their order, then further ones. `+` runs that must have a length are spelt {n,}
#: where failing matches cannot hide another (hex and access runs are maximal).
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE_KINDS = 3

_ANY = None


def _strings(tree) -> list[tuple[frozenset[str], str, str, bool]]:
    """What a parsed expression can match, as alternatives: (trigrams so far, known start, known end, exact).

    A start equal to the end with exact set is the whole match. Alternatives beyond MOST_SETS become unknown.
    """
    unknown = [(frozenset(), "", "", False)]
    out = [(frozenset(), "", "", True)]
    for op, arg in tree:
        if op is sre.LITERAL:
            c = chr(arg).lower()
            step = [(frozenset(), c, c, True)]
        elif op is sre.IN and 0 < len(arg) <= 4 and all(o is sre.LITERAL for o, _ in arg):
            step = [(frozenset(), c, c, True) for c in sorted({chr(a).lower() for _, a in arg})]
        elif op is sre.SUBPATTERN:
            step = _strings(arg[-1])
        elif op is sre.BRANCH:
            step = [s for branch in arg[1] for s in _strings(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            if (least, most) == (0, 1):
                step = [(frozenset(), "", "", True), *_strings(inner)]
            elif least >= 1:
                one = _strings(inner)
                step = one if least == most == 1 else [(t, a, b, False) for t, a, b, _ in one]
            else:
                step = unknown
        elif op is sre.AT:
            step = [(frozenset(), "", "", True)]
        else:
            step = unknown
        if len(out) * len(step) > MOST_SETS:
            step = unknown
        out = [_joined(x, y) for x in out for y in step]
    return out


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _joined(x, y):
    (grams_x, start_x, end_x, exact_x), (grams_y, start_y, end_y, exact_y) = x, y
    border = end_x + start_y
    grams = grams_x | grams_y | _grams(border) | (_grams(end_x) if not exact_x else frozenset()) | (_grams(start_y) if not exact_y else frozenset())
    start = start_x + start_y if exact_x else start_x
    end = end_x + end_y if exact_y else end_y
    return grams, start, end, exact_x and exact_y


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case trigrams, one of which every match contains entirely; empty if there is no such query."""
    found = {grams | _grams(start) | _grams(end) for grams, start, end, _ in _strings(sre_parser.parse(pattern))}
    if any(not g for g in found):
        return []
    return sorted((g for g in found if not any(h < g for h in found)), key=sorted)


#: Rows without an id are dealt to so many keys of their own, which no candidate has.
NULL_KEYS = 1024


def key_of() -> list[Column]:
    """The posting key of a row: its id, and 0. Rows that share an id share candidates, which verification settles; a row without one has a key that none has."""
    salt = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("text"), F.lit(NULL_KEYS))).otherwise(0)
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_gs_doc"), salt.cast("long").alias("_gs_salt")]


def postings(documents: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """The inverted index of the given trigrams: a row (trigram, doc) for each that the lower-cased text of a document with an id contains."""
    wanted = F.array(*[F.lit(t) for t in sorted(trigrams)])
    found = let(F.lower("text"), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))
    return documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.explode(found).alias("trigram"))


def candidates(documents: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """doc, rules: the numbers of the indexed rules whose query the document answers."""
    spark = documents.sparkSession
    sets = [(n, m, t, len(grams)) for n, rule in enumerate(rules) for m, grams in enumerate(trigram_query(rule.pattern)) for t in sorted(grams)]
    if not sets:
        return spark.createDataFrame([], "doc long, rules array<int>")
    queries = F.broadcast(spark.createDataFrame(sets, "rule int, alternative int, trigram string, needed int"))  # bounded by the rules
    posted = postings(documents, {t for _, _, t, _ in sets})
    answered = posted.join(queries, "trigram").groupBy("doc", "rule", "alternative", "needed").agg(F.countDistinct("trigram").alias("n"))
    return answered.where("n = needed").groupBy("doc").agg(F.collect_set("rule").alias("rules"))


SPANS = "array<struct<start: bigint, end: bigint, rank: int, kind: string>>"


def prefixed(items: Column, kind: str, measure, combine) -> Column:
    """Each item with what the measures of all items before it combine to (0 for the first): array of struct<before, item>.

    Items are taken in blocks of about the square root of their number, so no array grows beyond a block
    within a fold and the work is in proportion to the number to the power of 1.5 at most. combine is associative, 0 its start.
    """
    out, zero = f"array<struct<before: bigint, item: {kind}>>", F.lit(0).cast("bigint")
    size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(items)))).cast("int")
    add = lambda s, x: combine(s, measure(x).cast("bigint")).cast("bigint")

    def with_size(given: Column) -> Column:
        n = given["n"]
        part = lambda b: F.slice(items, (b * n + 1).cast("int"), n)
        blocks = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / n).cast("int"))).otherwise(F.array().cast("array<int>"))
        totals = F.transform(blocks, lambda b: F.aggregate(part(b), zero, add))
        begin = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        starts = F.aggregate(totals, begin, lambda a, t: F.struct(combine(a["at"], t).cast("bigint").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

        def within(start: Column, b: Column) -> Column:
            first = F.struct(start.alias("at"), F.array().cast(out).alias("out"))
            step = lambda a, x: F.struct(add(a["at"], x).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("before"), x.alias("item"))).cast(out)).alias("out"))
            return F.aggregate(part(b), first, step)["out"]

        return F.flatten(F.transform(starts, within))

    return let(F.struct(size.alias("n")), with_size)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's leftmost non-overlapping matches, in code points, without those whose group is too short."""
    pattern = F.lit(rule.pattern)
    pair = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("groups"), F.split(text, rule.pattern, -1).alias("gaps"))
    kind = "struct<gap: int, hit: int, good: boolean>"

    def located(p: Column) -> Column:
        sized = F.transform(p["hits"], lambda hit, i: F.struct(F.length(F.get(p["gaps"], i)).alias("gap"), F.length(hit).alias("hit"), (F.length(F.get(p["groups"], i)) >= rule.least).alias("good")))
        placed = let(sized, lambda items: prefixed(items, kind, lambda x: x["gap"] + x["hit"], lambda a, b: a + b))
        good = F.filter(placed, lambda x: x["item"]["good"])
        start = lambda x: x["before"] + x["item"]["gap"]
        return F.transform(good, lambda x: F.struct(start(x).alias("start"), (start(x) + x["item"]["hit"]).alias("end"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"))).cast(SPANS)

    return F.when(F.regexp_like(text, pattern), let(pair, located)).otherwise(F.array().cast(SPANS))


def with_spans(documents: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """documents with a column _gs_spans: all spans by start, then rule order."""
    found = materialize(candidates(documents, rules), "candidates").select(F.col("doc").alias("_gs_doc"), F.lit(0).cast("long").alias("_gs_salt"), F.col("rules").alias("_gs_rules"))
    if small_enough(found, BROADCAST_CANDIDATES):
        found = F.broadcast(found)
    joined = documents.select("*", *key_of()).join(found, ["_gs_doc", "_gs_salt"], "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = []
    for n, rule in enumerate(rules):
        spans = spans_of(text, rule, n)
        if trigram_query(rule.pattern):
            spans = F.when(F.col("_gs_salt") > 0, spans).when(F.array_contains("_gs_rules", n), spans).otherwise(F.array().cast(SPANS))
        parts.append(spans)
    ordered = F.sort_array(F.flatten(F.array(*parts)))
    # by start, then rule: end comes second in the struct, so order on a copy with rank before it
    by_rank = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return joined.withColumn("_gs_spans", F.sort_array(by_rank))


def shown(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(documents: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document row: doc_id and its spans as array<struct<start, rank, end, kind>>.

    Null and empty texts have none. Repeated rows each get their row; rows that share an id
    share index candidates but are verified one by one, and rows without one are verified for every rule. An empty table gives no rows.
    """
    return with_spans(documents, rules).select("doc_id", F.col("_gs_spans").alias("spans"))


def redact(documents: DataFrame, rules: Sequence[Rule] = RULES, mask: str = "[secret]") -> DataFrame:
    """documents with every span of text replaced by the mask (overlapping spans by one) and n_chars counted anew; null text stays.

    What lies between spans is cut out block by block, so a text with many spans is not read from its start for each.
    """
    columns = documents.columns
    rows = with_spans(documents, rules)
    text = F.col("text")
    placed = prefixed(F.col("_gs_spans"), "struct<start: bigint, rank: int, end: bigint, kind: string>", lambda s: s["end"], lambda a, b: F.greatest(a, b))
    gap = "array<struct<low: bigint, high: bigint>>"
    before = F.transform(F.filter(placed, lambda x: x["item"]["start"] >= x["before"]), lambda x: F.struct(x["before"].alias("low"), x["item"]["start"].alias("high"))).cast(gap)
    last = F.struct(F.array_max(F.transform("_gs_spans", lambda s: s["end"])).alias("low"), F.length(text).cast("bigint").alias("high"))

    def cut(gaps: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(gaps)))).cast("int")
        blocks = F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / size).cast("int"))

        def pieces(b: Column) -> Column:
            some = F.slice(gaps, (b * size + 1).cast("int"), size)
            low, high = F.element_at(some, 1)["low"], F.element_at(some, -1)["high"]
            near = F.struct(some.alias("gaps"), low.alias("low"), F.substring(text, (low + 1).cast("int"), (high - low).cast("int")).alias("text"))
            return let(near, lambda p: F.transform(p["gaps"], lambda g: F.substring(p["text"], (g["low"] - p["low"] + 1).cast("int"), (g["high"] - g["low"]).cast("int"))))

        return F.array_join(F.flatten(F.transform(blocks, pieces)), mask)

    masked = F.when(F.size("_gs_spans") > 0, let(F.concat(before, F.array(last).cast(gap)), cut)).otherwise(text)
    rows = rows.withColumn("_gs_masked", masked)
    new = {"text": F.col("_gs_masked"), "n_chars": F.when(F.size("_gs_spans") > 0, F.length("_gs_masked").cast("long")).otherwise(F.col("n_chars") if "n_chars" in columns else None)}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridstone.llm.common import table

    rows = secret_scan(table(spark, sf_dir, "documents"))
    of = lambda n: F.size(F.filter("spans", lambda s: s["rank"] == n))  # noqa: E731 (a second parameter of the inner one would be the element's place)
    counts = [of(n).cast("long").alias(f"n_{RULES[n].kind}") for n in range(BASE_KINDS)]
    base = shown(F.filter("spans", lambda s: s["rank"] < BASE_KINDS))
    return rows.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
