"""Personal data by bootstrapped contextual extraction, in DataFrame functions (operator 8).

Base spans come from fixed patterns, leftmost and without overlap within a kind; matches
that fail their kind's test are dropped. Offsets are code points, from running sums of the
lengths of the matches and of the text between them.

The base values are the seeds of a graph. Its instances are identifier-like strings: what any
base pattern matches, and other tokens with at least MIN_DIGITS digits in which no base
pattern matches. Its patterns are the two words before an instance in the whole text, in which
each earlier instance counts as a marker. In each of ROUNDS rounds a pattern's confidence is the
mean trust in its instances, smoothed; an instance's trust is the chance that at least one of
its patterns is right, times DECAY; seeds keep full trust. Patterns spread trust once MIN_SEEDS
of their instances are seeds or trusted by TRUSTED at least, so what was discovered supports
further patterns in the next round. Against drift, a pattern never counts what it gave an
instance itself, only what the instance has from other patterns. Patterns that are so
supported and reach MIN_CONFIDENCE discover: their other instances become spans of kind
``context``. Base spans always stay.

The graph holds each (pattern, instance) pair once, whatever the number of occurrences; each
round is written to the shared folder, so plans do not grow with the rounds; and its joins
leave both sides to adaptive execution, so a frequent pattern or instance can be split. A text
with n matches takes n ** 1.5 steps, not n ** 2: sums and cuts go in blocks of its root.

Defined results: null text counts as empty; rows are told apart by id and text, so a null
or repeated id is no harm; equal rows get equal results; other columns are ignored.

The patterns below equal those of the contract. Possessive repeats and the look-behind
only spare the matcher from going back where that could not give another match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import in_two_stages, ship, staged

KINDS = ("email", "ip", "card", "phone", "context")

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Behind \G a match goes on where the last one ended.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Runs of fewer than 13 digits fail the card's test, so they need not match.
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
OCTETS = rf"^{OCTET}(?:\.{OCTET}){{3}}$"

MIN_DIGITS = 4
TOKEN_CHAR, TOKEN_LETTER = "[A-Za-z0-9_@.:/+-]", "[A-Za-z_@.:/+-]"
TOKEN = (
    rf"(?<!{TOKEN_CHAR})(?={TOKEN_LETTER}*+(?:[0-9]{TOKEN_LETTER}*+){{{MIN_DIGITS}}})"
    rf"{TOKEN_CHAR}{{6,}}+"
)
#: The values of base spans, and other tokens; leftmost, in this order.
INSTANCE = "|".join(f"(?:{p})" for p in (EMAIL, PHONE, IP, CARD, TOKEN))
#: Two words at the end of what stands before an instance, and quotes or brackets.
BEFORE = r"(?<!\S)(\S++)\s++(\S++)\s++[\"'(\[]*+$"
#: Stands for an earlier instance: no character that texts use.
MARK = "\x01"

ROUNDS = 6
MIN_CONFIDENCE = 0.5
MIN_SEEDS = 3
TRUSTED = 0.6
DECAY = 0.95
SMOOTHING = 0.5

FOUND = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def in_blocks(array: Column) -> Column:
    """The array in about as many blocks as each has elements."""
    size = F.greatest(F.ceil(F.sqrt(F.size(array))).cast("int"), F.lit(1))
    starts = F.sequence(F.lit(1), F.greatest(F.size(array), F.lit(1)), size)
    return F.transform(starts, lambda k: F.slice(array, k, size))


def sums_before(numbers: Column) -> Column:
    """For each number the sum of those before it."""

    def within(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(
            block,
            start,
            lambda s, x: F.struct(
                (s["sum"] + x).alias("sum"), F.concat(s["before"], F.array(s["sum"])).alias("before")
            ),
        )

    def joined(blocks: Column) -> Column:
        return let(
            within(F.transform(blocks, lambda b: b["sum"])),
            lambda whole: F.flatten(
                F.zip_with(blocks, whole["before"], lambda b, more: F.transform(b["before"], lambda x: x + more))
            ),
        )

    return let(numbers, lambda n: let(F.transform(in_blocks(n), within), joined))


def located(text: Column, pattern: str) -> Column:
    """Matches of the pattern with their places, and the text between them: struct of
    found and gaps, or null where nothing matches."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def places(gaps: Column, matches: Column) -> Column:
        sizes = F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m))
        return let(
            sums_before(sizes),
            lambda sums: F.transform(
                matches,
                lambda m, i: let(
                    F.get(sums, i) + F.length(F.get(gaps, i)),
                    lambda at: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("value")),
                ),
            ),
        )

    def found(matches: Column) -> Column:
        return let(
            F.slice(F.split(text, pattern, -1), 1, F.size(matches)),
            lambda gaps: F.struct(places(gaps, matches).alias("found"), gaps.alias("gaps")),
        )

    return let(matches, lambda m: F.when(F.size(m) > 0, found(m)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    padded = F.lpad(digits, 20, "0")
    total = None
    for place in range(1, 21):
        digit = F.substring(padded, place, 1).cast("int")
        if place % 2:
            digit = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        total = digit if total is None else total + digit
    return total % 10 == 0


def _card(found: Column) -> Column:
    digits = _digits(found["value"])
    return F.length(digits).between(13, 19) & _luhn(digits)


def _phone(found: Column) -> Column:
    return F.length(_digits(found["value"])).between(9, 15)


def base_and_instances(docs: DataFrame) -> DataFrame:
    """(doc_id, row, email, ip, card, phone, instances, gaps): found matches per row of docs,
    and the text before each instance from the one before. row is a hash of the text that
    tells rows with one id apart."""
    none = F.array().cast(FOUND)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digits", F.col("text").rlike("[0-9]"))
    text = F.col("text")
    has_at = F.contains(text, F.lit("@"))

    def within(condition: Column, pattern: str) -> Column:
        return F.when(condition, F.coalesce(located(text, pattern)["found"], none)).otherwise(none)

    found = rows.select(
        "doc_id",
        F.xxhash64("text").alias("row"),
        within(has_at, EMAIL).alias("email"),
        within(F.col("digits"), IP).alias("ip"),
        within(F.col("digits"), CARD).alias("card"),
        within(F.col("digits") & F.contains(text, F.lit("+")), PHONE).alias("phone"),
        F.when(F.col("digits") | has_at, located(text, INSTANCE)).alias("every"),
    )
    return found.select(
        "doc_id",
        "row",
        "email",
        F.filter("ip", lambda x: x["value"].rlike(OCTETS)).alias("ip"),
        F.filter("card", _card).alias("card"),
        F.filter("phone", _phone).alias("phone"),
        F.col("every.found").alias("instances"),
        F.col("every.gaps").alias("gaps"),
    )


def _tagged(column: str, kind: int) -> Column:
    return F.transform(
        column,
        lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")
        ),
    )


def _is_seed(value: Column) -> Column:
    found = F.struct(value.alias("value"))
    return (
        value.rlike(rf"^{EMAIL}$")
        | value.rlike(OCTETS)
        | (value.rlike(rf"^{CARD}$") & _card(found))
        | (value.rlike(rf"^{PHONE}$") & _phone(found))
    )


def instances_of(found: DataFrame) -> DataFrame:
    """(doc_id, row, seed, start, end, value, pattern): instances with two words before them."""
    rows = found.filter(F.col("instances").isNotNull())
    rows = rows.select("doc_id", "row", F.posexplode("instances").alias("i", "x"), "gaps")
    # An earlier instance is a word, or part of one; two words need no more than two of them.
    last = F.get("gaps", F.col("i") - 1)
    before = F.concat(
        F.when(F.col("i") > 1, MARK).otherwise(""),
        F.when(F.col("i") > 0, F.concat(last, F.lit(MARK))).otherwise(""),
        F.get("gaps", F.col("i")),
    )
    rows = rows.select("doc_id", "row", "x", F.lower(before).alias("before"))
    value = F.col("x.value")
    rows = rows.select(
        "doc_id",
        "row",
        _is_seed(value).alias("seed"),
        "x.start",
        "x.end",
        F.lower(value).alias("value"),
        F.concat_ws(" ", *[F.regexp_extract("before", BEFORE, i) for i in (1, 2)]).alias("pattern"),
    )
    base = "|".join(f"(?:{p})" for p in (EMAIL, PHONE, IP, CARD))
    return rows.filter((F.col("pattern") != " ") & (F.col("seed") | ~F.col("value").rlike(base)))


def confident_patterns(
    instances: DataFrame, rounds: int = ROUNDS, least: float = MIN_CONFIDENCE, seeds: int = MIN_SEEDS
) -> DataFrame:
    """(pattern, confidence, seeds) of the patterns that may discover; seeds counts the
    instances that are seeds or trusted."""
    edges = staged(
        instances.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-graph"
    )
    known = edges.groupBy("value").agg(F.max("seed").alias("seed"))
    edges = edges.select("pattern", "value").join(in_two_stages(known), "value")
    # An edge's trust: that in its instance without what its own pattern gave it.
    trusted = staged(edges.withColumn("trust", F.col("seed").cast("double")), "pii-trust")
    for number in range(rounds):
        patterns = trusted.groupBy("pattern").agg(
            (F.sum("trust") / (F.count("*") + SMOOTHING)).alias("confidence"),
            F.count_if(F.col("trust") >= TRUSTED).alias("seeds"),
        )
        if number == rounds - 1:
            break
        wrong = F.when(
            F.col("seeds") >= seeds, F.log(1 - F.least("confidence", F.lit(0.999)))
        ).otherwise(0.0)
        scored = trusted.join(in_two_stages(patterns.select("pattern", wrong.alias("wrong"))), "pattern")
        values = scored.groupBy("value").agg(F.sum("wrong").alias("every"))
        found = DECAY * (1 - F.exp(F.least(F.col("every") - F.col("wrong"), F.lit(0.0))))
        trusted = staged(
            scored.join(in_two_stages(values), "value").select(
                "pattern", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(found).alias("trust")
            ),
            "pii-trust",
        )
    return patterns.filter((F.col("confidence") >= least) & (F.col("seeds") >= seeds))


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row, spans): one row per row of docs; spans is an array of (kind, start, end)
    by kind, then start; kind is a place in KINDS."""
    ship(docs.sparkSession)
    found = staged(base_and_instances(docs), "pii-found")
    instances = staged(instances_of(found), "pii-instances")
    patterns = confident_patterns(instances).select("pattern", "confidence")
    kind = KINDS.index("context")
    added = (
        instances.filter(~F.col("seed"))
        .join(in_two_stages(patterns), "pattern")
        .groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r"))
        .agg(F.sort_array(F.collect_set(F.struct(F.lit(kind).alias("kind"), "start", "end"))).alias("added"))
    )
    base = F.concat(*[_tagged(name, i) for i, name in enumerate(KINDS[:4])])
    rows = found.select("doc_id", "row", base.alias("base"))
    joined = rows.join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return joined.select(
        "doc_id", "row", F.concat("base", F.coalesce("added", none)).alias("spans")
    )


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def _count_of(kind: int) -> Column:
    # A second parameter of the lambda, even one with a default, would be the span's index.
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] < 4)
    counts = [_count_of(i).alias(f"n_{name}") for i, name in enumerate(KINDS[:4])]
    return spans.select(
        "doc_id",
        *counts,
        F.sha2(_text_of(base), 256).alias("base_sha256"),
        _text_of(F.col("spans")).alias("spans"),
    )


def united(spans: DataFrame) -> DataFrame:
    """(doc_id, row, spans): spans of find_spans as (start, end, kind) in order, those that
    overlap as one; it has the kind of the one that starts first, ties to the longer."""
    every = spans.filter(F.size("spans") > 0).distinct()
    every = every.select("doc_id", "row", F.explode("spans").alias("s")).select("doc_id", "row", "s.*")
    of_text = Window.partitionBy("doc_id", "row").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(of_text.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") >= reach, F.lit(True))
    marked = every.withColumn("fresh", fresh).withColumn(
        "island", F.sum(F.col("fresh").cast("long")).over(of_text.rowsBetween(Window.unboundedPreceding, 0))
    )
    merged = marked.groupBy("doc_id", "row", "island").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min(F.struct("start", (-F.col("end")).alias("last"), "kind"))["kind"].alias("kind"),
    )
    one = F.struct("start", "end", "kind")
    return merged.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(one)).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with its disjoint spans, in order, replaced by their kinds in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def block(spans: Column, before: Column) -> Column:
        """From ``before`` to the end of the last span, cut from that part of the text."""
        last = F.element_at(spans, -1)["end"]
        return let(
            F.substring(text, before + 1, last - before),
            lambda part: F.array_join(
                F.transform(
                    spans,
                    lambda s, i: let(
                        F.coalesce(F.get(spans, i - 1)["end"], before),
                        lambda at: F.concat(
                            F.substring(part, at - before + 1, s["start"] - at), F.get(names, s["kind"])
                        ),
                    ),
                ),
                "",
            ),
        )

    def whole(blocks: Column) -> Column:
        return F.array_join(
            F.transform(
                blocks,
                lambda b, k: block(
                    b, F.coalesce(F.element_at(F.get(blocks, k - 1), -1)["end"], F.lit(0))
                ),
            ),
            "",
        )

    end = F.element_at(spans, -1)["end"]
    return F.concat(let(in_blocks(spans), whole), F.substring(text, end + 1, F.length(text)))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of their text replaced by its kind in brackets, spans that overlap
    as one. All columns stay; null text stays null."""
    spans = united(find_spans(docs))
    spans = spans.select(F.col("doc_id").alias("__d"), F.col("row").alias("__r"), F.col("spans").alias("__s"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (
        F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__r")
    )
    text = F.col("text")
    new = F.when(F.col("__s").isNull(), text).otherwise(replaced(text, F.col("__s")))
    return docs.join(spans, same, "left").select(
        *[new.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    )
