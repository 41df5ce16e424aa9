"""Personal data: pattern spans, and identifiers found by bootstrapped contexts.

Everything is DataFrame expressions. Base spans (email, ip, card, phone) are leftmost
matches of fixed patterns with checks. Their surroundings then seed a bootstrapped
extraction:

* a *mention* is a run of neighbouring words that each hold a digit or an @, with at
  least MIN_DIGITS digits or an @ in all; its *pattern* is the pair of words before it;
  its *instance* is the run itself, bare of punctuation around it;
* instances that hold a base span, or that have the shape of a secret (SECRET), are seeds
  of confidence 1;
* each round scores patterns by their instances (mean confidence, and support: the sum)
  and instances by their accepted patterns (noisy or), on the pattern-instance graph;
* after ROUNDS, mentions in accepted patterns that hold no base span are spans of the
  kind ``id``, if their instance is confident enough. A shape alone makes no span.

Positions come from the lengths of what lies between matches, so a text is searched
once for its matches and once for the pieces between them; sums over the pieces go by
chunks of CHUNK, so the time is in proportion to the matches. Quantifiers are possessive
and starts are fixed to where a run begins or the last match ended, which changes no
match but keeps the time in proportion to the text.

Cases: a null text is empty and has no spans; equal texts get equal spans; a row that
repeats comes out as often; columns beyond doc_id and text are ignored; a corpus
without seeds adds nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitile.llm.shared import materialize

KINDS = ("email", "ip", "card", "phone", "id")
MIN_DIGITS = 4
ROUNDS = 3
#: A pattern is accepted with this mean confidence and support of its instances.
PATTERN_CONFIDENCE, PATTERN_SUPPORT = 0.6, 3.0
INSTANCE_CONFIDENCE = 0.6
#: Matches of a text that are put into one array step by step.
CHUNK = 256

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_MARKED = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
MENTION = rf"(?<![^\x20\x09-\x0D]){_MARKED}(?:\x20{_MARKED})*+"
#: The last two words of what stands before a mention.
BEFORE = r"(?<![^\x20\x09-\x0D])((?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++)?[^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$"
#: Shape of a secret: one word of 20 or more letters, digits, - and _, at least four of them digits and four letters.
SECRET = r"^(?=(?:[^0-9]*[0-9]){4})(?=(?:[^A-Za-z]*[A-Za-z]){4})[A-Za-z0-9_-]{20,}$"
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"

_SPANS = "array<struct<start:int,end:int,word:string,pattern:string>>"


def _digits(word: Column) -> Column:
    return F.length(F.regexp_replace(word, "[^0-9]", ""))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, b: a + b)


def found(text: Column, pattern: str, gate: Column, check=None, before: bool = False) -> Column:
    """Spans of the matches of ``pattern`` in ``text`` that pass ``check``, in order, with the pattern before each if asked."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("word"))
    size = lambda part: F.length(part["gap"]) + F.coalesce(F.length(part["word"]), F.lit(0))
    chunk = lambda parts, i: F.slice(parts, i * CHUNK + 1, CHUNK)

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["word"]), F.lit(0))
        good = part["word"].isNotNull() if check is None else part["word"].isNotNull() & check(part["word"])
        # a gap of one word is preceded by the last match
        context = pattern_of(F.concat(state["last"], part["gap"])) if before else F.lit(None).cast("string")
        span = F.struct(start.alias("start"), end.alias("end"), part["word"].alias("word"), context.alias("pattern"))
        out = F.when(good, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), F.coalesce(part["word"], F.lit("")).alias("last"), out.cast(_SPANS).alias("out"))

    def spans_of(parts: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int"))
        lengths = F.transform(numbers, lambda i: _total(F.transform(chunk(parts, i), size)))

        def one(sizes: Column, i: Column) -> Column:
            last = F.coalesce(F.get(parts, i * CHUNK - 1)["word"], F.lit(""))
            first = F.struct(_total(F.slice(sizes, F.lit(1), i)).alias("at"), last.alias("last"), F.array().cast(_SPANS).alias("out"))
            return F.aggregate(chunk(parts, i), first, step, lambda state: state["out"])

        # the sizes are bound to a name, so that they are summed up once
        return F.flatten(F.flatten(F.transform(F.array(lengths), lambda sizes: F.transform(numbers, lambda i: one(sizes, i)))))

    every = F.flatten(F.transform(F.array(pieces), spans_of))
    return F.when(gate, every).otherwise(F.array().cast(_SPANS))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum divisible by ten."""

    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        double = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(double - F.when(double > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> Column:
    """All base spans as array<struct<start, kind, end>>, by start, then kind as listed."""
    has_digit = text.rlike("[0-9]")
    kinds = [
        found(text, EMAIL, F.contains(text, F.lit("@"))),
        found(text, IP, has_digit, lambda w: w.rlike(OCTETS)),
        F.filter(found(text, CARD, has_digit, lambda w: _digits(w).between(12, 19)), lambda s: luhn(F.regexp_replace(s["word"], "[^0-9]", ""))),
        found(text, PHONE, F.contains(text, F.lit("+")), lambda w: _digits(w).between(9, 15)),
    ]

    def tagged(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    return F.array_sort(F.concat(*[tagged(spans, kind) for kind, spans in enumerate(kinds)]))


def pattern_of(before: Column) -> Column:
    """The last two words of what stands before a mention, lower-cased; null without any."""
    return F.nullif(F.lower(F.regexp_extract(before, BEFORE, 1)), F.lit(""))


_OUTER = r"^[^A-Za-z0-9+]++|(?<=[A-Za-z0-9])[^A-Za-z0-9]++$"


def instance_of(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, _OUTER, ""))


def bare_span(m: Column) -> tuple[Column, Column]:
    """Start and end of a mention without the punctuation around it."""
    ahead = F.length(F.regexp_extract(m["word"], r"^[^A-Za-z0-9+]++", 0))
    behind = F.length(F.regexp_extract(m["word"], r"(?<=[A-Za-z0-9])[^A-Za-z0-9]++$", 0))
    return m["start"] + ahead, m["end"] - behind


def scored_patterns(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Accepted patterns and instance confidences after ``rounds`` on (pattern, instance, seed)."""
    instances = materialize(edges.groupBy("instance").agg(F.max("seed").cast("double").alias("confidence")), "instances")
    patterns = None
    for _ in range(rounds):
        scored = edges.join(instances, "instance").groupBy("pattern").agg(F.avg("confidence").alias("score"), F.sum("confidence").alias("support"))
        patterns = materialize(scored.filter((F.col("score") >= PATTERN_CONFIDENCE) & (F.col("support") >= PATTERN_SUPPORT)).select("pattern", "score"), "patterns")
        doubt = edges.join(patterns, "pattern").groupBy("instance").agg(F.sum(F.log(F.lit(1.0) - F.least(F.col("score"), F.lit(0.999)))).alias("doubt"))
        grown = instances.join(doubt, "instance", "left").select("instance", F.greatest("confidence", F.lit(1.0) - F.exp(F.coalesce("doubt", F.lit(0.0)))).alias("confidence"))
        instances = materialize(grown, "instances")
    return patterns, instances


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts, digest of base spans, all spans and how many the contexts added, for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    identifier = lambda w: (_digits(w) >= MIN_DIGITS) | F.contains(w, F.lit("@"))
    once = rows.select("doc_id", F.xxhash64("text").alias("key"), base_spans(text).alias("base"), found(text, MENTION, text.rlike("[0-9@]"), identifier, True).alias("mentions"))
    once = materialize(once, "pii")
    each = once.select("doc_id", "key", F.explode("mentions").alias("m"))
    start, end = bare_span(F.col("m"))
    mentions = each.select("doc_id", "key", start.alias("start"), end.alias("end"), "m.pattern", instance_of(F.col("m.word")).alias("instance"), (F.size(base_spans(F.col("m.word"))) > 0).alias("held"))
    mentions = mentions.filter("pattern is not null and instance <> ''").withColumn("seed", F.col("held") | F.col("instance").rlike(SECRET))
    mentions = materialize(mentions, "mentions")
    edges = materialize(mentions.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pattern-instances")
    patterns, instances = scored_patterns(edges)
    sure = instances.filter(F.col("confidence") >= INSTANCE_CONFIDENCE).select("instance")
    fresh = mentions.filter("not held").join(patterns.select("pattern"), "pattern").join(sure, "instance")
    kind = F.lit(KINDS.index("id"))
    added = fresh.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", kind.alias("kind"), "end")).alias("added"))
    added = materialize(added, "pii-added").withColumnsRenamed({"doc_id": "of", "key": "of_key"})
    out = once.select("doc_id", "key", "base").join(added, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    name = F.array(*map(F.lit, KINDS))
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.col("added"))))
    found_ids = F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_id")
    return out.select("doc_id", *[count(k) for k in range(4)], F.sha2(show(F.col("base")), 256).alias("base_sha256"), show(every).alias("spans"), found_ids)
