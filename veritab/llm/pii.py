"""Personal data: base patterns, and terms that give a protected value away.

Method: information-theoretic sanitisation. The values that the base patterns find are the protected
entities. Over all documents, co-occurrence near an entity tells how much a term says about it: once the term is
seen, -log p(e|t) of the entity's information is left. p(e|t) is judged by a lower confidence bound that depends
on the sightings alone and not on how many other documents there are; the bound starts from how often terms
as rare as this one stand near any entity, so that a single sighting of a rare word says little in a corpus full
of rare words. A term whose bound reaches ``DISCLOSURE`` is generalised in documents that hold the entity: to its
stem if the stem, over all words that share it, stays below that line, else to its class of words. From
``REMOVAL`` on it is removed.

Only DataFrame and SQL functions are used, and work is in proportion to the texts. A context is a bounded number
of code points to either side of an entity, so a document of many entities has as many contexts and no more.
Patterns are written so that Java's matcher runs in time linear in the text: a search begins at the start of a
run of fitting characters or where the last match ended (\\G), and loops are possessive, which changes no match
here. Running sums over the matches of a text are taken in blocks of about the square root of their number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritab.llm.spread import lookup_by_size
from veritab.session import materialize

#: Lower bounds of p(entity | term) from which a term is generalised, and removed.
DISCLOSURE, REMOVAL = 0.5, 0.8
#: Code points to either side of an entity that are its context.
CONTEXT = 80
#: Standard deviations of the lower bound, and sightings that the background rate counts for.
DEVIATIONS, PRIOR = 0.5, 1.0
#: Code points of the parts that a text is cut into before spans are replaced.
PART = 4096
KINDS = ["email", "ip", "card", "phone", "stem", "term", "reveal"]
PLACEHOLDERS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
#: Terms are runs of at least four letters or digits.
TERM = r"[\p{L}\p{N}]{4,}"

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a match of the kind passes.
GUARDS = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11}",
    "phone": r"\+[0-9]",
}
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + F.when(digit > 9, digit - 9).otherwise(digit)

    # Places count from 1 at the right; every second digit counts double.
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _small_parts(value: Column) -> Column:
    def small(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+(?=.)", "")
        return (F.length(short) <= 3) & (F.substring(short, 1, 3).cast("int") <= 255)

    return F.forall(F.split(value, r"\."), small)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": _small_parts,
    "card": lambda v: F.length(_digits(v)).between(12, 19) & _luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once; within a lambda it would be for every element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` has made of ``start`` and all values before each value, as an array.

    In blocks, because an array that grows by one element is copied each time: n sqrt(n) copies instead of n * n.
    """

    def along(of: Column, first: Column) -> Column:
        return F.aggregate(of, F.array(first), lambda seen, v: F.concat(seen, F.array(step(F.element_at(seen, -1), v))))

    def blocks(x: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
        firsts = F.when(F.size(x) > 0, F.sequence(F.lit(1), F.size(x), size)).otherwise(F.array().cast("array<int>"))
        return F.transform(firsts, lambda i: F.slice(x, i, size))

    def joined(parts: Column) -> Column:
        ends = F.transform(parts, lambda part: F.element_at(along(part, start), -1))
        # The blocks' own steps start from nothing; what came before is put on top of them.
        before = F.slice(along(ends, start), 1, F.greatest(F.lit(1), F.size(ends)))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), before.alias("before")), lambda z: F.slice(along(z["part"], z["before"]), 1, F.size(z["part"]))))

    return _let(values, lambda x: F.when(F.size(x) > 0, _let(blocks(x), joined)).otherwise(F.slice(F.array(start), 1, 0)))


def _matches(text: Column, pattern: str) -> Column:
    """Every match with the text before it (since the last match) and behind it (up to the next)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("between"))
    empty = F.array().cast("array<struct<value:string,before:string,behind:string>>")

    def zipped(x: Column) -> Column:
        n = F.size(x["found"])
        rows = F.arrays_zip(x["found"].alias("value"), F.slice(x["between"], 1, n).alias("before"), F.slice(x["between"], 2, n).alias("behind"))
        return F.when(n > 0, rows).otherwise(empty)

    return _let(pieces, zipped)


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """All matches from left to right as (start, kind, stop, value), in code points.

    What lies between the matches comes from a split by the same pattern, so that the places are
    running sums of lengths.
    """

    def placed(x: Column) -> Column:
        sizes = F.transform(x, lambda m: F.length(m["before"]) + F.length(m["value"]))
        rows = F.arrays_zip(x.alias("m"), _running(sizes, F.lit(0), lambda at, v: at + v).alias("at"))

        def span(z: Column) -> Column:
            start = z["at"] + F.length(z["m"]["before"])
            return F.struct(
                start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(z["m"]["value"])).alias("stop"), z["m"]["value"].alias("value")
            )

        return F.transform(rows, span)

    return _let(_matches(text, pattern), placed)


def base_spans(text: Column) -> Column:
    """Valid spans of the four base kinds, by start, then kind. A null text has none."""
    none = F.array().cast(SPAN)

    def of(kind: str) -> Column:
        all_spans = spans_of(text, PATTERNS[kind], kind)
        return F.when(text.rlike(GUARDS[kind]), F.filter(all_spans, lambda s: VALID[kind](s["value"]))).otherwise(none)

    return F.array_sort(F.concat(*map(of, PATTERNS)))


def _guarded(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(g) for g in GUARDS.values()])


def _entity(kind: Column, value: Column) -> Column:
    """The protected value in one spelling, with its kind."""
    spelled = F.when(kind <= 1, F.lower(value)).otherwise(_digits(value))
    return F.concat(kind.cast("string"), F.lit(":"), spelled)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


FIRST_RUN, LAST_RUN = r"^[\p{L}\p{N}]+", r"[\p{L}\p{N}]+$"


def _context(before: Column, behind: Column) -> Column:
    """The ends of two texts that meet at an entity, without words that the cut or the entity has broken."""
    left = F.when(F.length(before) > CONTEXT, F.regexp_replace(F.right(before, F.lit(CONTEXT)), FIRST_RUN, "")).otherwise(before)
    right = F.when(F.length(behind) > CONTEXT, F.regexp_replace(F.left(behind, F.lit(CONTEXT)), LAST_RUN, "")).otherwise(behind)
    return F.concat_ws(" ", F.regexp_replace(left, LAST_RUN, ""), F.regexp_replace(right, FIRST_RUN, ""))


def sightings(text: Column) -> Column:
    """(entity, terms) of every valid match: the terms of its context that are not part of the entity itself.

    A context ends at the next match of the same pattern, valid or not.
    """
    none = F.array().cast("array<struct<entity:string,terms:array<string>>>")

    def of(kind: str) -> Column:
        def whole_words(x: Column) -> Column:
            def between(m: Column, i: Column) -> Column:
                before = F.when(i > 0, F.regexp_replace(m["before"], FIRST_RUN, "")).otherwise(m["before"])
                behind = F.when(i < F.size(x) - 1, F.regexp_replace(m["behind"], LAST_RUN, "")).otherwise(m["behind"])
                return F.struct(m["value"].alias("value"), before.alias("before"), behind.alias("behind"))

            return F.transform(x, between)

        def sighting(m: Column) -> Column:
            entity = _entity(F.lit(KINDS.index(kind)), m["value"])
            terms = F.filter(_terms(_context(m["before"], m["behind"])), lambda t: ~F.contains(entity, t))
            return F.struct(entity.alias("entity"), terms.alias("terms"))

        valid = F.filter(_let(_matches(text, PATTERNS[kind]), whole_words), lambda m: VALID[kind](m["value"]))
        return F.when(text.rlike(GUARDS[kind]), F.transform(valid, sighting)).otherwise(none)

    return F.concat(*map(of, PATTERNS))


def _stem(term: Column) -> Column:
    """The first half of a word; the end of a mark that no word has."""
    return F.concat(F.left(term, F.ceil(F.length(term) / 2).cast("int")), F.lit("…"))


def lower_bound(both: Column, of: Column, rate: Column) -> Column:
    """Of the share both / of: Wilson's bound, as if ``PRIOR`` more sightings had been seen at the background rate."""
    n = of + F.lit(PRIOR)
    p = F.least(F.lit(1.0), (both + F.lit(PRIOR) * rate) / n)
    z = F.lit(DEVIATIONS)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (p + z * z / (2 * n) - spread) / (1 + z * z / n)


def compared(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, n_both, n_term, n_entity, rate, bound, share) of every pair that shares a context.

    Counts are of documents, so that what is repeated within one is seen once; copies of a document count each. ``rate``
    is how often terms that are about as frequent stand near any entity, ``bound`` the lower bound of p(entity | term).
    ``share`` is PMI / IC by the counts as they are, for information: it moves with the number of documents.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The number comes before the explode, so that it is one per document.
    guarded = documents.filter(_guarded(text)).select(F.monotonically_increasing_id().alias("row"), sightings(text).alias("seen"))
    held = materialize(guarded.select("row", F.explode("seen").alias("s")).select("row", "s.entity", "s.terms"))
    entities = materialize(held.select("row", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity")))
    near = held.select("row", "entity", F.explode("terms").alias("term")).distinct()
    near = materialize(near)
    pairs = materialize(near.groupBy("entity", "term").agg(F.count("*").alias("n_both")))
    anywhere = near.select("row", "term").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    # Aggregated within each task first: the exchange has one row per term and task.
    everywhere = documents.select(F.explode(_terms(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    terms = everywhere.join(anywhere, "term", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    terms = materialize(terms.withColumn("stem", _stem(F.col("term"))).withColumn("often", F.floor(F.log2("n_term")).cast("int")))
    # One row for each power of two of a count: at most 63.
    rates = terms.groupBy("often").agg((F.sum("n_near") / F.sum("n_term")).alias("rate"))
    n_pairs, total = pairs.count(), documents.count()
    # A word that stands beside very many entities, and an entity beside very many words, are hot keys.
    sized = pairs.groupBy("term").agg(F.count("*").alias("rows")).join(terms, "term").join(F.broadcast(rates), "often")
    counted = lookup_by_size(pairs, materialize(sized), "term", "rows", n_pairs).drop("rows", "n_near", "often")
    owners = materialize(pairs.groupBy("entity").agg(F.count("*").alias("rows")).join(entities, "entity"))
    counted = lookup_by_size(counted, owners, "entity", "rows", n_pairs).drop("rows")
    # Words that share a stem: some document count of the stem is at least the largest of theirs.
    stems = materialize(terms.groupBy("stem").agg(F.max("n_term").alias("n_stem")))
    content = F.log(F.lit(float(total)) / F.col("n_entity"))
    pmi = F.log(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    return counted.withColumn("bound", lower_bound(F.col("n_both"), F.col("n_term"), F.col("rate"))).withColumn(
        "share", F.when(content > 0, pmi / content).otherwise(F.lit(0.0))
    ).join(stems, "stem")


def disclosing_terms(documents: DataFrame, text_col: str = "text", disclosure: float = DISCLOSURE, removal: float = REMOVAL) -> DataFrame:
    """(entity, term, bound, kind) for every term whose bound reaches ``disclosure``.

    ``kind`` numbers what becomes of it: ``reveal`` (removed) from ``removal`` on, else ``stem`` if the entity is not
    given away by the stem either, else ``term`` (its class of words).
    """
    flagged = compared(documents, text_col).filter(F.col("bound") >= disclosure)
    # Of all flagged words of an entity that share a stem; their documents may be the same, so this is at most.
    of_stem = Window.partitionBy("entity", "stem")
    both = F.least(F.sum("n_both").over(of_stem), F.col("n_entity"))
    stem_bound = lower_bound(both, F.greatest("n_stem", both), F.col("rate"))
    kind = F.when(F.col("bound") >= removal, KINDS.index("reveal")).when(stem_bound < disclosure, KINDS.index("stem")).otherwise(KINDS.index("term"))
    return flagged.withColumn("kind", kind).select("entity", "term", "bound", "kind")


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """``documents`` with two columns: ``base`` and ``spans`` (base and term spans, by start, then kind).

    Texts that no pattern can fit go past the join with the texts whose terms disclose something;
    of the others, those without an entity have a key of their own each.
    A null text has no spans. Repeated rows are treated alike. Columns that are named like the
    two new ones are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    documents = documents.drop("base", "spans")
    marked = documents.filter(_guarded(text)).withColumn("base", base_spans(text))
    found = materialize(disclosing_terms(documents, text_col, disclosure))
    entities = F.array_distinct(F.transform("base", lambda s: _entity(s["kind"], s["value"])))
    # Only texts with an entity; equal texts are one.
    owned = materialize(marked.filter(F.size("base") > 0).select(F.xxhash64(text).alias("_key"), text.alias("_text"), entities.alias("entities")))
    owners = owned.select("_key", F.explode("entities").alias("entity")).distinct()
    # By terms first: a term that gives entities away stands near few others, so a text meets no entity that
    # isn't its own much more often than those that are.
    words = owned.select("_key", F.explode(_terms(F.col("_text"))).alias("term")).distinct()
    hits = words.join(found, "term").join(owners, ["_key", "entity"]).groupBy("_key", "term").agg(F.max("kind").alias("kind"))
    hits = materialize(hits)
    affected = owned.join(hits.select("_key").distinct(), "_key", "left_semi").groupBy("_key").agg(F.first("_text").alias("_text"))
    placed = affected.select("_key", F.explode(spans_of(F.col("_text"), TERM, "term")).alias("w")).select("_key", F.lower("w.value").alias("term"), "w")
    one = F.struct(F.col("w.start").alias("start"), F.col("kind").alias("kind"), F.col("w.stop").alias("stop"), F.col("w.value").alias("value"))
    more = materialize(placed.join(hits, ["_key", "term"]).groupBy("_key").agg(F.collect_list(one).alias("_more")))
    key = F.when(F.size("base") > 0, F.xxhash64(text)).otherwise(F.xxhash64(F.lit("no entity"), F.col(id_col), F.length(text)))
    joined = marked.withColumn("_key", key).join(more, "_key", "left")
    spans = F.when(F.col("_more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.col("_more").cast(SPAN))))
    none = F.array().cast(SPAN)
    others = documents.filter(~_guarded(text)).withColumn("base", none).withColumn("spans", none)
    return joined.withColumn("spans", spans).drop("_key", "_more").unionByName(others)


def written(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))

    def one(s: Column) -> Column:
        return F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))

    return F.array_join(F.transform(spans, one), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    def count(kind: str) -> Column:
        number = KINDS.index(kind)
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long").alias(f"n_{kind}")

    return found.select(
        id_col, *map(count, PATTERNS), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


def sanitized_text(text: Column, spans: Column) -> Column:
    """The text with every span replaced; of overlapping spans the first begins and the rest join it."""
    words = F.create_map(*[F.lit(x) for kind, shown in PLACEHOLDERS.items() for x in (KINDS.index(kind), shown)])

    def shown(s: Column) -> Column:
        general = F.when(s["value"].rlike(r"^\p{N}+$"), "<NUMBER>").when(s["value"].rlike(r"^\p{Lu}"), "<NAME>").otherwise("<WORD>")
        return (
            F.when(s["kind"] < len(PLACEHOLDERS), words[s["kind"]]).when(s["kind"] == KINDS.index("stem"), _stem(s["value"]))
            .when(s["kind"] == KINDS.index("term"), general).otherwise("")
        )

    def piece(parts: Column, a: Column, b: Column) -> Column:
        """Code points a to b, from the few parts that hold them."""
        first = F.floor(a / PART).cast("int")
        joined = F.array_join(F.slice(parts, first + 1, F.floor((b - 1) / PART).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(joined, a - first * PART + 1, b - a)).otherwise("")

    def rebuilt(x: Column) -> Column:
        """``at`` is the end of all spans before."""
        ends = _running(F.transform(x["spans"], lambda s: s["stop"]), F.lit(0), lambda at, stop: F.greatest(at, stop))
        rows = F.arrays_zip(x["spans"].alias("s"), ends.alias("at"))
        out = F.transform(
            rows, lambda z: F.when(z["s"]["start"] >= z["at"], F.concat(piece(x["parts"], z["at"], z["s"]["start"]), shown(z["s"]))).otherwise("")
        )
        last = F.array_max(F.transform(x["spans"], lambda s: s["stop"]))
        return F.concat(F.array_join(out, ""), piece(x["parts"], last, x["size"]))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    whole = F.struct(parts.alias("parts"), spans.alias("spans"), F.length(text).alias("size"))
    return F.when(F.size(spans) > 0, _let(whole, rebuilt)).otherwise(text)


def sanitize(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with personal data replaced in the text; all else, null texts too, stays."""
    found = find(documents, id_col, text_col)
    return found.withColumn(text_col, sanitized_text(F.col(text_col), F.col("spans"))).select(*documents.columns)
