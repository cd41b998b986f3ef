"""Personal data and the terms that give it away, in DataFrame functions only.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers.  The method adds secrets (a value with a digit
after ``password=`` and the like) and terms.  Protected entities are the values found, and what values share and
recurs more often: an address's domain, an IP's first three parts, a card's first six digits, a phone number's without its last seven.

A term is a run of three letters or more outside the spans found.  From corpus co-occurrence by document, with N documents, n_e with the
entity, n_t with the term and n_te with both, and the entity's share p = n_e / N as what is known before,

    smoothed chance of the entity, given the term   P   = (n_te + PRIOR * p) / (n_t + PRIOR)
    what is left unknown of it, in bits             -log2 P
    what the term tells of it, in bits              log2(P / p), a smoothed PMI

and a term discloses the entity if at most RESIDUAL bits are left unknown, and it tells GAIN bits or more.  One document is no
evidence by this estimate, and neither threshold moves with N.  Such terms are spans of kind ``term`` wherever they stand in a
document with that entity.  Redaction generalises each span to the name of its kind.

The patterns are the contract's, written so that Java's matcher is linear and doesn't recurse: possessive, and
starting only where a leftmost match can start.  Running sums go over blocks of BLOCK elements, and text is cut from blocks of
characters, so the work for a text with n matches grows as n and, for the blocks' sums, (n / BLOCK) ** 2.

As n_t >= n_te, a pair with (n_te + PRIOR * p) / (n_te + PRIOR) below the threshold can't disclose; it leaves before it meets n_t,
which is counted over all documents, first within each task, so what is shuffled grows with the vocabulary.

Defined cases: null text counts as empty, without spans; repeated rows each count as a document and have their own
result; ties (overlapping kinds) are all listed, and redacted together under the first's name; an empty table
gives an empty result; an entity in most documents has no disclosing terms.  Other columns are not read, and may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table, text_or_empty

#: The contract's kinds, and those that the method adds.
KINDS, ADDED = ("email", "ip", "card", "phone"), ("secret", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){11}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"""(?i)(?<![a-z0-9])(?:password|passwd|passphrase|secret|token|api[_-]?key|access[_-]?key)\x20?[=:]\x20?["']?(?=[^\s"'<>]*[0-9])[^\s"'<>]{8,}+["']?""",
}
TERM = r"\p{L}{3,}+"
PRIOR, RESIDUAL, GAIN = 1.0, 0.5, 2.0
LEAST_CHANCE = 2.0**-RESIDUAL
BLOCK, CHARS = 64, 512

PLACES = "array<struct<start:int,end:int,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, add: bool = True) -> Column:
    """Of each of the ints, the sum (or else the maximum) of those before it; from 0."""
    op = (lambda a, b: a + b) if add else (lambda a, b: F.greatest(a, b))  # noqa: PLW0108  arguments by position

    def scan(of: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(of, first, step, lambda acc: acc["out"])

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), op))
        return F.flatten(F.zip_with(blocks, scan(totals, F.lit(0)), scan))

    def in_blocks(v: Column) -> Column:
        last = F.greatest(F.ceil(F.size(v) / BLOCK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))

    return _let(values, lambda v: _let(in_blocks(v), of_blocks))


def _places(text: Column, pattern: str, when: Column | None = None) -> Column:
    """array<struct<start, end, value>> of the pattern's matches; positions in code points."""

    def place(p: Column, at: Column) -> Column:
        lo = at + F.length(p["g"])
        return F.struct(lo.alias("start"), (lo + F.length(p["m"])).alias("end"), p["m"].alias("value"))

    def placed(pairs: Column) -> Column:
        return F.zip_with(pairs, _running(F.transform(pairs, lambda p: F.length(p["m"]) + F.length(p["g"]))), place)

    def paired(matches: Column) -> Column:
        # there is a gap more than matches
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        pairs = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        return F.when(F.size(matches) > 0, _let(pairs, placed)).otherwise(F.array().cast(PLACES))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if when is not None:
        found = F.when(when, found).otherwise(F.array().cast("array<string>"))
    return _let(found, paired)


def _assembled(text: Column, spans: Column, instead: Callable[[Column, Column], Column]) -> Column:
    """The text with each span (sorted by start) replaced; one that overlaps those before it stands under the first's name."""

    def whole(blocks: Column) -> Column:
        def piece(lo: Column, hi: Column) -> Column:
            first = F.floor(lo / CHARS).cast("int")
            some = F.slice(blocks, first + 1, F.floor((hi - 1) / CHARS).cast("int") - first + 1)
            return F.when(hi > lo, F.substring(F.array_join(some, ""), lo - first * CHARS + 1, hi - lo)).otherwise(F.lit(""))

        before = _running(F.transform(spans, lambda s: s["end"]), add=False)
        parts = F.zip_with(spans, before, lambda s, at: F.concat(piece(at, s["start"]), instead(s, at)))
        return F.concat(F.array_join(parts, ""), piece(F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0)), whole)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _part_ok(p: Column) -> Column:
    bare = F.ltrim(p, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _part_ok),
    "card": lambda v: F.length(_digits(v)).between(12, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "secret": lambda v: F.lit(True),
}
#: The protected entities of a value: itself in one spelling, and what it shares with others.
ENTITIES = {
    "email": lambda v: (F.lower(v), F.concat(F.lit("@"), F.lower(F.substring_index(v, "@", -1)))),
    "ip": lambda v: (v, F.concat(F.substring_index(v, ".", 3), F.lit(".*"))),
    "card": lambda v: (_digits(v), F.concat(F.left(_digits(v), F.lit(6)), F.lit("*"))),
    "phone": lambda v: (_digits(v), F.concat(F.left(_digits(v), F.length(_digits(v)) - 7), F.lit("*"))),
    "secret": lambda v: (v, v),
}
FOUND = (*KINDS, "secret")


def _found(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with the spans of all kinds but terms, sorted: array<struct<start, kind number, end, value>>."""
    t = F.col(text)
    digit = t.rlike("[0-9]")
    when = {"email": F.contains(t, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(t, F.lit("+")), "secret": digit & t.rlike("[=:]")}

    def of(k: int, kind: str) -> Column:
        good = F.filter(_places(t, PATTERNS[kind], when[kind]), lambda p: VALID[kind](p["value"]))
        return F.transform(good, lambda p: F.struct(p["start"].alias("start"), F.lit(k).alias("kind"), p["end"].alias("end"), p["value"].alias("value")))

    return docs.withColumn(out, F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(FOUND)])))


def _entities(span: Column) -> Column:
    """The protected entities of a span."""
    out = F.array().cast("array<string>")
    for k, kind in enumerate(FOUND):
        out = F.when(span["kind"] == k, F.array(*[F.concat(F.lit(kind + ":"), e) for e in ENTITIES[kind](span["value"])])).otherwise(out)
    return out


def disclosing(found: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entity, term) of what discloses, by counts over all documents; (row, entity) of entities that can be disclosed, and (row, term) of their documents.

    found(row, entities, terms), both distinct within a row.
    """
    n = float(found.count())
    share = F.col("n_e") / n
    chance = lambda n_t: (F.col("n_te") + PRIOR * share) / (F.col(n_t) + PRIOR)
    per = found.where(F.size("entities") > 0).select("row", F.explode("entities").alias("entity"))
    n_e = per.groupBy("entity").agg(F.count("*").alias("n_e")).where((F.col("n_e") + PRIOR * share) / (F.col("n_e") + PRIOR) >= LEAST_CHANCE)
    n_e = scratch.cut(n_e.where(F.log2(1 / share) >= GAIN), "entities")
    held = scratch.cut(per.join(n_e, "entity"), "held")
    own = found.where(F.size("entities") > 0).select("row", "terms").join(held.select("row").distinct(), "row", "left_semi")
    own = scratch.cut(own.select("row", F.explode("terms").alias("term")), "own-terms")
    pairs = held.join(own, "row").groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.first("n_e").alias("n_e"))
    pairs = scratch.cut(pairs.where(chance("n_te") >= LEAST_CHANCE), "pairs")
    # counted before the join, so that tasks hand out a row for each term and not one for each place
    n_t = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    told = pairs.join(n_t, "term").where((chance("n_t") >= LEAST_CHANCE) & (F.log2(chance("n_t") / share) >= GAIN))
    return scratch.cut(told.select("entity", "term", "n_e", "n_t", "n_te"), "disclosing"), held.select("row", "entity"), own


SPANS = "array<struct<start:int,kind:int,end:int>>"


def find(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, row_key, base, spans) for every row: arrays of struct<start, kind, end>, kinds numbered as in KINDS and ADDED; both sorted."""
    t = docs.select("doc_id", text_or_empty("text").alias("t"), F.xxhash64("doc_id", "text").alias("row_key"))
    found = _found(t, "t", "all")
    blanked = _assembled(F.col("t"), F.col("all"), lambda s, at: F.repeat(F.lit(" "), s["end"] - F.greatest(at, s["start"])))
    found = found.withColumn("left", F.when(F.size("all") > 0, blanked))
    found = found.withColumn("terms", F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("left", "t"), F.lit(TERM), F.lit(0)), F.lower)))
    entities = F.array_distinct(F.flatten(F.transform("all", _entities)))
    bare = F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    found = found.select("doc_id", "row_key", F.monotonically_increasing_id().alias("row"), bare.alias("all"), entities.alias("entities"), "terms", "left")
    found = scratch.cut(found, "found")

    pairs, held, own = disclosing(found, scratch)
    told = own.join(pairs.select("term").distinct(), "term").join(held, "row").join(pairs.select("entity", "term"), ["entity", "term"]).select("row", "term").distinct()
    told = scratch.cut(told, "told")
    at = found.select("row", "left").join(told.select("row").distinct(), "row")
    at = at.select("row", F.explode(_places(F.col("left"), TERM)).alias("p")).withColumn("term", F.lower("p.value")).join(told, ["row", "term"])
    mark = F.struct(F.col("p.start").alias("start"), F.lit(len(FOUND)).alias("kind"), F.col("p.end").alias("end"))
    marked = scratch.cut(at.groupBy("row").agg(F.collect_list(mark).alias("marks")), "marked")
    out = found.select("doc_id", "row_key", "row", "all").join(marked, "row", "left")
    spans = F.array_sort(F.concat("all", F.coalesce("marks", F.array().cast(SPANS))))
    return out.select("doc_id", "row_key", F.filter("all", lambda s: s["kind"] < len(KINDS)).alias("base"), spans.alias("spans"))


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, (*KINDS, *ADDED)))
    one = lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs' columns and rows, with every span of the text generalised to its kind's name."""
    spans, key, own_id = fresh(docs, "spans"), fresh(docs, "row_key"), fresh(docs, "row_id")
    found = find(docs, scratch).where(F.size("spans") > 0).select(F.col("doc_id").alias(own_id), F.col("row_key").alias(key), F.col("spans").alias(spans))
    found = scratch.cut(found.dropDuplicates([own_id, key]), "spans")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, *ADDED)])
    name = lambda s, at: F.when(s["start"] >= at, F.element_at(names, s["kind"] + 1)).otherwise(F.lit(""))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("doc_id", "text") == F.col(key))
    out = docs.join(found, same, "left")
    whole = _assembled(F.col("text"), F.col(spans), name)
    return out.withColumn("text", F.when(F.col(spans).isNotNull(), whole).otherwise(F.col("text"))).select(*docs.columns)


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op5"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    added = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == len(KINDS) + k)).cast("long").alias(f"n_{ADDED[k]}")
    return out.select(
        "doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"),
        *[added(k) for k in range(len(ADDED))],
    )
