"""Sanitisation by disclosure: what names a person goes, and so do terms that give it away.

Patterns find the protected entities (addresses, numbers). Over all documents,
co-occurrence tells how strongly a term reveals an entity: the pointwise mutual
information PMI(entity; term) against the information IC(entity) of the entity
itself. What the term leaves open of it, IC - PMI, is -log2 P(entity | term) and
doesn't depend on the size of the table. It is taken at the lower confidence
bound of that share, so that few meetings, or a rare term, tell little. A term
that leaves fewer bits open than a threshold is generalised or removed in every
document where it stands.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import shielded, told_if_small
from tabscope.session import stage_table

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Patterns for leftmost non-overlapping matches. Quantifiers don't give back what they took
#: where that can't change a match, and a match begins where its run of characters does, or where
#: the match before it ended; so a long run costs one attempt, not one for each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this character can't match.
NEEDS = {"email": "@", "phone": "+"}
NEEDS_PATTERN = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9]"}
WORD = r"\p{L}+"
#: Terms are told to every task up to so many bytes; beyond, the join deals them out.
TOLD_BYTES = 16 << 20


@dataclass(frozen=True)
class Disclosure:
    """How many bits of an entity a term may leave open at most to be treated, and must tell at least.

    ``z`` sets the confidence of the share's lower bound (Wilson's, one-sided). Only distinct texts are evidence.
    """

    generalise: float = 1.0
    remove: float = 1 / 3
    tells: float = 1.0
    z: float = 1.645

    @property
    def least(self) -> int:
        """Distinct texts in which an entity and a term must meet before the bound can be reached."""
        share = 2.0**-self.generalise
        return max(1, math.ceil(share * self.z**2 / (1 - share)))

    def low(self, k: Column, n: Column) -> Column:
        """Lower confidence bound of the share behind ``k`` of ``n``."""
        z2 = self.z**2
        p = k / n
        spread = F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
        return (p + z2 / (2 * n) - self.z * spread) / (1 + z2 / n)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` have a valid check digit."""
    plain = F.reverse(digits_of(value))

    def step(total: Column, i: Column) -> Column:
        d = F.substring(plain, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(plain)), F.lit(0), step) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits_of(value))
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return n.between(16, 19) & luhn(value)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def located(text: Column, pattern: Column, kind: str, n: int) -> Column:
    """All matches as array of (k, kind, s, e, v): code points, end exclusive.

    What lies between the matches and the matches themselves give the places.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(
        F.slice(between, 1, F.size(found)),
        found,
        lambda gap, v: F.struct(F.length(gap).alias("gap"), v.alias("v")),
    )
    kind_of = "array<struct<k:int,kind:string,s:int,e:int,v:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind_of).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc.at + x.gap
        e = s + F.length(x.v)
        span = F.struct(F.lit(n).alias("k"), F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x.v.alias("v"))
        return F.struct(e.alias("at"), F.concat(acc.out, F.array(span)).alias("out"))

    return F.aggregate(pairs, start, step).getField("out")


def checked(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: valid(kind, x.v))


def count_of(kind: int) -> Column:
    return F.size(F.filter("_spans", lambda x: x.k == kind)).cast("long")


def base_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``_spans``: valid matches of every kind in the order of ``KINDS``, then by place."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.withColumn("_pt", text)
    empty = F.array().cast("array<struct<k:int,kind:string,s:int,e:int,v:string>>")
    for n, kind in enumerate(KINDS):
        likely = F.col("_pt").contains(NEEDS[kind]) if kind in NEEDS else F.col("_pt").rlike(NEEDS_PATTERN[kind])
        spans = checked(located(F.col("_pt"), F.lit(PATTERNS[kind]), kind, n), kind)
        step = step.withColumn(f"_p{n}", F.when(likely, spans).otherwise(empty))
    return step.withColumn("_spans", F.concat(*(F.col(f"_p{n}") for n in range(len(KINDS))))).drop(
        "_pt", *(f"_p{n}" for n in range(len(KINDS)))
    )


def terms_of(text: Column) -> Column:
    """Distinct words in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def entities_of(spans: Column) -> Column:
    """Distinct names of the entities of one document."""
    value = lambda x: F.when(x.kind == "email", F.lower(x.v)).otherwise(x.v)
    return F.array_distinct(F.transform(spans, lambda x: F.concat(x.kind, F.lit(" "), value(x))))


def revealing(rows: DataFrame, n_docs: int, rule: Disclosure, text_col: str) -> DataFrame:
    """Terms that reveal an entity: term, action (the stronger one).

    Entities and terms meet in whole documents. Texts that repeat are one meeting;
    documents without the entity all count against it. What can't reach the bound,
    as it has fewer meetings or too many other documents, makes no pair.
    """
    held = rows.filter(F.size("_spans") > 0).select("_row", F.col("_th").alias("_text"), F.explode(entities_of(F.col("_spans"))).alias("entity"))
    counted = held.groupBy("entity", "_text").agg(F.count("*").alias("n")).groupBy("entity")
    entities = counted.agg(F.sum("n").alias("n_entity"), F.count("*").alias("n_texts")).filter(F.col("n_texts") >= rule.least)
    # Which of some equal texts stands for all of them, and for how many; only texts with an entity that recurs.
    meetings = held.join(entities, "entity").groupBy("_text", "entity").agg(
        F.min("_row").alias("_row"), F.count("*").alias("n_rows"), F.max("n_entity").alias("n_entity"), F.max("n_texts").alias("n_texts")
    )
    meetings = stage_table(meetings.drop("_text"), "pii-meetings")
    terms = rows.select(F.explode(terms_of(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    counted_terms = stage_table(terms.filter(F.col("n_term") >= rule.least), "pii-terms")
    chosen = rows.join(meetings.select("_row").distinct(), "_row", "left_semi")
    own = chosen.select("_row", F.explode(terms_of(F.col(text_col))).alias("term")).join(counted_terms, "term")
    # A term in more documents without the entity than the entity has texts leaves more than the bound open.
    share = 2.0**-rule.generalise
    few = F.col("n_term") - F.col("n_entity") <= F.col("n_texts") * ((1 - share) / share)
    pairs = own.join(meetings, "_row").filter(few).groupBy("entity", "term")
    pairs = pairs.agg(
        F.count("*").alias("n_pair"), F.sum("n_rows").alias("n_both"), F.max("n_term").alias("n_term"), F.max("n_entity").alias("n_entity")
    )
    low = rule.low(F.col("n_pair").cast("double"), F.col("n_pair") + F.col("n_term") - F.col("n_both"))
    bits = -F.log2(low)
    told = F.log2(low * n_docs / F.col("n_entity"))
    action = F.when(F.col("bits") <= rule.remove, "remove").otherwise("generalise")
    reached = pairs.select("term", bits.alias("bits"), told.alias("told")).filter((F.col("bits") <= rule.generalise) & (F.col("told") >= rule.tells))
    return reached.groupBy("term").agg(F.max(action).alias("action"))


def with_terms(rows: DataFrame, hidden: DataFrame, text_col: str) -> DataFrame:
    """_row, _spans, the text and ``_terms`` of documents with base spans or revealing terms: the places of such terms outside the spans."""
    chosen = (
        rows.select("_row", F.explode(terms_of(F.col(text_col))).alias("term"))
        .join(told_if_small(hidden, "term", TOLD_BYTES), "term")
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("_hide"))
    )
    text = F.coalesce(F.col(text_col), F.lit("")).alias("_ptext")
    step = rows.select("_row", "_spans", text).join(chosen, "_row", "left").filter((F.size("_spans") > 0) | F.col("_hide").isNotNull())
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.map_keys("_hide"), "|"), F.lit(r")(?!\p{L})"))
    spans = F.transform(
        located(F.col("_ptext"), pattern, TERM, len(KINDS)),
        lambda x: F.struct(x.k, x.kind, x.s, x.e, x.v, F.element_at(F.col("_hide"), F.lower(x.v)).alias("action")),
    )
    apart = F.filter("_all", lambda x: ~F.exists("_spans", lambda b: (x.s < b.e) & (b.s < x.e)))
    empty = F.array().cast("array<struct<k:int,kind:string,s:int,e:int,v:string,action:string>>")
    step = step.withColumn("_all", F.when(F.col("_hide").isNotNull(), spans).otherwise(empty))
    return step.withColumn("_terms", apart).drop("_hide", "_all")


def find_personal(
    docs: DataFrame, text_col: str = "text", rule: Disclosure = Disclosure()
) -> tuple[DataFrame, DataFrame]:
    """Stored rows of all documents with ``_row`` and ``_spans``, and those with personal data or revealing terms with ``_terms``."""
    # Nothing is dealt out before the write, and the numbers hold once they are stored.
    numbered = base_spans(docs, text_col).withColumns({"_row": F.monotonically_increasing_id(), "_th": F.xxhash64(text_col)})
    rows = stage_table(numbered, "pii-rows")
    hidden = stage_table(revealing(rows, max(1, rows.count()), rule, text_col), "pii-terms-hidden")
    return rows, with_terms(rows, hidden, text_col)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")


def personal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Disclosure = Disclosure()) -> DataFrame:
    """Counts and span digests per document.

    A null or empty text has no spans. A null id stays null, and repeated rows
    each get a row. Matches that fail their check are dropped without a retry.
    """
    rows, found = find_personal(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", rule)
    extra = found.select("_row", F.transform("_terms", lambda x: x.dropFields("action")).alias("_terms")).filter(F.size("_terms") > 0)
    step = rows.select("doc_id", "_row", "_spans").join(extra, "_row", "left")
    base = span_text(F.col("_spans"))
    terms = F.coalesce(span_text(F.col("_terms")), F.lit(""))
    counts = [count_of(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    return step.select(
        "doc_id",
        *counts,
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.filter(F.array(base, terms), lambda x: x != ""), ",").alias("spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced: entities by their kind, terms by their shape or by nothing.

    Spans that overlap become one, named by the first.
    """
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x.s, x.e, x.kind, x.action, x.v)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        label = F.when(x.kind != TERM, F.concat(F.lit("["), F.upper(x.kind), F.lit("]"))).when(
            x.action == "generalise", F.lit("[WORD]")
        )
        gap = F.substring(text, acc.at + 1, F.greatest(x.s - acc.at, F.lit(0)))
        new = F.when(x.s >= acc.at, F.array(gap, F.coalesce(label, F.lit("")))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc.at, x.e).alias("at"), F.concat(acc.out, new).alias("out"))

    done = F.aggregate(ordered, start, step)
    return F.concat(F.array_join(done.getField("out"), ""), F.substring(text, done.getField("at") + 1, F.length(text)))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Disclosure = Disclosure()) -> DataFrame:
    """``docs`` with the text of documents that hold personal data rewritten; others pass unchanged."""
    inner, restored = shielded(docs, id_col, text_col)
    rows, found = find_personal(inner, "text", rule)
    spans = F.concat(
        F.transform("_spans", lambda x: x.withField("action", F.lit("remove"))),
        F.col("_terms"),
    )
    # A row without a clean text keeps its own, also a null.
    clean = found.select("_row", masked(F.col("_ptext"), spans).alias("_clean"))
    return restored(rows.join(clean, "_row", "left").withColumn("text", F.coalesce("_clean", "text")))
