"""Quality rules as weak supervision.

Each rule votes good or bad on a document or abstains. Expectation-maximisation
estimates from the votes alone how often each rule is right, and the posterior
probability of good quality replaces the demand that all rules pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import literal_array, shielded
from tabscope.session import stage_table

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Frequent words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that was for on with as by at from be this are an or "
    "der die das und in den von zu mit ist im des auf für nicht ein eine dem "
    "de la el que y en los se del las por un para con no una es su "
    "le les et des est dans qui du pour pas sur au une il"
).split()
GOOD, BAD, ABSTAIN = 0, 1, 2
#: The rules, in the order of their digits in a vote pattern.
RULES = (
    "length", "word_length", "symbols", "symbol_words", "symbol_share", "line_copies", "repetition", "stop_words", "line_ends",
)
ROUNDS = 60
#: Bounds of a rule's accuracy on good and on bad documents. A bad document breaks only some rules, a good
#: one hardly any; as 0.15 exceeds 1 - 0.9, a vote for bad always speaks for bad and the classes keep their sides.
ON_GOOD, ON_BAD = (0.9, 0.995), (0.15, 0.95)


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with struct ``_q``: counts of each whole text, nulls counting as empty.

    Repeated five-word windows are found by sorting the windows' hashes with
    their places, and only in texts where the hashes aren't all different.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.withColumn("_qt", text)
    step = step.withColumn("_qw", F.filter(F.split("_qt", BLANKS), lambda w: w != ""))
    step = step.withColumn("_ql", F.filter(F.split("_qt", "\n"), lambda x: F.translate(x, BLANK_CHARS, "") != ""))
    window = (
        "CASE WHEN size(_qw) < 5 THEN cast(array() AS array<bigint>) ELSE transform(slice(_qw, 1, size(_qw) - 4),"
        " (w, i) -> xxhash64(w, _qw[i + 1], _qw[i + 2], _qw[i + 3], _qw[i + 4])) END"
    )
    step = step.withColumn("_qh", F.expr(window))
    step = step.withColumn(
        "_qs",
        F.expr(
            "CASE WHEN size(_qh) = size(array_distinct(_qh)) THEN NULL"
            " ELSE array_sort(transform(_qh, (h, i) -> struct(h, i))) END"
        ),
    )
    step = step.withColumn(
        "_qp",
        F.expr(
            "sort_array(transform(filter(_qs, (s, k) -> (k > 0 AND s.h = _qs[k - 1].h)"
            " OR (k + 1 < size(_qs) AND s.h = _qs[k + 1].h)), s -> s.i))"
        ),
    )
    repeated = F.expr(
        "CASE WHEN _qp IS NULL THEN 0L ELSE aggregate(transform(_qp, (p, k) -> CASE WHEN k + 1 < size(_qp)"
        " THEN least(5, _qp[k + 1] - p) ELSE 5 END), 0L, (a, x) -> a + x) END"
    )
    words = F.size("_qw").cast("long")
    bare = F.translate("_qt", BLANK_CHARS, "")
    lines = F.size("_ql").cast("long")
    stop = F.size(F.filter("_qw", lambda w: w.isin(STOP_WORDS))).cast("long")
    symbols = F.length("_qt") - F.length(F.translate("_qt", SYMBOLS, ""))
    marked = F.when(symbols > 0, F.size(F.filter("_qw", lambda w: F.translate(w, SYMBOLS, "") != w))).otherwise(0)
    ended = F.size(F.filter("_ql", lambda x: F.rtrim(x).rlike(r"[.!?:;\"”»)]$"))).cast("long")
    return step.withColumn(
        "_q",
        F.struct(
            words.alias("n_words"),
            F.length(bare).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            (lines - F.size(F.array_distinct("_ql"))).cast("long").alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            lines.alias("n_lines"),
            marked.cast("long").alias("n_marked"),
            stop.alias("n_stop"),
            ended.alias("n_ended"),
        ),
    ).drop("_qt", "_qw", "_ql", "_qh", "_qs", "_qp")


def base_failed(q: str = "_q") -> Column:
    return (F.col(f"{q}.n_words") < 10) | (100 * F.col(f"{q}.n_repeat_words") > 20 * F.col(f"{q}.n_words"))


def votes(q: str = "_q") -> list[Column]:
    """One vote of each rule; a rule abstains where it can't tell."""
    f = lambda name: F.col(f"{q}.{name}").cast("double")
    per_word = lambda name: f(name) / F.greatest(f("n_words"), F.lit(1.0))
    per_line = lambda name: f(name) / F.greatest(f("n_lines"), F.lit(1.0))
    few = f("n_words") < 20

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    return [
        vote(f("n_words") >= 50, f("n_words") < 10),
        vote(per_word("word_chars").between(3, 12), (per_word("word_chars") < 2) | (per_word("word_chars") > 20)),
        vote(per_word("n_symbols") <= 0.02, per_word("n_symbols") > 0.1),
        vote(per_word("n_marked") <= 0.02, per_word("n_marked") > 0.1),
        vote(f("n_symbols") <= 0.005 * f("word_chars"), f("n_symbols") > 0.03 * f("word_chars")),
        vote((f("n_dup_lines") == 0) & (f("n_lines") > 1), per_line("n_dup_lines") > 0.3),
        vote((per_word("n_repeat_words") <= 0.05) & ~few, per_word("n_repeat_words") > 0.2),
        vote((per_word("n_stop") >= 0.06) & ~few, (per_word("n_stop") < 0.005) & ~few),
        vote(per_line("n_ended") >= 0.6, (per_line("n_ended") < 0.1) & (f("n_lines") > 2)),
    ]


def pattern(q: str = "_q") -> Column:
    """All votes as one number in base 3, the first rule's digit last."""
    out = F.lit(0)
    for k, vote in enumerate(votes(q)):
        out = out + vote * (3**k)
    return out.cast("int")


@dataclass(frozen=True)
class RuleModel:
    """Share of good documents, each rule's accuracy on good and on bad ones, posterior by pattern."""

    prior: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]
    posterior: tuple[float, ...]


def fit_rules(counts: dict[int, int], n_rules: int = len(RULES), rounds: int = ROUNDS) -> RuleModel:
    """Expectation-maximisation over the counts of vote patterns, at most 3 ** n_rules of them.

    Accuracies stay within ``ON_GOOD`` and ``ON_BAD``. Without rows, the start
    values give the posteriors.
    """
    digits = {p: [(p // 3**k) % 3 for k in range(n_rules)] for p in range(3**n_rules)}
    prior, good, bad = 0.85, [0.97] * n_rules, [0.5] * n_rules

    def posterior(p: int) -> float:
        odds = math.log(prior) - math.log(1 - prior)
        for v, g, b in zip(digits[p], good, bad, strict=True):
            if v == GOOD:
                odds += math.log(g) - math.log(1 - b)
            elif v == BAD:
                odds += math.log(1 - g) - math.log(b)
        return 1 / (1 + math.exp(-max(-500, min(500, odds))))

    held = lambda x, bounds: min(bounds[1], max(bounds[0], x))
    for _ in range(rounds if counts else 0):
        share = {p: posterior(p) for p in counts}
        total = sum(counts.values())
        prior = min(0.99, max(0.01, sum(n * share[p] for p, n in counts.items()) / total))
        for k in range(n_rules):
            # One vote of each class is added, so that silent rules keep a defined accuracy.
            hit = {GOOD: [0.97, 0.5], BAD: [0.03, 0.5]}
            for p, n in counts.items():
                if (v := digits[p][k]) != ABSTAIN:
                    hit[v][0] += n * share[p]
                    hit[v][1] += n * (1 - share[p])
            good[k] = held(hit[GOOD][0] / (hit[GOOD][0] + hit[BAD][0]), ON_GOOD)
            bad[k] = held(hit[BAD][1] / (hit[GOOD][1] + hit[BAD][1]), ON_BAD)
    return RuleModel(prior, tuple(good), tuple(bad), tuple(posterior(p) for p in range(3**n_rules)))


def judge(scored: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, RuleModel]:
    """``scored`` (a stored frame with ``_q``) with ``_p`` (posterior) and ``_kept``.

    The votes are counted by pattern first, so only the patterns' counts reach
    the driver. Texts that fail the base rules are not kept whatever the posterior.
    """
    counted = scored.groupBy(pattern().alias("p")).count().collect()
    model = fit_rules({r["p"]: r["count"] for r in counted})
    table = literal_array((f"{x:.9f}" for x in model.posterior), "double")
    out = scored.withColumn("_p", F.element_at(table, pattern() + 1))
    return out.withColumn("_kept", ~base_failed() & (F.col("_p") >= threshold)), model


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, posterior and verdict per document.

    A null or empty text has no words and fails the base rules; a null id stays
    null; repeated rows each get the same verdict; no rows give no rows.
    """
    scored = features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    out, _ = judge(stage_table(scored, "quality"))
    return out.select(
        "doc_id",
        *(f"_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed().alias("base_failed"),
        F.col("_kept").alias("kept"),
        F.col("_p").alias("posterior"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    inner, restored = shielded(docs, id_col, text_col)
    judged, _ = judge(stage_table(features(inner), "quality-rows"))
    return restored(judged.filter("_kept"))
