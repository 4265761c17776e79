"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document. The ledger keeps its measurements and one integer whose
bit r says that rule r failed. A policy is a mask of the rules that reject, so a new policy, the
comparison of two policies or an ablation reads the ledger and never the texts.

Defined cases: a NULL or empty text has no words and fails ``few_words``. An empty table gives an
empty ledger. Repeated rows are judged one by one. Columns of the input beside the id and the text
play no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.text import GAP, fresh, let, words

#: Bit of each rule, in order, and the test of the measurements that fails it.
RULES: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("few_words", lambda m: m["n_words"] < 50),
    ("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    ("capitals", lambda m: 100 * m["n_upper"] > 30 * m["word_chars"]),
    ("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    ("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"])),
)
BIT = {name: 1 << r for r, (name, _) in enumerate(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rejecting rules."""

    name: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
STANDARD = Policy("standard-1", tuple(BIT))


def repeated_words(word: Column) -> Column:
    """How many words lie in a three-word window that the array has twice or more.

    Window hashes are sorted with their positions, so equal windows are neighbours: n log n for a text
    of n words. A repeated window at position p covers words p to p + 2.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(word) - 3), lambda i: F.xxhash64(word[i], word[i + 1], word[i + 2]))

    def covered(placed: Column) -> Column:
        same = lambda e, i: F.coalesce(F.get(placed, i)["h"] == e["h"], F.lit(False))
        starts = F.sort_array(F.transform(
            F.filter(placed, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("total"), F.lit(-3).alias("last")),
            lambda a, p: F.struct((a["total"] + F.least(F.lit(3), p - a["last"])).alias("total"), p.alias("last")),
            lambda a: a["total"])

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, covered))

    return F.when(F.size(word) < 3, F.lit(0)).otherwise(let(hashes, counted))


def measures(text: Column) -> Column:
    """A struct of MEASURES (all BIGINT)."""
    filled = F.coalesce(text, F.lit(""))
    kept = lambda pattern: F.length(F.regexp_replace(filled, pattern, ""))
    lines = F.filter(F.split(filled, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeats")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("repeats")))
    return let(F.struct(of_words.alias("w"), of_lines.alias("x")), lambda m: F.struct(*[c.cast("long").alias(n) for n, c in zip(MEASURES, (
        m["w"]["n"], kept(GAP), F.length(filled) - kept("[#*$%&|<>]+"), m["x"]["repeats"], m["w"]["repeats"],
        kept(r"\P{Lu}+"), m["x"]["n"]), strict=True)]))


def failures(measured: Column) -> Column:
    """INT whose bit r says that rule r failed."""
    bits = [F.when(test(measured), F.lit(1 << r)).otherwise(F.lit(0)) for r, (_, test) in enumerate(RULES)]
    return reduce(Column.bitwiseOR, bits)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, MEASURES and ``fail_bits``. One projection, no shuffle."""
    judged = let(measures(F.col(text_col)), lambda m: F.struct(*[m[c].alias(c) for c in MEASURES], failures(m).alias("fail_bits")))
    return docs.select(F.col(id_col), judged.alias("__judged")).select(id_col, "__judged.*")


def passes(fail_bits: Column, policy: Policy) -> Column:
    return fail_bits.bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(book: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The ledger with ``kept`` under the policy."""
    return book.withColumn("kept", passes(F.col("fail_bits"), policy))


def ablations(book: DataFrame, policies: tuple[Policy, ...] = (BASE, STANDARD)) -> DataFrame:
    """Per policy and rule: documents that fail the rule, that fail nothing else, and that stay without the rule.

    Documents are first counted by bit pattern (at most 2^rules rows a task); every figure is a sum over patterns.
    """
    patterns = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = ", ".join(
        f"named_struct('policy', '{p.name}', 'rule', '{r}', 'bit', {BIT[r]}, 'mask', {p.mask}, 'rest', {p.mask & ~BIT[r]})"
        for p in policies for r in p.rules)
    return (patterns.selectExpr("fail_bits", "n", f"inline(array({cases}))").groupBy("policy", "rule").agg(
        F.expr("sum(if(fail_bits & bit != 0, n, 0))").alias("n_fail"),
        F.expr("sum(if(fail_bits & bit != 0 and fail_bits & rest = 0, n, 0))").alias("n_fail_alone"),
        F.expr("sum(if(fail_bits & mask = 0, n, 0))").alias("n_kept"),
        F.expr("sum(if(fail_bits & rest = 0, n, 0))").alias("n_kept_without")))


def failures_by(book: DataFrame, *keys: str) -> DataFrame:
    """Per group: the rules that some document fails (``any_bits``) and that all fail (``all_bits``)."""
    return book.groupBy(*keys).agg(F.bit_or("fail_bits").alias("any_bits"), F.bit_and("fail_bits").alias("all_bits"),
                                   F.count(F.lit(1)).alias("n_docs"))


def filter_documents(docs: DataFrame, policy: Policy = STANDARD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with the columns of ``docs``."""
    verdict, = fresh(docs, "__passes")
    test = let(measures(F.col(text_col)), lambda m: passes(failures(m), policy))
    return docs.withColumn(verdict, test).where(F.col(verdict)).drop(verdict)
