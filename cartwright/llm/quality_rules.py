"""Quality rules as a ledger: measurements and one failure bit per rule, judged by policies later.

Every rule is evaluated once. A policy is a version and the mask of the rules it enforces, so a new
policy, or the effect of leaving a rule out, is read from the bits without reading the texts again.
Everything is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = r"[\x20\x09-\x0D]"
IN_WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
#: Finds candidates only; which windows are equal is told from their words.
WINDOW_HASH = "xxhash64({})"


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; ``bit`` never changes its meaning."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 20 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
)
#: The two rules that every policy has.
BASE = ("few_words", "repeated_words")
POLICIES = (
    Policy("base", BASE),
    Policy("symbols", (*BASE, "symbols")),
    Policy("full", tuple(r.name for r in RULES)),
)
CURRENT = "full"
MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[n] for n in set(names))


def _repeated_words() -> tuple[str, str, str, str]:
    """Words in 5-word windows that occur twice or more, from columns words, n_words and bits.

    Window hashes and their starts share a 64-bit value: the start in the low ``bits`` bits, as many
    as the text needs, the hash above. Sorted, windows of one hash are neighbours; those without a
    neighbour of their hash occur once. The others are sorted by their words, so equal windows stand
    together however many different ones share a hash. The covered words follow from the gaps between
    the starts.
    """
    words = ", ".join(f"words[i + {k}]" for k in range(WINDOW))
    place = "(1L << bits) - 1"

    def near(step: int) -> str:
        return f"((x >>> bits) <=> (get(hashes, j + {step}) >>> bits))"

    def same(step: int) -> str:
        return f"(x.win <=> get(alike, j + {step}).win)"

    hashes = f"sort_array(transform(sequence(0, n_words - {WINDOW}), i -> {WINDOW_HASH.format(words)} << bits | i))"
    alike = (
        f"sort_array(transform(filter(hashes, (x, j) -> {near(-1)} OR {near(1)}), "
        f"x -> struct(slice(words, int(x & {place}) + 1, {WINDOW}) AS win, x & {place} AS start)))"
    )
    starts = f"sort_array(transform(filter(alike, (x, j) -> {same(-1)} OR {same(1)}), x -> x.start))"
    covered = f"aggregate(transform(starts, (p, k) -> least({WINDOW}L, get(starts, k + 1) - p)), 0L, (a, x) -> a + x)"
    return hashes, alike, starts, covered


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and fail_bits of every row of ``docs``.

    Words are runs outside ``[\\x20\\x09-\\x0D]``; a null text has none, like an empty one, and fails
    ``few_words`` alone. Lines are what ``\\n`` separates and holds a word. Equal rows give equal
    rows; other columns are left out; an empty table gives an empty one. There is no shuffle.
    """
    text = F.coalesce("text", F.lit(""))
    trimmed = F.regexp_replace(text, rf"\A{SEPARATOR}+|{SEPARATOR}+\z", "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(IN_WORD))
    hashes, alike, starts, covered = _repeated_words()
    enough = F.col("n_words") >= WINDOW
    read = (
        docs.select("doc_id", text.alias("text"), trimmed.alias("trimmed"), lines.alias("lines"))
        .select(
            "doc_id", "text", "lines",
            F.when(F.col("trimmed") != "", F.split("trimmed", rf"{SEPARATOR}+"))
            .otherwise(F.array().cast("array<string>")).alias("words"),
        )
        .withColumn("n_words", F.size("words"))
        .withColumn("bits", F.length(F.bin("n_words")))
        .withColumn("hashes", F.when(enough, F.expr(hashes)).otherwise(F.array().cast("array<bigint>")))
        .withColumn("alike", F.expr(alike))
        .withColumn("starts", F.expr(starts))
    )
    measured = read.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
    )
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def passes(version: str, policies: tuple[Policy, ...] = POLICIES) -> Column:
    """Whether a ledger row passes a policy."""
    policy = next(p for p in policies if p.version == version)
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy.rules))) == 0


def ablations(
    rows: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Per policy and rule of it: documents that fail the rule, that fail no other rule of the
    policy and so return without it, and that the policy keeps.

    The ledger is first counted by its bits, at most ``2 ** len(rules)`` rows; the rest is bit
    operations on those.
    """
    enforced = [
        F.struct(
            F.lit(p.version).alias("policy"), F.lit(r.name).alias("rule"),
            F.lit(mask(p.rules)).cast("long").alias("mask"), F.lit(1 << r.bit).cast("long").alias("bit"),
        )
        for p in policies for r in rules if r.name in p.rules
    ]
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    under = F.col("fail_bits").bitwiseAND(F.col("mask"))

    def total(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    return patterns.select("fail_bits", "n", F.inline(F.array(*enforced))).groupBy("policy", "rule").agg(
        total(under.bitwiseAND(F.col("bit")) != 0, "n_fail"),
        total(under == F.col("bit"), "n_only"),
        total(under == 0, "n_kept"),
    )
