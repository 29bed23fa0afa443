"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one failure bit per rule, written to a table (:func:`store`, or the shared
folder); policies are named, versioned bit masks that are applied to the
stored bits, and ablations are bitwise aggregations over them. Nothing is
measured again when a policy changes.

Everything here is a DataFrame expression over a whole text; no shuffle is
needed to build the ledger.

Defined results: a null text counts as empty (no words); ties and repeated
rows are judged alike, row by row; a null ``doc_id`` stays null; an empty
table gives an empty ledger; other columns are ignored by ``ledger`` and
passed through unchanged by ``keep``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mkpulse.llm.common import bind, packed, text_of, words
from mkpulse.sinks import write_partition

WHITE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the same text.

    Windows are compared inside the row. Most texts repeat no window, which a
    distinct count of the 64-bit window hashes shows. For the others each hash
    gives its low bits to the window's place, the numbers are sorted, and
    neighbours of equal hash are compared word by word, so no hash collision
    makes a repeat; one that fell between two equal windows could part them,
    which a million words meet with a chance of about 10^-7. n log n for any
    text, no pairs, no shuffle.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                         lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def of(h: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(h)))) - 1
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(low, lambda m: bind(
            F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long")))),
            lambda s: covered(s, m))))

    def covered(s: Column, low: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            p, q = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
            equal = a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(low)) == 0
            for k in range(3):
                equal = equal & (F.get(w, p + k) == F.get(w, q + k))
            return equal

        twice = F.filter(s, lambda x, i: same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x))
        return bind(F.transform(twice, lambda x: x.bitwiseAND(low)), lambda p: F.size(F.array_union(
            F.array_union(p, F.transform(p, lambda x: x + 1)), F.transform(p, lambda x: x + 2))))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(bind(hashes, of)).cast("long")


def measurements(text: Column) -> Column:
    """Struct of all measurements of one text."""
    def of(w: Column) -> Column:
        # NUL-free joins: only lengths are read from them
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                        F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)).cast("long").alias("longest_word"),
                        repeat_words(w).alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = bind(words(text), of)
    by_lines = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                              (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long")
    return F.struct(by_words.alias("w"), by_lines.alias("l"), symbols.alias("n_symbols"), capitals.alias("n_capitals"))


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements; its bit is its place in ``RULES``."""
    name: str
    sql: str


#: The order is the ledger's format: a rule keeps its bit for good, new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("endless_word", "longest_word > 1000"),
    Rule("capitals", "100 * n_capitals > 60 * word_chars"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}


def mask_of(*names: str) -> int:
    return sum(BIT[n] for n in names)


BASE = mask_of("few_words", "repeated_windows")
#: Versioned policies: the bits that reject a document.
POLICIES = {
    "base": BASE,
    "v1": BASE | mask_of("symbols", "duplicate_lines"),
    "v2": mask_of(*BIT),
}
CURRENT = "v2"


def ledger(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: bool = False) -> DataFrame:
    """One row per document: id, measurements and ``failed_bits``.

    ``carry`` keeps the whole input row in a struct column ``row``.
    """
    m = packed(docs).select("row", measurements(text_of(F.col("row")[text])).alias("m"))
    flat = m.select(*(["row"] if carry else []), F.col("row")[doc_id].alias("doc_id"), "m.w.*", "m.l.*",
                    "m.n_symbols", "m.n_capitals")
    bits = None
    for r in RULES:
        bit = F.when(F.expr(r.sql), F.lit(BIT[r.name])).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return flat.withColumn("failed_bits", bits.cast("long"))


#: Version of the rules: the number of them, since a rule keeps its bit for good.
VERSION = len(RULES)


def store(led: DataFrame, path: str) -> None:
    """Put a ledger into the table at ``path``, in place of what it holds for this version of the rules."""
    write_partition(led, path, "rules_version", VERSION)


def stored(spark: SparkSession, path: str, version: int = VERSION) -> DataFrame:
    """The ledger of one version of the rules; policies of that version apply to its bits."""
    return spark.read.parquet(path).where(F.col("rules_version") == version).drop("rules_version")


def rejects(policy: str, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy])) != 0


def apply_policy(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``; a base failure rejects under every policy."""
    return led.withColumns({"base_failed": rejects("base"), "kept": ~rejects("base") & ~rejects(policy)})


def verdicts(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A stored ledger with the verdict of every policy (``kept_<name>``, and ``base_failed`` and ``kept`` of ``policy``),
    and the ablation seen from the row: ``sole_rule`` is the rule that alone rejects it under ``policy``, ``sole_rule_total``
    how many documents that rule alone rejects, which a policy without it would keep."""
    every = led.withColumns({f"kept_{p}": ~rejects("base") & ~rejects(p) for p in POLICIES})
    hit = F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy]))
    sole = F.lit(None).cast("string")
    for r in RULES:
        sole = F.when(hit == BIT[r.name], F.lit(r.name)).otherwise(sole)
    own = ablations(led, (policy,)).where("rule IS NOT NULL").agg(F.map_from_arrays(F.collect_list("rule"), F.collect_list("n_only")).alias("m"))
    return apply_policy(every, policy).withColumn("sole_rule", sole).withColumn("sole_rule_total", F.try_element_at(own.scalar(), F.col("sole_rule")))


def ablations(led: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """For each policy and rule in it: documents failing the rule, and documents
    rejected by this rule alone, which removing it from the policy would keep.

    The documents are first counted by ``failed_bits`` (at most 2^rules rows),
    then everything is read from those counts.
    """
    counts = led.groupBy("failed_bits").agg(F.count("*").alias("n"))
    aggs = []
    for p in policies:
        hit = F.col("failed_bits").bitwiseAND(F.lit(POLICIES[p]))
        aggs.append(F.struct(F.lit(p).alias("policy"), F.lit(None).cast("string").alias("rule"),
                             F.coalesce(F.sum(F.when(hit != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
                             F.coalesce(F.sum(F.when(F.bit_count(hit) == 1, F.col("n"))), F.lit(0)).alias("n_only")))
        for r in RULES:
            if POLICIES[p] & BIT[r.name]:
                aggs.append(F.struct(
                    F.lit(p).alias("policy"), F.lit(r.name).alias("rule"),
                    F.coalesce(F.sum(F.when(hit.bitwiseAND(F.lit(BIT[r.name])) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
                    F.coalesce(F.sum(F.when(hit == BIT[r.name], F.col("n"))), F.lit(0)).alias("n_only")))
    return counts.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def keep(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that pass, columns unchanged."""
    return apply_policy(ledger(docs, carry=True), policy).where("kept").select("row.*")
