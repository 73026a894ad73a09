"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once per document and stores the measurements and one failure bit per
rule. Policies are versioned masks over those bits: `apply_policy` needs no text, and `ablation`
counts from grouped masks what each rule of a policy removes, alone and with others.

All of it is row-wise DataFrame expressions; the only shuffle is ablation's, of at most one row per
mask and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space between words, and the characters that count as symbols.
BLANKS = " \t\n\x0b\f\r"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

WINDOW = 8

#: Name of each rule and when it fails, over the measurements of `measure`; a rule's bit is its place.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("shouting", "2 * n_upper > word_chars"),
    ("long_words", "word_chars > 40 * n_words"),
    ("short_words", "2 * word_chars < 3 * n_words"),
    ("exclamations", "2 * n_exclaims > n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Version -> names of the rules that reject a document.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "repeated_lines"],
    "v2": [name for name, _ in RULES],
}


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _lack(text: Column, chars: str) -> Column:
    """How many characters of `text` are among `chars`."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the measurements of each whole text (null: none), all long."""
    t = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    w = t.select(
        id_col,
        F.filter(F.split("__t", WORD_BREAK), lambda x: x != "").alias("__w"),
        F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("__l"),
        (F.length("__t") - _lack(F.col("__t"), BLANKS)).cast("long").alias("word_chars"),
        _lack(F.col("__t"), SYMBOLS).cast("long").alias("n_symbols"),
        F.regexp_count("__t", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        _lack(F.col("__t"), "!").cast("long").alias("n_exclaims"),
    )
    keep = ["word_chars", "n_symbols", "n_upper", "n_exclaims"]
    h = w.select(
        id_col,
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        "__w",
        F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"),
    )
    keep += ["n_words", "n_lines", "n_dup_lines"]
    # One hash per window of words; a repeat by hash is confirmed on the words below.
    win = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("__w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__h", i, WINDOW))))
    x = h.select(id_col, *keep, "__w", win.alias("__x"))
    twice = F.size(F.array_distinct("__x")) < F.size("__x")
    s = x.select(
        id_col,
        *keep,
        "__w",
        F.when(twice, F.sort_array(F.transform("__x", lambda v, i: F.struct(v.alias("v"), (i + 1).alias("i"))))).alias("__s"),
    )

    def same(a: Column, b: Column) -> Column:
        return (a["v"] == b["v"]) & (F.slice("__w", a["i"], WINDOW) == F.slice("__w", b["i"], WINDOW))

    def at(j: Column) -> Column:
        return F.element_at("__s", j)

    n = F.size("__s")
    hit = F.transform(
        F.sequence(F.lit(1), n),
        lambda j: F.when(((j > 1) & same(at(j), at(F.greatest(j - 1, F.lit(1))))) | ((j < n) & same(at(j), at(F.least(j + 1, n)))), at(j)["i"]),
    )
    p = s.select(id_col, *keep, F.when(F.col("__s").isNotNull(), F.sort_array(F.filter(hit, lambda v: v.isNotNull()))).alias("__p"))
    covered = F.aggregate(
        "__p",
        F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda a, v: F.struct((a["sum"] + F.least(F.lit(WINDOW), v - a["last"])).alias("sum"), v.alias("last")),
        lambda a: a["sum"],
    )
    return p.select(id_col, *keep, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the measurements and `failed`, the bits of the rules that the document fails.

    Null and empty texts have no words and fail few_words. Very long texts are measured as a whole, word by
    word in arrays of one row. Rows repeated in `docs` are repeated here; no measure depends on their order.
    An empty table gives an empty ledger. Columns of `docs` besides the two named aren't read.
    """
    bits = None
    for i, (_, rule) in enumerate(RULES):
        bit = F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs, id_col, text_col).withColumn("failed", bits.cast("long"))


def apply_policy(led: DataFrame, policy: str) -> DataFrame:
    """The ledger with `kept`: no rule of the policy failed."""
    return led.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(led: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """Per policy and rule: documents that fail it, that only it removes, and that the policy keeps without it.

    Computed from counts by mask, of which there are at most two to the number of rules.
    """
    masks = led.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    cases = [(p, name, mask(p), BIT[name]) for p in policies or POLICIES for name in POLICIES[p]]
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(name).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for p, name, m, b in cases]))
    hit = masks.select("failed", "n", rows.alias("c")).select("n", "c.policy", "c.rule", F.expr("failed & c.mask").alias("of"), "c.bit")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    return hit.groupBy("policy", "rule").agg(
        total(F.col("of").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        total(F.col("of") == F.col("bit"))("n_only"),
        total(F.col("of") == 0)("n_kept"),
        total((F.col("of") == 0) | (F.col("of") == F.col("bit")))("n_kept_without"),
    )
