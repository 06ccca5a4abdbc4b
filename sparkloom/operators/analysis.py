"""Token analytics: frequencies, anomalies, comparisons, merges."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Types whose tokens are what they look like.
TRUSTED = ("ABBREV", "ABBREV-I", "ABBREV-P", "ABBREV-PP", "BBCode", "DECONTRACTION", "EMAIL-ADDRESS", "FILENAME", "HANDLE", "HASHTAG", "IPA", "SYMBOL", "URL", "XML")


#: Languages whose words hold apostrophes.
APOSTROPHE = ("asm", "heb", "som", "tgl")


def frequency(tokens: DataFrame, *keys: str) -> DataFrame:
    """A1: how often each surface occurs."""
    return tokens.groupBy(*keys, "surf").agg(F.count("*").alias("n"))


def top(counts: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k most frequent surfaces of each key; equal counts in the order of the surface."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "surf")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _suspects(tokens: DataFrame) -> DataFrame:
    return tokens.where(~F.col("type").isin(*TRUSTED)) if "type" in tokens.columns else tokens


def case_anomaly(tokens: DataFrame) -> DataFrame:
    """A2: a capital behind a small letter, but for Mac and Mc names."""
    return _suspects(tokens).where(F.col("surf").rlike(r"\p{Ll}\p{Lu}") & ~F.col("surf").rlike(r"^(?:Mac|Mc)\p{Lu}\p{Ll}+$"))


def punct_anomaly(tokens: DataFrame) -> DataFrame:
    """A3: letters and punctuation in one token, but for initials, 'n', entities of quotes, and apostrophes in languages that spell with them."""
    s = F.col("surf")
    found = _suspects(tokens).where(s.rlike(r"\p{L}") & s.rlike(r"\p{P}") & ~s.rlike(r"^(?:\p{L}\.|'n'|&quot;)$"))
    spelt = F.col("lang").isin(*APOSTROPHE) & s.rlike(r"^['’]?[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*['’]?$") if "lang" in tokens.columns else F.lit(False)
    return found.where(~F.coalesce(spelt, F.lit(False)))


def number_anomaly(tokens: DataFrame) -> DataFrame:
    """A4: letters and numbers in one token."""
    return _suspects(tokens).where(F.col("surf").rlike(r"\p{L}") & F.col("surf").rlike(r"\p{N}"))


def period_anomaly(tokens: DataFrame, share: float = 0.4) -> DataFrame:
    """A5: short words that a period follows in so large a share of their occurrences; tokens has next_surf."""
    s = F.col("surf")
    short = tokens.where((F.length("surf") <= 4) & s.rlike(r"^\p{L}+$"))
    return short.groupBy("surf").agg(F.count("*").alias("total"), F.sum(F.col("next_surf").startswith(".").cast("bigint")).alias("n")).where(F.col("n") >= share * F.col("total"))


def neighbours(tokens: DataFrame, *line: str, order: str = "tok_no") -> DataFrame:
    """The surfaces before, before that, and after."""
    w = Window.partitionBy(*line).orderBy(order)
    return tokens.withColumns({"prev_surf": F.lag("surf", 1).over(w), "prev2_surf": F.lag("surf", 2).over(w), "next_surf": F.lead("surf", 1).over(w)})


def around_numbers(tokens: DataFrame, side: str) -> DataFrame:
    """What stands before (with the surface before that, as second) or after numbers and isn't a word; digits are masked. tokens has the neighbours."""
    near = F.col("prev_surf" if side == "before" else "next_surf")
    masked = lambda c: F.regexp_replace(c, r"[0-9]", "d")
    odd = tokens.where(F.col("surf").rlike(r"^[0-9]") & near.isNotNull() & ~near.rlike(r"^\p{L}+$"))
    second = masked(F.coalesce("prev2_surf", F.lit(""))) if side == "before" else F.lit("")
    return odd.select(second.alias("second"), masked(near).alias("near"), masked("surf").alias("number")).groupBy("second", "near", "number").agg(F.count("*").alias("n"))


def ranked(anomalies: DataFrame, location: str, shown: int = 10, most: int = 12) -> DataFrame:
    """Anomalies with their count and locations: all of them up to ``most``, else the first ``shown`` (and more is true). No more are gathered."""
    w = Window.partitionBy("surf").orderBy(location)
    first = anomalies.withColumn("i", F.row_number().over(w)).groupBy("surf").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("i") <= most, F.col(location)))).alias("locations"))
    more = F.col("n") > most
    return first.withColumns({"locations": F.when(more, F.slice("locations", 1, shown)).otherwise(F.col("locations")), "more": more})


def in_rank_order(found: DataFrame) -> DataFrame:
    """The most frequent first; equal counts by their lower-cased surface."""
    return found.orderBy(F.desc("n"), F.lower("surf"), "surf")


def line_diff(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """A10: lines of both (keys, text) that differ; lines that only one side has don't count."""
    return a.select(*keys, F.col("text").alias("before")).join(b.select(*keys, F.col("text").alias("after")), list(keys)).where(~F.col("before").eqNullSafe(F.col("after")))


def block_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines (block, text) that only one side of a block has, and how often more than the other."""
    n = lambda x, name: x.groupBy("block", "text").agg(F.count("*").alias(name))
    both = n(a, "before").join(n(b, "after"), ["block", "text"], "full_outer").fillna(0, ["before", "after"])
    return both.where("before <> after")


def block_context(a: DataFrame, b: DataFrame, around: int = 3) -> DataFrame:
    """(block, diff) of blocks (block, line_no, text) that differ: lines with - or +, and ``around`` unchanged ones near them. A block is held as a whole."""

    def compared(key, left: pa.Table, right: pa.Table) -> pa.Table:
        old, new = (t.sort_by("line_no").column("text").to_pylist() for t in (left, right))
        lines = list(difflib.unified_diff(old, new, n=around, lineterm=""))[2:]
        return pa.table({"block": pa.array([key[0].as_py()] * bool(lines), pa.string()), "diff": pa.array(["\n".join(lines)] * bool(lines), pa.string())})

    keyed = lambda x: x.select(F.col("block").cast("string").alias("block"), "line_no", F.coalesce("text", F.lit("")).alias("text")).groupBy("block")
    return keyed(a).cogroup(keyed(b)).applyInArrow(compared, "block string, diff string")


#: What merged rules are ordered by, behind the kind.
RULE_ORDER = ("sem_class", "taxon", "token_category", "tag", "etym", "problem", "head", "target")


def merge_rules(anchor: DataFrame, new: DataFrame) -> DataFrame:
    """Both rule tables (kind, head, target, and any of RULE_ORDER); rows that only the new one has are disabled, but for misspellings."""
    keys = ["kind", "head", "target"]
    more = [c for c in RULE_ORDER if c not in keys and c in anchor.columns and c in new.columns]
    a = anchor.select(*keys, *(F.col(c).alias(f"{c}_a") for c in more), F.lit(True).alias("old"))
    b = new.select(*keys, *(F.col(c).alias(f"{c}_b") for c in more), F.lit(True).alias("fresh"))
    both = a.join(b, keys, "full_outer")
    order = F.when(F.col("kind") == "punct-split", 1).when(F.col("kind") == "abbrev", 2).when(F.col("kind") == "contraction", 3).otherwise(4)
    return both.select(
        order.alias("priority"), *keys, *(F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in more), F.coalesce("old", F.lit(False)).alias("old"),
        F.coalesce("fresh", F.lit(False)).alias("fresh"), (F.col("old").isNull() & (F.col("kind") != "misspelling")).alias("disabled"),
    )


def in_rule_order(merged: DataFrame) -> DataFrame:
    """Merged rules by priority and then by all of RULE_ORDER that they have."""
    return merged.orderBy("priority", *(F.coalesce(F.lower(c), F.lit("")) for c in RULE_ORDER if c in merged.columns))


def rule_text(merged: DataFrame) -> DataFrame:
    """The lines of a rule file, disabled rules as comments."""
    slot = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f" ::{c.replace('_', '-')} "), F.col(c))).otherwise(F.lit(""))
    more = [c for c in ("target", *RULE_ORDER[:6]) if c in merged.columns]
    return in_rule_order(merged).select(F.concat(F.when(F.col("disabled"), F.lit("# ")).otherwise(F.lit("")), F.lit("::"), "kind", F.lit(" "), "head", *map(slot, more)).alias("value"))


def longest_matches(words: DataFrame, rules: DataFrame, most: int, *line: str) -> DataFrame:
    """C11 in relational form: word n-grams that are rule heads, the longest at each start, then the first rule.

    words has the line's words as an array; heads of up to ``most`` words are found."""
    at = words.select(*line, F.posexplode("words").alias("start", "_w"), "words")
    grams = at.select(*line, "start", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("words") - F.col("start"))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("words", F.col("start") + 1, n), " ").alias("gram")))).alias("g"))
    found = grams.select(*line, "start", "g.n", F.lower("g.gram").alias("head_lc"), "g.gram").join(F.broadcast(rules) if _small(rules) else rules, "head_lc")
    w = Window.partitionBy(*line, "start").orderBy(F.desc("n"), "rule_no")
    return found.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def _small(df: DataFrame, limit: int = 8 << 20, most: int = 50_000) -> bool:
    """Whether the optimizer's estimate allows a broadcast. Tables of the driver's rows have no estimate; then no more than ``most`` rows are counted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= limit or size >= 1 << 62 and df.limit(most + 1).count() <= most


_QUOTE, _SIDES = "['’]", "(?= |$)"
#: Marks that may have signs of where they were attached; the first group may repeat.
_MARKED = "(?:" + "|".join(["(?:" + "|".join(f"{c}+" for c in ("'", "’", "-", "–", "—", '"', "‘", r"\+")) + ")", "[:*_”“~/`]|‘’", r"\.{2,}", "&quot;"]) + ")"
_NOT = "(are|could|did|do|does|had|has|have|is|shall|should|was|were|will|would)"
#: What tokenizers cut or mark in different ways, in order, over lines with a space at either end.
BOOST_TOKENS = [
    (r"([!?‹›]) (?=\1 )", "$1"), (f" @({_MARKED}@?){_SIDES}", " $1"), (f" ({_MARKED})@{_SIDES}", " $1"), (f" ({_QUOTE}) ({_QUOTE}){_SIDES}", " $1$2"),
    (f"(?i) ({_QUOTE}) (d|ll|m|re|s|ve)\\b", " $1$2"), (f"(?i)\\b{_NOT}n ({_QUOTE})t\\b", "$1 n$2t"), (f"(?i)\\bca n({_QUOTE})t\\b", "can n$1t"), (f"(?i)\\bcan ({_QUOTE})t\\b", "can n$1t"),
    (f"(?i)\\bwo n({_QUOTE})t\\b", "will n$1t"), (f"(?i)\\bwon ({_QUOTE})t\\b", "will n$1t"), (r"(?i)\b(can)(not)\b", "$1 $2"), (r"(?i) @-@ (in) @-@ (law)\b", "-$1-$2"), (f"(?i)\\b(d|l|n|s) +({_QUOTE})([\\p{{L}}0-9])", "$1$2 $3"),
]
#: What detokenizers attach in different ways, in order.
BOOST_TEXT = [
    *((chr(code), c) for code, c in ((0x99, "™"), (0x91, "‘"), (0x92, "’"), (0x94, "”"), (0x93, "“"), (0x96, "–"), (0x97, "—"))),
    ("(?: |\t|&#160;)+", " "), (r" +@([-:/])@ +", "$1"), (r"( [-:/])@ +", "$1"), (r" +@([-:/] )", "$1"), (r" +([.!?]) ?$", "$1 "), (r"(\p{L}\p{M}*) +([,;] +)", "$1$2"), ("(?:\u00a0|&#160;)+", " "),
    (f" ({_QUOTE})(d|em|m|re|s|ve)(?= )", "$1$2"), (r"([0-9]) (%)(?= )", "$1$2"), (r" ([$]|RMB) ([0-9])", " $1$2"), (r"(\p{L}) (:)(?= )", "$1$2"), (r" ([(“‘\[]) ", " $1"), (r" ([)!?”])", "$1"),
    (r" ([.,;।’!?]’?”?’?'?\"?\)?]?”?|!+|\?+)(?= )", "$1"), (r"(?i) (can) (not)(?= )", " $1$2"), (r" ([i’]) s(?= )", "$1s"), (r'(?i)(, ") ([a-z])', "$1$2"),
    (r"(?i)\b(are|ca|could|did|do|does|had|has|have|is|sha|should|was|were|wo|would) ?n['’]?t\b", "$1n't"),
]


def _rewritten(text, chain):
    text = F.concat(F.lit(" "), F.trim(text), F.lit(" "))
    for pattern, by in chain:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def boosted(text):
    """style differences of tokenizers undone, before tokens are compared."""
    return _rewritten(text, BOOST_TOKENS)


def boosted_text(text):
    """style differences of detokenizers undone, before texts are compared."""
    return _rewritten(text, BOOST_TEXT)


def versions(spark, path: str) -> list[str]:
    """The versions kept under a path, the oldest first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath().getName()[1:] for x in fs.listStatus(place) if x.getPath().getName().startswith("v")] if fs.exists(place) else []
    return sorted(found, key=lambda v: [int(x) if x.isdigit() else -1 for x in v.split(".")])


def update_snapshot(df: DataFrame, path: str) -> str:
    """The table as a new version, one above the last; those before stay."""
    last = versions(df.sparkSession, path)
    head, _, tail = last[-1].rpartition(".") if last else ("", "", "0")
    return snapshot(df, path, f"{head}{'.' if head else ''}{int(tail) + 1}")


def snapshot(df: DataFrame, path: str, version: str) -> str:
    """A table kept under a version; one that exists is never overwritten. Returns its place."""
    place = f"{path}/v{version}"
    df.write.mode("errorifexists").parquet(place)
    return place
