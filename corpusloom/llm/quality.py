"""Quality rules combined by weak supervision, with DataFrame functions only.

Every rule looks at one signal of a text and votes junk (1), good (-1) or abstains (0). Expectation-maximisation
estimates, from the numbers of vote patterns alone, how often each rule votes each way on junk and on good texts and
how much junk there is; a text is rejected if its posterior probability of being junk is at least a half. One
strong vote suffices where a rule hardly ever votes junk on good texts, which all-must-pass filtering can't tell.
A base rule (too short, or mostly repetition) rejects by itself.

The patterns number at most 3 ** RULES, whatever the corpus; only they meet in one task, already counted.

Defined results: null and empty text have no words and fail the base rule; nulls elsewhere and repeated rows are
judged row by row; extra columns are ignored; an empty table gives an empty result.
Repeated windows are found by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path

LEAST_WORDS, MOST_REPEAT, WINDOW = 20, 30, 8
RULES, ROUNDS, SMOOTH = 4, 25, 10.0
# No rule is taken to vote junk on more than this share of good texts; otherwise a common kind of junk that one
# rule alone finds could pass as a habit of good texts.
MOST_FALSE = 0.01
# Start and prior (worth SMOOTH votes) of the estimates: share of junk, then how junk and good texts are voted on
# (good, abstain, junk). A rule finds one kind of junk, so on junk too most rules vote good.
START = [0.1] + [0.55, 0.2, 0.25] * RULES + [0.85, 0.145, 0.005] * RULES

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def _bind(value: Column, use) -> Column:
    """`use(value)` with the value computed once: array functions would otherwise repeat it per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(starts: Column) -> Column:
    """Words under windows that begin at the sorted places `starts`."""
    def one(place: Column, i: Column) -> Column:
        following = F.get(starts, i + 1)
        return F.when(following.isNull(), WINDOW).otherwise(F.least(F.lit(WINDOW), following - place))

    return F.aggregate(F.transform(starts, one), F.lit(0), lambda total, n: total + n)


def _repeated(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""
    def places(pairs: Column) -> Column:
        def twice(pair: Column, i: Column) -> Column:
            # Beyond the ends of the list `get` gives null.
            return F.coalesce(pair["h"] == F.get(pairs, i - 1)["h"], F.lit(False)) | F.coalesce(
                pair["h"] == F.get(pairs, i + 1)["h"], F.lit(False)
            )

        same = F.filter(pairs, twice)
        return F.array_sort(F.transform(same, lambda p: p["i"]))

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = _bind(pairs, places)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_bind(starts, _covered))


def signals(docs: DataFrame) -> DataFrame:
    """`docs` with the SIGNALS as columns q_..., all long."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = F.translate(text, SPACES, " " * len(SPACES))
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACES, "") != "")
    first = docs.withColumns({
        "q_words": F.array_remove(F.split(blank, " "), ""),
        "q_lines": lines,
        "q_word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "q_n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "q_n_capitals": (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("long"),
    })
    second = first.withColumns({
        "q_n_words": F.size("q_words").cast("long"),
        "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "q_n_lines": F.size("q_lines").cast("long"),
        "q_hashes": F.transform("q_words", lambda w: F.xxhash64(w)),
    }).drop("q_words", "q_lines")
    count = F.size("q_hashes") - (WINDOW - 1)
    windows = F.when(
        count > 0,
        F.transform(
            F.slice("q_hashes", F.lit(1), count),
            lambda h, i: F.xxhash64(h, *(F.get("q_hashes", i + j) for j in range(1, WINDOW))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    third = second.withColumn("q_windows", F.when(F.size("q_hashes") >= 0, windows)).drop("q_hashes")
    return third.withColumn("q_n_repeat_words", _repeated(F.col("q_windows")).cast("long")).drop("q_windows")


def base_failed() -> Column:
    return (F.col("q_n_words") < LEAST_WORDS) | (
        100 * F.col("q_n_repeat_words") > MOST_REPEAT * F.col("q_n_words")
    )


def votes() -> list[Column]:
    """1 junk, -1 good, 0 no opinion, by rule: symbols, repetition, word length, capitals."""
    words, chars = F.col("q_n_words"), F.col("q_word_chars")

    def vote(junk: Column, good: Column) -> Column:
        return F.when(junk, 1).when(good, -1).otherwise(0)

    return [
        vote(10 * F.col("q_n_symbols") > 3 * words, 50 * F.col("q_n_symbols") <= words),
        vote(2 * F.col("q_n_dup_lines") > F.col("q_n_lines"), 20 * F.col("q_n_repeat_words") <= words),
        vote((chars < 2 * words) | (chars > 14 * words), (chars >= 3 * words) & (chars <= 9 * words)),
        vote(10 * F.col("q_n_capitals") > 3 * chars, 20 * F.col("q_n_capitals") <= 3 * chars),
    ]


def _place(junk: int | Column, rule: int | Column, vote: Column) -> Column:
    """Index of a probability in the flat list: after the share of junk, junk first."""
    return F.lit(1) + ((1 - F.lit(junk)) * RULES + rule) * 3 + vote + 1


def _posterior(p: Column, own: Column) -> Column:
    """Probability of junk for the votes `own` under the estimates `p`."""
    def chance(junk: int) -> Column:
        prior = F.get(p, F.lit(0)) if junk else 1 - F.get(p, F.lit(0))
        out = prior
        for rule in range(RULES):
            out = out * F.get(p, _place(junk, rule, F.get(own, F.lit(rule))))
        return out

    return chance(1) / (chance(1) + chance(0))


def _improve(p: Column, patterns: Column) -> Column:
    """One round: posteriors of the patterns, then the estimates that fit them."""
    def estimates(judged: Column) -> Column:
        def total(value) -> Column:
            return F.aggregate(judged, F.lit(0.0), lambda acc, x: acc + value(x))

        share = total(lambda x: x["n"] * x["junk"]) / total(lambda x: x["n"])

        def rate(k: Column) -> Column:
            good, rule, vote = F.floor(k / (3 * RULES)), F.pmod(F.floor(k / 3), F.lit(RULES)), F.pmod(k, F.lit(3)) - 1

            def weight(x: Column) -> Column:
                return x["n"] * F.when(good == 0, x["junk"]).otherwise(1 - x["junk"])

            hit = total(lambda x: F.when(F.get(x["votes"], rule.cast("int")) == vote, weight(x)).otherwise(0.0))
            prior = F.get(F.array(*map(F.lit, START)), (k + 1).cast("int"))
            found = (hit + SMOOTH * prior) / (total(weight) + SMOOTH)
            return F.when((good == 1) & (vote == 1), F.least(found, F.lit(MOST_FALSE))).otherwise(found)

        return F.concat(F.array(share), F.transform(F.sequence(F.lit(0), F.lit(6 * RULES - 1)), rate))

    judged = F.transform(
        patterns,
        lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), _posterior(p, x["votes"]).alias("junk")),
    )
    return _bind(judged, estimates)


def estimate(rows: DataFrame) -> list[float]:
    """The estimates after ROUNDS rounds over all rows of signals that pass the base rule."""
    counted = (
        rows.where(~base_failed()).select(F.array(*votes()).alias("votes"))
        .groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    )
    listed = counted.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    start = F.array(*map(F.lit, START))
    learnt = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda p, _: _improve(p, F.col("patterns"))
    )
    row = listed.select(F.when(F.size("patterns") > 0, learnt).otherwise(start).alias("p")).first()
    return list(row["p"])


def verdict(p: list[float]) -> Column:
    """Whether a row of signals is kept."""
    own = F.array(*votes())
    return ~base_failed() & (_posterior(F.array(*map(F.lit, p)), own) < 0.5)


def judge(docs: DataFrame, *columns: str) -> DataFrame:
    """`columns` of every document, its signals, base_failed and kept."""
    names = list(dict.fromkeys(columns or ("doc_id",)))
    path = scratch_path(docs.sparkSession, "signals")
    held = docs.select(*(F.col(n).alias(f"__c{i}") for i, n in enumerate(names)), "text")
    signals(held).drop("text").write.parquet(path)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(
        [f"__c{i} {kinds[n]}" for i, n in enumerate(names)] + [f"q_{s} long" for s in SIGNALS]
    )
    rows = docs.sparkSession.read.schema(schema).parquet(path)
    out = rows.select(
        "*", base_failed().alias("base_failed"), verdict(estimate(rows)).alias("kept")
    )
    return out.withColumnsRenamed(
        {f"__c{i}": n for i, n in enumerate(names)} | {f"q_{s}": s for s in SIGNALS}
    )


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns; signals are computed again instead of copying texts."""
    path = scratch_path(docs.sparkSession, "signals")
    signals(docs.select("text")).drop("text").write.parquet(path)
    rows = docs.sparkSession.read.schema(", ".join(f"q_{s} long" for s in SIGNALS)).parquet(path)
    # Under other names no column of the documents can clash with a signal.
    held = docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)), "text")
    found = F.struct(*(F.col(f"q_{s}") for s in SIGNALS))
    # A generator keeps the filter above the signals; pushed below, it would repeat their expressions for every vote.
    apart = signals(held).select(
        *(f"__c{i}" for i in range(len(docs.columns))), F.explode_outer(F.array(found)).alias("q")
    ).select("*", "q.*")
    kept = apart.where(verdict(estimate(rows)))
    return kept.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))
