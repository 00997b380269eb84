"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Word, symbol, line and repetition counts are taken of every whole text. Each
rule rejects documents whose measure is above a cutoff. Cutoffs are chosen per
stratum on one half of the labelled documents, by a hash of the id: walking
from the loosest cutoff of a fixed grid to the strictest, those whose rejected
good documents an exact binomial test shows to be few, and of them the one that
tells bad documents from good ones best. The other half, which has no part in
the choice, decides what is used: a stratum's rules are added one by one, the
best first, as long as an exact binomial test shows that all rules so far
together reject less than the permitted share of its good documents. As that
order is fixed before the test and the test ends at the first failure, it needs
no correction in a stratum; over strata the error level is divided (Bonferroni).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.scratch import cut, small_or_not

#: Share of a stratum's good documents that all rules together may reject, and the chance that they reject more in any stratum.
RISK, ERROR = 0.02, 0.05
#: Share of bad documents among the labelled ones that a cutoff rejects, at least.
PRECISION = 0.9
#: Cutoffs on the grid of each rule.
STEPS = 400
#: White space other than the space, and what counts as a symbol; all of one byte.
_OTHER_SPACE, _SYMBOLS = "\t\n\x0b\x0c\r", "#*$%&|<>"

#: Rule: measure in [0, 1] from the base columns; high is bad.
RULES: dict[str, str] = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
}


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column, window: int = 3) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the array ``words``.

    Windows are compared by 64-bit hashes of their words. Where no hash recurs
    none are. Else sorting brings equal ones together; the starts that recur are
    sorted again, and each adds what it covers beyond the start before it.
    """
    w = int(window)

    def starts(hashes: Column) -> Column:
        def again(sorted_: Column) -> Column:
            same = F.filter(
                sorted_,
                lambda x, k: ((k > 0) & (x["h"] == F.get(sorted_, k - 1)["h"])) | (x["h"] == F.get(sorted_, k + 1)["h"]),
            )
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        return _bind(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), again)

    def covered(at: Column) -> Column:
        total = F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-w).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(w), i - acc["last"])).alias("n"), i.alias("last")),
        )
        return total["n"]

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _bind(starts(hashes), covered)).otherwise(0)

    def hashed(ws: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(ws) - w), lambda i: F.xxhash64(*(F.get(ws, i + j) for j in range(w))))
        return F.when(F.size(ws) > w, _bind(each, counted)).otherwise(0)

    return _bind(words, hashed).cast("long")


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns ``keep`` and the base counts of every row of ``docs``.

    Words are runs of characters other than ASCII white space. ``word_chars``
    counts their code points, ``n_symbols`` the characters of ``#*$%&|<>``,
    ``n_lines`` the lines with a word, ``n_dup_lines`` those equal to an earlier
    one, ``n_repeat_words`` the words in recurring 3-word windows and
    ``n_capitals`` the upper-case letters. A null text has no words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), *(F.col(c) for c in keep), text.alias("__text"))
    t = F.col("__text")
    spaced, bare = t, t
    for c in _OTHER_SPACE:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    for c in _SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" " + _OTHER_SPACE)) != "")
    # plain replacements and splits at one character are many times cheaper than patterns
    rows = rows.withColumn("__spaced", spaced).withColumn("__words", F.array_remove(F.split("__spaced", " "), ""))
    return rows.select(
        "doc_id",
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.replace("__spaced", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.octet_length(t) - F.octet_length(bare)).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("__lines"),
        repeat_words(F.col("__words")).alias("n_repeat_words"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
    ).select(
        "doc_id",
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("__lines.d").cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.col("__lines.n").cast("long").alias("n_lines"),
        "n_capitals",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def allowed_rejections(n: Column, risk: Column, error: Column) -> Column:
    """The most of ``n`` good documents that may be rejected: the largest k with P(Bin(n, risk) <= k) <= error; -1 if none.

    Terms of the distribution are added in logarithms, so that no ``n`` underflows.
    """
    odds = F.ln(risk) - F.log1p(-risk)

    def step(acc: Column, k: Column) -> Column:
        term = F.when(k == 0, n * F.log1p(-risk)).otherwise(acc["term"] + F.ln((n - k + 1) / k) + odds)
        high = F.greatest(acc["total"], term)
        total = F.when(acc["total"].isNull(), term).otherwise(high + F.ln(F.exp(acc["total"] - high) + F.exp(term - high)))
        good = total <= F.ln(error)
        return F.struct(term.alias("term"), total.alias("total"), F.when(good, k).otherwise(acc["best"]).alias("best"))

    none = F.lit(None).cast("double")
    walked = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.floor(n * risk).cast("long")),
        F.struct(none.alias("term"), none.alias("total"), F.lit(-1).cast("long").alias("best")),
        step,
    )
    return walked["best"]


def log_tail(n: Column, k: Column, p: float) -> Column:
    """The logarithm of P(Bin(n, p) <= k), for k from 0 to n."""
    odds = F.lit(p).cast("double")
    odds = F.ln(odds) - F.log1p(-odds)

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.ln((n - i + 1) / i) + odds
        high = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.ln(F.exp(acc["total"] - high) + F.exp(term - high))).alias("total"))

    first = n * F.log1p(F.lit(-p))
    rest = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(rest, F.struct(first.alias("term"), first.alias("total")), step)["total"]


def fit_cutoffs(
    counts: DataFrame,
    labels: DataFrame,
    stratum: str = "stratum",
    good: str = "quality = 1",
    risk: float = RISK,
    error: float = ERROR,
    precision: float = PRECISION,
    steps: int = STEPS,
) -> DataFrame:
    """Rows ``(stratum, rule, cutoff, n_good, n_bad, n_test, rejected, allowed)`` from the labelled rows of ``counts``.

    ``cutoff`` is null where the rule rejects nothing. To be chosen on the first
    half of the labels, a cutoff must be safe there, bad documents must be
    ``precision`` or more of what it rejects, and an exact test must show them
    to be most of it: without that, one bad document with an extreme measure
    would make a cutoff. Of these it is the one with the largest difference
    between the rejected shares of bad and good documents, in the middle of
    those that reject the same ones. To be used, the stratum's rules up to this
    one, in falling order of that difference, must together have ``rejected`` no
    more than ``allowed`` of the ``n_test`` good documents of the second half.
    Documents that the base rules reject are not counted, nor are null labels;
    a document with contradicting labels is good. All labelled rows are used;
    counts of them, by grid step, are what is shuffled.
    """
    marks = labels.select("doc_id", F.expr(good).alias("good")).where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.max("good").alias("good"))
    marks = marks.withColumn("choosing", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8")
    measures = F.struct(*(F.least(F.lit(1.0), F.expr(e).cast("double")).alias(r) for r, e in RULES.items()))
    labelled = cut(counts.where("not base_failed").join(marks, "doc_id").select(F.col(stratum).alias("stratum"), "good", "choosing", measures.alias("of")), "labelled")
    steps_of = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"of.{r}").alias("measure")) for r in RULES)))
    # the step of a measure: the number of grid cutoffs below it, which would reject it
    binned = (
        labelled.where("choosing").select("stratum", "good", steps_of.alias("x"))
        .groupBy("stratum", F.col("x.rule").alias("rule"), F.ceil(F.col("x.measure") * steps).cast("long").alias("step"))
        .agg(F.count_if("good").alias("goods"), F.count_if(~F.col("good")).alias("bads"))
    )
    n_strata = binned.agg(F.count_distinct(F.coalesce(F.col("stratum"), F.lit("\u0000"))).alias("n_strata"))
    limits = (
        binned.groupBy("stratum", "rule")
        .agg(F.sum("goods").alias("n_good"), F.sum("bads").alias("n_bad"))
        .crossJoin(F.broadcast(n_strata))  # a single row
        .withColumn("level", F.lit(error) / (F.col("n_strata") * len(RULES)))
        .withColumn("allowed", allowed_rejections(F.col("n_good"), F.lit(risk), F.col("level")))
    )
    # the cutoffs between a step and the next lower one reject all whose step is this or a higher one
    falling = Window.partitionBy("stratum", "rule").orderBy(F.desc("step"))
    walk = (
        binned.withColumn("rejected", F.sum("goods").over(falling))
        .withColumn("caught", F.sum("bads").over(falling))
        .withColumn("below", F.coalesce(F.lead("step").over(falling), F.lit(0)))
    )
    same = F.col("c.stratum").eqNullSafe(F.col("l.stratum")) & (F.col("c.rule") == F.col("l.rule"))
    gain = F.try_divide("caught", "n_bad") - F.try_divide("rejected", "n_good")
    safe = walk.alias("c").join(limits.alias("l"), same).where("rejected <= allowed and step > 0").select("c.*", "level", gain.alias("gain"))
    both = F.col("caught") + F.col("rejected")
    precise = safe.where((F.col("gain") > 0) & (F.col("caught") >= precision * both))
    best = precise.where(log_tail(both, F.col("rejected"), 0.5) <= F.ln("level")).groupBy("stratum", "rule").agg(F.max(F.struct("gain", "step", "below")).alias("b"))
    middle = F.expr("(b.below + b.step - 1) / 2") / F.lit(float(steps))
    found = limits.alias("l").join(best.alias("c"), same, "left")
    turn = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc_nulls_last("gain"), "rule"))  # a stratum has a row for each rule
    found = found.select("l.stratum", "l.rule", F.when(F.col("b").isNotNull(), middle).alias("cutoff"), "n_good", "n_bad", F.col("b.gain").alias("gain"))
    found = cut(found.withColumn("turn", F.when(F.col("cutoff").isNotNull(), turn)), "chosen")

    # the second half: of each good document the first rule, in their order, that rejects it
    chosen = found.where("cutoff is not null").groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.struct("cutoff", "turn")))).alias("rules"))
    tests = labelled.where("good and not choosing").alias("l").join(small_or_not(cut(chosen, "chosen-rules"), 100_000).alias("c"), F.col("l.stratum").eqNullSafe(F.col("c.stratum"))).select("l.stratum", "of", "rules")
    turns = [F.when(F.col(f"of.{r}") > F.try_element_at("rules", F.lit(r))["cutoff"], F.try_element_at("rules", F.lit(r))["turn"]) for r in RULES]
    first = tests.select("stratum", F.array_min(F.array(*turns)).alias("turn")).groupBy("stratum").agg(F.count("*").alias("n_test"), *(F.count_if(F.col("turn") <= k).alias(f"upto{k}") for k in range(1, len(RULES) + 1)))
    n_tested = found.where("cutoff is not null").agg(F.count_distinct(F.coalesce(F.col("stratum"), F.lit("\u0000"))).alias("n_tested"))
    tested = first.crossJoin(F.broadcast(n_tested))  # a single row
    tested = tested.withColumn("allowed", allowed_rejections(F.col("n_test"), F.lit(risk), F.lit(error) / F.col("n_tested")))
    rejected = F.get(F.array(*(F.col(f"upto{k}") for k in range(1, len(RULES) + 1))), F.col("turn") - 1)
    out = found.alias("f").join(tested.alias("t"), F.col("f.stratum").eqNullSafe(F.col("t.stratum")), "left").select("f.*", "n_test", rejected.alias("rejected"), "allowed")
    return out.select("stratum", "rule", F.when(F.col("rejected") <= F.col("allowed"), F.col("cutoff")).alias("cutoff"), "n_good", "n_bad", "n_test", "rejected", "allowed")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    **fit,
) -> DataFrame:
    """One row per row of ``docs``: id, base counts, ``base_failed`` and ``kept``, and the rules that reject it.

    A document is kept if neither the base rules nor a cutoff of its stratum
    rejects it. Strata are the values of ``stratum_col``, null being one; where
    labels are too few or missing only the base rules hold. Empty texts fail
    the base rules, very long ones are counted whole, rows of null id are judged
    like any other, repeated rows each give a row, and an empty table gives
    none. Other columns are not read, whatever their names.
    """
    text = F.col(text_col).cast("string")
    from_docs = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    counts = cut(base_counts(from_docs, keep=("stratum", "text_hash")), "base-counts")
    fitted = fit_cutoffs(counts, labels, **fit).where("cutoff is not null")
    wide = cut(fitted.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")), "cutoffs")
    joined = counts.alias("d").join(small_or_not(wide, 100_000).alias("c"), F.col("d.stratum").eqNullSafe(F.col("c.stratum")), "left").select("d.*", "cutoffs")
    fired = F.array_compact(F.array(*(F.when(F.expr(e) > F.element_at("cutoffs", F.lit(r)), F.lit(r)) for r, e in RULES.items())))
    return joined.withColumn("rejected_by", fired).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"),
        "rejected_by",
        "stratum",
        "text_hash",
    )


def keep_accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **fit) -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects; columns pass unchanged.

    Rejected rows are found again by id, stratum and a hash of the text, so
    rows that share an id are judged each on its own text. Null, empty and very
    long texts, repeated rows, null ids and clashing names are treated as in
    ``judge``; an empty table stays one.
    """
    verdicts = judge(docs, labels, id_col, text_col, stratum_col, **fit)
    gone = cut(verdicts.where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("stratum").alias("__stratum")).distinct(), "rejected")
    gone = small_or_not(gone)
    same = (
        docs[id_col].eqNullSafe(gone["__id"])
        & (F.xxhash64(docs[text_col].cast("string")) == gone["__hash"])
        & docs[stratum_col].cast("string").eqNullSafe(gone["__stratum"])
    )
    return docs.join(gone, same, "left_anti")
