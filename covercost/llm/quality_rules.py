"""Operator 3: quality rules whose limits adapt to each language and source.

Every rule value is an expression over the whole text.  A rule's limit comes
from a mergeable quantile sketch (log-spaced bins with relative error
``ALPHA``, merged by adding counts, so neither the order of rows nor the
number of tasks matters) of its (lang, source) group; a group of fewer than
``MIN_GROUP`` documents takes the sketch of its language, and that of a small
language the sketch of all documents.  A document is rejected when the fixed
base rules fail it or a value lies beyond its group's outlier fence.

Only DataFrame functions are used.  Defined cases: null or blank text has no
words and fails the base rules; null lang or source is a group of its own;
equal rows get equal verdicts and stay separate rows; an empty table gives an
empty result; further columns are ignored, or carried when named in ``carry``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covercost.llm.base import broadcast_if_small, stage, table

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Relative error of the quantile sketches.
ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
MIN_GROUP = 200
#: Quartiles of the fence, and how many interquartile ranges beyond them are kept.
LOW_Q, HIGH_Q, REACH = 0.25, 0.75, 3.0
#: Rule value -> slack that a fence has at least: (beyond the upper quartile, below the lower one or None).
RULES = {
    "symbols_per_word": (0.25, None),
    "dup_line_share": (0.25, None),
    "repeat_share": (0.25, None),
    "mean_word_chars": (3.0, 3.0),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the five base counts, base_failed and the rule values of every row."""
    f = docs.select(*dict.fromkeys(("doc_id", "lang", "source", *carry)), F.coalesce("text", F.lit("")).alias("_t"))
    f = f.withColumn("_trim", F.btrim("_t", F.lit(WHITE)))
    f = f.withColumn("_w", F.split("_trim", r"[\x20\x09-\x0D]+"))
    f = f.withColumn("n_words", F.when(F.col("_trim") == "", 0).otherwise(F.size("_w")).cast("long"))
    # (hash, position) of each window of three words, sorted: equal windows stand side by side
    f = f.withColumn("_h", F.when(F.col("n_words") < 3, F.expr("cast(array() as array<struct<h:bigint,i:int>>)")).otherwise(F.expr(
        "sort_array(transform(sequence(0, cast(n_words as int) - 3), "
        "i -> struct(xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)) as h, i as i)))")))
    f = f.withColumn("_r", F.expr("filter(_h, (x, i) -> x.h <=> get(_h, i - 1).h or x.h <=> get(_h, i + 1).h)"))
    f = f.withColumn("_l", F.expr(r"filter(split(_t, '\n'), x -> btrim(x, ' \t\n\u000b\u000c\r') != '')"))
    f = f.withColumns({
        "word_chars": F.length(F.translate("_t", WHITE, "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.size(F.array_distinct(F.flatten(F.expr("transform(_r, x -> array(x.i, x.i + 1, x.i + 2))")))).cast("long"),
        "_lines": F.size("_l"),
    })
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return f.select(
        *dict.fromkeys(("doc_id", "lang", "source", *carry)), *BASE,
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1)).cast("double")).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("word_chars") / words).alias("mean_word_chars"),
    )


def sketches(feats: DataFrame) -> DataFrame:
    """Quantile sketches of the documents that pass the base rules: (lang, source, rule, bin) -> count."""
    long = feats.where("not base_failed").select("lang", "source", F.explode(F.map_from_arrays(
        F.array(*map(F.lit, RULES)), F.array(*RULES))).alias("rule", "value"))
    bin_ = F.when(F.col("value") <= 0, F.lit(None)).otherwise(F.ceil(F.log("value") / math.log(GAMMA)))
    return long.groupBy("lang", "source", "rule", bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches added up to coarser groups, as quartiles: (by.., rule) -> n, low, high."""
    s = sketch.groupBy(*by, "rule", "bin").agg(F.sum("n").alias("n"))
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bin")) / (GAMMA + 1))
    # one row per group: its bins are few (their number grows with the logarithm of the values), so they fit in an array
    s = s.groupBy(*by, "rule").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(value.alias("v"), F.col("n").alias("c")))).alias("bins"))
    at = lambda q: F.expr(
        f"aggregate(bins, named_struct('seen', 0L, 'v', cast(null as double)), (a, b) -> named_struct('seen', a.seen + b.c, "
        f"'v', if(a.v is null and a.seen + b.c >= {q} * n, b.v, a.v)), a -> a.v)")
    return s.select(*by, "rule", "n", at(LOW_Q).alias("low"), at(HIGH_Q).alias("high"))


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source) -> the least and most value that each rule keeps."""
    g = merged(sketch, ["lang", "source"]).alias("g")
    lang, every = merged(sketch, ["lang"]).alias("l"), merged(sketch, []).alias("e")
    j = g.join(lang, (F.col("g.rule") == F.col("l.rule")) & F.col("g.lang").eqNullSafe(F.col("l.lang")), "left")
    j = j.join(every, F.col("g.rule") == F.col("e.rule"), "left")
    pick = lambda c: F.when(F.col("g.n") >= MIN_GROUP, F.col(f"g.{c}")).when(F.col("l.n") >= MIN_GROUP, F.col(f"l.{c}")).otherwise(F.col(f"e.{c}"))
    j = j.select("g.lang", "g.source", "g.rule", pick("low").alias("low"), pick("high").alias("high"))
    cols = []
    for rule, (above, below) in RULES.items():
        reach = REACH * (F.col("high") - F.col("low"))
        most = F.when(F.col("rule") == rule, F.col("high") + F.greatest(reach, F.lit(above)))
        least = F.when(F.col("rule") == rule, F.col("low") - F.greatest(reach, F.lit(below))) if below else F.lit(None).cast("double")
        cols += [F.max(most).alias(f"most_{rule}"), F.max(least).alias(f"least_{rule}")]
    return j.groupBy("lang", "source").agg(*cols)


def judge(spark: SparkSession, docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its base counts, ``base_failed`` and ``kept``; columns in ``carry`` stay."""
    feats = stage(spark, features(docs, carry), "quality-features")
    lim = limits(sketches(feats)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    # one row per (lang, source): joined without moving the documents while these are few
    lim = broadcast_if_small(stage(spark, lim, "quality-limits"), 200)
    j = feats.join(lim, feats.lang.eqNullSafe(lim["_lang"]) & feats.source.eqNullSafe(lim["_source"]), "left")
    fine = ~F.col("base_failed")
    for rule, (_, below) in RULES.items():
        fine = fine & F.coalesce(F.col(rule) <= F.col(f"most_{rule}"), F.lit(True))
        if below:
            fine = fine & F.coalesce(F.col(rule) >= F.col(f"least_{rule}"), F.lit(True))
    return j.select(*dict.fromkeys(("doc_id", *carry)), *BASE, "base_failed", fine.alias("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "documents"))


def _sketch_sql(by: str) -> str:
    on = f"{by}, " if by else ""
    part = f"partition by {by}, rule" if by else "partition by rule"
    return f"""
      select {on}rule, max(n) n, min(case when seen >= {LOW_Q} * n then v end) low, min(case when seen >= {HIGH_Q} * n then v end) high
      from (select {on}rule, v, sum(c) over ({part}) n, sum(c) over ({part} order by v) seen
            from (select {on}rule, case when bin is null then 0.0 else 2 * pow({GAMMA!r}, bin) / {GAMMA + 1!r} end v, sum(c) c
                  from bins group by {on}rule, bin))
      group by {on}rule"""


def oracle() -> str:
    values = {"symbols_per_word": "n_symbols / greatest(n_words, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
              "repeat_share": "n_repeat_words / greatest(n_words, 1)", "mean_word_chars": "word_chars / greatest(n_words, 1)"}
    long = " union all ".join(f"select lang, source, '{k}' rule, cast({k} as double) v from f where not base_failed" for k in RULES)
    fences, checks = [], []
    for rule, (above, below) in RULES.items():
        fences.append(f"max(case when rule = '{rule}' then high + greatest({REACH} * (high - low), {above}) end) most_{rule}")
        checks.append(f"coalesce({rule} <= most_{rule}, true)")
        if below:
            fences.append(f"max(case when rule = '{rule}' then low - greatest({REACH} * (high - low), {below}) end) least_{rule}")
            checks.append(f"coalesce({rule} >= least_{rule}, true)")
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
    with t as (
      select row_number() over () rid, doc_id, lang, source, coalesce(text, '') t from documents),
    w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w,
                 list_filter(string_split(t, chr(10)), lambda x: trim(x, {white}) <> '') l from t),
    pos as (select rid, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] g
            from (select rid, w, unnest(range(1, len(w) - 1)) i from w where len(w) >= 3)),
    rep as (select rid, count(distinct p) n from
              (select rid, unnest([i, i + 1, i + 2]) p from (select rid, i, count(*) over (partition by rid, g) c from pos) where c > 1)
            group by rid),
    c as (select w.rid, doc_id, lang, source, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars,
                 (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint n_symbols, (len(l) - len(list_distinct(l)))::bigint n_dup_lines,
                 coalesce(rep.n, 0) n_repeat_words, len(l) n_lines
          from w left join rep on w.rid = rep.rid),
    f as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) base_failed, {', '.join(f'{v} {k}' for k, v in values.items())} from c),
    bins as (select lang, source, rule, case when v > 0 then ceil(ln(v) / {math.log(GAMMA)!r})::bigint end bin, count(*) c
             from ({long}) group by all),
    g as ({_sketch_sql('lang, source')}), l as ({_sketch_sql('lang')}), e as ({_sketch_sql('')}),
    q as (select g.lang, g.source, g.rule,
                 case when g.n >= {MIN_GROUP} then g.low when l.n >= {MIN_GROUP} then l.low else e.low end low,
                 case when g.n >= {MIN_GROUP} then g.high when l.n >= {MIN_GROUP} then l.high else e.high end high
          from g left join l on g.rule = l.rule and g.lang is not distinct from l.lang left join e on g.rule = e.rule),
    lim as (select lang, source, {', '.join(fences)} from q group by lang, source)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not base_failed and {' and '.join(checks)} kept
    from f left join lim on f.lang is not distinct from lim.lang and f.source is not distinct from lim.source"""
