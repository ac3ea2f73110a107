"""Queries of the data-quality audit and of preparation, over the ticket tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions import text as T
from ticketloom.functions.stats import association, contingency
from ticketloom.operators import quality as Q

TAGS = [f"tag_{i}" for i in range(1, 9)]
LEVELS = ["low", "medium", "high"]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _tickets(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "aa_dataset_tickets")


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _priority() -> F.Column:
    return T.clean_category(F.col("priority"), lower=True)


def text_quality_profile(spark, sf):
    """Flagship: per language label, sizes, duplicate texts and their priority conflicts."""
    d = _tickets(spark, sf).select(F.coalesce(T.clean_category(F.col("language"), True), F.lit("<missing>")).alias("language"), _priority().alias("priority"), F.concat_ws(" ", "subject", "body").alias("text"))
    d = d.withColumns({"key": T.group_key(T.comparison_form(F.col("text"))), "chars": F.length("text"), "words": T.word_count(F.col("text"))})
    groups = d.groupBy("language", "key").agg(F.count("*").alias("n"), F.count_distinct("priority").alias("targets"), F.sum("chars").alias("chars"), F.sum("words").alias("words"), F.max("chars").alias("longest"))
    out = groups.groupBy("language").agg(F.sum("n").alias("records"), F.count("*").alias("distinct_texts"), F.sum((F.col("n") > 1).cast("bigint")).alias("duplicate_groups"), F.sum((F.col("targets") > 1).cast("bigint")).alias("conflict_groups"), F.sum("words").alias("words"), F.max("longest").alias("longest_chars"), (F.sum("chars") / F.sum("n")).alias("mean_chars"))
    return _rounded(out, "mean_chars")


def value_distribution(spark, sf):
    return _rounded(Q.value_distribution(_tickets(spark, sf), "queue"), "share")


def column_profile(spark, sf):
    return _rounded(Q.column_profile(_tickets(spark, sf), ["subject", "priority", "language", "queue", "requester_id", *TAGS[:3]]), "missing_share")


def text_summary(spark, sf):
    return Q.text_summary(_tickets(spark, sf), ["subject", "body", "answer"])


def quality_indicators(spark, sf):
    return _rounded(Q.indicator_counts(_tickets(spark, sf), Q.signals(F.col("body"))), "share")


def short_text_decisions(spark, sf):
    d = _tickets(spark, sf).select("source_row_id", F.concat_ws(" ", "subject", "body").alias("text")).distinct()
    n = F.length(F.trim("text"))
    label = Q.first_match([(n == 0, "empty"), (F.trim("text").rlike(T.PLACEHOLDER), "placeholder"), (n <= 20, "very_short"), (n <= 40, "short")], "kept")
    return d.select(label.alias("decision"), n.alias("n")).groupBy("decision").agg(F.count("*").alias("records"), F.max("n").alias("longest"))


def exact_groups(spark, sf):
    return Q.duplicate_groups(_tickets(spark, sf), T.group_key(F.nullif(T.comparison_form(F.col("body")), F.lit(""))), "priority")


def group_conflicts(spark, sf):
    d = _t(spark, sf, "customer_it_support_prepared").withColumn("priority", _priority())
    return Q.conflicts(d, "text_group_id", "priority")


def group_audit(spark, sf):
    d = _t(spark, sf, "customer_it_support_prepared").withColumn("priority", _priority())
    return Q.group_audit(d, "semantic_group_id", ["priority", "type", "language"]).where("records > 1")


def repeated_rows(spark, sf):
    return Q.repeated_rows(_t(spark, sf, "split_assignments"), ["modeling_row_id", "source_row_id", "semantic_group_id", "text_group_id", "priority", "split"])


def leakage_pairs(spark, sf):
    f = Q.leakage_flags(_tickets(spark, sf), "answer", "body")
    return _rounded(f.where("leak").select("source_row_id", "exact", "contained", "coverage").distinct(), "coverage")


def leakage_threshold_sweep(spark, sf):
    return Q.threshold_sweep(Q.leakage_flags(_tickets(spark, sf), "answer", "body"), [0.5, 0.6, 0.7, 0.8, 0.9])


def exclusion_reasons(spark, sf):
    d = Q.leakage_flags(_tickets(spark, sf), "answer", "body")
    text = F.concat_ws(" ", "subject", "body")
    out = Q.exclusion_reasons(d, [(F.trim(text) == "", "empty"), (F.length(F.trim(text)) <= 40, "short"), (F.col("exact"), "answer equals body"), (F.col("leak") & ~F.col("exact"), "answer in body")])
    return out.where("exclusion_reason is not null").select("source_row_id", "exclusion_reason").distinct()


def language_decisions(spark, sf):
    d = _tickets(spark, sf).select("source_row_id", "language").distinct()
    audit, review = _t(spark, sf, "language_audit"), _t(spark, sf, "language_label_manual_review").where("manual_language is not null").select("source_row_id", "manual_language")
    joined = d.join(audit, "source_row_id", "left").join(review, "source_row_id", "left")
    out = Q.language_decisions(joined, "language", "detected_language", "language_confidence", "manual_language")
    return out.groupBy("language_scope", "corrected", "final_language").agg(F.count("*").alias("records"))


def markup_artifacts(spark, sf):
    return Q.artifact_counts(_tickets(spark, sf), F.col("body"), T.normalize_markup(F.col("body")))


def normalized_bodies(spark, sf):
    """The whole normalization, entities and compatibility forms included, by hash."""
    return _tickets(spark, sf).where("body is not null").select("source_row_id", F.sha1(T.normalize_ticket(F.col("body"))).alias("key")).distinct()


def normalized_markup(spark, sf):
    return _tickets(spark, sf).where("body is not null").select("source_row_id", F.md5(T.normalize_markup(F.col("body"))).alias("key")).distinct()


def angle_tokens(spark, sf):
    return Q.angle_tokens(_tickets(spark, sf), "source_row_id", F.col("body"))


def tag_frequency(spark, sf):
    return _rounded(Q.tag_frequency(_tickets(spark, sf), TAGS), "share")


def filled_tags(spark, sf):
    return Q.filled_columns(_tickets(spark, sf), TAGS)


def priority_crosstab(spark, sf):
    return _rounded(Q.crosstab(_tickets(spark, sf).withColumn("priority", _priority()), "type", "priority", LEVELS, shares=True), *LEVELS)


def priority_association(spark, sf):
    d = _tickets(spark, sf).withColumn("priority", _priority())
    parts = [association(contingency(d, c, "priority")).select(F.lit(c).alias("variable"), "*") for c in ("type", "queue", "version")]
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "chi2", "p", "cramers_v", "min_expected", "small_cells", digits=6)


def order_association(spark, sf):
    d = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return _rounded(association(contingency(d, "c_mktsegment", "o_orderstatus")), "chi2", "p", "cramers_v", "min_expected", "small_cells", digits=6)


def latest_delivery(spark, sf):
    """Each ticket once: the delivery ingested last."""
    d = Q.latest_per_key(_tickets(spark, sf), ["source_row_id"], [F.desc("ingested_at")])
    return d.select("source_row_id", "ingested_at", "version")


QUERIES = {f.__name__: f for f in (
    text_quality_profile, value_distribution, column_profile, text_summary, quality_indicators, short_text_decisions, exact_groups, group_conflicts, group_audit, repeated_rows, leakage_pairs, leakage_threshold_sweep,
    exclusion_reasons, language_decisions, markup_artifacts, normalized_bodies, normalized_markup, angle_tokens, tag_frequency, filled_tags, priority_crosstab, priority_association, order_association, latest_delivery,
)}


# The same in SQL.
def _cmp(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '{T.LITERAL_ESCAPE}', ' ', 'g'), '[\\s ​]+', ' ', 'g'))"


def _words(c: str) -> str:
    return f"len(regexp_extract_all(regexp_replace(coalesce({c}, ''), '{T.LITERAL_ESCAPE}', ' ', 'g'), '[\\p{{L}}\\p{{N}}_]+'))"


def _clean(c: str, lower: bool = False) -> str:
    inner = f"nullif(trim(regexp_replace({c}, '[\\s ]+', ' ', 'g')), '')"
    return f"lower({inner})" if lower else inner


_TEXT = "concat_ws(' ', subject, body)"
_FLAGS = f"""
f0 AS (SELECT *, {_cmp('answer')} AS a, {_cmp('body')} AS b FROM aa_dataset_tickets),
f AS (SELECT *, a = b AND a <> '' AS exact, (length(a) >= 20 AND contains(b, a)) OR (length(b) >= 20 AND contains(a, b)) AS contained, CASE WHEN length(b) = 0 THEN 0.0 ELSE length(a)::double / length(b) END AS coverage FROM f0),
flags AS (SELECT *, exact OR (contained AND coverage >= 0.7) AS leak FROM f)"""


def _markup(c: str) -> str:
    out = f"regexp_replace({c}, '{T.LITERAL_ESCAPE}', ' ', 'g')"
    for name in T.PROTECTED:
        out = f"regexp_replace({out}, '(?i)<{name}>', '⦃{name}⦄', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?i)<br\\s*/?>', ' ', 'g'), '{T.TAG}', ' ', 'g')"
    for name in T.PROTECTED:
        out = f"replace({out}, '⦃{name}⦄', '<{name}>')"
    out = f"regexp_replace(regexp_replace({out}, '{T.URL}', '<url>', 'g'), '{T.EMAIL}', '<email_address>', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '{T.CONTROL}', ' ', 'g'), '{T.ZERO_WIDTH}', '', 'g')"
    return f"trim(regexp_replace({out}, '[\\s ]+', ' ', 'g'))"


def _stacked(pairs: list[tuple[str, str]], source: str, name: str = "indicator", share: bool = True) -> str:
    extra = ", round(coalesce(sum(({p})::bigint), 0)::double / count(*), 9) AS share" if share else ""
    return "\nUNION ALL ".join(f"SELECT '{k}' AS {name}, coalesce(sum(({p})::bigint), 0)::bigint AS records{extra.format(p=p)} FROM {source}" for k, p in pairs)


_SIG = "(SELECT coalesce(body, '') AS t FROM aa_dataset_tickets)"
_SIGNALS = [
    ("placeholder", f"regexp_matches(trim(t), '{T.PLACEHOLDER}')"), ("very_short", "length(trim(t)) BETWEEN 1 AND 20"), ("short", "length(trim(t)) BETWEEN 21 AND 40"), ("missing_whitespace", f"{_words('t')} <= 2 AND length(trim(t)) > 40"),
    ("url", f"regexp_matches(t, '{T.URL_SIGNAL}')"), ("email", f"regexp_matches(t, '{T.EMAIL}')"), ("markup", f"regexp_matches(t, '{T.MARKUP}')"), ("stack_trace", f"regexp_matches(t, '{T.STACK_TRACE}')"), ("literal_escape", f"regexp_matches(t, '{T.LITERAL_ESCAPE}')"),
]
_KINDS = {"literal_escape": T.LITERAL_ESCAPE, "break_tag": r"(?i)<br\s*/?>", "entity": r"&(?:nbsp|amp|lt|gt|quot|#\d{1,6});", "url": T.URL, "email": T.EMAIL, "double_space": r"\s\s"}
_PROFILED = ["subject", "priority", "language", "queue", "requester_id", *TAGS[:3]]


def _assoc(name: str, source: str, r: str, c: str) -> str:
    return f"""
SELECT {name} round(chi2, 6) AS chi2, dof, round(CASE WHEN dof <= 0 THEN 1.0 WHEN dof % 2 = 0 THEN least(1.0, exp(-chi2 / 2) * (1 + coalesce(list_sum(list_transform(range(1, (dof // 2)::bigint), lambda i: pow(chi2 / 2, i) / gamma(i + 1))), 0))) END, 6) AS p,
  round(sqrt(coalesce(greatest(0.0, chi2 / total - dof / greatest(total - 1, 1)) / nullif(greatest(least(nr - pow(nr - 1, 2) / greatest(total - 1, 1), nc - pow(nc - 1, 2) / greatest(total - 1, 1)) - 1, 0.0), 0), 0)), 6) AS cramers_v, round(me, 6) AS min_expected, round(sc, 6) AS small_cells
FROM (SELECT sum(CASE WHEN e > 0 THEN pow(n - e, 2) / e ELSE 0 END) AS chi2, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS dof, sum(n)::double AS total, count(DISTINCT r) AS nr, count(DISTINCT c) AS nc, min(e) AS me, avg((e < 5)::int) AS sc
  FROM (SELECT r, c, n, sum(n) OVER (PARTITION BY r)::double * sum(n) OVER (PARTITION BY c) / sum(n) OVER () AS e FROM (
    SELECT r.r, c.c, count(x.r) AS n FROM (SELECT DISTINCT {r} AS r FROM {source} WHERE {r} IS NOT NULL AND {c} IS NOT NULL) r CROSS JOIN (SELECT DISTINCT {c} AS c FROM {source} WHERE {r} IS NOT NULL AND {c} IS NOT NULL) c
    LEFT JOIN (SELECT {r} AS r, {c} AS c FROM {source}) x ON x.r = r.r AND x.c = c.c GROUP BY 1, 2)))"""


_PRI = f"(SELECT * EXCLUDE (priority), {_clean('priority', True)} AS priority FROM aa_dataset_tickets)"
_PREPARED = f"(SELECT * EXCLUDE (priority), {_clean('priority', True)} AS priority FROM customer_it_support_prepared)"

ORACLES = {
    "text_quality_profile": f"""
WITH d AS (SELECT coalesce({_clean('language', True)}, '<missing>') AS language, {_clean('priority', True)} AS priority, {_TEXT} AS text FROM aa_dataset_tickets),
g AS (SELECT language, sha1({_cmp('text')}) AS key, count(*) AS n, count(DISTINCT priority) AS targets, sum(length(text)) AS chars, sum({_words('text')}) AS words, max(length(text)) AS longest FROM d GROUP BY 1, 2)
SELECT language, sum(n)::bigint AS records, count(*) AS distinct_texts, sum((n > 1)::bigint)::bigint AS duplicate_groups, sum((targets > 1)::bigint)::bigint AS conflict_groups, sum(words)::bigint AS words, max(longest)::int AS longest_chars, round(sum(chars)::double / sum(n), 9) AS mean_chars FROM g GROUP BY 1""",
    "value_distribution": "SELECT coalesce(queue, '<Missing>') AS value, count(*) AS records, round(count(*)::double / sum(count(*)) OVER (), 9) AS share FROM aa_dataset_tickets GROUP BY 1",
    "column_profile": "\nUNION ALL ".join(f"SELECT '{c}' AS variable, count(DISTINCT {c}) AS distinct_values, coalesce(sum(({c} IS NULL)::bigint), 0)::bigint AS missing, coalesce(sum((trim({c}) = '')::bigint), 0)::bigint AS blank, round(avg(({c} IS NULL)::int), 9) AS missing_share FROM aa_dataset_tickets" for c in _PROFILED),
    "text_summary": "\nUNION ALL ".join(f"SELECT '{c}' AS field, sum((regexp_replace(coalesce({c}, ''), '[\\s\\x{{00a0}}]', '', 'g') = '')::bigint)::bigint AS empty, quantile_cont(length(coalesce({c}, '')), 0.5) AS chars_median, quantile_cont(length(coalesce({c}, '')), 0.95) AS chars_p95, quantile_cont({_words(c)}, 0.5) AS words_median, quantile_cont({_words(c)}, 0.95) AS words_p95, max(length(coalesce({c}, '')))::int AS chars_max, max({_words(c)})::int AS words_max FROM aa_dataset_tickets" for c in ("subject", "body", "answer")),
    "quality_indicators": _stacked(_SIGNALS, _SIG),
    "short_text_decisions": f"""
SELECT CASE WHEN n = 0 THEN 'empty' WHEN regexp_matches(trim(text), '{T.PLACEHOLDER}') THEN 'placeholder' WHEN n <= 20 THEN 'very_short' WHEN n <= 40 THEN 'short' ELSE 'kept' END AS decision, count(*) AS records, max(n)::int AS longest
FROM (SELECT DISTINCT source_row_id, {_TEXT} AS text, length(trim({_TEXT})) AS n FROM aa_dataset_tickets) GROUP BY 1""",
    "exact_groups": f"SELECT sha1(nullif({_cmp('body')}, '')) AS group_key, count(*) AS records, count(DISTINCT priority) AS distinct_targets FROM aa_dataset_tickets WHERE {_cmp('body')} <> '' GROUP BY 1 HAVING count(*) > 1",
    "group_conflicts": f"SELECT text_group_id, count(*) AS records, count(DISTINCT priority) AS distinct_targets FROM {_PREPARED} WHERE text_group_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT priority) > 1",
    "group_audit": f"SELECT semantic_group_id, count(*) AS records, " + ", ".join(f"count(DISTINCT {c}) AS n_{c}, coalesce(string_agg(DISTINCT {c}, ' | ' ORDER BY {c}), '') AS {c}_values" for c in ("priority", "type", "language")) + f" FROM {_PREPARED} WHERE semantic_group_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "repeated_rows": "SELECT count(*) AS groups, coalesce(sum(n), 0)::bigint AS records FROM (SELECT count(*) AS n FROM split_assignments GROUP BY modeling_row_id, source_row_id, semantic_group_id, text_group_id, priority, split HAVING count(*) > 1)",
    "leakage_pairs": f"WITH {_FLAGS} SELECT DISTINCT source_row_id, exact, contained, round(coverage, 9) AS coverage FROM flags WHERE leak",
    "leakage_threshold_sweep": f"WITH {_FLAGS} " + " UNION ALL ".join(f"SELECT {t}::double AS threshold, coalesce(sum((exact OR (contained AND coverage >= {t}))::bigint), 0)::bigint AS records FROM flags" for t in (0.5, 0.6, 0.7, 0.8, 0.9)),
    "exclusion_reasons": f"""
WITH {_FLAGS} SELECT DISTINCT source_row_id, reason AS exclusion_reason FROM (SELECT source_row_id, concat_ws(' | ', CASE WHEN trim({_TEXT}) = '' THEN 'empty' END, CASE WHEN length(trim({_TEXT})) <= 40 THEN 'short' END, CASE WHEN exact THEN 'answer equals body' END, CASE WHEN leak AND NOT exact THEN 'answer in body' END) AS reason FROM flags) WHERE reason <> ''""",
    "language_decisions": """
WITH j AS (SELECT d.source_row_id, d.language, a.detected_language AS det, a.language_confidence AS conf, r.manual_language AS man FROM (SELECT DISTINCT source_row_id, language FROM aa_dataset_tickets) d LEFT JOIN language_audit a USING (source_row_id)
  LEFT JOIN (SELECT source_row_id, manual_language FROM language_label_manual_review WHERE manual_language IS NOT NULL) r USING (source_row_id)),
k AS (SELECT *, coalesce(det IN ('de', 'en'), false) AS tgt, coalesce(conf >= 0.8, false) AS sure FROM j),
m AS (SELECT *, CASE WHEN man IS NOT NULL THEN man WHEN sure AND tgt THEN det ELSE language END AS final_language,
  CASE WHEN man IN ('de', 'en') THEN 'manual_target_retained' WHEN man IS NOT NULL THEN 'manual_non_target_excluded' WHEN NOT tgt AND coalesce(conf >= 0.99, false) THEN 'certain_non_target_excluded' WHEN NOT sure THEN 'low_confidence_label_retained' WHEN coalesce(det <> language, true) THEN 'confident_mismatch_retained' ELSE 'confident_match_retained' END AS language_scope FROM k)
SELECT language_scope, coalesce(final_language <> language, final_language IS NOT NULL) AS corrected, final_language, count(*) AS records FROM m GROUP BY 1, 2, 3""",
    "markup_artifacts": " UNION ALL ".join(f"SELECT '{s}' AS stage, * FROM ({_stacked([(k, f'''regexp_matches(coalesce(t, ''), '{v}')''') for k, v in _KINDS.items()], f'(SELECT {e} AS t FROM aa_dataset_tickets)', 'artifact', False)})" for s, e in (("before", "body"), ("after", _markup("body")))),
    "normalized_markup": f"SELECT DISTINCT source_row_id, md5({_markup('body')}) AS key FROM aa_dataset_tickets WHERE body IS NOT NULL",
    "angle_tokens": f"SELECT lower(t) AS token, count(DISTINCT source_row_id) AS records, count(*) AS occurrences FROM (SELECT source_row_id, unnest(regexp_extract_all(body, '{T.ANGLE_TOKEN}')) AS t FROM aa_dataset_tickets) GROUP BY 1",
    "tag_frequency": f"SELECT tag, count(*) AS records, round(count(*)::double / sum(count(*)) OVER (), 9) AS share FROM (SELECT unnest([{', '.join(TAGS)}]) AS tag FROM aa_dataset_tickets) WHERE tag IS NOT NULL GROUP BY 1",
    "filled_tags": f"SELECT {' + '.join(f'({c} IS NOT NULL)::int' for c in TAGS)} AS filled, count(*) AS records FROM aa_dataset_tickets GROUP BY 1",
    "priority_crosstab": "SELECT coalesce(type, '<Missing>') AS type, " + ", ".join(f"round(coalesce(count(*) FILTER (priority = '{v}')::double / nullif(count(*) FILTER (priority IN ('low', 'medium', 'high')), 0), 0), 9) AS {v}" for v in LEVELS) + f" FROM {_PRI} GROUP BY 1",
    "priority_association": " UNION ALL ".join(_assoc(f"'{c}' AS variable,", _PRI, c, "priority") for c in ("type", "queue", "version")),
    "order_association": _assoc("", "(SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)", "c_mktsegment", "o_orderstatus"),
    "latest_delivery": "SELECT source_row_id, ingested_at, version FROM (SELECT *, row_number() OVER (PARTITION BY source_row_id ORDER BY ingested_at DESC) AS r FROM aa_dataset_tickets) WHERE r = 1",
}
