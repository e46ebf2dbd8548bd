"""Every operator bound to the driver's tables, each with the same query in DuckDB's SQL where SQL can express it.

The texts of the tables are not Hebrew, so the bindings pass Latin classes and word lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import prompts
from ..functions import text as tx
from ..operators import curate, distribution, features, judge, labels, lexicon, model, profile, split
from ..sources import generate, synthetic
from ..sources.shared import folder, settled, spread
from ..sources.tables import with_aliases
from .bindings import CLASSES, DOCS_SQL, EVENTS_SQL, ORDERS_SQL, SCORES_SQL, UNIFORM, docs, events, orders, scores, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Word lists of the bindings.
TERMS = ["the", "and", "tion", "ing", "est", "der", "que", "ment", "ción", "zz"]
LATIN = {"target": "[A-Za-z]", "foreign": r"[^\x00-\x7F]"}
GATE = {"letters": "[A-Za-z]", "forbidden": ["token", "idiot"], "meta": ["licensed under", "output:"], "points": "[ÄÖÜ]", "archaic": ["thereof", "hereby"], "endings": ["the", "der"], "broken": ["(?:and) (?:and)", "[!]{2,}$"]}
WS = tx.SPACE.replace("\\x{85}", "\\x{0085}")
QUIET = "[" + WS + "]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# labels


@query(f"WITH {DOCS_SQL} SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM docs) GROUP BY label")
def label_marginals(spark, sf):
    return labels.marginals(docs(spark, sf))


@query(f"WITH {ORDERS_SQL} SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM recs) GROUP BY label")
def label_marginals_orders(spark, sf):
    return labels.marginals(orders(spark, sf))


@query(f"WITH {DOCS_SQL} SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM docs) GROUP BY label HAVING count(*) <= 60")
def sparse_labels(spark, sf):
    return labels.sparse_labels(docs(spark, sf), 60)


_CO = "e AS (SELECT id, unnest(labels) AS label FROM {0}), j AS (SELECT x.label AS a, y.label AS b, count(*) AS n FROM e x JOIN e y USING (id) GROUP BY ALL), c AS (SELECT DISTINCT label FROM e), dense AS (SELECT p.label AS a, q.label AS b, coalesce(n, 0) AS n FROM c p CROSS JOIN c q LEFT JOIN j ON j.a = p.label AND j.b = q.label)"


@query(f"WITH {ORDERS_SQL}, {_CO.format('recs')} SELECT * FROM dense")
def label_cooccurrence(spark, sf):
    return labels.cooccurrence(orders(spark, sf))


@query(f"WITH {EVENTS_SQL}, {_CO.format('days')} SELECT * FROM dense")
def label_cooccurrence_events(spark, sf):
    return labels.cooccurrence(events(spark, sf))


@query(
    f"""WITH {EVENTS_SQL}, {_CO.format('days')}, t AS (SELECT count(*)::DOUBLE AS t FROM days)
SELECT d.a, d.b, round((t * d.n - x.n * y.n) / nullif(sqrt(x.n::DOUBLE * (t - x.n) * y.n * (t - y.n)), 0), 9) AS phi
FROM dense d JOIN dense x ON x.a = d.a AND x.b = d.a JOIN dense y ON y.a = d.b AND y.b = d.b, t"""
)
def label_phi_correlation(spark, sf):
    return labels.phi(events(spark, sf)).withColumn("phi", F.round("phi", 9))


@query(f"WITH {DOCS_SQL} SELECT len(labels)::BIGINT AS n_labels, count(*) AS n FROM docs GROUP BY 1")
def label_cardinality_hist(spark, sf):
    return labels.cardinality_histogram(docs(spark, sf))


@query(f"WITH {DOCS_SQL} SELECT avg(len(labels)) AS mean_cardinality FROM docs")
def mean_cardinality(spark, sf):
    return labels.mean_cardinality(docs(spark, sf))


@query(f"WITH {DOCS_SQL} SELECT id, list_contains(labels, 'long')::INTEGER AS long, list_contains(labels, 'non_english')::INTEGER AS non_english, list_contains(labels, 'quality')::INTEGER AS quality, list_contains(labels, 'toxic')::INTEGER AS toxic FROM docs")
def label_indicators(spark, sf):
    return labels.indicators(docs(spark, sf), CLASSES)


_DENSE = "e AS (SELECT {c} AS {c}, unnest(labels) AS label FROM recs), n AS (SELECT {c}, label, count(*) AS n FROM e GROUP BY ALL) SELECT r.{c}, l.label, coalesce(n, 0) AS n FROM ({rows}) r CROSS JOIN (SELECT DISTINCT label FROM e) l LEFT JOIN n ON n.{c} = r.{c} AND n.label = l.label"


@query(f"WITH {ORDERS_SQL}, " + _DENSE.format(c="severity", rows="SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '9-NONE']) AS severity"))
def severity_x_label(spark, sf):
    return labels.by_category(orders(spark, sf), "severity", ["1-URGENT", "2-HIGH", "3-MEDIUM", "9-NONE"])


@query(f"WITH {ORDERS_SQL}, " + _DENSE.format(c="explicitness", rows="SELECT DISTINCT explicitness FROM recs WHERE explicitness IS NOT NULL"))
def explicitness_x_label(spark, sf):
    return labels.by_category(orders(spark, sf), "explicitness")


# profiles


@query("SELECT 'lang' AS \"column\", lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY 2")
def category_counts(spark, sf):
    return profile.category_counts(table(spark, sf, "documents"), ["lang", "source"])


@query("WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT a.lang, b.source, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT lang FROM n) a CROSS JOIN (SELECT DISTINCT source FROM n) b LEFT JOIN n USING (lang, source)")
def crosstab_lang_source(spark, sf):
    return profile.crosstab(table(spark, sf, "documents"), "lang", "source")


_WORDS = f"len(regexp_extract_all(text, '[^{WS}]+'))"


@query(f"SELECT lang, count(*) AS n, quantile_cont(w, 0.5) AS median_words, quantile_cont(w, 0.25) AS q25_words, quantile_cont(w, 0.75) AS q75_words, round(stddev_samp(w), 6) AS std_words FROM (SELECT lang, {_WORDS} AS w FROM documents) GROUP BY lang")
def length_by_group(spark, sf):
    return profile.length_by_group(table(spark, sf, "documents"), "lang")


@query(f"SELECT source, median(w) < 180 AS short, coalesce(round(stddev_samp(w), 6) < 420, false) AS uniform FROM (SELECT source, {_WORDS} AS w FROM documents) GROUP BY source")
def length_flags(spark, sf):
    return profile.length_flags(table(spark, sf, "documents"), "source", least_median=180, least_std=420)


_DESCRIBED = "SELECT '{0}' AS measure, count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) AS max FROM (SELECT {1}::DOUBLE AS x FROM documents)"


@query(_DESCRIBED.format("word_count", _WORDS) + " UNION ALL " + _DESCRIBED.format("char_count", "length(text)"))
def length_describe(spark, sf):
    return profile.describe(table(spark, sf, "documents"), profile.text_lengths())


@query(" UNION ALL ".join(f"SELECT l_returnflag, {p}::DOUBLE AS p, round(quantile_cont(l_extendedprice, {p}), 6) AS value FROM lineitem GROUP BY l_returnflag" for p in (0.25, 0.5, 0.75, 0.999)))
def price_quantiles(spark, sf):
    """Exact quantiles of a measure of many different values."""
    found = distribution.quantiles(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", [0.25, 0.5, 0.75, 0.999])
    return found.withColumn("value", F.round("value", 6))


@query(
    f"""WITH x AS (SELECT lang AS g, {_WORDS}::DOUBLE AS x FROM documents), s0 AS (SELECT g, count(*) AS n, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi FROM x GROUP BY g HAVING max(x) > min(x)),
s AS (SELECT g, n, lo, hi, sd * pow(n::DOUBLE, -0.2::DOUBLE) AS bw FROM s0), h AS (SELECT g, n, lo, hi, bw, least(floor((x - lo) / (hi - lo) * 1024), 1023) AS part, count(*) AS m FROM x JOIN s USING (g) GROUP BY ALL),
k AS (SELECT g, n, bw, i::INT AS i, lo - 2 * bw + i * ((hi - lo + 4 * bw) / 99) AS at, lo + (part + 0.5::DOUBLE) * ((hi - lo) / 1024) AS mid, m FROM h, (SELECT unnest(range(100)) AS i))
SELECT g AS lang, i, round("at", 6) AS "at", round(sum(m * exp(-0.5::DOUBLE * pow(("at" - mid) / bw, 2))) / (n * bw * sqrt(2 * pi())), 9) AS density FROM k GROUP BY g, i, "at", n, bw"""
)
def length_violin(spark, sf):
    """Densities of the number of words by language."""
    d = settled(spread(table(spark, sf, "documents")).select("lang", tx.word_count(F.col("text")).alias("words")))  # read twice, a number a row
    return distribution.densities(d, "lang", "words").select("lang", "i", F.round("at", 6).alias("at"), F.round("density", 9).alias("density"))


_MATCHED = f"list_filter({TERMS!r}, lambda t: contains(coalesce(text, ''), t))"


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({_MATCHED}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 5")
def token_top(spark, sf):
    return profile.top_tokens(table(spark, sf, "documents"), tx.matched_terms(F.col("text"), TERMS), 5)


@query(f"SELECT avg(CASE WHEN len({_MATCHED}) > 0 THEN 1.0::DOUBLE ELSE 0 END) AS coverage FROM documents")
def coverage_rate(spark, sf):
    return profile.coverage(table(spark, sf, "documents"), tx.matched_terms(F.col("text"), TERMS))


@query(f"SELECT doc_id, len({_MATCHED})::BIGINT AS n_hits, array_to_string({_MATCHED}, ',') AS hits FROM documents")
def lexicon_hits(spark, sf):
    hits = tx.matched_terms(F.col("text"), TERMS)
    return table(spark, sf, "documents").select("doc_id", F.size(hits).cast("long").alias("n_hits"), F.array_join(hits, ",").alias("hits"))


_LONG_WORDS = "SELECT DISTINCT w AS term FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS w FROM documents WHERE doc_id % 50 = 0)"


@query(f"WITH lexicon AS ({_LONG_WORDS}) SELECT term, count(*) AS n_docs FROM documents d JOIN lexicon ON contains(d.text, term) GROUP BY term")
def lexicon_index(spark, sf):
    """In how many documents each long word of every fiftieth document stands: a lexicon that grows with the table."""
    d = table(spark, sf, "documents")
    words = d.where("doc_id % 50 = 0").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))).alias("term"))
    return lexicon.lexicon_matches(d, words, id="doc_id").groupBy("term").agg(F.count("*").alias("n_docs"))


# predicates

_STRIP = lambda x: f"regexp_replace({x}, '^{QUIET}+|{QUIET}+$', '', 'g')"
_RAW = "CASE doc_id % 5 WHEN 0 THEN '--- \"' || text || '\"\"' WHEN 1 THEN '  ---' || text || ' ' ELSE text END"
_NORMAL = f"""SELECT doc_id, CASE WHEN NOT starts_with(b, '---') THEN b WHEN NOT starts_with(r, '"') THEN r ELSE {_STRIP("regexp_replace(substr(r, 2), '\"+$', '')")} END AS clean
FROM (SELECT doc_id, b, {_STRIP("substr(b, 4)")} AS r FROM (SELECT doc_id, {_STRIP(_RAW)} AS b FROM documents))"""


def _raw(spark, sf):
    by = F.col("doc_id") % 5
    raw = F.when(by == 0, F.concat(F.lit('--- "'), "text", F.lit('""'))).when(by == 1, F.concat(F.lit("  ---"), "text", F.lit(" "))).otherwise(F.col("text"))
    return table(spark, sf, "documents").withColumn("text", raw)


@query(f"SELECT doc_id, md5(clean) AS clean_md5, length(clean) AS n FROM ({_NORMAL})")
def normalize_text(spark, sf):
    clean = tx.normalize_text(F.col("text"))
    return _raw(spark, sf).select("doc_id", F.md5(clean).alias("clean_md5"), F.length(clean).cast("long").alias("n"))


_PRE = f"""pre AS (SELECT doc_id, CASE WHEN f::DOUBLE / nullif(f + t, 0) > 0.10 THEN 'MIXED_SCRIPT' WHEN w < 5 THEN 'GIBBERISH_SHORT' END AS code FROM (
  SELECT doc_id, len(regexp_extract_all(clean, '[^\\x00-\\x7F]')) AS f, len(regexp_extract_all(clean, '[A-Za-z]')) AS t, len(regexp_extract_all(clean, '[A-Za-z]{{2,}}')) AS w FROM ({_NORMAL})))"""


@query(f"WITH {_PRE} SELECT doc_id, code FROM pre")
def prefilter_verdict(spark, sf):
    return _raw(spark, sf).select("doc_id", tx.prefilter_code(F.col("text"), **LATIN).alias("code"))


def _prefiltered(spark, sf):
    d = docs(spark, sf)
    code = tx.prefilter_code(F.col("text"), **LATIN)
    out = d.withColumn("codes", F.when(code.isNotNull(), F.array(code)).otherwise(F.array().cast("array<string>")))
    return out.withColumn("verdict", judge.verdict(F.col("codes")))


_JUDGED = f"""WITH {DOCS_SQL}, {_PRE.replace(f'({_NORMAL})', f'(SELECT id AS doc_id, {_STRIP("text")} AS clean FROM docs)')}, j AS (SELECT id, labels, platform, code, code IS NOT NULL AS bad FROM docs JOIN pre ON id = doc_id)"""


@query(
    _JUDGED
    + """, r AS (
  SELECT 'total' AS kind, 'generated' AS name, count(*)::BIGINT AS n, count(*) AS o FROM j
  UNION ALL SELECT 'total', 'accepted', count(*) FILTER (WHERE NOT bad), count(*) FROM j
  UNION ALL SELECT 'total', 'rejected', count(*) FILTER (WHERE bad), count(*) FROM j
  UNION ALL SELECT 'code', code, count(*), count(*) FROM j WHERE bad GROUP BY code
  UNION ALL SELECT 'platform', coalesce(platform, 'unknown'), count(*) FILTER (WHERE bad), count(*) FROM j GROUP BY 2
  UNION ALL SELECT 'label', label, count(*) FILTER (WHERE bad), count(*) FROM (SELECT unnest(labels) AS label, bad FROM j) GROUP BY 2)
SELECT kind, name, n, round(n::DOUBLE / (SELECT count(*) FROM j), 6) AS share_of_total, round(n::DOUBLE / o, 6) AS rate FROM r"""
)
def prefilter_metrics(spark, sf):
    return judge.filter_metrics(_prefiltered(spark, sf))


@query(
    _JUDGED
    + """, c AS (SELECT code, count(*) AS n, min(id) AS f FROM j WHERE bad GROUP BY code ORDER BY n DESC, f LIMIT 1), t AS (SELECT count(*) FILTER (WHERE bad)::DOUBLE / count(*) AS r FROM j)
SELECT round(r, 6) AS rejection_rate, code AS dominant_code, 'none' AS action, 0.75::DOUBLE AS recommended_temperature, CAST(NULL AS VARCHAR) AS prompt_injection FROM t LEFT JOIN c ON true"""
)
def judge_feedback(spark, sf):
    return judge.feedback(_prefiltered(spark, sf), 0.75)


_ACCEPT = f"""length(text) >= 25 AND len(regexp_extract_all(text, '[A-Za-z]')) >= 12 AND NOT regexp_matches(lower(text), 'token|idiot|licensed under|output:')
  AND NOT regexp_matches(text, '[ÄÖÜ]') AND NOT regexp_matches(text, 'thereof|hereby') AND NOT regexp_matches(regexp_replace(text, '[ .]+$', ''), '(the|der)\\z') AND NOT regexp_matches(text, '(and and)|([!]{{2,}}\\z)')"""


@query(f"SELECT doc_id, {_ACCEPT} AS accepted FROM documents")
def accept_gate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.accept_gate(F.col("text"), **GATE).alias("accepted"))


_LIST = f"regexp_extract_all(text, '[^{WS}]+')"


@query(
    f"""SELECT doc_id, length(text) >= 30 AND len(regexp_extract_all(text, '[A-Za-z]')) >= 15 AND NOT regexp_matches(lower(text), 'token|idiot|here is|output:')
  AND len(list_filter(w, lambda x: regexp_full_match(x, '[A-Z][a-z]{{11,}}'))) <= 3 AND len(list_filter(list_zip(w, w[2:]), lambda p: p[1] = p[2] AND length(p[1]) > 1)) = 0 AS valid
FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce({_LIST}, []) AS w FROM documents)"""
)
def valid_gate(spark, sf):
    gate = tx.valid_gate(F.col("text"), letters="[A-Za-z]", forbidden=["token", "idiot"], phrases=["here is", "output:"], foreign_word="^[A-Z][a-z]{11,}$")
    return spread(table(spark, sf, "documents")).select("doc_id", gate.alias("valid"))


@query(ORACLE_SQL["valid_gate"])
def valid_gate_whole(spark, sf):
    """The same, under the name that it had while valid_gate left out long documents."""
    return valid_gate(spark, sf)


@query(
    f"""WITH t AS (SELECT *, lead(text) OVER w AS polished, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT *, {_WORDS} AS rw, len(regexp_extract_all(polished, '[^{WS}]+')) AS pw FROM t WHERE role = 'user' AND next_role = 'assistant')
SELECT conv_id, turn, length(polished) >= 15 AND len(regexp_extract_all(polished, '[A-Za-z]')) >= 10 AND NOT regexp_matches(polished, '[ÄÖÜ]') AND NOT regexp_matches(lower(polished), 'licensed under|output:')
  AND NOT (rw > 3 AND pw < rw * 0.3::DOUBLE) AND pw <= rw * 2.5::DOUBLE AND NOT regexp_matches(polished, 'thereof|hereby') AND NOT regexp_matches(polished, '(and and)|([!]{{2,}}\\z)') AS polished_ok FROM p"""
)
def polish_gate(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").withColumns({"polished": F.lead("text").over(w), "next_role": F.lead("role").over(w)}).where("role = 'user' and next_role = 'assistant'")
    ok = tx.polish_gate(F.col("text"), F.col("polished"), letters="[A-Za-z]", points="[ÄÖÜ]", meta=GATE["meta"], archaic=GATE["archaic"], broken=GATE["broken"])
    return t.select("conv_id", "turn", ok.alias("polished_ok"))


@query(
    f"""SELECT doc_id, greatest(0, 10 - CASE WHEN length(text) < 40 THEN 3 ELSE 0 END - CASE WHEN length(text) > 450 THEN 3 ELSE 0 END - CASE WHEN len({_MATCHED}) > 3 THEN 3 ELSE 0 END
  - CASE WHEN len({_MATCHED}) > 5 THEN 3 ELSE 0 END - CASE WHEN length(text) - length(replace(text, ':', '')) > 1 THEN 2 ELSE 0 END - CASE WHEN regexp_matches(text, '^["''“‘]') THEN 2 ELSE 0 END
  - CASE WHEN {_WORDS} < 5 THEN 3 ELSE 0 END) / 10.0::DOUBLE AS score FROM documents"""
)
def quality_score(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.quality_score(F.col("text"), TERMS).alias("score"))


_FIRST = f"coalesce({_LIST}[1], '')"


@query(f"SELECT doc_id, CASE WHEN {_FIRST} IN ('Der', 'The') OR (starts_with({_FIRST}, 'T') AND length({_FIRST}) > 3 AND regexp_matches({_FIRST}, '(ing|ed)\\z')) OR {_FIRST} IN ('What', 'Was') THEN 'clause' ELSE 'verb' END AS shape FROM documents")
def phrase_shape(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.phrase_shape(F.col("text"), ["Der", "The"], ["What", "Was"], "T", ["ing", "ed"]).alias("shape"))


_MARKED = "CASE item_id % 3 WHEN 0 THEN '\"' || replace(text, '. ', chr(10) || '(') || '\"' WHEN 1 THEN ' ' || replace(text, '. ', chr(10)) ELSE text END"


@query(
    f"""WITH m AS (SELECT item_id, {_STRIP(_MARKED)} AS t FROM benchmark), q AS (SELECT item_id, CASE WHEN regexp_full_match(t, '(?s)["''“].*["''”]') AND length(t) >= 2 THEN {_STRIP("substr(t, 2, length(t) - 2)")} ELSE t END AS t FROM m)
SELECT item_id, trim(regexp_replace(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '^{QUIET}*(\\(|\\z)')), ' '), '{QUIET}+', ' ', 'g')) AS bare FROM q"""
)
def meta_line_strip(spark, sf):
    by = F.col("item_id") % 3
    line = F.replace(F.col("text"), F.lit(". "), F.lit("\n"))
    marked = F.when(by == 0, F.concat(F.lit('"'), F.replace(F.col("text"), F.lit(". "), F.lit("\n(")), F.lit('"'))).when(by == 1, F.concat(F.lit(" "), line)).otherwise(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", tx.strip_meta_lines(marked).alias("bare"))


# curation

_KEY_SQL = f"lower(trim(regexp_replace(coalesce(text, ''), '{QUIET}+', ' ', 'g')))"


@query(
    f"""WITH s AS (SELECT d.doc_id, score, {_KEY_SQL} AS key FROM documents d JOIN ({ORACLE_SQL["valid_gate"]}) v USING (doc_id) JOIN ({ORACLE_SQL["quality_score"]}) q USING (doc_id) WHERE valid AND score >= 0.5)
SELECT doc_id AS id, score FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1) ORDER BY id LIMIT 500"""
)
def quality_cut(spark, sf):
    """A target of 500 rows, as they come, of valid new texts that score 0.5 or more."""
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    gate = tx.valid_gate(F.col("text"), letters="[A-Za-z]", forbidden=["token", "idiot"], phrases=["here is", "output:"], foreign_word="^[A-Z][a-z]{11,}$")
    return curate.first_good(d.where(gate).withColumn("score", tx.quality_score(F.col("text"), TERMS)), "score", 500).select("id", "score")


@query(f"WITH {DOCS_SQL} SELECT id, platform AS persona, example_type AS event_type FROM docs")
def record_aliases(spark, sf):
    return with_aliases(docs(spark, sf)).select("id", "persona", "event_type")

_KEY = f"lower(trim(regexp_replace(coalesce(text, ''), '{QUIET}+', ' ', 'g')))"
_PREFIX = f"array_to_string({_LIST}[1:3], ' ')"


@query(f"SELECT doc_id AS id, source FROM documents QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) = 1")
def dedup_first(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    return curate.dedup_first(d).select("id", "source")


@query(f"SELECT doc_id AS id, {_PREFIX} AS prefix FROM documents QUALIFY row_number() OVER (PARTITION BY {_PREFIX} ORDER BY doc_id) <= 2")
def prefix_cap(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    return curate.prefix_cap(d, 2).select("id", tx.first_words(F.col("text")).alias("prefix"))


@query("SELECT doc_id AS id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10")
def type_quota(spark, sf):
    return curate.type_quota(table(spark, sf, "documents").withColumnRenamed("doc_id", "id"), 10, "source").select("id", "source")


@query("SELECT doc_id AS id, printf('syn_%04d', row_number() OVER (ORDER BY doc_id) - 1) AS row_id FROM documents")
def row_ids(spark, sf):
    return curate.numbered(table(spark, sf, "documents").withColumnRenamed("doc_id", "id")).select("id", "row_id")


@query()
def curated_by_type(spark, sf):
    d = table(spark, sf, "documents").withColumnsRenamed({"doc_id": "id", "lang": "example_type"})
    return curate.curate(d, {"en": 300, "de": 60, "fr": 60, "es": 60}, 3).select("id", "example_type")


# verdicts


@query("SELECT doc_id, 'v2:' || sha1(coalesce(text, '')) AS cache_key FROM documents")
def cache_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.cache_key(F.col("text")).alias("cache_key"))


def _stub(rows: DataFrame) -> DataFrame:
    """A seeded scorer: half of the texts that reach it are rejected."""
    u = tx.hash_uniform(F.lit("stub"), F.col("cache_key"))
    return rows.select("cache_key", F.when(u < 0.5, F.array(F.lit("INCOHERENT"))).otherwise(F.array().cast("array<string>")).alias("codes"))


@query(
    f"""WITH k AS (SELECT doc_id, 'v2:' || sha1(text) AS key FROM documents), pre0 AS (SELECT doc_id, {_STRIP('text')} AS clean FROM documents), {_PRE.replace(f'({_NORMAL})', 'pre0')},
cached AS (SELECT DISTINCT 'v2:' || sha1(text) AS key FROM documents WHERE doc_id % 3 = 0)
SELECT k.doc_id, coalesce(pre.code, CASE WHEN cached.key IS NOT NULL THEN 'LABEL_MISMATCH' WHEN {UNIFORM.format("'stub:' || k.key")} < 0.5 THEN 'INCOHERENT' ELSE '' END) AS codes,
  CASE WHEN coalesce(pre.code, CASE WHEN cached.key IS NOT NULL THEN 'LABEL_MISMATCH' WHEN {UNIFORM.format("'stub:' || k.key")} < 0.5 THEN 'INCOHERENT' ELSE '' END) = '' THEN 'ACCEPT' ELSE 'REJECT' END AS verdict
FROM k JOIN pre USING (doc_id) LEFT JOIN cached ON cached.key = k.key"""
)
def cache_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    cached = d.where("doc_id % 3 = 0").select(tx.cache_key(F.col("text")).alias("cache_key")).distinct().withColumn("codes", F.array(F.lit("LABEL_MISMATCH")))
    out, _ = judge.settle(d, cached, _stub, **LATIN)
    return out.select("doc_id", F.array_join("codes", ",").alias("codes"), "verdict")


def _rubrics(spark, sf):
    score = lambda k: (F.col("n_chars") + F.col("doc_id") * k) % 6
    raw = F.format_string(
        '```json\n{"reasoning": "r", "scores": {"naturalness": %d, "idiomaticity": %d, "register_fit": %d, "label_grounding": %d, "coherence": %d}, "clinical_leak": %s, "slang_natural": %s}\n```',
        *(score(k) + 1 for k in (1, 2, 3, 5, 7)), F.when(F.col("doc_id") % 7 == 0, "true").otherwise("false"), F.when(F.col("doc_id") % 5 == 0, "false").otherwise("true"),
    )
    broken = F.when(F.col("doc_id") % 11 == 3, "no object here").when(F.col("doc_id") % 11 == 5, "{bad}").otherwise(raw)
    return table(spark, sf, "documents").select("doc_id", broken.alias("raw"))


@query(
    """WITH s AS (SELECT doc_id, (n_chars + doc_id * 1) % 6 + 1 AS a, (n_chars + doc_id * 2) % 6 + 1 AS b, (n_chars + doc_id * 3) % 6 + 1 AS c, (n_chars + doc_id * 5) % 6 + 1 AS d, (n_chars + doc_id * 7) % 6 + 1 AS e FROM documents),
k AS (SELECT doc_id, CASE WHEN doc_id % 11 IN (3, 5) THEN 'GIBBERISH_SHORT' ELSE array_to_string(list_filter([CASE WHEN a < 4 THEN 'LOW_NATURALNESS' END, CASE WHEN b < 4 THEN 'TRANSLATIONESE' END,
  CASE WHEN c < 4 THEN 'UNNATURAL_ROBOTIC' END, CASE WHEN d < 4 THEN 'LABEL_MISMATCH' END, CASE WHEN e < 4 THEN 'INCOHERENT' END, CASE WHEN doc_id % 7 = 0 THEN 'CLINICAL_LEAK' END, CASE WHEN doc_id % 5 = 0 THEN 'SLANG_MISUSE' END], lambda x: x IS NOT NULL), ',') END AS codes FROM s)
SELECT doc_id, codes, CASE WHEN codes = '' THEN 'ACCEPT' ELSE 'REJECT' END AS verdict FROM k"""
)
def rubric_verdict(spark, sf):
    return judge.rubric_verdicts(_rubrics(spark, sf)).select("doc_id", F.array_join("codes", ",").alias("codes"), "verdict")


# splits

_SPLIT = ("WITH {0}, g AS (SELECT id, labels, array_to_string(list_sort(labels), '|') AS s FROM {1}), f AS (SELECT id, labels, CASE WHEN row_number() OVER (PARTITION BY s ORDER BY md5('1240:' || id), id) "
          "<= floor(count(*) OVER (PARTITION BY s) * 0.25::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS fold FROM g)")  # fmt: skip
_RATIOS = ", r AS (SELECT label, count(*) AS total, count(*) FILTER (WHERE fold = 'train') AS train, count(*) FILTER (WHERE fold = 'test') AS test FROM (SELECT unnest(labels) AS label, fold FROM f) GROUP BY label)"
_JS = """, z AS (SELECT greatest(count(*) FILTER (WHERE fold = 'train'), 1) AS ntr, greatest(count(*) FILTER (WHERE fold = 'test'), 1) AS nte FROM f),
p AS (SELECT train / ntr + 1e-12 AS p, test / nte + 1e-12 AS q FROM r, z), s AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM p),
js AS (SELECT round(coalesce((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2, 0), 9) AS js FROM s)"""


@query(_SPLIT.format(DOCS_SQL, "docs") + " SELECT id, fold FROM f")
def strat_split(spark, sf):
    return split.stratified_split(docs(spark, sf)).select("id", "fold")


@query(_SPLIT.format(ORDERS_SQL, "recs") + " SELECT id, fold FROM f")
def strat_split_orders(spark, sf):
    return split.stratified_split(orders(spark, sf)).select("id", "fold")


@query(_SPLIT.format(DOCS_SQL, "docs") + _RATIOS + " SELECT label, total, train, test, round(train / total, 6) AS train_share FROM r")
def split_ratios(spark, sf):
    return split.fold_counts(split.stratified_split(docs(spark, sf)))


@query(_SPLIT.format(DOCS_SQL, "docs") + _RATIOS + _JS + " SELECT js FROM js")
def js_divergence(spark, sf):
    return split.js_divergence(split.stratified_split(docs(spark, sf)))


@query(
    _SPLIT.format(DOCS_SQL, "docs")
    + _RATIOS
    + _JS
    + """, b AS (SELECT coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE test = 0), '') AS absent, coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE NOT train / total BETWEEN 0.65::DOUBLE AND 0.85::DOUBLE), '') AS out_of_band FROM r)
SELECT absent, out_of_band, js, absent = '' AND out_of_band = '' AND js < 0.05 AS passed FROM b, js"""
)
def split_gates(spark, sf):
    return split.gates(split.stratified_split(docs(spark, sf)))


@query(
    _SPLIT.format(ORDERS_SQL, "recs")
    + _RATIOS
    + _JS
    + " SELECT 1240 AS seed, 0.25::DOUBLE AS test_size, count(*) AS n_total, count(*) FILTER (WHERE fold = 'train') AS n_train, count(*) FILTER (WHERE fold = 'test') AS n_test, round(count(*) FILTER (WHERE fold = 'test') / count(*), 6) AS actual_test_ratio, min(js) AS js FROM f, js"
)
def split_manifest(spark, sf):
    return split.manifest(split.stratified_split(orders(spark, sf)))


@query("SELECT o_orderkey AS id, CASE WHEN row_number() OVER (ORDER BY md5('1240:' || o_orderkey), o_orderkey) <= greatest(1, floor((SELECT count(*) FROM orders) * 0.25::DOUBLE)) THEN 'test' ELSE 'train' END AS fold FROM orders")
def random_split(spark, sf):
    return split.random_split(table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id"))


@query("SELECT o_orderkey AS id, CASE WHEN row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) <= greatest(1, ceil((SELECT count(*) FROM orders) * 0.15::DOUBLE)) THEN 'test' ELSE 'train' END AS fold FROM orders")
def validation_split(spark, sf):
    return split.random_split(table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id"), 0.15, 7, True)


@query()
def greedy_split(spark, sf):
    return split.stratified_split(docs(spark, sf), greedy=True).select("id", "fold")


@query(
    f"""WITH {EVENTS_SQL}, p AS (SELECT x.label AS a, y.label AS b FROM (SELECT id, unnest(labels) AS label FROM days) x JOIN (SELECT id, unnest(labels) AS label FROM days) y ON x.id = y.id AND x.label < y.label)
SELECT a, b, count(*) AS total, true AS in_band FROM p GROUP BY ALL HAVING count(*) >= 20"""
)
def pair_shares(spark, sf):
    """Pairs of labels of 20 rows or more, and whether the greedy split leaves 65 to 85 % of each to the train fold, as it must."""
    share = 1 - F.col("test") / F.col("total")
    return split.pair_counts(split.greedy_split(events(spark, sf))).where("total >= 20").select("a", "b", "total", share.between(*split.SHARE_BAND).alias("in_band"))


# seeded choice

_ID = "CAST(doc_id AS VARCHAR)"


@query(f"SELECT doc_id, {[*lex.PLATFORMS]!r}[CAST(floor({UNIFORM.format(f'''chr(112) || ':' || {_ID}''')} * 4) AS INTEGER) + 1] AS picked FROM documents")
def bank_pick(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.pick(lex.PLATFORMS, F.lit("p"), F.col("doc_id")).alias("picked"))


_EDGES = [sum(lex.LABEL_SET_WEIGHTS[: i + 1]) for i in range(len(lex.LABEL_SET_WEIGHTS))]


@query(f"SELECT doc_id, len(list_filter({_EDGES!r}, lambda e: e <= {UNIFORM.format(f'''chr(119) || ':' || {_ID}''')} * {_EDGES[-1]}))::INTEGER AS picked FROM documents")
def weighted_pick(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.weighted_pick(lex.LABEL_SETS, lex.LABEL_SET_WEIGHTS, F.lit("w"), F.col("doc_id")).alias("picked"))


@query(f"SELECT doc_id, {UNIFORM.format(f'''chr(98) || ':' || {_ID}''')} < 0.2 AS chosen FROM documents")
def bernoulli_pick(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (tx.hash_uniform(F.lit("b"), F.col("doc_id")) < 0.2).alias("chosen"))


def _banked(bank: str, key: str, size: str) -> str:
    """One of a list in SQL, by a seeded key."""
    return f"({bank})[CAST(floor({UNIFORM.format(key)} * {size}) AS INTEGER) + 1]"


_PLAN_KEY = "'plan-1:{0}:' || row".format
_TYPE_EDGES = [round(sum(s[0] for s in list(synthetic.TYPES.values())[: i + 1]), 9) for i in range(len(synthetic.TYPES))]
_TYPED = lambda at, salt: "CASE example_type " + " ".join(f"WHEN '{k}' THEN {_banked(repr(v[at]), _PLAN_KEY(salt), len(v[at]))}" for k, v in synthetic.TYPES.items()) + " END"
_PLAN_SQL = f"""n AS (SELECT count(*) AS n FROM documents), places AS (SELECT unnest(range(n)) AS row, n FROM n),
typed AS (SELECT row, CASE {' '.join(f"WHEN row / n < {e}::DOUBLE - 1e-12 THEN '{k}'" for k, e in zip(list(synthetic.TYPES)[:-1], _TYPE_EDGES))} ELSE '{list(synthetic.TYPES)[-1]}' END AS example_type FROM places),
plan AS (
  SELECT row, example_type, CASE WHEN example_type = 'hard_negative' OR example_type = 'ambiguous' AND {UNIFORM.format(_PLAN_KEY('has'))} <= 0.4::DOUBLE THEN CAST([] AS VARCHAR[])
      ELSE {[list(s) for s in lex.LABEL_SETS]!r}[len(list_filter({_EDGES!r}, lambda e: e <= {UNIFORM.format(_PLAN_KEY('labels'))} * {_EDGES[-1]})) + 1] END AS labels,
    {_banked(repr([*lex.PLATFORMS]), _PLAN_KEY('platform'), len(lex.PLATFORMS))} AS platform, {_TYPED(2, 'explicitness')} AS explicitness, {_TYPED(1, 'severity')} AS severity, {_TYPED(3, 'slang')} AS slang_level,
    {UNIFORM.format(_PLAN_KEY('context'))} < CASE example_type {' '.join(f"WHEN '{k}' THEN {v[4]}::DOUBLE" for k, v in synthetic.TYPES.items())} END AS military_context
  FROM typed)"""


@query(f"WITH {_PLAN_SQL} SELECT row, example_type, array_to_string(labels, '|') AS label_set, platform, explicitness, severity, slang_level, military_context FROM plan")
def scenario_plan(spark, sf):
    """As many scenarios as there are documents."""
    plan = synthetic.scenarios(spark, table(spark, sf, "documents").count())
    return plan.withColumn("label_set", F.array_join("labels", "|")).drop("labels")


@query()
def synthetic_records(spark, sf):
    plan = synthetic.scenarios(spark, table(spark, sf, "documents").count())
    behaviours = {s[0]: [f"{s[0].replace('_', ' ')} {w}" for w in ("at night", "at work", "again")] for s in lex.LABEL_SETS[:8]}
    return synthetic.composed(plan, ["Lately", "Since I came back", "These days"], behaviours, ["that is all", "no idea why"])


#: Of generated records: words of a text, share of the table that each type wants, and the cap of opening words.
_OPENING, _WANTED, _CAP = 14, {"en": 4, "fr": 20, "de": 25}, 3
_GIVEN = f"""bank AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n, lang, array_to_string(list_slice(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> ''), 1, {_OPENING}), ' ') AS text FROM documents),
n AS (SELECT count(*) AS n FROM documents), kinds AS (SELECT unnest({list(_WANTED)!r}) AS kind, unnest({list(_WANTED.values())!r}) AS part),
tries AS (SELECT kind, n // part AS quota, n, unnest(range(8 * (n // part))) AS attempt FROM kinds, n),
made AS (SELECT kind, quota, attempt, b.text, lower(b.text) AS norm, array_to_string(list_slice(string_split(b.text, ' '), 1, 3), ' ') AS prefix FROM tries t JOIN bank b ON b.place = floor({UNIFORM.format("'draw:' || kind || ':' || attempt")} * t.n)::BIGINT WHERE lang = kind AND length(b.text) >= 25)"""


def _taken_sql() -> str:
    """A query for each type over those before it."""
    parts, names = [], []
    for k, kind in enumerate(_WANTED):
        before = " UNION ALL ".join(f"SELECT norm, prefix FROM g{j}" for j in names)
        new = f"SELECT *, row_number() OVER (PARTITION BY norm ORDER BY attempt) AS first FROM made WHERE kind = '{kind}'" + (f" AND norm NOT IN (SELECT norm FROM ({before}))" if before else "")
        used = f"coalesce((SELECT count(*) FROM ({before}) b WHERE b.prefix = r.prefix), 0)" if before else "0"
        parts.append(f"g{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY attempt) AS nth FROM ({new}) WHERE first = 1) r WHERE nth + {used} <= {_CAP} QUALIFY row_number() OVER (ORDER BY attempt) <= quota)")
        names.append(k)
    return ", ".join(parts) + ", every AS (" + " UNION ALL ".join(f"SELECT {k} AS k, kind, attempt, text FROM g{k}" for k in names) + ")"


@query(f"WITH {_GIVEN}, {_taken_sql()} SELECT format('syn_{{:04d}}', row_number() OVER (ORDER BY k, attempt) - 1) AS id, kind AS example_type, attempt, text FROM every")
def generated_by_quota(spark, sf):
    """Records drawn from the documents' openings until each type has its share of the table, or eight attempts were made for each that it wants."""
    d = spread(table(spark, sf, "documents"))
    words = F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: w != "")
    bank = curate.numbered(d.select("doc_id", "lang", F.array_join(F.slice(words, 1, _OPENING), " ").alias("text")), "doc_id", "%d", "place").withColumn("place", F.col("place").cast("long"))
    bank = settled(bank.select("place", "lang", "text"))
    n = bank.count()

    def make(rows):
        at = F.floor(tx.hash_uniform(F.lit("draw"), F.col("example_type"), F.col("attempt")) * n).cast("long")
        return rows.withColumn("place", at).join(bank.hint("merge"), "place").where("lang = example_type").select("example_type", "attempt", "text")

    quotas = {k: n // part for k, part in _WANTED.items()}
    return generate.generate(spark, folder(spark), quotas, make, F.length("text") >= 25, _CAP).select("id", "example_type", "attempt", "text")


# features and models

_TERMS = """t AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents),
g AS (SELECT id, unnest(w) AS term FROM t UNION ALL SELECT id, w[i] || ' ' || w[i + 1] FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM t WHERE len(w) > 1)),
c AS (SELECT id, term, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95::DOUBLE * (SELECT n FROM n))"""


@query(f"WITH {_TERMS} SELECT term, df FROM v")
def vocab(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    return features.vocabulary(d, d.count())


@query(
    f"""WITH {_TERMS}, w AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w FROM c JOIN v USING (term), n)
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 8) AS weight FROM w"""
)
def tfidf_terms(spark, sf):
    return features.tfidf(table(spark, sf, "documents").withColumnRenamed("doc_id", "id")).withColumn("weight", F.round("weight", 8))


_BY = "k AS (SELECT label, count(*) FILTER (WHERE proba >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE proba >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE proba < 0.5 AND y = 1) AS fn FROM scores GROUP BY label), m AS (SELECT *, tp + fn AS support, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM k)"


@query(f"WITH {SCORES_SQL}, {_BY} SELECT coalesce(sum(tp) / nullif(sum(tp + fp), 0), 0) AS precision_micro, coalesce(sum(tp) / nullif(sum(tp + fn), 0), 0) AS recall_micro, coalesce(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 0) AS f1_micro, round(avg(precision), 9) AS precision_macro, round(avg(recall), 9) AS recall_macro, round(avg(f1), 9) AS f1_macro FROM m")
def prf_metrics(spark, sf):
    return model.metrics(scores(spark, sf))


@query(
    f"""WITH {SCORES_SQL}, {_BY}, s AS (SELECT id, count(*) FILTER (WHERE proba >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE proba >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE proba < 0.5 AND y = 1) AS fn FROM scores GROUP BY id),
r AS (SELECT label AS row, precision, recall, f1, support FROM m
UNION ALL SELECT 'avg/micro', sum(tp) / sum(tp + fp), sum(tp) / sum(tp + fn), 2 * sum(tp) / sum(2 * tp + fp + fn), sum(support)::BIGINT FROM m
UNION ALL SELECT 'avg/macro', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM m
UNION ALL SELECT 'avg/weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM m
UNION ALL SELECT 'avg/samples', avg(coalesce(tp / nullif(tp + fp, 0), 0)), avg(coalesce(tp / nullif(tp + fn, 0), 0)), avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), sum(tp + fn)::BIGINT FROM s)
SELECT row, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM r"""
)
def per_label_report(spark, sf):
    return model.report(scores(spark, sf))


@query(
    f"""WITH {SCORES_SQL}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold),
k AS (SELECT label, threshold, count(*) FILTER (WHERE proba >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE proba >= threshold AND y = 0) AS fp, count(*) FILTER (WHERE proba < threshold AND y = 1) AS fn FROM scores, t GROUP BY ALL)
SELECT label, threshold, round(f1, 9) AS f1 FROM (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM k) QUALIFY row_number() OVER (PARTITION BY label ORDER BY f1 DESC, threshold) = 1"""
)
def threshold_search(spark, sf):
    return model.threshold_search(scores(spark, sf))


@query(
    f"""WITH {_TERMS}, {DOCS_SQL}, sets AS (SELECT id, array_to_string(list_sort(labels), '|') AS s FROM docs),
f AS (SELECT id, CASE WHEN row_number() OVER (PARTITION BY s ORDER BY md5('1240:' || id), id) <= floor(count(*) OVER (PARTITION BY s) * 0.25::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS fold FROM sets),
seen AS (SELECT count(*) AS rows FROM f WHERE fold = 'train'),
known AS (SELECT term, count(*) AS df FROM c JOIN f USING (id) WHERE fold = 'train' GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95::DOUBLE * (SELECT rows FROM seen)),
w AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0::DOUBLE + seen.rows) / (1 + df)) + 1) AS w FROM c JOIN f USING (id) JOIN known USING (term), seen WHERE fold = 'test')
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 8) AS weight FROM w"""
)
def tfidf_unseen(spark, sf):
    """The test fold's texts by the vocabulary and frequencies of the train fold."""
    d = docs(spark, sf)
    folded = d.join(settled(split.stratified_split(d).select("id", "fold")), "id")
    train = folded.where("fold = 'train'")
    n = train.count()
    known = features.vocabulary(train, n)
    return features.tfidf(folded.where("fold = 'test'"), fitted=known, n_rows=n).withColumn("weight", F.round("weight", 8))


@query(f"WITH {SCORES_SQL} SELECT id, label, CASE WHEN proba >= 0.5 THEN proba ELSE 0.0 END AS score FROM scores")
def dense_scores(spark, sf):
    """Only confident scores are found; every other pair of document and label has 0."""
    found = scores(spark, sf).where("proba >= 0.5").withColumnRenamed("proba", "score")
    return model.dense_scores(found, docs(spark, sf), CLASSES)


@query()
def ovr_logreg(spark, sf):
    d = docs(spark, sf)
    return model.one_vs_rest(features.tfidf_cells(d), d, CLASSES, None)


@query(
    f"WITH {DOCS_SQL}, s AS (SELECT id, label, {UNIFORM.format(chr(39) + 'zero-shot:' + chr(39) + chr(32) + '|| label || chr(58) || id')} AS score FROM docs, (SELECT unnest({CLASSES!r}) AS label)) SELECT id, label, score, (score >= 0.5)::INTEGER AS predicted FROM s"
)
def zero_shot_stub(spark, sf):
    return model.zero_shot(docs(spark, sf), CLASSES)


@query(
    f"""WITH {SCORES_SQL}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold),
c AS (SELECT label, threshold, count(*) FILTER (WHERE proba >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE proba >= threshold AND y = 0) AS fp, count(*) FILTER (WHERE proba < threshold AND y = 1) AS fn FROM scores, t GROUP BY ALL),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS q, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM c),
m AS (SELECT 'plain' AS model, * FROM r WHERE threshold = 0.5 UNION ALL SELECT 'tuned', * FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY f DESC, threshold) = 1),
w AS (SELECT model, coalesce(sum(tp) / nullif(sum(tp + fp), 0), 0) AS precision_micro, coalesce(sum(tp) / nullif(sum(tp + fn), 0), 0) AS recall_micro, coalesce(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 0) AS f1_micro,
  round(avg(p), 9) AS precision_macro, round(avg(q), 9) AS recall_macro, round(avg(f), 9) AS f1_macro FROM m GROUP BY model)
SELECT model, metric, value FROM w UNPIVOT (value FOR metric IN (precision_micro, recall_micro, f1_micro, precision_macro, recall_macro, f1_macro))"""
)
def metrics_comparison(spark, sf):
    s = scores(spark, sf)
    tuned = model.threshold_search(s).select("label", "threshold")
    return model.comparison({"plain": model.metrics(s), "tuned": model.metrics(s, tuned)})


@query(f"WITH {DOCS_SQL}, m AS (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM docs) GROUP BY label) SELECT arg_min(label, (n, label)) AS rarest_label, min(n) AS rarest_n, arg_max(label, (n, label)) AS top_label, max(n) AS top_n, count(*) AS n_labels FROM m")
def label_extremes(spark, sf):
    from .report import extremes

    return extremes(labels.marginals(docs(spark, sf)))


@query(
    f"""WITH b AS (SELECT unnest({TERMS!r}) AS x), o AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || ':' || x), x) AS r FROM documents, b)
SELECT doc_id, string_agg(x, ',' ORDER BY r) AS picked FROM o WHERE r <= 3 GROUP BY doc_id"""
)
def sample_without_replacement(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(synthetic.sampled(TERMS, 3, F.col("doc_id")), ",").alias("picked"))


@query(
    f"""WITH {DOCS_SQL} SELECT id, md5('Text:' || chr(10) || platform || '/' || example_type || chr(10) || chr(10) || 'Platform:' || chr(10) || platform
  || CASE WHEN len(labels) > 0 THEN chr(10) || chr(10) || 'Labels:' || chr(10) || array_to_string(labels, ', ') ELSE '' END) AS prompt_md5 FROM docs"""
)
def prompt_sections(spark, sf):
    d = docs(spark, sf)
    body = prompts.sections(prompts.section("Text", F.concat_ws("/", "platform", "example_type")), prompts.section("Platform", F.col("platform")), prompts.section("Labels", F.array_join("labels", ", ")))
    return d.select("id", F.md5(body).alias("prompt_md5"))


_ANSWER = '{"reasoning": "...", "scores": {"naturalness": 1-5, "idiomaticity": 1-5, "register_fit": 1-5, "label_grounding": 1-5, "coherence": 1-5}, "clinical_leak": true|false, "slang_natural": true|false}'


@query(
    f"""WITH {DOCS_SQL} SELECT id, array_to_string(list_filter([CASE WHEN text <> '' THEN 'Text:' || chr(10) || text END, CASE WHEN platform <> '' THEN 'Platform:' || chr(10) || platform END,
  CASE WHEN len(labels) > 0 THEN 'Labels:' || chr(10) || array_to_string(labels, ', ') END, 'Answer with:' || chr(10) || '{_ANSWER}'], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS prompt FROM docs"""
)
def judge_prompts(spark, sf):
    d = docs(spark, sf)
    return d.select("id", prompts.judge_prompt(F.col("text"), F.col("labels"), F.col("platform")).alias("prompt"))


@query(f"WITH {ORDERS_SQL} SELECT id, CASE WHEN len(labels) = 0 THEN '__NEG__' ELSE array_to_string(labels, '|') END AS label_set FROM recs")
def negative_class(spark, sf):
    return labels.with_negative(orders(spark, sf)).select("id", F.array_join("labels", "|").alias("label_set"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey ORDER BY n DESC, id LIMIT 20")
def top_orders(spark, sf):
    return profile.top_tokens(table(spark, sf, "lineitem"), F.array(F.col("l_orderkey").cast("string")), 20).withColumnRenamed("token", "id")


@query(f"SELECT {_PREFIX} AS prefix, count(*) AS n FROM documents GROUP BY 1")
def prefix_frequency(spark, sf):
    return table(spark, sf, "documents").groupBy(tx.first_words(F.col("text")).alias("prefix")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('shuffle:' || doc_id), doc_id) - 1 AS place FROM documents")
def global_shuffle(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws(":", F.md5(F.concat_ws(":", F.lit("shuffle"), F.col("doc_id").cast("string"))), F.lpad(F.col("doc_id").cast("string"), 20, "0")).alias("key"))
    return curate.numbered(d, "key", "%d", "place").select("doc_id", F.col("place").cast("long").alias("place"))


_BARE = f"""trim(regexp_replace(array_to_string(list_filter(regexp_split_to_array(t, '\\r\\n|[\\n\\r]'), lambda x: NOT regexp_matches(x, '^{QUIET}*(\\(|\\z)')), ' '), '{QUIET}+', ' ', 'g'))"""


@query(
    f"""WITH c AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations), u AS (SELECT conv_id, turn, text, answer, {_STRIP("coalesce(answer, '')")} AS t FROM c WHERE role = 'user'),
q AS (SELECT conv_id, turn, text, answer, CASE WHEN regexp_full_match(t, '(?s)["''“].*["''”]') AND length(t) >= 2 THEN {_STRIP("substr(t, 2, length(t) - 2)")} ELSE t END AS t FROM u),
p AS (SELECT *, {_BARE} AS polished FROM q), w AS (SELECT *, {_WORDS} AS rw, len(regexp_extract_all(polished, '[^{WS}]+')) AS pw FROM p)
SELECT conv_id, turn, CASE WHEN answer IS NOT NULL AND length(polished) >= 15 AND len(regexp_extract_all(polished, '[A-Za-z]')) >= 10 AND NOT regexp_matches(polished, '[ÄÖÜ]') AND NOT regexp_matches(lower(polished), 'licensed under|output:')
  AND NOT (rw > 3 AND pw < rw * 0.3::DOUBLE) AND pw <= rw * 2.5::DOUBLE AND NOT regexp_matches(polished, 'thereof|hereby') AND NOT regexp_matches(polished, '(and and)|([!]{{2,}}\\z)') THEN polished ELSE text END AS text FROM w"""
)
def polished_texts(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").withColumn("answer", F.lead("text").over(w)).where("role = 'user'")
    better = tx.polished_or_raw(F.col("text"), F.col("answer"), letters="[A-Za-z]", points="[ÄÖÜ]", meta=GATE["meta"], archaic=GATE["archaic"], broken=GATE["broken"])
    return t.select("conv_id", "turn", better.alias("text"))
