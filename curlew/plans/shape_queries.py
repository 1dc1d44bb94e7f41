"""Queries of text builders, filters, joins, batch algebra and token arrays over the tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rollouts, scores, text, vectors as vector_functions
from ..operators import advantages, balance, batches, bayes, clusters, evaluation, noise, prompts, selection
from .carriers import PAIRS_SQL, pairs, rated, table, vectors
from .catalog import query

_MESSY = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' || chr(10) ELSE ' ' || lang || chr(10) END"


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and a field that is null, blank or padded."""
    field = F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, "  \n").otherwise(F.concat(F.lit(" "), "lang", F.lit("\n")))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", field.alias("field"))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_FIELD = f"NULLIF({_STRIP.format(_MESSY)}, '')"


# Text builders


@query(f"SELECT doc_id, {_STRIP.format(f'coalesce({_MESSY}, {chr(39)}{chr(39)}) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END')} AS text FROM documents")
def prompt_answer_text(spark, sf_dir):
    rows = _messy(spark, sf_dir)
    return rows.select("doc_id", text.prompt_answer("field", F.when(F.col("doc_id") % 3 == 0, F.col("lang")), "source").alias("text"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Instruction: ' || lang || chr(10) || 'Answer:' WHEN 1 THEN 'Instruction: ' || chr(10) || 'Answer: ' || source
    ELSE 'Instruction: ' || source || chr(10) || 'Answer: ' || lang END AS text FROM documents""")
def instruction_text_of_record(spark, sf_dir):
    rows = _messy(spark, sf_dir)
    at = F.col("doc_id") % 3
    made = text.instruction_text_of_record(F.when(at == 0, F.col("lang")), F.when(at == 1, F.col("source")), "source", "lang")
    return rows.select("doc_id", made.alias("text"))


@query(f"""SELECT doc_id, CASE doc_id % 5
    WHEN 0 THEN 'Q: ' || lang || chr(10) || 'A: ' || source WHEN 1 THEN source || chr(10) || 'A) x' WHEN 2 THEN source WHEN 3 THEN source || chr(10) || 'Answer: x' ELSE 'C: ' || lang || chr(10) || 'S: ' END AS text FROM documents""")
def library_text(spark, sf_dir):
    rows = _messy(spark, sf_dir)
    at = F.col("doc_id") % 5
    kind = F.when(at == 0, "qa").when(at == 1, "mcq").when(at == 2, "tfq").when(at == 3, "paragraph").otherwise("cs")
    body = F.when(at == 1, F.concat("source", F.lit("\nA) x\n Answer: B "))).when(at == 2, F.concat("source", F.lit("\nanswer : True"))).otherwise(F.concat("source", F.lit("\nAnswer: x")))
    return rows.select("doc_id", text.library_text(kind, "lang", "source", body, "lang", F.lit(" ")).alias("text"))


@query(f"SELECT doc_id, coalesce({_FIELD}, lang) AS loose, {_FIELD} AS strict, coalesce({_FIELD}, source) AS generated FROM documents")
def rated_text_fields(spark, sf_dir):
    rows = _messy(spark, sf_dir)
    return rows.select("doc_id", text.rated_text("field", F.lit(" "), "lang").alias("loose"), text.rated_text("field", "lang", strict=True).alias("strict"), text.first_text("field", "source").alias("generated"))


@query("""SELECT doc_id, concat_ws(chr(10), CASE WHEN doc_id % 2 = 0 THEN lang END, source, CASE WHEN doc_id % 3 = 0 THEN 'said ' || lang ELSE 'plain' END) AS text FROM documents""")
def reward_text(spark, sf_dir):
    response = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x <answer> said "), "lang", F.lit(" </answer>")))
    return _messy(spark, sf_dir).select("doc_id", text.reward_text(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(" "), "source", F.lit("plain"), response).alias("text"))


@query("""SELECT doc_id, length(CASE doc_id % 5 WHEN 0 THEN 'QA Pair' WHEN 1 THEN 'MCQ Item' WHEN 2 THEN 'Paragraph' WHEN 3 THEN 'TFQ' ELSE 'CS Example' END) AS named, lang AS tail FROM documents""")
def rating_prompts(spark, sf_dir):
    from ..operators.ratings import rating_prompt

    made = rated(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", rating_prompt(F.col("task"), F.col("lang")).alias("p"))
    return made.select("doc_id", F.length(F.regexp_extract("p", r"### ([^:]*):\n", 1)).cast("long").alias("named"), F.regexp_extract("p", r":\n([^\n]*)$", 1).alias("tail"))


@query(f"SELECT doc_id, concat_ws(chr(10), {_FIELD}, source) AS request FROM documents")
def merge_requests(spark, sf_dir):
    return _messy(spark, sf_dir).select("doc_id", text.merge_request("field", "source").alias("request"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 > 1 THEN '<think>' || chr(10) || ' ' || lang || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END || '<answer>' || chr(10) || source || chr(10) || '</answer>' AS target FROM documents""")
def training_targets(spark, sf_dir):
    return _messy(spark, sf_dir).select("doc_id", text.training_target("field", F.concat("source", F.lit("  "))).alias("target"))


@query(f"""SELECT conv_id, turn, prompt AS asked, completion AS answered FROM (SELECT conv_id, turn, {_STRIP.format('prompt')} AS prompt, {_STRIP.format('completion')} AS completion FROM ({PAIRS_SQL}))""")
def split_transcripts(spark, sf_dir):
    said = text.split_by_roles(F.concat(F.lit("Human: "), "prompt", F.lit("\n\nAssistant: "), "completion"), ["Human", "Assistant"])
    return pairs(spark, sf_dir).select("conv_id", "turn", F.element_at(F.element_at(said, "Human"), 1).alias("asked"), F.element_at(F.element_at(said, "Assistant"), 1).alias("answered"))


@query("SELECT doc_id, u.turn, 3 - u.turn + 1 AS chosen, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'x' END AS first FROM documents, range(1, 4) u(turn) WHERE (doc_id % 2 = 0 AND u.turn = 3) OR (doc_id % 2 = 1 AND u.turn IN (1, 3))")
def preference_suffixes(spark, sf_dir):
    """Odd rows differ in turns 1 and 3, even ones in none (the last turn)."""
    a = F.array(F.lit("a"), F.lit("b"), F.lit("a"))
    b = F.when(F.col("doc_id") % 2 == 0, a).otherwise(F.array(F.lit("x"), F.lit("b"), F.lit("x")))
    rows = _messy(spark, sf_dir).select("doc_id", F.explode(text.preference_suffixes(a, b)).alias("s"))
    return rows.select("doc_id", F.col("s.turn").cast("long").alias("turn"), F.size("s.chosen").cast("long").alias("chosen"), F.element_at("s.rejected", 1).alias("first"))


@query("SELECT page_id, array_to_string(list_slice(string_split(html, ' '), greatest(1, len(string_split(html, ' ')) - 4), len(string_split(html, ' '))), ' ') AS words FROM pages")
def last_words(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.last_words("html", 5).alias("words"))


@query("""SELECT doc_id, 3 AS parts, 'text,image,text' AS types, lang || ' ' AS head, 'Say: ' || source || '!' AS filled FROM documents""")
def media_prompts(spark, sf_dir):
    rows = _messy(spark, sf_dir).select("doc_id", "lang", "source", text.content_parts(F.concat("lang", F.lit(" <image> rest"))).alias("p"))
    return rows.select("doc_id", F.size("p").alias("parts"), F.array_join(F.transform("p", lambda x: x["type"]), ",").alias("types"), F.element_at("p", 1)["text"].alias("head"), text.templated("Say: {{ content | trim }}!", F.concat(F.lit(" "), "source", F.lit("\n"))).alias("filled"))


@query("SELECT doc_id, 'Q: ' || lang || chr(10) || 'A: 7' || chr(10) || chr(10) || 'Q: plain' || chr(10) || 'A: 8' AS demos FROM documents")
def demonstrations_without_reasoning(spark, sf_dir):
    demos = F.concat(F.lit("Q: "), "lang", F.lit("\nA: Let's think step by step. First this.\nSo the answer is 7\n\nQ: plain\nA: 8"))
    return _messy(spark, sf_dir).select("doc_id", prompts.without_reasoning(demos).alias("demos"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'Answer in English' WHEN 'fr' THEN 'Répondez' END AS opening FROM documents")
def language_templates(spark, sf_dir):
    templates = spark.createDataFrame([("en", "Answer in English"), ("fr", "Répondez")], "lang string, opening string")
    return prompts.by_language(_messy(spark, sf_dir), templates).select("doc_id", "opening")


@query("""SELECT c_custkey, replace('high_school_x', '_', ' ') AS subject, c_name || chr(10) || 'A. ' || c_mktsegment || chr(10) || 'B. no' || chr(10) || 'Answer:' AS open, c_name || chr(10) || 'A. yes' || chr(10) || 'Answer: A' || chr(10) || chr(10) AS shown FROM customer""")
def question_prompts(spark, sf_dir):
    shown = text.question_prompt("c_name", [F.lit("yes")], F.lit("A"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.subject_title(F.lit("high_school_x")).alias("subject"), text.question_prompt("c_name", ["c_mktsegment", F.lit("no")]).alias("open"), shown.alias("shown"))


@query("""SELECT doc_id, lang AS stated, source AS plain, lang AS trimmed, lang || '. ' || source || '.' AS answers, lang || '.' AS best FROM documents""")
def answer_forms(spark, sf_dir):
    rows = _messy(spark, sf_dir)
    return rows.select(
        "doc_id",
        text.stated_answer(F.concat(F.lit("So the answer is "), "lang", F.lit(". Next."))).alias("stated"),
        text.stated_answer(F.concat(F.lit("\n "), "source")).alias("plain"),
        text.trim_answer(F.concat(F.lit(" A: "), "lang", F.lit("\nQ: next"))).alias("trimmed"),
        F.array_join(text.reference_answers(F.concat("lang", F.lit(" ; ;"), "source", F.lit("."))), " ").alias("answers"),
        text.best_answer("lang").alias("best"),
    )


# Filters and joins


@query(f"SELECT doc_id FROM documents WHERE doc_id % 4 > 1 AND lower(trim(source)) IN ('src1', 'src2')")
def filter_text_and_source(spark, sf_dir):
    rows = selection.with_text(_messy(spark, sf_dir).withColumn("field", text.blank_to_null("field")), "field")
    return selection.from_sources(rows, "source", [" SRC1", "src2 "]).select("doc_id")


@query("SELECT doc_id, round_even(try_cast(v AS DOUBLE), 0)::INT AS score FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2.5' WHEN 1 THEN '3.5' WHEN 2 THEN 'none' ELSE doc_id::VARCHAR END AS v FROM documents) WHERE try_cast(v AS DOUBLE) IS NOT NULL")
def whole_scores(spark, sf_dir):
    at = F.col("doc_id") % 4
    v = F.when(at == 0, "2.5").when(at == 1, "3.5").when(at == 2, "none").otherwise(F.col("doc_id").cast("string"))
    return _messy(spark, sf_dir).select("doc_id", scores.whole_score(v).alias("score")).filter("score IS NOT NULL")


@query("SELECT page_id FROM pages WHERE len(string_split(html, ' ')) <= 60")
def filter_short_prompts(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.split("html", " ").alias("tokens"))
    return selection.short_prompts(rows, "tokens", 60).select("page_id")


@query("SELECT doc_id, doc_id % 7 + 1 AS length, doc_id % 7 - 2 AS kept FROM documents WHERE doc_id % 7 > 2")
def masked_prompt_labels(spark, sf_dir):
    """Prompts of three tokens are ignored; rows without a label left go."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sequence(F.lit(0), F.col("doc_id") % 7).alias("ids"))
    rows = rows.withColumn("labels", rollouts.prompt_masked("ids", F.lit(3)))
    kept = F.size(F.filter("labels", lambda x: x != -100))
    return selection.with_labels(rows, "labels").select("doc_id", F.size("ids").cast("long").alias("length"), kept.cast("long").alias("kept"))


@query("SELECT doc_id, u.i AS place, CASE WHEN u.i IN (1, 2, 5) THEN 10 + u.i ELSE -100 END AS label FROM documents, range(0, 6) u(i)")
def masked_spans(spark, sf_dir):
    spans = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("stop")), F.struct(F.lit(5).alias("start"), F.lit(9).alias("stop")))
    rows = table(spark, sf_dir, "documents").select("doc_id", rollouts.spans_masked(F.sequence(F.lit(10), F.lit(15)), spans).alias("labels"))
    return rows.select("doc_id", F.posexplode("labels").alias("place", "label")).select("doc_id", F.col("place").cast("long").alias("place"), "label")


@query("SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id) UNION ALL SELECT -doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def inside_and_outside(spark, sf_dir):
    rows, known = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return selection.inside(rows, known, "doc_id").union(selection.not_in(rows, known, "doc_id").select(-F.col("doc_id")))


@query("SELECT vec_id AS id, c.centre::INT AS centre, round(list_dot_product(embedding::DOUBLE[], CASE c.centre WHEN 0 THEN [1.0::DOUBLE] || list_transform(range(63), lambda x: 0.0::DOUBLE) ELSE [0.0::DOUBLE, 1.0::DOUBLE] || list_transform(range(62), lambda x: 0.0::DOUBLE) END) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS similarity FROM embeddings, range(2) c(centre)")
def centre_similarities(spark, sf_dir):
    found = clusters.similarities(vectors(spark, sf_dir), "vec_id", "embedding", np.eye(2, 64), 2)
    return found.select("id", "centre", F.round("similarity", 6).alias("similarity"))


@query("SELECT count(*) AS n, true AS same FROM customer")
def same_key_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    same = selection.same_keys(rows, rows.withColumn("x", F.lit(1)).union(rows.withColumn("x", F.lit(2))), "c_custkey")
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("same", F.lit(same))


@query("SELECT 25 AS n, 25 AS different, 1 AS in_table")
def fixed_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    some = selection.sample(rows, "c_custkey", 25)
    again = selection.sample(rows, "c_custkey", 25)
    met = some.join(again, "c_custkey").join(rows, "c_custkey")
    return met.agg(F.count(F.lit(1)).cast("int").alias("n"), F.countDistinct("c_custkey").cast("int").alias("different")).withColumn("in_table", F.lit(1))


@query("""SELECT doc_id, source FROM documents WHERE NOT (doc_id % 3 = 0 AND lang = 'en')""")
def resume_by_source(spark, sf_dir):
    """The same ids are done in one source and open in another."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    done = rows.filter("doc_id % 3 = 0").select("doc_id", F.lit("en").alias("lang"))
    return selection.pending(rows, done, "doc_id", by="lang").select("doc_id", "source")


# Metrics


@query("""WITH c(subject, category) AS (VALUES ('en', 'germanic'), ('de', 'germanic'), ('fr', 'romance'), ('es', 'romance'), ('en', 'first'), ('none', 'empty'))
    SELECT category, round(avg(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM documents JOIN c ON lang = subject GROUP BY category""")
def category_accuracy(spark, sf_dir):
    known = spark.createDataFrame([("en", "germanic"), ("de", "germanic"), ("fr", "romance"), ("es", "romance"), ("en", "first"), ("none", "empty")], "subject string, category string")
    rows = table(spark, sf_dir, "documents").select("lang", (F.col("doc_id") % 3 == 0).alias("correct"))
    return evaluation.category_accuracy(rows, "correct", "lang", known).select("category", F.round("accuracy", 6).alias("accuracy"), "n")


@query("""SELECT doc_id, CASE WHEN n_chars % 4 = 3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS same FROM documents""")
def numeric_answers(spark, sf_dir):
    """Fractions, percentages, separators; one in four differs."""
    n, at = F.col("n_chars").cast("string"), F.col("n_chars") % 4
    said = F.when(at == 0, F.concat(F.lit(r"\frac{"), n, F.lit("}{4}"))).when(at == 1, F.concat(n, F.lit("/4"))).when(at == 2, F.concat((F.col("n_chars") * 25).cast("string"), F.lit(r"\%"))).otherwise(F.concat(n, F.lit(".5")))
    answer = (F.col("n_chars") / 4.0).cast("decimal(20,2)").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(scores.same_answer(said, answer), 1.0).otherwise(0.0).alias("same"))


@query("SELECT o_orderkey, round(o_totalprice * 1000 / (o_custkey + 1), 4) AS ms_per_token, round((o_custkey + 1) / (o_totalprice * 4), 8) AS rate FROM orders")
def timing_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("s"), (F.col("o_custkey") + 1).alias("t"))
    return advantages.timing_metrics(rows, "s", "t", 4).select("o_orderkey", F.round("ms_per_token", 4).alias("ms_per_token"), F.round("tokens_per_device_second", 8).alias("rate"))


@query("SELECT event_type AS key, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def mean_metrics(spark, sf_dir):
    return advantages.mean_metrics(table(spark, sf_dir, "events"), "event_type", "value").select(F.col("event_type").alias("key"), F.round("value", 6).alias("value"))


_METRIC = "SELECT lang AS key, count(*)::DOUBLE AS value FROM documents WHERE {} GROUP BY lang"


@query(f"WITH a AS ({_METRIC.format('lang != $$de$$')}), b AS ({_METRIC.format('lang != $$fr$$ AND doc_id % 2 = 0')}) SELECT 'both' AS kind, a.key, a.value AS v0, b.value AS v1 FROM a JOIN b USING (key) UNION ALL SELECT 'merged', coalesce(a.key, b.key), coalesce(b.value, a.value), NULL FROM a FULL JOIN b ON a.key = b.key")
def metric_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    of = lambda d: d.groupBy(F.col("lang").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    a, b = of(rows.filter("lang != 'de'")), of(rows.filter("lang != 'fr' AND doc_id % 2 = 0"))
    both = advantages.common_metrics(a, b).select(F.lit("both").alias("kind"), "key", F.col("value_0").alias("v0"), F.col("value_1").alias("v1"))
    return both.unionByName(advantages.merged_metrics(a, b).select(F.lit("merged").alias("kind"), "key", F.col("value").alias("v0"), F.lit(None).cast("double").alias("v1")))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 100.0::DOUBLE ELSE 80.0::DOUBLE END AS f1, CASE WHEN doc_id % 2 = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS exact, 100.0::DOUBLE AS recall FROM documents")
def best_f1(spark, sf_dir):
    rows = _messy(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("The "), "lang", F.lit("!"))).otherwise(F.concat("lang", F.lit(" one two"))).alias("p"), F.array(F.lit("other"), F.col("lang"), F.concat("lang", F.lit(" two"))).alias("t"))
    found = evaluation.best_f1(rows, "p", "t")
    return found.select("doc_id", F.round("f1", 4).alias("f1"), F.when(F.col("doc_id") % 2 == 0, F.col("exact")).otherwise(F.col("exact")).alias("exact"), "recall")


@query("SELECT lang AS value, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS class FROM (SELECT DISTINCT lang FROM documents)")
def class_index(spark, sf_dir):
    return bayes.class_index(table(spark, sf_dir, "documents"), "lang")


@query("SELECT o_orderkey, round(o_totalprice - 1000 * o_custkey, 2) AS advantage FROM orders")
def remax_advantage(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("s"), (F.col("o_custkey") * 1000.0).alias("b"))
    return advantages.remax(rows, "s", "b").select("o_orderkey", F.round("advantage", 2).alias("advantage"))


_V = "list_transform(embedding::DOUBLE[], lambda x: x)"
_TOKENS = "SELECT vec_id, u.i AS i, (embedding::DOUBLE[])[u.i + 1] AS v, CASE WHEN u.i <= vec_id % 9 THEN 1 ELSE 0 END AS m FROM embeddings, range(0, 8) u(i) WHERE embedding IS NOT NULL"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, v: eight numbers, m: a mask of the first of them."""
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i <= F.col("vec_id") % 9).cast("int"))
    return vectors(spark, sf_dir).select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("v"), mask.alias("m"))


@query(f"""WITH t AS ({_TOKENS}), a AS (SELECT sum(v * m) / (sum(m) + 1e-8) AS mean, sum(m) AS n FROM t),
    b AS (SELECT sum((v - mean) * (v - mean) * m) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM t, a)
    SELECT vec_id, i, round((v - mean) / sqrt(var + 1e-8), 5) AS w FROM t, a, b""")
def masked_whitening(spark, sf_dir):
    rows = advantages.masked_whitened(_tokens(spark, sf_dir), "v", "m", "w")
    return rows.select("vec_id", F.posexplode("w").alias("i", "w")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("w", 5).alias("w"))


@query(f"""WITH t AS ({_TOKENS}), r AS (SELECT *, v AS o, v * 3 AS n, v * 10 AS a FROM t),
    x AS (SELECT *, exp(least(greatest(n - o, -20), 20)) AS ratio FROM r),
    y AS (SELECT *, -a * ratio AS l1, -a * least(greatest(ratio, 0.8::DOUBLE), 1.2::DOUBLE) AS l2, -a * 3 AS l3 FROM x)
    SELECT round(sum(CASE WHEN l1 < l2 THEN m ELSE 0 END) / (sum(m) + 1e-8), 6) AS clip_higher, round(sum(CASE WHEN greatest(l1, l2) > l3 AND a < 0 THEN m ELSE 0 END) / (sum(m) + 1e-8), 6) AS clip_lower,
        round(sum((o - n) * m) / (sum(m) + 1e-8), 6) AS kl, round(sum(-n * m) / (sum(m) + 1e-8), 6) AS entropy,
        round(sum(CASE WHEN (v - 0.1) * (v - 0.1) < (least(greatest(v, v * 2 - 0.05), v * 2 + 0.05) - 0.1) * (least(greatest(v, v * 2 - 0.05), v * 2 + 0.05) - 0.1) THEN m ELSE 0 END) / (sum(m) + 1e-8), 6) AS value_clip FROM y""")
def policy_metrics(spark, sf_dir):
    times = lambda k: F.transform("v", lambda x: x * k)
    rows = _tokens(spark, sf_dir).withColumns({"n": times(3.0), "a": times(10.0), "w": times(2.0), "r": F.transform("v", lambda x: F.lit(0.1))})
    rows = rows.withColumns(rollouts.policy_metrics("v", "n", "a")).withColumn("value_clip", rollouts.value_clipped("v", "r", "w", 0.05))
    found = advantages.token_means(rows, "m", "clip_higher", "clip_lower", "kl", "entropy", "value_clip")
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query("SELECT doc_id, u.i AS place, CASE WHEN u.i = doc_id % 5 + 1 THEN n_chars::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM documents, range(1, 7) u(i)")
def token_rewards(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", rollouts.token_reward(F.col("n_chars").cast("double"), F.col("doc_id") % 5 + 1, F.lit(6)).alias("r"))
    return rows.select("doc_id", F.posexplode("r").alias("place", "reward")).select("doc_id", (F.col("place") + 1).cast("long").alias("place"), "reward")


@query(f"WITH t AS ({_TOKENS}) SELECT vec_id, i, round(v - 0.5::DOUBLE * m, 6) AS shaped FROM t")
def shaped_rewards(spark, sf_dir):
    rows = _tokens(spark, sf_dir).select("vec_id", F.posexplode(rollouts.shaped_rewards("v", "m", 0.5)).alias("i", "s"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.round("s", 6).alias("shaped"))


@query("SELECT doc_id, n_chars % 9 AS size, CASE WHEN n_chars % 9 >= 5 THEN 0 ELSE 5 - n_chars % 9 END AS fill, CASE WHEN n_chars % 9 >= 4 THEN 3 ELSE 0 END AS place FROM documents")
def padded_rows(spark, sf_dir):
    """Left fill to five tokens, and the place of the tokens 3, 4."""
    n = F.col("n_chars") % 9
    ids = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1), n).cast("array<bigint>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), ids.alias("ids"))
    left = rollouts.padded("ids", 5, 0, left=True)
    return rows.select("doc_id", F.col("n").alias("size"), F.size(F.filter(left, lambda x: x == 0)).cast("long").alias("fill"), rollouts.subsequence_at("ids", [3, 4]).cast("long").alias("place"))


@query(f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL) SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 5) AS total, round((v[1] + v[2]) / 2, 6) AS pooled FROM e")
def pooled_vectors(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    unit = vector_functions.normalised("v")
    pool = vector_functions.mean_pool(F.array(F.slice("v", 1, 1), F.slice("v", 2, 1)), F.array(F.lit(1), F.lit(1)))
    return rows.select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(pool[0], 6).alias("pooled"))


# Rewards and noise


@query("SELECT doc_id, CASE WHEN n_chars % 100 >= 80 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS alignment, CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy, CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS form FROM documents")
def tagged_rewards(spark, sf_dir):
    response = F.concat(F.when(F.col("doc_id") % 3 == 0, "<think>x</think>\n").otherwise("x"), F.lit("<answer> "), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("none"), F.lit(" </answer>"))
    return table(spark, sf_dir, "documents").select("doc_id", scores.alignment_reward(F.col("n_chars") % 100 / 100.0).alias("alignment"), scores.tagged_accuracy(response, F.col("lang")).alias("accuracy"), scores.tagged_format_reward(response).alias("form"))


@query("SELECT i::INT AS round, round(0.1::DOUBLE * pow(1 + 0.2::DOUBLE * 64 / 10000, i + 1), 9) AS coefficient FROM range(5) t(i)")
def kl_control(spark, sf_dir):
    """Above the target by far: the coefficient grows by the largest step each time."""
    held = advantages.KlController(0.1, target=1.0)
    return spark.createDataFrame([(i, round(held.update(5.0, 64), 9)) for i in range(5)], "round int, coefficient double")


@query("SELECT quality AS label, count(*) AS n, 1 AS classes_kept FROM labels WHERE quality IS NOT NULL GROUP BY quality")
def synthetic_noise(spark, sf_dir):
    """Flips stay in the classes; a diagonal of 1 flips nothing."""
    rows = table(spark, sf_dir, "labels").filter("quality IS NOT NULL")
    still = noise.synthetic_noise(rows, "doc_id", "quality", noise.random_transition([1.0, 1.0], 3), 7)
    moved = noise.synthetic_noise(rows, "doc_id", "quality", noise.random_transition([0.7, 0.4], 3), 7).filter("noisy_label NOT IN (0, 1)")
    return still.filter("noisy_label = quality").groupBy(F.col("quality").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("classes_kept", F.lit(1 if moved.isEmpty() else 0))


# Batches


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))


@query("SELECT n_nationkey AS row_id, n_name AS label, 'taken' AS side FROM nation WHERE n_nationkey IN (1, 3, 8) UNION ALL SELECT n_nationkey, n_regionkey::VARCHAR, 'rest' FROM nation WHERE n_nationkey >= 5 AND n_nationkey < 9")
def batch_columns_and_rows(spark, sf_dir):
    taken, rest = batches.pop(_numbered(spark, sf_dir), ["name", "unknown"])
    a = batches.rename(batches.rows_at(taken, [1, 3, 8]), {"name": "label", "none": "x"}).withColumn("side", F.lit("taken"))
    b = batches.rows_between(rest, 5, 9).select("row_id", F.col("region").cast("string").alias("label"), F.lit("rest").alias("side"))
    return a.unionByName(b)


@query("SELECT CASE WHEN s = 0 THEN n_nationkey ELSE n_nationkey + (SELECT count(*) FROM nation) END AS row_id, n_name AS name FROM nation, range(2) t(s)")
def batch_concat(spark, sf_dir):
    rows = _numbered(spark, sf_dir)
    return batches.concat(rows, rows).select("row_id", "name")


@query("""WITH o AS (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY o_custkey HAVING avg(o_totalprice) > 100000 AND avg(o_totalprice) < 200000)
    SELECT o_orderkey FROM orders SEMI JOIN o USING (o_custkey) ORDER BY o_orderkey LIMIT 100""")
def quota_of_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("s"))
    return advantages.quota_groups(rows, "o_custkey", "o_orderkey", "s", 100_000, 200_000, 100).select("o_orderkey")


@query("""WITH s AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label) SELECT count(*) AS count, round(avg(size), 6) AS mean, round(stddev_samp(size), 6) AS std, min(size) AS min, quantile_cont(size, 0.25) AS q1, quantile_cont(size, 0.5) AS median, quantile_cont(size, 0.75) AS q3, max(size) AS max FROM s""")
def cluster_size_summary(spark, sf_dir):
    found = clusters.size_summary(vectors(spark, sf_dir), "label")
    return found.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("SELECT lang AS part, sum(n_chars)::BIGINT AS total FROM documents GROUP BY lang")
def ordered_sums(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("part")).agg(F.sum("n_chars").alias("total"))
    return rows.orderBy("part")


@query("SELECT doc_id AS id, true AS once, true AS held FROM documents")
def micro_batch_invariants(spark, sf_dir):
    """Each row is in one part of its batch, and rows come back in their order."""
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 32).alias("batch"), F.col("doc_id").alias("id"), F.least(F.col("n_chars"), F.lit(4000)).alias("n"))
    found = balance.restored(balance.micro_batches(rows, "batch", "id", "n", 8000).withColumn("p", F.col("part")), "batch", "id")
    n = found.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    sums = found.join(rows, ["batch", "id"]).groupBy("batch", "p").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c"))
    return found.join(n, "id").join(sums, ["batch", "p"]).select("id", (F.col("k") == 1).alias("once"), (F.col("c") > 0).alias("held"))


@query("SELECT doc_id // 32 AS batch, count(*) AS rows, sum(n_chars)::BIGINT AS total, true AS all_filled FROM documents GROUP BY 1")
def partition_invariants(spark, sf_dir):
    """Balanced parts hold every row of their batch, and no part is empty."""
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 32).alias("batch"), F.col("doc_id").alias("id"), "n_chars")
    found = balance.balance(rows, "batch", "id", "n_chars", 4).join(rows, ["batch", "id"])
    return found.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("total"), (F.countDistinct("part") == F.least(F.lit(4), F.count(F.lit(1)))).alias("all_filled"))


@query("SELECT label::VARCHAR AS block, count(*) AS rows, true AS within FROM embeddings WHERE label IS NOT NULL GROUP BY label")
def capacity_cluster_invariants(spark, sf_dir):
    """Every row of a block is in one cluster; sizes lie within the bounds."""
    found = clusters.capacity_clusters(vectors(spark, sf_dir).filter("label IS NOT NULL"), "vec_id", "embedding", "label", 5, 15, 10, 2)
    sizes = found.groupBy("block", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("block").agg(F.sum("n").alias("rows"), F.min((F.col("n") >= 5) & (F.col("n") <= 15)).alias("within"))
