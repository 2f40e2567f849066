"""Registered check queries, part 2: curation, chat, sources and sinks, composed jobs."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from evidence_spark.functions.text import normalize_variant
from evidence_spark.operators import chat as ch
from evidence_spark.operators import curate as cu
from evidence_spark.operators import keyed as kd
from evidence_spark.operators import report as rp
from evidence_spark.operators import scoring as sc
from evidence_spark.plans import jobs
from evidence_spark.plans import oracle as O
from evidence_spark.plans.fixtures import fixture
from evidence_spark.plans.queries import _results, _samples, _scoring, register
from evidence_spark.session import scratch_path
from evidence_spark.sources import corpus as src
from evidence_spark.sources import keyed_table
from evidence_spark.sources import scores as score_src


def _fx(spark, sf, name):
    return fixture(spark, sf, name)


def sql_template(template: str, **cols: str) -> str:
    parts = []
    for literal, field, _s, _c in string.Formatter().parse(template):
        if literal:
            parts.append("'" + literal.replace("'", "''") + "'")
        if field is not None:
            parts.append(cols[field])
    return "(" + " || ".join(parts) + ")"


GOLD_SQL = "coalesce(nullif(quotes, ''), nullif(original_quotes, ''), '')"
TARGET_SQL = "coalesce(nullif(split, ''), 'train')"
ROUTED = f"{TARGET_SQL} IN ('train', 'validation', 'test')"
USER_SQL = sql_template(cu.DEFAULT_CONVERSATION_TEMPLATE, question="question", context="context")
MD5_REC = ("md5(concat_ws(chr(31), coalesce(question, ''), coalesce(answer, ''), coalesce(context, ''), "
           "coalesce(quotes, ''), coalesce(split, '')))")


def _docs(spark, sf):
    return _fx(spark, sf, "fx_docs").drop("doc_id")


# --------------------------------------------------------------------------- curation
@register("p01_distilled_quotes", O.q(["fx_docs"], "SELECT hf_id FROM fx_docs WHERE quotes IS NOT NULL"))
def p01_distilled_quotes(spark, sf):
    return cu.with_distilled_quotes(_docs(spark, sf)).select("hf_id")


@register("p02_normalize_text", O.q(["fx_docs"],
    "SELECT hf_id, CASE doc_id % 9 WHEN 0 THEN question || answer WHEN 1 THEN question WHEN 2 THEN NULL "
    "WHEN 3 THEN '[' || CAST(doc_id AS STRING) || ',1]' WHEN 4 THEN CAST(doc_id AS STRING) WHEN 5 THEN 'true' "
    "WHEN 6 THEN question WHEN 7 THEN '{\"n\":' || CAST(doc_id AS STRING) || '}' ELSE '[]' END AS answer_text FROM fx_docs"))
def p02_normalize_text(spark, sf):
    """All shapes of the field: objects, string, null, list without objects, number, bool, missing text, object, empty list."""
    d = _fx(spark, sf, "fx_docs")
    i = F.col("doc_id")

    def text(c):
        return F.struct(F.col(c).alias("text"))

    shapes = [
        F.to_variant_object(F.array(text("question"), text("answer"))),
        F.col("question").cast("variant"),
        F.lit(None).cast("variant"),
        F.array(i, F.lit(1).cast("bigint")).cast("variant"),
        i.cast("variant"),
        F.lit(True).cast("variant"),
        F.parse_json(F.concat(F.lit('[{"text":'), F.to_json(F.col("question").cast("variant")), F.lit('},{"other":1},2]'))),
        F.to_variant_object(F.struct(i.alias("n"))),
        F.parse_json(F.lit("[]")),
    ]
    raw = F.lit(None).cast("variant")
    for k, shape in enumerate(shapes):
        raw = F.when(i % 9 == k, shape).otherwise(raw)
    return d.select("hf_id", normalize_variant(raw).alias("answer_text"))


@register("p03_gold_text", O.q(["fx_docs"], f"SELECT hf_id, {GOLD_SQL} AS gold FROM fx_docs"))
def p03_gold_text(spark, sf):
    return _docs(spark, sf).select("hf_id", cu.gold_text().alias("gold"))


@register("p04_conversation", O.q(["fx_docs"],
    f"SELECT hf_id, CAST(0 AS BIGINT) AS turn, 'user' AS role, {USER_SQL} AS content FROM fx_docs "
    f"UNION ALL SELECT hf_id, CAST(1 AS BIGINT) AS turn, 'assistant' AS role, {GOLD_SQL} AS content FROM fx_docs"))
def p04_conversation(spark, sf):
    d = _docs(spark, sf).select("hf_id", cu.conversation().alias("c"))
    out = d.select("hf_id", F.posexplode("c").alias("turn", "m"))
    return out.select("hf_id", F.col("turn").cast("bigint").alias("turn"), "m.role", "m.content")


@register("p05_route_split", O.q(["fx_docs"],
    f"SELECT hf_id, split, {TARGET_SQL} AS target_split FROM fx_docs WHERE quotes IS NOT NULL AND {ROUTED}"))
def p05_route_split(spark, sf):
    return cu.route_split(cu.with_distilled_quotes(_docs(spark, sf))).select("hf_id", "split", "target_split")


_EXPORT_SQL = (f"SELECT hf_id, question, context, answer, level, split, quotes, {USER_SQL} AS user_content, "
               f"{GOLD_SQL} AS assistant_content, {TARGET_SQL} AS target_split FROM fx_docs "
               f"WHERE quotes IS NOT NULL AND {ROUTED}")


def _flat_export(df):
    return df.select(*cu.EXPORT_COLUMNS, F.col("conversations")[0]["content"].alias("user_content"),
                     F.col("conversations")[1]["content"].alias("assistant_content"), "target_split")


@register("p06_export_records", O.q(["fx_docs"], _EXPORT_SQL))
def p06_export_records(spark, sf):
    return _flat_export(cu.export_records(_docs(spark, sf)))


@register("p07_training_rows", O.q(["fx_docs"],
    f"SELECT question, answer, context, {GOLD_SQL} AS quotes, {USER_SQL} AS user_content, "
    f"{GOLD_SQL} AS assistant_content FROM fx_docs"))
def p07_training_rows(spark, sf):
    t = cu.training_rows(_docs(spark, sf))
    return t.select("question", "answer", "context", "quotes", F.col("conversations")[0]["content"].alias("user_content"),
                    F.col("conversations")[1]["content"].alias("assistant_content"))


@register("p08_drop_columns", O.q(["fx_pool"], "SELECT question, answer, context, quotes, split FROM fx_pool"))
def p08_drop_columns(spark, sf):
    return cu.drop_columns(_fx(spark, sf, "fx_pool"), ["id", "source", "doc_id", "not_there"])


# The oracle knows nothing of how ids are made: every content has as many ids as records,
# and no id stands for two contents.
_IDS_SQL = ("SELECT {cols}, count(*) AS n, CASE WHEN bool_and({made}) THEN count(*) ELSE 1 END AS n_ids, CAST(0 AS BIGINT) AS n_shared "
            "FROM {src} GROUP BY ALL")


def _id_counts(df, cols):
    """Rows and distinct ids of each content, and how many of its ids other contents have too."""
    owners = df.select("uuid", F.md5(F.to_json(F.struct(*cols))).alias("content")).groupBy("uuid").agg(
        F.count_distinct("content").alias("owners"))
    out = df.join(owners, "uuid").groupBy(*cols).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("uuid").alias("n_ids"),
        F.count_distinct(F.when(F.col("owners") > 1, F.col("uuid"))).alias("n_shared"))
    return out


_REC = ("rec", "SELECT question, answer, context, quotes, split, doc_id, nullif(uuid, '') AS uuid "
               "FROM fx_published WHERE split IN ('test', 'nosuch')")


@register("p09_test_records", O.q(["fx_published"], _IDS_SQL.format(
    cols="question, answer, context, quotes, split, uuid IS NULL AS made", made="uuid IS NULL", src="rec"), [_REC]))
def p09_test_records(spark, sf):
    pub = _fx(spark, sf, "fx_published").withColumn("made", F.coalesce(F.col("uuid"), F.lit("")) == "")
    rec = cu.test_records(pub, ["test", "nosuch"], keep=["made"])
    given = rec.where(~F.col("made")).groupBy("question", "answer", "context", "quotes", "split", "made").agg(
        F.count(F.lit(1)).alias("n"), F.lit(1).cast("bigint").alias("n_ids"), F.lit(0).cast("bigint").alias("n_shared"))
    return given.unionByName(_id_counts(rec.where("made"), ["question", "answer", "context", "quotes", "split", "made"]))


_P10_COLS = "question, answer, context, quotes, split"


@register("p10_assign_ids", O.q(["fx_published"], _IDS_SQL.format(
    cols=_P10_COLS, made="TRUE", src="fx_published WHERE split = 'test'")))
def p10_assign_ids(spark, sf):
    ds = _fx(spark, sf, "fx_published").select("question", "answer", "context", "quotes", "split")
    out = cu.assign_ids(ds, ["test"])
    return _id_counts(out.where("uuid is not null"), ["question", "answer", "context", "quotes", "split"])


@register("p11_inference_prompts", O.q(["fx_testset"],
    f"SELECT uuid, {sql_template(ch.DEFAULT_INFERENCE_TEMPLATE, question='question', context='context')} AS prompt "
    "FROM fx_testset"))
def p11_inference_prompts(spark, sf):
    return ch.inference_prompts(_fx(spark, sf, "fx_testset"))


@register("p12_judge_prompts", O.q(O.SCORING_FX,
    f"SELECT uuid, model, {sql_template(ch.DEFAULT_JUDGE_TEMPLATE, ground_truth='gt', system_response='resp')} AS prompt "
    "FROM samples", [O.SAMPLES]))
def p12_judge_prompts(spark, sf):
    samples, _ = _samples(spark, sf)
    return ch.judge_prompts(samples)


_CONV_STATS = (
    "st",
    "SELECT conv_id, max(turn) AS last_turn, coalesce(max(CASE WHEN role = 'user' THEN turn END), -1) AS last_user, "
    "string_agg(CASE WHEN role = 'system' THEN coalesce(text, '') END, chr(10) || chr(10) ORDER BY turn) AS system "
    "FROM {conversations} GROUP BY conv_id",
)
_PIECES = (
    "pc",
    "SELECT m.conv_id, m.turn, (CASE "
    "WHEN role = 'user' THEN '<|im_start|>user' || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) "
    "WHEN role = 'assistant' THEN '<|im_start|>assistant' || chr(10) || coalesce(text, '') || "
    "  CASE WHEN m.turn = s.last_turn THEN '' ELSE '<|im_end|>' || chr(10) END "
    "WHEN role = 'tool' THEN '<|im_start|>user' || chr(10) || '<tool_response>' || chr(10) || coalesce(text, '') || "
    "  chr(10) || '</tool_response><|im_end|>' || chr(10) "
    "ELSE '' END) || CASE WHEN role <> 'assistant' AND m.turn = s.last_turn THEN '<|im_start|>assistant' || chr(10) "
    "ELSE '' END AS piece FROM {conversations} m JOIN st s ON s.conv_id = m.conv_id",
)


@register("p13_chat_render", O.q([],
    "SELECT p.conv_id, CASE WHEN s.system IS NOT NULL AND s.system <> '' THEN "
    "'<|im_start|>system' || chr(10) || chr(10) || s.system || '<|im_end|>' || chr(10) ELSE '' END || "
    "string_agg(p.piece, '' ORDER BY p.turn) AS rendered FROM pc p JOIN st s ON s.conv_id = p.conv_id "
    "GROUP BY p.conv_id, s.system", [_CONV_STATS, _PIECES]))
def p13_chat_render(spark, sf):
    return ch.render_conversations(spark.read.parquet(f"{sf}/conversations.parquet"))


@register("p13b_chat_pieces", O.q([], "SELECT conv_id, turn, piece FROM pc", [_CONV_STATS, _PIECES]))
def p13b_chat_pieces(spark, sf):
    return ch.message_pieces(spark.read.parquet(f"{sf}/conversations.parquet"))


_SAMPLES_RESUMED = (
    "samples",
    O.SAMPLES[1] + " AND NOT EXISTS (SELECT 1 FROM fx_prior_scores p WHERE p.uuid = t.uuid AND p.model = i.model)",
)


def _resumed(spark, sf, force=False):
    ts, inf, _ = _scoring(spark, sf)
    return sc.evaluation_samples(ts, inf, prior_scores=_fx(spark, sf, "fx_prior_scores"), force=force)


@register("p14_eval_samples", O.q(O.SCORING_FX + ["fx_prior_scores"],
    "SELECT uuid, model, gt AS ground_truth, resp AS system_response FROM samples", [_SAMPLES_RESUMED]))
def p14_eval_samples(spark, sf):
    return _resumed(spark, sf).select("uuid", "model", "ground_truth", "system_response")


@register("p15_usable_questions", O.q(["fx_docs"],
    f"SELECT hf_id FROM fx_docs WHERE question IS NOT NULL AND {O.strip('question')} <> ''"))
def p15_usable_questions(spark, sf):
    return cu.usable_questions(_docs(spark, sf)).select("hf_id")


_KEYS = ("keys", f"SELECT DISTINCT lower({O.strip('question')}) AS qkey FROM fx_existing "
                 "WHERE question IS NOT NULL AND question <> ''")
_NOVEL = ("novel", f"SELECT * FROM fx_docs WHERE split = 'train' AND question IS NOT NULL AND {O.strip('question')} <> '' "
                   f"AND lower({O.strip('question')}) NOT IN (SELECT qkey FROM keys)")


@register("a08_question_keys", O.q(["fx_existing"], "SELECT qkey FROM keys", [_KEYS]))
def a08_question_keys(spark, sf):
    return cu.existing_question_keys(_fx(spark, sf, "fx_existing"))


@register("j01_novelty", O.q(["fx_docs", "fx_existing"], "SELECT hf_id FROM novel", [_KEYS, _NOVEL]))
def j01_novelty(spark, sf):
    keys = cu.question_keys(_fx(spark, sf, "fx_existing"))
    return cu.novel_samples(_docs(spark, sf), keys, "train").select("hf_id")


_MERGED_SQL = (f"SELECT question, answer, context, quotes, split FROM fx_existing UNION ALL "
               f"SELECT question, answer, context, {GOLD_SQL} AS quotes, 'train' AS split FROM novel")


@register("u01_add_samples", O.q(["fx_docs", "fx_existing"], _MERGED_SQL, [_KEYS, _NOVEL]))
def u01_add_samples(spark, sf):
    existing = _fx(spark, sf, "fx_existing").drop("doc_id")
    novel = cu.novel_samples(_docs(spark, sf), cu.question_keys(existing), "train")
    return cu.add_samples(existing, cu.training_rows(novel))


@register("u02_merge_job", O.q(["fx_docs", "fx_existing"], _MERGED_SQL, [_KEYS, _NOVEL]))
def u02_merge_job(spark, sf):
    existing = _fx(spark, sf, "fx_existing").drop("doc_id")
    out = jobs.merge_dataset(existing, _docs(spark, sf), split="train", n=None)
    return out if out is not None else spark.createDataFrame([], "question string, answer string, context string, quotes string, split string")


@register("l03_sample_novel", O.q(["fx_docs", "fx_existing"],
    "SELECT hf_id FROM novel ORDER BY md5('7|' || hf_id), hf_id LIMIT 25", [_KEYS, _NOVEL]))
def l03_sample_novel(spark, sf):
    """Seeded exact sample of 25 novel rows."""
    novel = cu.novel_samples(_docs(spark, sf), cu.question_keys(_fx(spark, sf, "fx_existing")), "train")
    return cu.sample_exact(novel, 25, seed=7, key_cols=["hf_id"]).select("hf_id")


@register("j02_attach_inferences", O.q(["fx_inf_files", "fx_testset"],
    "SELECT uuid, model, quotes FROM (SELECT *, row_number() OVER (PARTITION BY uuid, model ORDER BY file DESC, pos DESC) "
    "AS rn FROM fx_inf_files WHERE uuid IN (SELECT uuid FROM fx_testset)) WHERE rn = 1"))
def j02_attach_inferences(spark, sf):
    from evidence_spark.sources.inferences import attach_inferences

    return attach_inferences(_fx(spark, sf, "fx_testset"), None, _fx(spark, sf, "fx_inf_files"))


@register("j03_resume", O.q(O.SCORING_FX + ["fx_prior_scores"], "SELECT uuid, model FROM samples", [_SAMPLES_RESUMED]))
def j03_resume(spark, sf):
    return _resumed(spark, sf).select("uuid", "model")


@register("j03b_resume_forced", O.q(O.SCORING_FX, "SELECT uuid, model FROM samples", [O.SAMPLES]))
def j03b_resume_forced(spark, sf):
    return _resumed(spark, sf, force=True).select("uuid", "model")


_MI = ("mi", "SELECT m.* FROM fx_manual m JOIN fx_testset t ON t.uuid = m.uuid "
             "JOIN fx_inf i ON i.uuid = m.uuid AND i.model = m.model "
             "WHERE i.quotes IS NOT NULL AND i.quotes <> '' AND m.uuid <> '' AND m.model <> ''")
_ML = ("ml", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uuid, model ORDER BY ord DESC) AS rn FROM mi) "
             "WHERE rn = 1")
_MPAIRS = ("mpairs", "SELECT l.uuid, l.model, i.quotes AS resp, l.recall, l.precision FROM ml l "
                     "JOIN fx_inf i ON i.uuid = l.uuid AND i.model = l.model")
_MGOLD = ("mgold", "SELECT uuid, quotes AS gt FROM fx_testset WHERE uuid IN (SELECT uuid FROM ml)")
_MANUAL_FX = ["fx_manual", "fx_testset", "fx_inf"]


@register("j04_manual_scores", O.q(_MANUAL_FX,
    f"SELECT p.uuid, p.model, {O.r4('p.recall')} AS recall, {O.r4('p.precision')} AS precision, "
    f"{O.r4(O.f1('p.precision', 'p.recall'))} AS f1, CAST(b.bm25 AS DOUBLE) AS bm25, "
    f"CAST({O.fmt('p.resp')} AS DOUBLE) AS format_score FROM mpairs p JOIN bm b ON b.uuid = p.uuid AND b.model = p.model",
    [_MI, _ML, _MPAIRS, _MGOLD] + O.bm25_ctes("mgold", "mpairs")))
def j04_manual_scores(spark, sf):
    ts, inf, _ = _scoring(spark, sf)
    rows, _count = sc.manual_scores(_fx(spark, sf, "fx_manual"), ts, inf)
    return rows


@register("j04b_manual_count", O.q(_MANUAL_FX, "SELECT count(*) AS updated FROM mi", [_MI]))
def j04b_manual_count(spark, sf):
    ts, inf, _ = _scoring(spark, sf)
    return sc.manual_scores(_fx(spark, sf, "fx_manual"), ts, inf)[1]


_REQUESTED = ["m_open", "zzz", "m_exact", "m_open"]


@register("j05_model_select", O.q(["fx_testset", "fx_inf"],
    "SELECT CAST(r.ord AS BIGINT) AS ord, r.model FROM (VALUES "
    + ", ".join(f"({i}, '{m}')" for i, m in enumerate(_REQUESTED))
    + ") r(ord, model) WHERE r.model IN (SELECT model FROM fx_inf WHERE uuid IN (SELECT uuid FROM cands))",
    [("cands", "SELECT * FROM fx_testset t WHERE (t.quotes IS NULL OR t.quotes <> '') "
               "AND EXISTS (SELECT 1 FROM fx_inf i WHERE i.uuid = t.uuid)")]))
def j05_model_select(spark, sf):
    ts, inf, _ = _scoring(spark, sf)
    avail = sc.available_models(sc.candidate_documents(ts, inf), inf)
    return sc.select_models(spark, avail, _REQUESTED)


# --------------------------------------------------------------------------- reports
_LONG = ("lng", "SELECT model, 'recall' AS metric, recall AS value FROM res UNION ALL "
                "SELECT model, 'precision', precision FROM res UNION ALL SELECT model, 'f1', f1 FROM res")


_BEFORE = "avg(CASE WHEN model = 'm_first' THEN value END)"
_AFTER = "avg(CASE WHEN model = 'm_exact' THEN value END)"


@register("a09_compare_settings", O.q(O.SCORING_FX,
    f"SELECT metric, {O.r4(_BEFORE)} AS before, {O.r4(_AFTER)} AS after, "
    f"{O.r4(_AFTER + ' - ' + _BEFORE)} AS improvement FROM lng GROUP BY metric", O.scored_ctes() + [_LONG]))
def a09_compare_settings(spark, sf):
    long = rp.metrics_long(_results(spark, sf)).where(F.col("model").isin("m_first", "m_exact"))
    return rp.compare_settings(long, ["metric"], "model", "value", "m_first", "m_exact")


@register("a10_split_counts", O.q(["fx_docs"],
    "SELECT split, count(*) AS n, CAST(GROUPING(split) AS BIGINT) AS is_total FROM fx_docs GROUP BY ROLLUP (split)"))
def a10_split_counts(spark, sf):
    return rp.split_counts(_docs(spark, sf))


# --------------------------------------------------------------------------- sources / sinks
@register("s02_validate_records", O.q(["fx_docs"],
    "SELECT hf_id, 'invalid: ' || concat_ws(',', CASE WHEN doc_id % 9 = 0 THEN 'question' END, "
    "CASE WHEN doc_id % 14 = 0 THEN 'level' END, CASE WHEN doc_id % 11 = 0 THEN 'quotes' END) AS reason FROM fx_docs "
    "WHERE doc_id % 9 = 0 OR doc_id % 14 = 0 OR doc_id % 11 = 0"))
def s02_validate_records(spark, sf):
    """Missing fields, and quotes that are a list (rejected) or null (kept)."""
    d = _fx(spark, sf, "fx_docs")
    i = F.col("doc_id")
    quotes = F.when(i % 11 == 0, F.parse_json(F.lit('[{"text": "x"}]'))).when(i % 11 != 1, F.col("original_quotes").cast("variant"))
    raw = d.select(
        "split", i.alias("pos"), F.col("hf_id").cast("variant").alias("id"),
        F.when(i % 9 != 0, F.col("question").cast("variant")).alias("question"),
        F.col("context").cast("variant").alias("context"), F.col("answer").cast("variant").alias("answer"),
        F.when(i % 14 != 0, F.col("level").cast("variant")).alias("level"), quotes.alias("quotes"),
        F.lit(None).cast("string").alias("_corrupt_record"))
    _valid, quarantine = src.validate_corpus(raw)
    return quarantine.select("hf_id", "reason")


_S01_SPLITS = "split IN ('train', 'validation', 'test')"


@register("s01_read_corpus", O.q(["fx_docs"],
    f"SELECT split, hf_id, question, context, answer, original_quotes, CAST(NULL AS VARCHAR) AS reason FROM fx_docs "
    f"WHERE {_S01_SPLITS} AND doc_id % 50 <> 1 "
    f"UNION ALL SELECT split, NULL, NULL, NULL, NULL, NULL, 'invalid: record' FROM fx_docs WHERE {_S01_SPLITS} AND doc_id % 50 = 1"))
def s01_read_corpus(spark, sf):
    """Corpus files with one record a line, some lines cut off, written, read back and validated."""
    folder = scratch_path(spark, "corpus-files")
    d = _fx(spark, sf, "fx_docs")
    line = F.to_json(F.struct(F.col("hf_id").alias("id"), "question", "context", "answer", "level", F.col("original_quotes").alias("quotes")))
    line = F.when(F.col("doc_id") % 50 == 1, F.substring(line, 1, 30)).otherwise(line)
    for split in src.CORPUS_FILES:
        d.where(F.col("split") == split).select(line.alias("value")).write.text(f"{folder}/{split}.jsonl")
    valid, bad = src.validate_corpus(src.read_corpus_files(spark, folder))
    cols = ["split", "hf_id", "question", "context", "answer", "original_quotes"]
    return valid.select(*cols, F.lit(None).cast("string").alias("reason")).unionByName(bad.select("split", "reason"), allowMissingColumns=True)


@register("s03_append_batch", O.q(["fx_docs"],
    "SELECT hf_id, question, (SELECT count(*) FROM fx_docs WHERE doc_id % 3 <> 0) AS written FROM fx_docs"))
def s03_append_batch(spark, sf):
    """A table written in two appends, the second checked against the first, and the count it returns."""
    path = scratch_path(spark, "appended")
    d = _fx(spark, sf, "fx_docs").select("doc_id", "hf_id", "question")
    src.append_batch(d.where("doc_id % 3 = 0").drop("doc_id"), None, ["hf_id"], path)
    n = src.append_batch(d.where("doc_id % 3 <> 0").drop("doc_id"), spark.read.parquet(path), ["hf_id"], path)
    return spark.read.parquet(path).withColumn("written", F.lit(n).cast("bigint"))


@register("s04_read_split", O.q(["fx_docs"], "SELECT hf_id, split FROM fx_docs WHERE split = 'validation'"))
def s04_read_split(spark, sf):
    path = scratch_path(spark, "corpus")
    jobs.write_corpus(_docs(spark, sf), path)
    return jobs.read_corpus(spark, path, "validation").select("hf_id", "split")


@register("s05_lookup_keys", O.q(["fx_docs", "fx_manual"],
    "SELECT hf_id, question FROM fx_docs WHERE hf_id IN (SELECT uuid FROM fx_manual)"))
def s05_lookup_keys(spark, sf):
    keys = _fx(spark, sf, "fx_manual").select(F.col("uuid").alias("hf_id"))
    return src.find_by_keys(_docs(spark, sf), keys, "hf_id").select("hf_id", "question")


@register("s06_update_field", O.q(["fx_docs"],
    "SELECT d.hf_id, CASE WHEN c.hf_id IS NOT NULL THEN c.value ELSE d.quotes END AS quotes, "
    "CAST(c.hf_id IS NOT NULL AND d.quotes IS DISTINCT FROM c.value AS BIGINT) AS changed FROM fx_docs d "
    "LEFT JOIN (SELECT hf_id, original_quotes AS value FROM fx_docs WHERE doc_id % 5 = 0) c ON c.hf_id = d.hf_id"))
def s06_update_field(spark, sf):
    d = _fx(spark, sf, "fx_docs")
    changes = d.where(F.col("doc_id") % 5 == 0).select("hf_id", F.col("original_quotes").alias("value"))
    out = kd.update_field(d.select("hf_id", "quotes"), changes, "hf_id", "quotes")
    return out.select("hf_id", "quotes", F.col("changed").cast("bigint").alias("changed"))


@register("s07_key_violations", O.q(["fx_inf_files", "fx_inf"],
    "SELECT uuid, model, 'duplicate_in_batch' AS reason FROM fx_inf_files GROUP BY uuid, model HAVING count(*) > 1 "
    "UNION ALL SELECT DISTINCT b.uuid, b.model, 'exists_in_target' AS reason FROM fx_inf_files b "
    "WHERE EXISTS (SELECT 1 FROM fx_inf t WHERE t.uuid = b.uuid AND t.model = b.model)"))
def s07_key_violations(spark, sf):
    return kd.key_violations(_fx(spark, sf, "fx_inf_files"), _fx(spark, sf, "fx_inf"), ["uuid", "model"])


@register("s08_read_dataset", O.q(["fx_pool"], "SELECT id, question, split FROM fx_pool"))
def s08_read_dataset(spark, sf):
    path = scratch_path(spark, "published")
    ex = _fx(spark, sf, "fx_pool")
    ex.withColumn("target_split", F.col("split")).write.mode("overwrite").partitionBy("target_split").parquet(path)
    missing = src.read_table(spark, path + "-absent", ex.select("id", "question", "split").schema)
    return src.read_table(spark, path).select("id", "question", "split").unionByName(missing)


_LATEST = ("latest", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY doc_id DESC) AS rn "
                     "FROM rec WHERE uuid IS NOT NULL) WHERE rn = 1")
# records that came with an id keep it; those that did not are all new, each with an id of its own
_UPSERTED = ("SELECT uuid, question, answer, context, quotes FROM fx_testset WHERE uuid NOT IN (SELECT uuid FROM latest) "
             "UNION ALL SELECT uuid, question, answer, context, quotes FROM latest "
             "UNION ALL SELECT 'new' AS uuid, question, answer, context, quotes FROM rec WHERE uuid IS NULL")


def _testset_job(spark, sf):
    ts, inf, _ = _scoring(spark, sf)
    return jobs.build_testset(_fx(spark, sf, "fx_published"), ["test", "nosuch"],
                              current=ts.drop("doc_id"), inferences=inf, order=["doc_id"], unique_order=True)


def _new_ids_marked(df):
    """Generated ids (32 hex digits) as 'new'."""
    return df.withColumn("uuid", F.when(F.col("uuid").rlike("^[0-9a-f]{32}$"), F.lit("new")).otherwise(F.col("uuid")))


@register("s09_upsert_testset", O.q(["fx_published", "fx_testset"], _UPSERTED, [_REC, _LATEST]))
def s09_upsert_testset(spark, sf):
    return _new_ids_marked(_testset_job(spark, sf).testset)


@register("s09b_upsert_children", O.q(["fx_published", "fx_inf"],
    "SELECT uuid, model FROM fx_inf WHERE uuid NOT IN (SELECT uuid FROM latest)", [_REC, _LATEST]))
def s09b_upsert_children(spark, sf):
    return _testset_job(spark, sf).inferences.select("uuid", "model")


@register("s09c_upsert_count", O.q(["fx_published"], "SELECT count(*) AS upserted FROM rec", [_REC]))
def s09c_upsert_count(spark, sf):
    return _testset_job(spark, sf).upserted


_STORED_COLS = ("SELECT uuid, model, CAST(recall AS DOUBLE) AS recall, CAST(precision AS DOUBLE) AS precision, "
                "CAST(f1 AS DOUBLE) AS f1, CAST(bm25 AS DOUBLE) AS bm25, CAST(format_score AS DOUBLE) AS format_score ")


@register("s11_read_scores", O.q(O.SCORING_FX, _STORED_COLS + "FROM res WHERE status = 'scored'", O.scored_ctes()))
def s11_read_scores(spark, sf):
    nested = score_src.scores_to_nested(sc.stored_scores(_results(spark, sf)))
    return score_src.scores_from_nested(nested)


@register("s12_candidates", O.q(["fx_testset", "fx_inf"],
    "SELECT uuid FROM fx_testset t WHERE (t.quotes IS NULL OR t.quotes <> '') "
    "AND EXISTS (SELECT 1 FROM fx_inf i WHERE i.uuid = t.uuid)"))
def s12_candidates(spark, sf):
    ts, inf, _ = _scoring(spark, sf)
    return sc.candidate_documents(ts, inf).select("uuid")


@register("s13_write_scores", O.q(O.SCORING_FX + ["fx_prior_scores"],
    _STORED_COLS + "FROM fx_prior_scores UNION ALL " + _STORED_COLS + "FROM res WHERE status = 'scored'",
    O.scored_ctes(samples=_SAMPLES_RESUMED)))
def s13_write_scores(spark, sf):
    ts, inf, j = _scoring(spark, sf)
    ev = jobs.evaluate(spark, ts, inf, judgments=j, prior_scores=_fx(spark, sf, "fx_prior_scores"))
    return ev.scores


@register("s13b_keyed_upsert", O.q(["fx_inf"],
    "SELECT uuid, model, quotes FROM fx_inf WHERE model <> 'm_first' OR uuid NOT IN (SELECT uuid FROM fx_inf WHERE model = 'm_other') "
    "UNION ALL SELECT uuid, 'm_first', quotes FROM fx_inf WHERE model = 'm_other'"))
def s13b_keyed_upsert(spark, sf):
    """All inferences in a bucketed table, then the answers of one model replaced by keyed upsert."""
    path = scratch_path(spark, "keyed-inferences")
    rows = _fx(spark, sf, "fx_inf").select("uuid", "model", "quotes")
    keyed_table.write_table(rows, path, buckets=16)
    new = rows.where("model = 'm_other'").withColumn("model", F.lit("m_first"))
    keyed_table.upsert_table(new, path, buckets=16, match=["uuid", "model"])
    return keyed_table.read_table(spark, path, rows.schema)


@register("s12b_keyed_lookup", O.q(["fx_testset"], "SELECT uuid, question, answer, context, quotes FROM fx_testset WHERE uuid IN ('d1', 'd3', 'd64', 'd100', 'nobody')"))
def s12b_keyed_lookup(spark, sf):
    """Test records of a list of keys from a bucketed table of them all."""
    path = scratch_path(spark, "keyed-testset")
    rows = _fx(spark, sf, "fx_testset").drop("doc_id")
    keyed_table.write_table(rows, path, buckets=16)
    return keyed_table.lookup(spark, path, rows.schema, ["d1", "d3", "d64", "d100", "nobody"], buckets=16)


@register("s14_export_written", O.q(["fx_docs"],
    f"SELECT hf_id, split, quotes, {TARGET_SQL} AS target_split FROM fx_docs WHERE quotes IS NOT NULL AND {ROUTED}"))
def s14_export_written(spark, sf):
    path = scratch_path(spark, "export")
    jobs.curated_export(_docs(spark, sf), path)
    return spark.read.parquet(path).select("hf_id", "split", "quotes", "target_split")


# --------------------------------------------------------------------------- composed jobs
@register("c01_curated_export", O.q(["fx_docs"], _EXPORT_SQL))
def c01_curated_export(spark, sf):
    return _flat_export(jobs.curated_export(_docs(spark, sf)))


@register("c02_add_ids", O.q(["fx_published"], _IDS_SQL.format(
    cols=_P10_COLS, made="split = 'test'", src="fx_published").replace("ELSE 1 END", "ELSE 0 END")))
def c02_add_ids(spark, sf):
    path = scratch_path(spark, "with-ids")
    cols = ["question", "answer", "context", "quotes", "split"]
    jobs.add_ids(_fx(spark, sf, "fx_published").select(*cols), ["test"], out_path=path)
    out = spark.read.parquet(path)
    plain = out.where("uuid is null").groupBy(*cols).agg(
        F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("n_ids"), F.lit(0).cast("bigint").alias("n_shared"))
    return _id_counts(out.where("uuid is not null"), cols).unionByName(plain)


@register("c03_build_testset", O.q(["fx_published"], _IDS_SQL.format(
    cols="question, answer, context, quotes", made="TRUE", src="rec WHERE uuid IS NULL"), [_REC]))
def c03_build_testset(spark, sf):
    """The records that the job gave an id, as they stand in the new table."""
    t = _testset_job(spark, sf).testset
    return _id_counts(t.where(F.col("uuid").rlike("^[0-9a-f]{32}$")), ["question", "answer", "context", "quotes"])


_ALL_ROWS = ("allrows", "SELECT * FROM res UNION ALL SELECT t.uuid, i.model, 'skipped', NULL, NULL, NULL, NULL, NULL "
             "FROM fx_testset t JOIN fx_inf i ON i.uuid = t.uuid JOIN fx_prior_scores p ON p.uuid = t.uuid AND p.model = i.model "
             "WHERE t.quotes IS NOT NULL AND t.quotes <> '' AND i.quotes IS NOT NULL AND i.quotes <> ''")
_SUMMARY = (
    "SELECT model, "
    + ", ".join(f"coalesce({O.r4(f'avg(CASE WHEN f1 IS NOT NULL THEN {m} END)')}, 0.0) AS avg_{m}"
                for m in ("recall", "precision", "f1"))
    + f", count(f1) AS n_f1, coalesce({O.r4('avg(CASE WHEN bm25 <> 0 THEN bm25 END)')}, 0.0) AS avg_bm25, "
    "count(CASE WHEN bm25 <> 0 THEN bm25 END) AS n_bm25, "
    f"coalesce({O.r4('avg(format_score)')}, 0.0) AS avg_format_score, count(format_score) AS n_format, "
    + ", ".join(f"count(CASE WHEN status = '{s}' THEN 1 END) AS n_{s}" for s in rp.OUTCOMES)
    + " FROM allrows GROUP BY model"
)
_EVAL_CTES = O.scored_ctes(samples=_SAMPLES_RESUMED) + [_ALL_ROWS]


@register("a11c_counts_while_written", O.q(O.SCORING_FX + ["fx_prior_scores"],
    " UNION ALL ".join(f"SELECT '{o}' AS status, count(*) AS n FROM allrows WHERE status = '{o}'" for o in rp.OUTCOMES), _EVAL_CTES))
def a11c_counts_while_written(spark, sf):
    """Outcomes of a resumed evaluation, counted as its results are written."""
    return spark.createDataFrame(list(_evaluated(spark, sf).counts.items()), "status string, n bigint")


def _evaluated(spark, sf, **kw):
    ts, inf, j = _scoring(spark, sf)
    return jobs.evaluate(spark, ts, inf, judgments=j, prior_scores=_fx(spark, sf, "fx_prior_scores"), **kw)


@register("c05_evaluate", O.q(O.SCORING_FX + ["fx_prior_scores"], _SUMMARY, _EVAL_CTES))
def c05_evaluate(spark, sf):
    return _evaluated(spark, sf).summary


@register("a11b_outcomes_resumed", O.q(O.SCORING_FX + ["fx_prior_scores"],
    "SELECT model, status, count(*) AS n FROM allrows GROUP BY ALL", _EVAL_CTES))
def a11b_outcomes_resumed(spark, sf):
    return _evaluated(spark, sf).outcomes


class StubJudge:
    """A deterministic stand-in for a remote judge; fails on some responses."""

    def __call__(self, ground_truth, system_response):
        if len(system_response) % 7 == 0:
            raise ValueError("no answer")
        return len(system_response) % 5 / 4, len(ground_truth) % 5 / 4


@register("x04_callable_judge", O.q(O.SCORING_FX + ["fx_prior_scores"], _SUMMARY,
                                    O.scored_ctes("stub", samples=_SAMPLES_RESUMED) + [_ALL_ROWS]))
def x04_callable_judge(spark, sf):
    """The evaluation with a judge that is called, some calls failing."""
    return _evaluated(spark, sf, judge=StubJudge, parallelism=8, judge_chunks=3).summary


@register("c06_report_after_resume", O.q(O.SCORING_FX + ["fx_prior_scores"],
    O.report_select("allscores"),
    O.scored_ctes(samples=_SAMPLES_RESUMED)
    + [("allscores", _STORED_COLS + "FROM fx_prior_scores UNION ALL " + _STORED_COLS + "FROM res WHERE status = 'scored'")]))
def c06_report_after_resume(spark, sf):
    ts, inf, j = _scoring(spark, sf)
    ev = jobs.evaluate(spark, ts, inf, judgments=j, prior_scores=_fx(spark, sf, "fx_prior_scores"))
    return jobs.model_report(ev.scores)



# --------------------------------------------------------------------------- files and streams
#: Model -> folder name; one with a space, one with a plus sign.
_FOLDERS = {"m_exact": "m_exact", "m_first": "m_first", "m.noise-1": "m.noise+1", "m_other": "m other", "m_badfmt": "m_badfmt",
            "m_open": "m_open", "m_empty": "m_empty"}


def _write_answers(rows, folder, name):
    """One record a line, in as many files as there are tasks, gzipped; added to those that are there."""
    lines = rows.select(F.to_json(F.struct("uuid", "quotes"), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("append").option("compression", "gzip").text(f"{folder}/{name}.jsonl")


def _inference_files(spark, sf):
    """Inference files in a fresh folder: for each model a folder of one record a line, written in parallel."""
    folder = scratch_path(spark, "inference-files")
    inf = _fx(spark, sf, "fx_inf")
    for model, name in _FOLDERS.items():
        _write_answers(inf.where(F.col("model") == model), folder, name)
    return folder


_RENAMED = "CASE model WHEN 'm_other' THEN 'm other' WHEN 'm.noise-1' THEN 'm.noise+1' ELSE model END AS model"
_FILES_SQL = f"SELECT uuid, {_RENAMED}, quotes FROM fx_inf"


@register("s10_read_inferences", O.q(["fx_inf"], _FILES_SQL))
def s10_read_inferences(spark, sf):
    from evidence_spark.sources.inferences import read_inference_files

    return read_inference_files(spark, _inference_files(spark, sf)).select("uuid", "model", "quotes")


@register("c04_update_inferences", O.q(["fx_inf", "fx_testset"],
    f"SELECT * FROM ({_FILES_SQL}) WHERE uuid IN (SELECT uuid FROM fx_testset) "
    "UNION ALL SELECT uuid, model, quotes FROM fx_inf WHERE model IN ('m_other', 'm.noise-1')"))
def c04_update_inferences(spark, sf):
    """Files applied to a table that holds some of their pairs with other answers, and other models."""
    inf = _fx(spark, sf, "fx_inf").select("uuid", "model", "quotes")
    old = inf.where("model IN ('m_open', 'm_other', 'm.noise-1')").unionByName(
        inf.where("model = 'm_first'").withColumn("quotes", F.lit("old")))
    return jobs.update_inferences(spark, _inference_files(spark, sf), _fx(spark, sf, "fx_testset"), old)


#: What is in force after the second drop: m_first then has the answers of m_other, where there are any.
_DROPPED = ("dropped", f"SELECT uuid, {_RENAMED}, quotes FROM fx_inf WHERE model <> 'm_first' OR uuid NOT IN (SELECT uuid FROM fx_inf WHERE model = 'm_other') "
                       "UNION ALL SELECT uuid, 'm_first', quotes FROM fx_inf WHERE model = 'm_other'")


def _streamed(spark, sf, score):
    """Both streams over two drops of whole models, each drop in several batches, started anew
    for each; m_first is judged after the second drop, the other models after the first."""
    from evidence_spark.streaming import ingest as ig
    from evidence_spark.streaming import keyed

    folder, log, scores, said, ckpt, ckpt2 = (scratch_path(spark, n) for n in ("dropped-files", "inference-log", "score-log", "judgments", "ingest-ckpt", "scoring-ckpt"))
    inf, ts = _fx(spark, sf, "fx_inf"), _fx(spark, sf, "fx_testset").drop("doc_id")
    judged = _fx(spark, sf, "fx_all_judgments").drop("doc_id").withColumn("model", F.expr(_RENAMED.removesuffix(" AS model")))

    def run(batches):
        files = len(spark.read.text(f"{folder}/*.jsonl").inputFiles())
        ig.start_ingest(spark, folder, ts, log, ckpt, max_files_per_trigger=-(-files // batches)).awaitTermination()
        if score:
            keyed.start_scoring(spark, ts, log, scores, ckpt2, judgment_dir=said).awaitTermination()

    for model, name in _FOLDERS.items():
        _write_answers(inf.where(F.col("model") == model), folder, name)
    run(3)
    judged.where("model <> 'm_first'").write.mode("append").parquet(said)
    # the lines of m_other once more, as answers of m_first
    spark.read.text(f"{folder}/{_FOLDERS['m_other']}.jsonl").write.mode("append").option("compression", "gzip").text(f"{folder}/m_first.jsonl")
    run(3)
    ig.compact_logs(spark, log, scores if score else None, 2)
    judged.where("model = 'm_first'").write.mode("append").parquet(said)
    run(3)
    return ig, log, scores


@register("x01_stream_ingest", O.q(["fx_inf"], "SELECT uuid, model, quotes FROM dropped", [_DROPPED]))
def x01_stream_ingest(spark, sf):
    """Two drops of answers, streamed in batches, the log folded in between: the last answers."""
    ig, log, _ = _streamed(spark, sf, score=False)
    return ig.current_inferences(spark, log)


_STREAM_SAMPLES = ("samples", "SELECT t.uuid, d.model, t.quotes AS gt, d.quotes AS resp FROM fx_testset t JOIN dropped d ON d.uuid = t.uuid "
                              "WHERE t.quotes IS NOT NULL AND t.quotes <> '' AND d.quotes IS NOT NULL AND d.quotes <> ''")
_STREAM_JUDGED = ("fx_judgments", f"SELECT uuid, {_RENAMED}, recall, precision FROM fx_all_judgments")


@register("x02_stream_scoring", O.q(["fx_testset", "fx_all_judgments"],
    _STORED_COLS + "FROM res WHERE status = 'scored'", [_DROPPED, _STREAM_JUDGED] + O.scored_ctes(samples=_STREAM_SAMPLES)))
def x02_stream_scoring(spark, sf):
    """Scores of all pairs by the keyed stream, with judgments that come after the answers."""
    ig, _, scores = _streamed(spark, sf, score=True)
    return ig.current_scores(spark, scores)


@register("p13c_chat_tools", O.q([],
    "SELECT p.conv_id, '<|im_start|>system' || chr(10) || CASE WHEN s.system IS NOT NULL AND s.system <> '' THEN chr(10) || s.system ELSE '' END || "
    f"'{ch.TOOLS_HEAD}' || chr(10) || '{{\"type\": \"function\", \"function\": {{\"name\": \"f' || CAST(p.conv_id AS VARCHAR) || '\"}}}}' || "
    f"'{ch.TOOLS_TAIL}' || '<|im_end|>' || chr(10) || "
    "string_agg(p.piece, '' ORDER BY p.turn) AS rendered FROM pc p JOIN st s ON s.conv_id = p.conv_id "
    "GROUP BY p.conv_id, s.system", [_CONV_STATS, _PIECES]))
def p13c_chat_tools(spark, sf):
    """Every conversation with one tool defined."""
    tool = F.concat(F.lit('{"name": "f'), F.col("conv_id").cast("string"), F.lit('"}'))
    return ch.render_conversations(spark.read.parquet(f"{sf}/conversations.parquet").withColumn("tools", F.array(tool)))


# --------------------------------------------------------------------------- streaming
@register("x03_live_report", O.q(O.SCORING_FX, O.report_select("stored"), O.scored_ctes() + [("stored", "SELECT * FROM res WHERE status = 'scored'")]))
def x03_live_report(spark, sf):
    """Stored scores written as files, read back as a stream, live per-model means."""
    import uuid as _uuid

    from evidence_spark.streaming.ingest import live_model_averages

    path = scratch_path(spark, "score-files")
    stored = sc.stored_scores(_results(spark, sf))
    stored.write.mode("overwrite").parquet(path)
    stream = spark.readStream.schema(stored.schema).parquet(path)
    name = "live_report_" + _uuid.uuid4().hex[:8]
    q = (live_model_averages(stream).writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", scratch_path(spark, "live-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)
