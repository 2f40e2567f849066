"""Benchmark the headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Input tables (corpus, test set, inferences, judgments, ...) are first shaped from the
driver's Parquet and written once to a scratch folder; each timed query then reads
those tables and runs the library's job end to end (forced with the ``noop`` sink).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from evidence_spark.operators import chat as ch  # noqa: E402
from evidence_spark.operators import report as rp  # noqa: E402
from evidence_spark.operators import scoring as sc  # noqa: E402
from evidence_spark.plans import jobs  # noqa: E402
from evidence_spark.plans.fixtures import fixture  # noqa: E402
from evidence_spark.session import build_session  # noqa: E402
from evidence_spark.sources.inferences import attach_inferences  # noqa: E402

INPUTS = ["fx_docs", "fx_testset", "fx_inf", "fx_judgments", "fx_existing", "fx_published",
          "fx_prior_scores", "fx_inf_files", "fx_manual"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    scratch = tempfile.mkdtemp(prefix="evidence-bench-")
    spark = build_session(
        master=f"local[{cpus}]",
        shuffle_partitions=max(8, cpus * 2),
        conf={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"), "spark.driver.memory": "16g"},
    )
    t0 = time.time()
    tables, stored = {}, {}
    for name in INPUTS:
        path = os.path.join(scratch, name)
        # inputs are stored as several files, as real datasets are
        fixture(spark, sf_dir, name).repartition(max(8, cpus * 2)).write.mode("overwrite").parquet(path)
        tables[name] = path
    prep = time.time() - t0

    def t(name):
        return spark.read.parquet(tables[name])

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    def q_evaluate():
        ev = jobs.evaluate(spark, t("fx_testset").drop("doc_id"), t("fx_inf"), judgments=t("fx_judgments"),
                           prior_scores=t("fx_prior_scores"))
        run(ev.scores)
        run(ev.summary)
        run(ev.outcomes)
        stored["scores"] = ev.scores

    def q_evaluate_lexical():
        ev = jobs.evaluate(spark, t("fx_testset").drop("doc_id"), t("fx_inf"), judge="lexical")
        run(ev.scores)
        run(ev.summary)

    def q_bm25_only():
        samples = sc.evaluation_samples(t("fx_testset"), t("fx_inf"))
        from evidence_spark.functions.text import parse_quotes
        from evidence_spark.operators import bm25 as bm

        s = samples.withColumn("resp_quotes", parse_quotes("system_response"))
        run(bm.add_bm25(s, "gold_quotes", "resp_quotes").select("uuid", "model", "bm25"))

    def q_report():
        # over the whole score table that the evaluation left
        run(rp.model_report(stored["scores"]))

    def q_manual():
        table, count = jobs.manual_override(t("fx_manual"), t("fx_testset"), t("fx_inf"), t("fx_prior_scores"))
        run(table)

    def q_export():
        jobs.curated_export(t("fx_docs").drop("doc_id"), os.path.join(scratch, "export"))

    def q_merge():
        out = jobs.merge_dataset(t("fx_existing").drop("doc_id"), t("fx_docs").drop("doc_id"), split="train")
        run(out)

    def q_testset():
        r = jobs.build_testset(t("fx_published"), ["test"], current=t("fx_testset").drop("doc_id"),
                               inferences=t("fx_inf"), order=["doc_id"], unique_order=True)
        run(r.testset)
        run(r.inferences)

    def q_attach():
        run(attach_inferences(t("fx_testset"), t("fx_inf"), t("fx_inf_files")))

    def q_chat():
        run(ch.render_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))

    queries = {
        "evaluate": q_evaluate,
        "evaluate_lexical": q_evaluate_lexical,
        "bm25": q_bm25_only,
        "report": q_report,
        "manual_override": q_manual,
        "curated_export": q_export,
        "merge": q_merge,
        "testset_upsert": q_testset,
        "attach_inferences": q_attach,
        "chat_render": q_chat,
    }
    times = {}
    for name, fn in queries.items():
        start = time.time()
        fn()
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "cpus": cpus, "input_prep_sec": round(prep, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
