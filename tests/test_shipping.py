"""Functions that run Python on executors bring the package along."""

from .shipping import run


def test_functions_run_from_another_folder(tmp_path):
    one = "spark.createDataFrame([('{\"@id\": \"a\"}', 1)], 'x string, k int')"
    calls = [
        f"{one}.select(evidence.verbatim_quote(F.col('x'), F.col('x')))", f"{one}.select(arrow.nfc('x'))", f"{one}.select(arrow.repaired_json('x'))", f"{one}.select(arrow.rewritten_json('x', {{}}))",
        f"{one}.select(arrow.patch_problems('x'))", f"{one}.select(pages.page('x'))", f"numbering.numbered({one}, ['k'], 'x')",
        "jobs.job_states(spark.sql(\"select 'a' job, current_timestamp() at, 1L seq, 'enqueue' event\"))",
    ]
    run(calls, "from civicframe.functions import arrow, evidence\nfrom civicframe.operators import numbering\nfrom civicframe.sources import pages\nfrom civicframe.streaming import jobs", tmp_path)
