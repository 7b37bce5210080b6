"""Operators bring the package along to the executors, each as the first call of a session."""

from ..shipping import run


def test_operators_run_from_another_folder(tmp_path):
    docs = "spark.createDataFrame([(1, 'some words of a text', 'a'), (2, 'other words', 'a')], 'doc_id long, text string, source string')"
    labels = "spark.createDataFrame([(1, 0, 0), (2, 1, 1)], 'doc_id long, quality int, toxic int')"
    pages = "spark.createDataFrame([(1, 'u', '<p>x</p>')], 'page_id long, url string, html string')"
    calls = [
        f"html_extract.main_text({pages})", f"packing.pack({docs}, catalog.tokenizer('word_bpe_49k.json'))", f"quality.statistics({docs})", f"quality.quality({docs}, {labels})", f"warc.round_trip({pages})",
        f"toxicity.toxicity({docs}, {labels})", f"near_dups.near_duplicates({docs})", f"tokens.counts({docs}, catalog.tokenizer('byte_bpe_50k.tiktoken'), public_tokenizers.PATTERN)",
        "prefix_trie.prefix_trie(spark.createDataFrame([(1, 0, 'u', 'x')], 'conv_id long, turn long, role string, text string'))[0]", f"resampling.resample({docs}, {docs})",
        "vector_search.search(spark.createDataFrame([(0, [1.0])], 'vec_id long, embedding array<double>'))",
    ]
    run(calls, "import public_tokenizers\nfrom civicframe.llm import catalog, html_extract, near_dups, packing, prefix_trie, quality, resampling, tokens, toxicity, vector_search, warc", tmp_path)
