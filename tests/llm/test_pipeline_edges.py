"""Each stage of the pipeline over null and repeated ids, and over no rows."""

import os
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from sentrylake.llm import pipeline, queries  # noqa: E402

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_ids_do_not_tell_rows_apart(spark):
    rows = [(d, f"{'w ' * n}{chr(97 + n)}{d}", "en", "src0", None) for n in range(2, 8) for d in (None, None, 1, 1, 2)] + [(None, None, None, None, None), (3, "", "de", "src1", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    chosen = queries.mixed(df).collect()
    got = pipeline.mix(spark, df, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in chosen)
    assert Counter((r.doc_id, len((r.text or "").split())) for r in got) == Counter((r.doc_id, r.take_tokens) for r in chosen)


def test_every_stage_over_odd_and_no_rows(spark):
    odd = [(1, "a b c d e f", "en", "src0", 11), (1, "g h i j k l", "en", "src0", 11), (None, "m n o p q", "de", None, None), (None, None, None, None, None), (4, "", "fr", "src9", 0)]
    for rows in (odd, []):
        df = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            if name != "packing":
                assert out.columns == df.columns, name
            n = out.count()
            assert n <= len(rows) * (queries.MAX_EPOCHS if name == "source mixing" else 1) + (len(rows) if name == "packing" else 0), name
