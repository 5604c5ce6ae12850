"""The pipeline, and its parts where the folder's operators can be left out."""

import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import bpe, linededup, mixing, simhash, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    first = toxicity.scored(docs, labels).where("NOT is_toxic").select(*docs.columns).collect()
    a = spark.createDataFrame(first, docs.schema)
    second = [r for r in linededup.deduplicated(a).collect() if r.n_removed_lines == 0 or (r.text or "").split()]
    b = spark.createDataFrame([tuple(r)[:5] for r in second], docs.schema)
    c = spark.createDataFrame(simhash.one_of_each(b).collect(), docs.schema)
    d = mixing.mixed(c)
    want = sorted(map(tuple, bpe.round_trip(d).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == want
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "tokens"]


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    odd = [
        (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, 0), (3, "Same text here, twice over.", "en", "a", None),
        (3, "Same text here, twice over.", "en", "a", None), (4, "x" * 5000, "de", "b", 27), (5, "One two.\nThree four.\nFive six.", "en", "b", 1),
        (6, "Seven.\nOne two.\nThree four.\nFive six.", "en", "b", 1), (None, "An id that is null.", "en", "c", 3),
    ]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for k, rows in enumerate((df, df.where("false"))):
        folder = str(tmp_path / str(k))
        rows.withColumn("_row", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        found = corpus_pipeline.run(spark, folder).collect()
        assert bool(found) == (k == 0) and len({r.doc_id for r in found}) <= 7


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns


def test_library_stands_without_this_folder():
    code = "import sys; sys.modules['skein.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k[:2] == 'op' and k[2].isdigit() for k in q)"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
