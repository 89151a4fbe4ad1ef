import hashlib

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from ohmlake.llm import bpe, language
from tests.llm import test_decontaminate, test_jaccard, test_quality

AT = "/root/testdata/sf0.001"


def brute(docs, items, sure):
    docs = [(i, t) for i, t in docs if sure[i]]
    docs = [(i, t) for i, t in docs if test_quality.brute(t)[-1]]
    rows, group, sets = test_jaccard.brute(docs, 5, 80)
    least = {}
    for (i, _), g in zip(docs, group):
        least[g] = min(i, least.get(g, i))
    docs = [(i, t) for (i, t), g, s in zip(docs, group, sets) if not s or least[g] == i]
    return [(i, t) for i, t in docs if not test_decontaminate.brute(t, items)[1]]


def test_run_is_the_stages_one_after_another(spark):
    table = spark.read.parquet(f"{AT}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    found = language.predict(table, language.train_on(table)).collect()
    sure = {r.doc_id: r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SURE for r in found}
    want = dict(brute(docs, items, sure))
    rows = corpus_pipeline.run(spark, AT).collect()
    assert {r.doc_id for r in rows} == set(want) and len(rows) == len(want) > 100
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in rows:
        ids = b"".join(x.to_bytes(4, "little") for x in library.encode_ordinary(want[r.doc_id]))
        assert bytes(r.ids) == ids and r.n_tokens == len(ids) // 4
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_stages_keep_columns_and_stand_odd_rows(spark):
    table = spark.read.parquet(f"{AT}/documents.parquet")
    odd = table.limit(60).union(table.limit(3)).union(table.limit(4).withColumn("text", F.lit(None).cast("string"))).union(table.limit(4).withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.withColumns({"score": F.lit("mine"), "kept": F.lit(7), "items": F.lit("i"), "_row": F.lit(1), "n": F.lit(2)})
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, AT)
            assert out.columns == docs.columns
            rows = out.collect()
            assert all(r.score == "mine" and r.kept == 7 and r["_row"] == 1 for r in rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, AT).count() == docs.count()
