"""What long operators leave in the driver: broadcasts are dropped, and garbage is collected between steps."""

from pyspark import SparkContext
from pyspark.sql import functions as F

from seqloom.llm import bpe, line_dedup, ngram_join


def collections(spark):
    """Whole collections of the driver's heap so far."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep"))


def rows(spark):
    base = [" ".join(f"w{g}x{i}" for i in range(60)) for g in range(3)]
    docs = [(g * 10 + k, base[g] if not k else base[g].replace(f"w{g}x{k} ", "other ", 1)) for g in range(3) for k in range(3)]
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_join_leaves_no_broadcast(spark, monkeypatch):
    sent, make = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(make(self, value)) or sent[-1])
    before = collections(spark)
    out = ngram_join.classes(rows(spark), num=60)
    assert len(sent) == 1 and not sent[0]._jbroadcast.isValid()
    assert collections(spark) - before >= 5
    # The lazy result needs nothing that was dropped.
    assert {(r["id"], r["component_id"]) for r in out.collect()} == {(g * 10 + k, g * 10) for g in range(3) for k in range(3)}


def test_line_dedup_collects_between_steps(spark):
    before = collections(spark)
    out = line_dedup.deduped(rows(spark).withColumn("text", F.concat("text", F.lit("\nthe same line in all of them"))), exact=1)
    assert collections(spark) - before >= 3
    assert out.where("text LIKE '%the same line%'").count() == 1


def test_plans_spell_no_vocabulary_out(spark):
    docs = spark.createDataFrame([(1, "some words and some words"), (2, None)], "doc_id long, text string")
    store = spark._jsparkSession.sharedState().statusStore()
    known = {e.executionId() for e in (store.executionsList().apply(i) for i in range(store.executionsList().size()))}
    out = bpe.encode_documents(docs, decode=True)
    assert [r["n_tokens"] > 0 for r in out.orderBy("doc_id").collect()] == [True, False]
    assert bpe.decode_documents(out).where("doc_id = 1").first()["decoded"].decode() == "some words and some words"
    done = store.executionsList()
    kept = [len(e.physicalPlanDescription()) for e in (done.apply(i) for i in range(done.size())) if e.executionId() not in known]
    assert kept and max(kept) < 100_000
