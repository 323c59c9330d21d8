"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one line of JSON.

The keyword index and the embedded chunks are built and saved once, and timed; the queries then run on what is saved, as a user's do.
"bm25_topk_rebuilt" and "index_build_s" say what building costs.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import time

from whinstone.operators import fusion, metrics
from whinstone.operators.index import Index, bm25_search, build_index
from whinstone.operators.retrieval import Retriever
from whinstone.plans.catalogue import MD5_DIM, QUERIES, documents, items, qrels, ranking, retriever, two_lists
from whinstone.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
REPEATS = 3
#: Of the catalogue, as they are: they need no index, or build what they measure.
WHOLE = ["vector_topk_exact", "hash_embed_terms", "chunk_documents", "sync_diff_status", "best_note_coverage"]


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/tmp/whinstone-bench-{os.getpid()}"
    run(QUERIES["bm25_topk"](spark, SF_DIR))  # compiles and starts Python workers
    built = timed(lambda: build_index(documents(spark, SF_DIR)).save(f"{folder}/index"))
    index, asked = Index.load(spark, f"{folder}/index"), items(spark, SF_DIR)
    found, embedded = retriever(spark, SF_DIR)
    embed = timed(lambda: (found.chunks.write.parquet(f"{folder}/chunks"), embedded.write.parquet(f"{folder}/asked")))
    saved = Retriever(spark.read.parquet(f"{folder}/chunks")).use_index(index)
    embedded = spark.read.parquet(f"{folder}/asked")
    headline = {
        "bm25_topk": lambda: bm25_search(index, asked),
        "search_hybrid": lambda: saved.search(embedded, 10, "hybrid"),
        "search_notes_dedup": lambda: saved.search_notes(asked, 5, "keyword"),
        "rrf_fusion": lambda: fusion.reciprocal_rank_fusion(two_lists(spark, SF_DIR, index)),
        "evaluate_report": lambda: metrics.evaluate(ranking(spark, SF_DIR, 10, index), qrels(spark, SF_DIR), asked),
        **{name: lambda name=name: QUERIES[name](spark, SF_DIR) for name in WHOLE},
    }
    times: dict[str, list[float]] = {name: [] for name in headline}
    for _ in range(REPEATS):  # interleaved, so that a slow minute hits all alike
        for name, f in headline.items():
            times[name].append(timed(lambda f=f: run(f())))
    rebuilt = timed(lambda: run(QUERIES["bm25_topk"](spark, SF_DIR)))
    n = asked.count()
    queries = {name: round(statistics.median(t), 3) for name, t in times.items()}
    print(
        json.dumps(
            {
                "metric": "total of headline queries", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries,
                "sf": SF_DIR, "spread": {k: round(max(t) - min(t), 3) for k, t in times.items()}, "index": "saved", "index_build_s": round(built, 3),
                "embed_s": round(embed, 3), "embed_dim": MD5_DIM, "bm25_topk_rebuilt": round(rebuilt, 3),
                "indexed_batch_s": queries["bm25_topk"], "indexed_queries_per_s": round(n / queries["bm25_topk"], 1),
            }
        )
    )
    shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
