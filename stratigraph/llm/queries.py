"""Queries of the llm problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratigraph.llm import bpe, docpairs, language, neighbours, packing, provenance, rank_walk, syntax
from stratigraph.session import table


def p1_found(spark, d):
    r = rank_walk.fused_ranking(table(spark, d, "context_items"), table(spark, d, "fused_entries"))
    return r.where("place <= 3").select("query_id", "item_id")


def p1_ranking(spark, d):
    r = rank_walk.fused_ranking(table(spark, d, "context_items"), table(spark, d, "fused_entries"))
    return r.select("query_id", "item_id", F.round("weight", 9).alias("weight"), "place")


def p2_found(spark, d):
    return provenance.provenance(table(spark, d, "files")).where("reason != ''").select("repo", "path")


def p2_reasons(spark, d):
    return provenance.provenance(table(spark, d, "files"))


def p3_found(spark, d):
    return syntax.parse_files(table(spark, d, "files")).where("error_line > 0").select("repo", "path")


def p3_errors(spark, d):
    return syntax.parse_files(table(spark, d, "files"))


def p3_rates(spark, d):
    return syntax.error_rates(syntax.parse_files(table(spark, d, "files")))


def p4_found(spark, d):
    # inherited descriptions are a pointer elsewhere: no case
    return docpairs.pairs(table(spark, d, "declarations"), table(spark, d, "files")).where("origin = 'own'").select("decl_id")


def p4_pairs(spark, d):
    return docpairs.pairs(table(spark, d, "declarations"), table(spark, d, "files"))


def p7_found(spark, d):
    p = neighbours.similar_pairs(neighbours.nearest(table(spark, d, "chunk_vec")), 0.85)
    return p.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p7_neighbours(spark, d):
    n = neighbours.nearest(table(spark, d, "chunk_vec"))
    return n.select(F.col("id").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"), F.round("similarity", 6).alias("similarity"), "place")


def p8_ids(spark, d):
    return bpe.encode_texts(table(spark, d, "documents"))


def p9_found(spark, d):
    # a document is split where its pieces stand in different containers
    p = packing.pack_documents(table(spark, d, "documents")).where("pieces > 1")
    return p.groupBy("doc_id").agg(F.count_distinct("container").alias("n")).where("n > 1").select("doc_id")


def p9_containers(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


def p9_report(spark, d):
    p = packing.pack_documents(table(spark, d, "documents"))
    return p.agg(F.count_distinct(F.when(F.col("size") > 0, F.col("container"))).alias("containers"), F.sum("size").alias("tokens"), F.ceil(F.sum("size") / 4096).alias("least_containers"))


def _segments(spark, d):
    docs, names = table(spark, d, "documents"), table(spark, d, "languages")
    return language.segments(docs, language.train_on(docs, names), label=language.label_code(F.col("lang"), names))


def p10_found(spark, d):
    return language.wrong_labels(language.document_languages(_segments(spark, d))).select("doc_id", "lang")


def p10_segments(spark, d):
    return _segments(spark, d).select("doc_id", "seg_start", "seg_end", "lang", F.round("confidence", 4).alias("confidence"))


def p10_documents(spark, d):
    return language.document_languages(_segments(spark, d)).select("doc_id", "lang", F.round("confidence", 4).alias("confidence"), "n_sentences")


QUERIES = {"p1_found": p1_found, "p1_ranking": p1_ranking, "p2_found": p2_found, "p2_reasons": p2_reasons, "p3_found": p3_found, "p3_errors": p3_errors, "p3_rates": p3_rates, "p4_found": p4_found, "p4_pairs": p4_pairs, "p7_found": p7_found, "p7_neighbours": p7_neighbours, "p8_ids": p8_ids, "p9_found": p9_found, "p9_containers": p9_containers, "p9_report": p9_report, "p10_found": p10_found, "p10_segments": p10_segments, "p10_documents": p10_documents}
SQL = {}
