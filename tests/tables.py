"""Empty tables with columns of clashing names besides their own."""

from __future__ import annotations

SCHEMAS = {
    "read_barcodes": "rec_id bigint, barcode bigint, rec_offset bigint, len1 int, len2 int, lane int, seen_at timestamp_ntz, loaded_at timestamp_ntz",
    "seq_reads": "read_id bigint, mate int, name string, info string, seq string, note string, qual string, len int, lib string, loaded_at timestamp_ntz",
    "kmer_hash": "slot_id bigint, keys bigint, adjs int, word_size int, batch_no int",
    "contigs": "edge_id bigint, rc_id bigint, node_from bigint, node_to bigint, graph string, seq_len int, cnt bigint, holes array<struct<pos:int,len:int>>",
    "repeat_contigs": "edge_id bigint, seq_len int, copies int",
    "contig_links": "e1 bigint, e2 bigint, n_read int, n_pair int, counted_at timestamp_ntz",
    "edge_barcodes": "edge bigint, kind string, n_item int, keys array<bigint>, cnts array<int>, dumped_at timestamp_ntz",
    "mm_db": "edge bigint, p int, mm bigint, k int",
    "mm_align": "edge bigint, pos int, cnt int, mm bigint",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, paper_id string, issue_date date, page_no int, boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>, scanned_at timestamp_ntz, loaded_at timestamp_ntz",
    "raw_reads": "rec_id bigint, fmt string, raw string, received_at timestamp_ntz",
    "mix_targets": "source string, target_share double, max_repeats int",
}
CLASHES = ["n", "key", "id", "src", "tok", "h", "hot", "shard", "kmer", "cov", "k", "level", "u", "v", "x", "bin", "share", "reason", "error", "ids", "n_tokens", "block", "kind", "value", "best", "score", "adj", "size"]


def write_empty(spark, folder: str) -> str:
    for name, schema in SCHEMAS.items():
        own = {c.strip().split(" ")[0] for c in schema.split(", ")}
        more = "".join(f", {c} string" for c in CLASHES if c not in own)
        spark.createDataFrame([], schema + more).write.parquet(f"{folder}/{name}.parquet")
    return folder
