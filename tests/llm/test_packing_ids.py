"""The packing query's pieces against the tokenizer's own library: ids, cuts, checksums and places."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fieldweave.llm import packing

ODD = [None, "", "<|endoftext|> inside", "a  b\n\n c", "word " * 3_000, "é\U0001f642\x00", " " * 60_000 + "x", "it's 2024", " \t lead"]


def test_pieces_and_places_brute(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, text in rows:
        ids = np.array(own.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or min(len(ids), 1024)
        edges = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, piece] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.packing_report(table.withColumn("length", table.doc_id).withColumn("sequence_id", table.text)).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == np.concatenate([[0], np.cumsum(part["length"])[:-1]]).tolist() and part["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= 1.02 * -(-got["length"].sum() // 1024)
