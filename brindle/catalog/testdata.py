"""The registry of the project's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.catalog.registry import FieldSpec, Registry, table_from_schema
from brindle.session import read

# Primary keys, and edges from child to parent.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id",
    "audio_asset": "audio_id", "image_asset": "image_id", "text_asset": "text_id", "person": "person_id", "proceeding": "proceeding_id", "opinion_text": "row_id", "cl_opinion_cluster": "row_id", "cl_citation_map": "row_id", "benchmark": "item_id",
}
EDGES = (
    ("nation.n_regionkey", "region.r_regionkey"), ("customer.c_nationkey", "nation.n_nationkey"), ("supplier.s_nationkey", "nation.n_nationkey"), ("orders.o_custkey", "customer.c_custkey"), ("lineitem.l_orderkey", "orders.o_orderkey"), ("lineitem.l_partkey", "part.p_partkey"), ("lineitem.l_suppkey", "supplier.s_suppkey"),
    ("nation.n_regionkey", "nation.n_regionkey"), ("audio_asset.document_id", "documents.doc_id"), ("image_asset.document_id", "documents.doc_id"), ("text_asset.document_id", "documents.doc_id"), ("cl_citation_map.cited_opinion_id", "cl_opinion_cluster.opinion_id"), ("opinion_text.cluster_id", "cl_opinion_cluster.cluster_id"),
)


def testdata_registry(spark: SparkSession, root: str, frames: dict[str, DataFrame] | None = None) -> Registry:
    """The registry of all tables, or of the given ones, whose schemas are then not read again."""
    frames = frames if frames is not None else {name: read(spark, root, name) for name in KEYS}
    overlays = {
        "documents": {"text": FieldSpec("text", "TEXT", embeddable=True), "title": FieldSpec("title", "TEXT"), "chunks": FieldSpec("chunks", "TEXT_CHUNKED", "chunk", 30, derivation="CHUNK", source_field="text")},
        "text_asset": {"plain_text": FieldSpec("plain_text", "TEXT", embeddable=True), "parsed": FieldSpec("parsed", "DOC_SCAN", derivation="DOC_PARSE", source_field="html")},
        "audio_asset": {"timestamp_index": FieldSpec("timestamp_index", "AUDIO", "segment", 120, parts=(("start_seconds", "offset"), ("end_seconds", "offset"), ("speaker", "text"), ("text", "text"))), "spoken": FieldSpec("spoken", "TEXT", derivation="ASR", source_field="timestamp_index")},
        "image_asset": {"ocr_text": FieldSpec("ocr_text", "TEXT"), "pages": FieldSpec("pages", "IMAGE_SET", "page", 1, derivation="RASTERIZE", source_field="image_ref")},
        "opinion_text": {"plain_text": FieldSpec("plain_text", "TEXT", embeddable=True)},
        "benchmark": {"text": FieldSpec("text", "TEXT", embeddable=True)},
    }
    tables = [table_from_schema(name, key, frames[name].schema, **overlays.get(name, {})) for name, key in KEYS.items() if name in frames]
    side = lambda s: (s.split(".")[0], tuple(s.split(".")[1:]))
    return Registry("testdata", tables, [(side(a), side(b)) for a, b in EDGES if {side(a)[0], side(b)[0]} <= set(frames)])
