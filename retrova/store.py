"""A store of chunks in one folder: ingest, search, look up, delete, compact; and its tools by name, for agents.

The folder holds segments. A change writes one segment of its own rows and touches
no other: chunks that are put, and ids that are deleted. Of an id's rows the last
segment's counts. `compact` writes one segment of what is left, and drops the others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunks as C
from .operators import lexical
from .plans.request import SearchRequest
from .plans.search import search, search_batch
from .storage import exists

VERSION = 1
_SEGMENT = "seq long, op string, id string, doc_id string, content string, metadata string, embedding array<float>, source string"
_PUT = ("id", "doc_id", "content", "metadata", "embedding", "source")


@dataclass
class Store:
    """`open` makes or opens one. Only one process should change a store at a time."""

    spark: SparkSession
    path: str

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        store = cls(spark, path)
        if not exists(spark, f"{path}/segments"):
            store._write(spark.createDataFrame([], _SEGMENT), 0)
        return store

    def _segments(self) -> list[int]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)
        names = [f.getPath().getName() for f in found]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("n=") and exists(self.spark, f"{self.path}/segments/{n}/_SUCCESS"))

    def _write(self, rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/segments/n={n}")

    def _add(self, rows: DataFrame) -> int:
        n = self._segments()[-1] + 1
        self._write(rows, n)
        return n

    def _rows(self) -> DataFrame:
        """All rows of all segments; a row's age is (n, seq)."""
        paths = [f"{self.path}/segments/n={n}" for n in self._segments()]
        return self.spark.read.schema(f"{_SEGMENT}, n int").option("basePath", f"{self.path}/segments").parquet(*paths)

    def chunks(self) -> DataFrame:
        """The chunks as they are: rowid and created_at follow from the age of an id's first row, its content is the last one's."""
        rows = self._rows()
        age = F.struct("n", "seq")
        last = rows.groupBy("id").agg(F.max_by(F.struct("op", *_PUT[1:]), age).alias("c"), F.min(age).alias("first")).where("c.op = 'put'")
        # seq is under 2**50 for 2**17 tasks of a segment, and 2**13 segments go between compactions: numbers keep the order without a sort of all rows
        number = F.shiftleft(F.col("first.n").cast("long"), 50) + F.col("first.seq")
        return last.select(number.alias("rowid"), "id", "c.doc_id", "c.content", "c.metadata", "c.embedding", number.alias("created_at"), "c.source")

    def documents(self) -> DataFrame:
        """(id, source): the documents that chunks name; the source is the first chunk's."""
        return self.chunks().groupBy(F.col("doc_id").alias("id")).agg(F.min_by("source", "rowid").alias("source"))

    def ingest(self, rows: DataFrame) -> int:
        """Puts (id, doc_id, content, and metadata, embedding, source where they are): known ids are replaced, of equal ones the last stays. An empty id is an error. Says how many rows were put."""
        have = set(rows.columns)
        default = {"metadata": F.lit("{}"), "embedding": F.lit(None).cast("array<float>"), "source": F.lit(None).cast("string")}
        named = [F.coalesce(F.col(c), F.lit("{}")).alias(c) if c == "metadata" and c in have else F.col(c) if c in have else default[c].alias(c) for c in _PUT]
        bad = F.when(F.coalesce(F.trim("id") == "", F.lit(True)), F.raise_error(F.lit("a chunk id is empty")).cast("string")).otherwise(F.col("id"))
        out = rows.select(*named).withColumn("id", bad).withColumns({"seq": F.monotonically_increasing_id(), "op": F.lit("put")})
        n = self._add(out.select(*[c.split()[0] for c in _SEGMENT.split(", ")]))
        return self.spark.read.parquet(f"{self.path}/segments/n={n}").count()

    def _delete(self, ids: DataFrame) -> int:
        empty = {c: F.lit(None).cast("array<float>" if c == "embedding" else "string") for c in _PUT[1:]}
        out = ids.select("id").withColumns({"seq": F.monotonically_increasing_id(), "op": F.lit("del"), **empty})
        n = self._add(out.select(*[c.split()[0] for c in _SEGMENT.split(", ")]))
        return self.spark.read.parquet(f"{self.path}/segments/n={n}").count()

    def delete_by_metadata(self, key: str, value: str) -> int:
        """How many chunks went."""
        return self._delete(self.chunks().where(C.metadata_value(key) == value))

    def delete_document(self, doc_id: str) -> int:
        return self._delete(self.chunks().where(F.col("doc_id") == doc_id))

    def lookup(self, ids: list[str]) -> DataFrame:
        """The chunks of these ids, in their order."""
        wanted = self.spark.createDataFrame(list(enumerate(dict.fromkeys(ids))), "place long, id string")
        return C.lookup(self.chunks(), F.broadcast(wanted)).drop("place")

    def index(self) -> lexical.TextIndex:
        """The text index of the store as it is, kept beside it until the next change."""
        return lexical.TextIndex.kept(self.chunks(), f"{self.path}/text/{'-'.join(map(str, self._segments()[-1:]))}")

    def search(self, request: SearchRequest) -> DataFrame:
        return search(self.chunks(), request, self.index() if request.text else None)

    def search_batch(self, queries: DataFrame, request: SearchRequest) -> DataFrame:
        return search_batch(self.chunks(), queries, request, self.index())

    def health(self) -> dict:
        """Counts, sizes, and whether the rows hold together: ids once and not empty, vectors without nulls."""
        chunks = self.chunks()
        d = C.diagnostics(chunks).first().asDict()
        bad = F.coalesce(F.trim("id") == "", F.lit(True)) | F.col("doc_id").isNull() | F.coalesce(F.exists("embedding", lambda x: x.isNull()), F.lit(False))
        ok = chunks.where(bad).isEmpty() and d["chunk_count"] == chunks.select("id").distinct().count()
        return {"schema_version": VERSION, "chunk_count": d["chunk_count"], "document_count": d["document_count"], "vector_count": d["vector_count"], "vector_bytes": d["bytes_f32"] or 0, "segments": len(self._segments()), "integrity_check_ok": bool(ok)}

    def compact(self, dedupe: bool = True) -> dict:
        """One segment of the chunks as they are, without repeated content where `dedupe`; says what that changed."""
        old, rows, before = self._segments(), self._rows().count(), self.chunks().count()
        kept = C.deduplicated(self.chunks()) if dedupe else self.chunks()
        # numbered anew in the order of the rowids, by ranges
        out = kept.repartitionByRange("rowid").sortWithinPartitions("rowid").withColumns({"seq": F.monotonically_increasing_id(), "op": F.lit("put")})
        n = self._add(out.select(*[c.split()[0] for c in _SEGMENT.split(", ")]))
        jvm = self.spark._jvm
        for k in old:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments/n={k}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        after = self.spark.read.parquet(f"{self.path}/segments/n={n}").count()
        return {"rows_before": rows, "rows_after": after, "deduplicated": before - after, "segments_dropped": len(old)}


class Tools:
    """The store's operations by name, with JSON in and out; an error is an answer like any other."""

    def __init__(self, store: Store):
        self.store = store

    def search(self, query_text=None, query_embedding=None, top_k=None, alpha=None, candidate_limit=None, metadata_filters=None, doc_id=None) -> list:
        given = {"top_k": top_k, "alpha": alpha, "candidate_limit": candidate_limit, "filters": metadata_filters}
        request = SearchRequest(text=query_text, vector=query_embedding, doc_id=doc_id, **{k: v for k, v in given.items() if v is not None})
        return [{**r.asDict(), "metadata": json.loads(r["metadata"] or "null")} for r in self.store.search(request).collect()]

    def ingest(self, chunks=()) -> dict:
        rows = [(c["id"], c["doc_id"], c["content"], json.dumps(c.get("metadata") or {}), [float(x) for x in c["embedding"]] if c.get("embedding") else None, c.get("source")) for c in chunks]
        n = self.store.ingest(self.store.spark.createDataFrame(rows, "id string, doc_id string, content string, metadata string, embedding array<float>, source string")) if rows else 0
        return {"ingested": n, "chunk_count": self.store.chunks().count()}

    def health(self) -> dict:
        return self.store.health()

    def delete_by_metadata(self, key="", value="") -> dict:
        return {"deleted": self.store.delete_by_metadata(key, value)}

    def call(self, name: str, arguments: dict) -> dict:
        tools: dict[str, Callable] = {n: getattr(self, n) for n in SCHEMAS}
        if name not in tools:
            return {"status": "error", "message": f"unknown tool `{name}`"}
        try:
            known = {k: v for k, v in arguments.items() if k in SCHEMAS[name]["properties"]}
            return {"status": "ok", "payload": tools[name](**known)}
        except Exception as e:  # whatever it is, the caller gets it as an answer
            return {"status": "error", "message": str(e).split("\n")[0]}

    def call_json(self, payload: str) -> str:
        """{"tool": name, ..arguments} to {"status": "ok", "payload": ..} or {"status": "error", "message": ..}."""
        try:
            request = json.loads(payload)
            name = request.pop("tool")
        except (ValueError, KeyError, AttributeError, TypeError) as e:
            return json.dumps({"status": "error", "message": f"invalid request json: {e}"})
        return json.dumps(self.call(name, request), indent=2)


_TEXT, _NUMBER, _WHOLE = {"type": "string"}, {"type": "number"}, {"type": "integer"}
SCHEMAS = {
    "search": {"type": "object", "properties": {"query_text": _TEXT, "query_embedding": {"type": "array", "items": _NUMBER}, "top_k": _WHOLE, "alpha": _NUMBER, "candidate_limit": _WHOLE, "metadata_filters": {"type": "object", "additionalProperties": _TEXT}, "doc_id": _TEXT}},
    "ingest": {"type": "object", "required": ["chunks"], "properties": {"chunks": {"type": "array"}}},
    "health": {"type": "object", "properties": {}},
    "delete_by_metadata": {"type": "object", "required": ["key", "value"], "properties": {"key": _TEXT, "value": _TEXT}},
}
_ABOUT = {"search": "Find chunks by text, vector, or both", "ingest": "Put chunks into the store", "health": "Counts and integrity of the store", "delete_by_metadata": "Delete the chunks with a metadata value"}


def manifest() -> list[dict]:
    return [{"name": n, "description": _ABOUT[n], "input_schema": s} for n, s in SCHEMAS.items()]


def temporary(spark: SparkSession, folder: str) -> Store:
    return Store.open(spark, f"{folder}/store-{uuid.uuid4().hex}")
