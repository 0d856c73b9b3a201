"""Names of interchangeable parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sparkrag.operators import chunking, search


class Registry:
    """Functions by name; an unknown name tells the known ones."""

    def __init__(self, kind: str, parts: dict[str, Callable] | None = None):
        self.kind, self.parts = kind, dict(parts or {})

    def register(self, name: str, part: Callable) -> None:
        self.parts[name] = part

    def get(self, name: str) -> Callable:
        if name not in self.parts:
            raise KeyError(f"unknown {self.kind} {name}; there are: {', '.join(sorted(self.parts))}")
        return self.parts[name]


chunkers = Registry("chunker", chunking.CHUNKERS)
retrievers = Registry("retriever", {"semantic": search.semantic, "bm25": search.bm25, "hybrid": search.hybrid, "reranked": search.rerank, "expanded": search.expanded})


@udtf(returnType="chunk_index int, content string, heading_path string")
class ChunkText:
    """SQL table function: the chunks of a text."""

    def eval(self, text: str, strategy: str, size: int):
        for i, (path, part) in enumerate(chunking.CHUNKERS[strategy](text or "", size=size)):
            yield i, part, path or None


def register_sql(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", ChunkText)
