"""From sections to stored chunks with attributes and embeddings, a document at a time as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia.sources import chunks, versions

CHUNK = "doc_id long, owner_id string, chunk_no int, page int, section_path string, element_type string, text string, attrs map<string,string>, embedding array<float>"
# Attributes of a section that an empty one of a chunk does not take away.
PROTECTED = ["role", "chapter_num"]


def merged_attrs(section: Column, chunk: Column) -> Column:
    """A section's attributes overlaid by those of its chunk; null maps are empty."""
    none = F.create_map().cast("map<string,string>")
    over = F.map_filter(F.coalesce(chunk, none), lambda k, v: ~(k.isin(*PROTECTED) & (F.coalesce(v, F.lit("")) == "")))
    return F.map_concat(F.map_filter(F.coalesce(section, none), lambda k, v: ~F.map_contains_key(over, k)), over)


def chunk_rows(sections: DataFrame, embed: Callable[[Column], Column] | None = None, limit: int = 1800) -> DataFrame:
    """Chunks of sections (doc_id, owner_id, ord, page, section_path, element_type, text, attrs), numbered from 1 in each document.

    Texts are packed by their paragraphs to about `limit` characters; blank ones go. attrs of a part of
    a longer section say which it is. embed gives a vector for each text; one that it has no vector for
    is an error, as rows without vectors would never be found.
    """
    parts = chunks.pack(F.split(F.coalesce("text", F.lit("")), r"\n{2,}"), limit)
    own = F.when(F.size("parts") > 1, F.create_map(F.lit("part"), (F.col("k") + 1).cast("string")))
    rows = sections.withColumn("parts", parts).select("*", F.posexplode("parts").alias("k", "chunk")).where(F.trim("chunk") != "")
    vector = F.lit(None).cast("array<float>")
    if embed is not None:
        made = embed(F.col("chunk")).cast("array<float>")
        vector = F.when(made.isNotNull(), made).otherwise(F.raise_error(F.concat(F.lit("no vector for a chunk of document "), F.col("doc_id").cast("string"))))
    keyed = rows.select("doc_id", "owner_id", F.struct("ord", "k").alias("at"), "page", "section_path", "element_type", F.col("chunk").alias("text"), merged_attrs(F.col("attrs"), own).alias("attrs"), vector.alias("embedding"))
    # a document's places are counted over its sections' sizes, so that no window holds its texts
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    places = keyed.select("doc_id", "at").withColumn("chunk_no", place)
    found = keyed.join(places, ["doc_id", "at"]).drop("at")
    return found.select(*[F.col(f.split()[0]) for f in CHUNK.split(", ")])


class ChunkStore:
    """The chunks of all documents behind a pointer; a document's chunks are replaced as a whole."""

    def __init__(self, spark: SparkSession, where: str, buckets: int = 64):
        self.table = versions.Table(spark, where, CHUNK, ["doc_id"], buckets)

    @staticmethod
    def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)

    def index(self, sections: DataFrame, embed: Callable[[Column], Column] | None = None, writer: str | None = None, batch: int | None = None) -> int:
        """Stores the chunks of the documents that sections has, in place of what was stored of them; the version after that. A writer's batch counts once."""
        return self.table.apply(chunk_rows(sections, embed), self._replaced, writer, batch)

    def stream(self, sections: DataFrame, name: str, checkpoint: str, embed: Callable[[Column], Column] | None = None):
        """A writer (to be started) that indexes the batches of a stream of sections; all sections of a document come in one batch."""
        return sections.writeStream.foreachBatch(lambda rows, batch: self.index(rows, embed, name, batch)).option("checkpointLocation", checkpoint)

    def delete(self, docs: DataFrame) -> int:
        """Takes the chunks of documents (doc_id) out."""
        return self.table.apply(docs.select("doc_id"), lambda old, new: old.join(new, "doc_id", "left_anti"))

    def read(self) -> DataFrame:
        return self.table.read()
