"""From documents to chunks: the fact table that retrieval, tables and checks work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A chunk's id: its document's id shifted by so many bits, plus its position, which no text can exceed.
POSITION_BITS = 31


def line_chunks(docs: DataFrame) -> DataFrame:
    """One chunk a line: doc_id, owner_id, id (document order), pos, text, element_type, section_path.

    Every tenth line opens a section as its heading; lines with cells are table rows.
    """
    rows = docs.select("doc_id", F.col("source").alias("owner_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    kind = F.when(F.col("pos") % 10 == 0, "heading").when(F.col("text").contains(" | "), "table_row").otherwise("text")
    section = F.floor(F.col("pos") / 10).cast("string")
    path = F.when(kind == "table_row", F.concat(F.lit("S"), section, F.lit(" / T"), section, F.lit(" [row "), (F.col("pos") % 10).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("S"), section))
    return rows.select("doc_id", "owner_id", (F.shiftleft("doc_id", POSITION_BITS) + F.col("pos")).alias("id"), "pos", "text", kind.alias("element_type"), path.alias("section_path"))


#: The same as a common table expression.
SQL = """chunks AS (
  SELECT doc_id, owner_id, doc_id * 2147483648 + pos AS id, pos, text,
         CASE WHEN pos % 10 = 0 THEN 'heading' WHEN contains(text, ' | ') THEN 'table_row' ELSE 'text' END AS element_type,
         CASE WHEN pos % 10 <> 0 AND contains(text, ' | ') THEN 'S' || (pos // 10) || ' / T' || (pos // 10) || ' [row ' || (pos % 10) || ']' ELSE 'S' || (pos // 10) END AS section_path
  FROM (SELECT doc_id, source AS owner_id, unnest(range(len(l))) AS pos, unnest(l) AS text FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)))"""


def pack(paragraphs: Column, limit: int = 1800, keep_all: bool = True, tail: int = 1600) -> Column:
    """Greedy packing of an array of paragraphs to chunks of about `limit` characters, joined by a blank line.

    A joiner counts as one character. keep_all: a paragraph over the limit is a chunk of its own;
    else only its last `tail` characters stay (the lossy form of older indexes).
    """
    over = lambda p: p if keep_all else F.when(F.length(p) > limit, F.substring(p, F.greatest(F.length(p) - (tail - 1), F.lit(1)), F.lit(tail))).otherwise(p)

    def step(state, p):
        fits = F.length(state["open"]) + F.length(p) + 1 <= limit
        grown = F.when(state["open"] == "", p).otherwise(F.concat(state["open"], F.lit("\n\n"), p))
        done = F.when(fits | (state["open"] == ""), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(done.alias("done"), F.when(fits, grown).otherwise(over(p)).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.aggregate(paragraphs, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
