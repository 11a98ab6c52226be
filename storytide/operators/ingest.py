"""From fetched documents to a stored corpus: hashes, duplicates, revisions, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import canonical_url
from ..functions.text import chunks, content_hash, near_duplicate_key
from .relational import first_per


def with_keys(documents: DataFrame, body: str = "text", title: str = "title", url: str = "url") -> DataFrame:
    """Adds content_hash (of the body, or of source, address and time where only metadata are kept), near_duplicate_key and canonical_url."""
    address = F.coalesce(canonical_url(F.col(url)), F.col(url))
    meta = F.sha2(F.concat_ws(":", F.col("source"), address, F.col("published").cast("string")), 256)
    return documents.withColumn("canonical_url", address).withColumn("content_hash", F.when(F.coalesce(F.col(body), F.lit("")) == "", meta).otherwise(content_hash(F.col(body)))).withColumn("near_duplicate_key", near_duplicate_key(F.col(title)))


def first_writer(documents: DataFrame, *order: Column) -> DataFrame:
    """One document per content hash, the first in the order."""
    return first_per(documents, ["content_hash"], *order)


def resolve(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming with action and stored id: `skip` where the hash is stored, `revise` (under id:rev:hash8) where the id is
    stored with another hash, `insert` else. Both: document_id, content_hash."""
    seen = stored.select("content_hash").distinct().withColumn("__seen", F.lit(True))
    known = stored.select("document_id").distinct().withColumn("__known", F.lit(True))
    x = incoming.join(seen, "content_hash", "left").join(known, "document_id", "left")
    action = F.when(F.col("__seen"), "skip").when(F.col("__known"), "revise").otherwise("insert")
    return x.select(*incoming.columns, action.alias("action"), F.when(action == "revise", F.concat(F.col("document_id").cast("string"), F.lit(":rev:"), F.substring("content_hash", 1, 8))).otherwise(F.col("document_id").cast("string")).alias("stored_id"))


def chunk_rows(documents: DataFrame, size: int = 8000, overlap: int = 500, text: str = "text") -> DataFrame:
    """document_id, chunk_index, start, content, content_length."""
    rows = documents.select("document_id", F.posexplode(chunks(F.col(text), size, overlap)).alias("chunk_index", "c"))
    return rows.select("document_id", "chunk_index", "c.start", "c.content", F.length("c.content").alias("content_length"))


def repair_texts(chunks_: DataFrame) -> DataFrame:
    """document_id, text: the chunks joined in order."""
    return chunks_.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), "\n\n").alias("text"))


def preview(is_public: Column, delivered: Column, reported: Column) -> Column:
    """Whether a text is only a preview: not public, and under nine tenths of the reported words or none delivered."""
    words = F.size(F.filter(F.split(F.coalesce(delivered, F.lit("")), r"\s+"), lambda w: w != ""))
    return ~is_public & ((words == 0) | (words < 0.9 * reported))
